"""A paged interface's recorded answers as a table: a Python data source that follows the cursors.

An answer is a JSON file ``{"results": [...], "has_more": bool, "next_cursor": str}``; that of the first
page is called ``start.json``, those behind a cursor ``<cursor>.json``. A folder is one listing (a
database, or the children of a page) and one partition of the table, so listings are read in parallel
and each is walked in its order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "listing string, position int, object string"


class Listing(InputPartition):
    def __init__(self, folder: str):
        self.folder = folder


class PagedReader(DataSourceReader):
    def __init__(self, options):
        path = options["path"]
        self.uri = path if urlsplit(path).scheme else f"file://{path}"
        self.follow = options.get("follow", "true") == "true"

    def partitions(self):
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(self.uri)
        found = system.get_file_info(fs.FileSelector(top, allow_not_found=True))
        return [Listing(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.Directory] or [Listing("")]

    def read(self, partition: Listing) -> Iterator[tuple]:
        from pyarrow import fs

        if not partition.folder:  # an empty source
            return
        system, _ = fs.FileSystem.from_uri(self.uri)
        cursor, at, seen = "start", 0, set()
        while cursor and cursor not in seen:
            seen.add(cursor)
            with system.open_input_file(f"{partition.folder}/{cursor}.json") as f:
                page = json.loads(f.readall())
            for thing in page.get("results", []):
                yield partition.folder.rpartition("/")[2], at, json.dumps(thing, ensure_ascii=False)
                at += 1
            cursor = page.get("next_cursor") if self.follow and page.get("has_more") else None


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


def read_paged(spark: SparkSession, path: str, follow: bool = True) -> DataFrame:
    """(listing, position, object): the objects of all listings below ``path``; ``follow`` off reads first pages only."""
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged_json").option("follow", str(follow).lower()).load(path)
