"""One file per row, written by the workers to any file system that the cluster shares."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_files(df: DataFrame, root: str, path: Column, content: Column) -> DataFrame:
    """Write ``content`` of each row to ``root/path``; returns (path, n_bytes) of what was written.

    A file is written under a name of its task's and then moved, so a task that runs twice leaves one whole
    file. Rows without a path are left out; null content is the empty text. Of rows with one path any wins.
    The result is what the writing yields: it is lazy, and must be run once.
    """
    base = root if urlsplit(root).scheme else f"file://{root}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        system, top = fs.FileSystem.from_uri(base)
        task = f"{TaskContext.get().partitionId()}-{TaskContext.get().attemptNumber()}"
        made: set[str] = set()
        for pdf in batches:
            sizes = []
            for name, text in zip(pdf["path"], pdf["content"], strict=True):
                target = f"{top}/{name}"
                folder = target.rpartition("/")[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                data = (text if isinstance(text, str) else "").encode("utf-8", "surrogatepass")
                hidden = f"{folder}/_{task}-{quote(name.rpartition('/')[2])[:60]}"
                with system.open_output_stream(hidden) as out:
                    out.write(data)
                system.move(hidden, target)
                sizes.append(len(data))
            yield pd.DataFrame({"path": pdf["path"], "n_bytes": sizes})

    narrow = df.select(path.alias("path"), content.alias("content")).where(F.col("path").isNotNull())
    return narrow.mapInPandas(run, "path string, n_bytes long")
