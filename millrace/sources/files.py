"""Markdown and HTML files as tables: trees, targets, slugs, front matter."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import blank, split_front_matter

#: Folders that a walk leaves out.
IGNORED = ("node_modules", ".git", "dist", ".astro", "tests/fixtures")


def whole_files(spark: SparkSession, paths: str | list[str], glob: str) -> DataFrame:
    """(path, value): one row per file below ``paths`` whose name matches ``glob``; no file gives no rows."""
    try:
        files = spark.read.text(paths, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    except AnalysisException:
        return spark.createDataFrame([], "path string, value string")
    return files.select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/").alias("path"), "value")


def markdown_files(spark: SparkSession, root: str, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """Markdown files below ``root`` outside ignored folders."""
    files = whole_files(spark, root, "*.md")
    for name in ignored:
        files = files.where(~F.col("path").contains(f"/{name}/"))
    return files


def targets(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """Markdown files of the given files and folders below ``root``; none given means everything."""
    if not names:
        return markdown_files(spark, root)
    return whole_files(spark, [str(PurePosixPath(root) / n) for n in names], "*.md")


def source_files(spark: SparkSession, root: str, suffixes: tuple[str, ...]) -> DataFrame:
    """Files by suffix, without tests and ignored folders."""
    files = whole_files(spark, root, "*{" + ",".join(suffixes) + "}")
    for name in IGNORED:
        files = files.where(~F.col("path").contains(f"/{name}/"))
    return files.where(~F.col("path").rlike(r"\.(test|spec)\."))


def by_slug(files: DataFrame, slug: str) -> DataFrame:
    """Files whose name without ``.md`` is ``slug``."""
    return files.where(F.regexp_extract("path", r"([^/]+)\.md$", 1) == slug)


def with_front_matter(files: DataFrame) -> DataFrame:
    """Files with ``frontmatter`` and ``body``."""
    return files.withColumn("parts", split_front_matter(F.col("value"))).select("path", "parts.frontmatter", "parts.body")


def html_file(spark: SparkSession, path: str) -> DataFrame:
    """The one HTML file at ``path``; a missing or blank file raises ValueError."""
    files = whole_files(spark, path, "*")
    if files.where(~blank(F.col("value"))).isEmpty():
        raise ValueError(f"no HTML in {path}")
    return files


def snapshot_allowed_for(provider: Column) -> Column:
    """``snapshot_allowed`` of a column of providers."""
    return provider == "zhihu"


def snapshot_allowed(provider: str) -> bool:
    """Whether pages of this provider may come from a saved file."""
    return provider == "zhihu"
