"""Writing results: Markdown files, changed rows, upserts, deletions, log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.sync import upsert

#: More matching folders than this stop a deletion.
MOST_DELETED = 20


def write_markdown(df: DataFrame, path: str, slug: str, body: str, overwrite: bool = False, dry_run: bool = False) -> DataFrame:
    """One text file per row below ``path``, in a folder per slug; returns what is (or would be) written.

    Existing output is an error unless ``overwrite``; a dry run writes nothing.
    """
    out = df.where(F.col(slug).isNotNull()).select(F.col(slug).alias("slug"), F.coalesce(F.col(body), F.lit("")).alias("value"))
    if not dry_run:
        out.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("slug").text(path)
    return out


def changed_only(df: DataFrame, new: str, old: str) -> DataFrame:
    """Rows whose new value differs from the old one; null equals null."""
    return df.where(~F.col(new).eqNullSafe(F.col(old)))


def write_upserted(current: DataFrame, incoming: DataFrame, path: str) -> DataFrame:
    """Merge and write as a new table at ``path``, never over the one that is read; returns counts by action."""
    merged = upsert(current, incoming)
    merged.write.mode("errorifexists").parquet(path)
    return current.sparkSession.read.parquet(path).groupBy("action").agg(F.count("*").alias("n"))


def delete_articles(files: DataFrame, slug: str, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(kept, deleted): files in folders called ``slug`` or ``slug-*``, or named so; too many are an error."""
    folder = F.regexp_extract(path, r"([^/]+)/[^/]*$", 1)
    name = F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)
    hit = (folder == slug) | folder.startswith(f"{slug}-") | (name == slug)
    deleted = files.where(hit)
    if deleted.select(folder).distinct().limit(MOST_DELETED + 1).count() > MOST_DELETED:
        raise ValueError(f"more than {MOST_DELETED} folders match {slug}")
    return files.where(~hit), deleted


def write_log_lines(lines: DataFrame, path: str) -> None:
    """Append redacted JSON lines (column ``line``)."""
    lines.select(F.col("line").alias("value")).write.mode("append").text(path)


def report_lines(df: DataFrame, key: str) -> DataFrame:
    """(key, line): each row as a line of a Markdown table, made in the executors; ``key`` orders the lines."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    return df.select(key, F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def report(counts: DataFrame, title: str) -> str:
    """An aggregate as a Markdown table, whole; for results that fit the driver, else write ``report_lines``."""
    head = "| " + " | ".join(counts.columns) + " |\n|" + "---|" * len(counts.columns)
    return f"# {title}\n\n{head}\n" + "\n".join("| " + " | ".join(str(v) for v in r) + " |" for r in counts.toLocalIterator()) + "\n"
