"""A bounded sample of rows for fitting a model: the same rows in every run, from all over a table."""

from __future__ import annotations

from hashlib import blake2b

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from millrace.sources import read_table

#: Files that a sample is taken from, those of least hash: a sample doesn't read a whole table.
FILES = 4


def sample_files(spark: SparkSession, sf_dir: str, table: str, *columns: str, files: int = FILES) -> DataFrame:
    """The rows of at most ``files`` of the table's files, picked by the hash of their names."""
    df = read_table(spark, sf_dir, table, *columns)
    names = sorted(df.inputFiles(), key=lambda f: blake2b(f.rsplit("/", 1)[-1].encode(), digest_size=8).digest())
    return df if len(names) <= files else spark.read.schema(df.schema).parquet(*names[:files])


def least_hashes(df: DataFrame, key: Column, bound: int, wanted: Column | None = None, share: float = 1.0) -> list[Row]:
    """At most ``bound`` rows of ``df`` that are ``wanted``, those whose key has the least hash; only about so many reach the driver.

    ``share`` is about how many of the rows are wanted: with fewer than that, fewer than ``bound`` rows come.
    The condition is tested on the rows of least hash only, so counting needs no column of the table.
    """
    h, n = F.xxhash64(key), df.count()
    part = min(1.0, (1.2 * bound / n + 100 / n) / share) if n else 1.0
    if part < 1.0:
        df = df.where(h <= F.lit(int(-(2**63) + part * (2**64 - 1))))
    rows = (df if wanted is None else df.where(wanted)).withColumn("__hash", h)
    # The hashes alone tell how far the sample goes, so that no more rows than it has are fetched.
    least = sorted(r[0] for r in rows.select("__hash").collect())[:bound]
    return sorted(rows.where(F.col("__hash") <= least[-1]).collect(), key=lambda r: r["__hash"])[:bound] if least else []
