"""Reading the Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.plans.shipping import ship


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Table ``name`` below ``sf_dir`` (a file or a directory of files), narrowed to ``columns``.

    The narrowing is a plain projection, so it reaches the scan as its ReadSchema.
    """
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df
