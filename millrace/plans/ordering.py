"""A global order without a global task: range partitions, numbered and offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.plans.storage import materialise


def numbered(df: DataFrame, order: list[Column], output: str) -> DataFrame:
    """``df`` with a column ``output``: the 1-based position of each row in ``order``.

    Rows are range-partitioned by the order and written, so the partitions counted are those numbered;
    each partition is sorted by itself and shifted by the rows in front of it. One row per partition
    comes to the driver. ``order`` should be total; ties are numbered arbitrarily but once.
    """
    spark = df.sparkSession
    ranged = materialise(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ordered")
    counts = {r["__part"]: r["c"] for r in ranged.groupBy("__part").agg(F.count("*").alias("c")).collect()}
    ahead, offsets = 0, []
    for part in sorted(counts):
        offsets.append((part, ahead))
        ahead += counts[part]
    shift = spark.createDataFrame(offsets, "__part int, __ahead long")
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.join(F.broadcast(shift), "__part").withColumn(output, (F.col("__ahead") + inside).cast("long")).drop("__part", "__ahead")


def with_neighbours(df: DataFrame, order: list[Column], column: str, before: str, after: str) -> DataFrame:
    """``df`` with ``column`` of the row in front and of the row behind.

    Rows are range-partitioned and written; within a partition they see each other through a window, and
    across its borders through the first and last row of the partitions beside it, one row a partition.
    """
    spark = df.sparkSession
    ranged = materialise(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ordered")
    inside = Window.partitionBy("__part").orderBy(*order)
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ranged.select("__part", F.first(column).over(whole).alias("first"), F.last(column).over(whole).alias("last")).distinct().orderBy("__part").collect()
    borders = [(r["__part"], ends[i - 1]["last"] if i else None, ends[i + 1]["first"] if i + 1 < len(ends) else None) for i, r in enumerate(ends)]
    beside = spark.createDataFrame(borders, ranged.select("__part", F.col(column).alias("__front"), F.col(column).alias("__behind")).schema)
    n, size = F.row_number().over(inside), F.count(F.lit(1)).over(Window.partitionBy("__part"))
    # The value itself may be null, so the border is told by the position.
    seen = ranged.select("*", F.lag(column).over(inside).alias("__lag"), F.lead(column).over(inside).alias("__lead"), (n == 1).alias("__top"), (n == size).alias("__end"))
    out = seen.join(F.broadcast(beside), "__part")
    front, behind = F.when(F.col("__top"), F.col("__front")).otherwise(F.col("__lag")), F.when(F.col("__end"), F.col("__behind")).otherwise(F.col("__lead"))
    return out.select(*df.columns, front.alias(before), behind.alias(after))
