"""Using all cores where a small table comes in fewer pieces than there are cores."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: A scan in at least this share of the cores is left as it is: its splits are as good as one a core.
ENOUGH = 0.75


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as the cluster has cores, for Python work on its rows, if it has far fewer.

    A scan cuts its files so that there is a split for each core, down to spark.sql.files.openCostInBytes
    (4 MB). Fewer splits than that come from a table smaller than 4 MB a core, or one whose few files
    can't be split; only such a table is shuffled here, any larger one is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= ENOUGH * cores else df.repartition(cores)
