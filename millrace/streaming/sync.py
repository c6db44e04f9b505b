"""The incremental operators as streams: versions merged by micro-batch, and log windows."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.sync import upsert
from millrace.plans.storage import file_system, hadoop_path, scratch_path
from millrace.sources import read_table


#: Buckets of a table by the hash of its key; a micro-batch rewrites those that its keys fall into.
BUCKETS = 64


def latest_versions(rows: DataFrame, key: str = "slug", version: str = "updated") -> DataFrame:
    """The last version of each key in a batch: an aggregate, so a hot key is combined before the shuffle."""
    others = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max(F.struct(F.col(version).alias("__v"), F.struct(*others).alias("__row"))).alias("__last"))
    return last.select(*(F.col(key) if c == key else F.col(f"__last.__row.{c}").alias(c) for c in rows.columns))


def _manifests(spark: SparkSession, table: str) -> dict[int, str]:
    """Paths of the manifests by batch."""
    folder = f"{table}/_manifests"
    fs = file_system(spark, folder)
    if not fs.exists(hadoop_path(spark, folder)):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(hadoop_path(spark, folder))]
    return {int(n.partition(".")[0]): f"{folder}/{n}" for n in names if n.endswith(".json")}


def _manifest(spark: SparkSession, table: str, before: int | None = None) -> dict[int, int]:
    """Generation of each bucket after the last batch, or the last one below ``before``."""
    found = _manifests(spark, table)
    usable = [b for b in found if before is None or b < before]
    if not usable:
        return {}
    text = spark.read.text(found[max(usable)], wholetext=True).first()[0]
    return {int(b): g for b, g in json.loads(text).items()}


def _write_manifest(spark: SparkSession, table: str, batch_id: int, buckets: dict[int, int]) -> None:
    path = f"{table}/_manifests/{batch_id}.json"
    out = file_system(spark, path).create(hadoop_path(spark, path), True)
    try:
        out.write(bytearray(json.dumps(buckets), "utf-8"))
    finally:
        out.close()


def _read_buckets(spark: SparkSession, table: str, buckets: dict[int, int]) -> DataFrame | None:
    paths = [f"{table}/generation={g}/bucket={b}" for b, g in sorted(buckets.items())]
    return spark.read.parquet(*paths) if paths else None


def upsert_stream(incoming: DataFrame, table: str, checkpoint: str, key: str = "slug", version: str = "updated") -> StreamingQuery:
    """Merge a stream of rows into the table folder ``table``, all available rows and then stop.

    The table is in BUCKETS buckets by its key. A micro-batch reads and rewrites the buckets that its keys
    fall into, as ``generation=<batch id>``, and then writes a manifest that names the generation of every
    bucket: readers see a batch whole or not at all, and one that runs again after a failure starts from the
    manifest before it. Generations that neither that manifest nor the new one names are deleted, so the
    folder holds about twice the table. Equality of the version decides, so late rows need no watermark.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        news = latest_versions(batch, key, version).withColumn("bucket", bucket).persist()
        try:
            touched = sorted(r["bucket"] for r in news.select("bucket").distinct().collect())  # BUCKETS rows at most
            if not touched:
                return
            base = _manifest(spark, table, batch_id)
            before = _read_buckets(spark, table, {b: base[b] for b in touched if b in base})
            merged = news.drop("bucket") if before is None else upsert(before, news.drop("bucket"), key, version).drop("action")
            merged.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/generation={batch_id}")
            now = base | dict.fromkeys(touched, batch_id)
            _write_manifest(spark, table, batch_id, now)
            _drop_superseded(spark, table, batch_id, base, now)
        finally:
            news.unpersist()

    return incoming.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _drop_superseded(spark: SparkSession, table: str, batch_id: int, base: dict[int, int], now: dict[int, int]) -> None:
    """Delete the buckets, generations and manifests that are older than the batch before."""
    fs = file_system(spark, table)
    named = set(base.items()) | set(now.items())
    for status in fs.listStatus(hadoop_path(spark, table)):
        name = status.getPath().getName()
        if not name.startswith("generation="):
            continue
        g = int(name.partition("=")[2])
        inside = [b.getPath() for b in fs.listStatus(status.getPath()) if b.getPath().getName().startswith("bucket=")]
        stale = [b for b in inside if (int(b.getName().partition("=")[2]), g) not in named]
        if len(stale) == len(inside) and g != batch_id:
            fs.delete(status.getPath(), True)
        else:
            for b in stale:
                fs.delete(b, True)
    found = sorted(b for b in _manifests(spark, table) if b < batch_id)
    for b in found[:-1]:
        fs.delete(hadoop_path(spark, f"{table}/_manifests/{b}.json"), False)


def current_generation(spark: SparkSession, table: str, before: int | None = None) -> DataFrame | None:
    """The table as of the last batch, or the last one below ``before``; None without any."""
    return _read_buckets(spark, table, _manifest(spark, table, before))


def log_counts(logs: DataFrame, delay: str | None = None, size: str = "1 hour") -> DataFrame:
    """Entries by hour and level of a stream of log rows; re-delivered ids count once.

    Every row counts, however late; the state keeps all ids and hours for that. A ``delay`` bounds the
    state: rows later than it are dropped, and ids count once within it. The progress of the query has
    the number of dropped rows (``stateOperators``, ``numRowsDroppedByWatermark``). Append output needs a delay.
    """
    at = logs.withColumn("at", F.col("ts").try_cast("timestamp")).where(F.col("at").isNotNull())
    once = at.withWatermark("at", delay).dropDuplicatesWithinWatermark(["log_id"]) if delay else at.dropDuplicates(["log_id"])
    return once.groupBy(F.window("at", size), F.lower(F.coalesce("level", F.lit("info"))).alias("level")).agg(F.count("*").alias("n"))


def wait(query: StreamingQuery, seconds: float = 120) -> None:
    """Wait for a query that ends by itself; an error in it is raised here."""
    until = time.time() + seconds
    while query.isActive and time.time() < until:
        query.awaitTermination(1)
    if query.exception():
        raise query.exception()


def table_stream(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the data directory as a stream of files."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(read_table(spark, sf_dir, name).schema)
    one_file = file_system(spark, path).getFileStatus(hadoop_path(spark, path)).isFile()
    stream = reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if one_file else reader.parquet(path)
    return stream.select(*columns)


def _upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posts' versions, streamed into a table: its slugs and their versions."""
    table = scratch_path(spark, "upsert-stream")
    posts = table_stream(spark, sf_dir, "post", "slug", "title", "date", "updated", "tags").where(F.col("slug").isNotNull())
    wait(upsert_stream(posts, table, f"{table}-checkpoint"), 3600)
    return current_generation(spark, table).select("slug", "updated")


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log entries by hour and level, from a stream: the last complete result, written by the executors."""
    path = scratch_path(spark, "log-stream")
    counts = log_counts(table_stream(spark, sf_dir, "log_entry", "log_id", "ts", "level"))
    write = lambda batch, _: batch.select(F.col("window.start").alias("hour"), "level", "n").write.mode("overwrite").parquet(path)
    wait(counts.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start(), 3600)
    return spark.read.schema("hour timestamp, level string, n long").parquet(path)


QUERIES = {"stream_upsert": _upserted, "stream_log_counts": _counted}
ORACLE = {
    "stream_upsert": "select slug, max(updated) as updated from post where slug is not null group by slug",
    "stream_log_counts": "select date_trunc('hour', moment) as hour, level, count(*) as n from (select distinct on (log_id) log_id, try_cast(ts as timestamptz) as moment, lower(coalesce(level, 'info')) as level from log_entry where try_cast(ts as timestamptz) is not null) group by all",
}
