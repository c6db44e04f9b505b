"""Queries of the sync operators over tables with the cases that the dealt ones lack."""

import datetime

from compare import database, sorted_rows
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.sync import QUERIES, upsert

WHOLE_SPANS = """with l as (select distinct on (log_id) log_id, try_cast(ts as timestamptz) as moment, runId, event from log_entry),
d as (select * from l where event = 'fetch.done' and moment is not null), s as (select * from l where event = 'fetch.start' and moment is not null)
select d.log_id, cast(trunc((epoch_us(d.moment) - epoch_us(max(s.moment))) / 1000.0) as bigint) as span_ms
from d join s on d.runId = s.runId and (s.moment, s.log_id) < (d.moment, d.log_id) group by d.log_id, d.moment"""


def test_spans_cross_hours(spark, tmp_path):
    rows = [
        (1, "2024-01-01T00:10:00Z", "a", "fetch.start"),
        (2, "2024-01-01T00:50:00Z", "a", "fetch.start"),
        (3, "2024-01-01T01:10:00Z", "a", "fetch.done"),
        (3, "2024-01-01T01:10:00Z", "a", "fetch.done"),
        (4, "2024-01-01T05:00:00Z", "a", "fetch.done"),
        (5, "2024-01-01T05:20:00Z", "a", "fetch.start"),
        (6, "2024-01-01T05:20:01Z", "a", "fetch.done"),
        (7, "2024-01-01T00:40:00Z", "b", "fetch.done"),
        (8, "2024-01-01T00:45:00Z", "b", "fetch.start"),
        (9, "2024-01-01T01:00:00Z", None, "fetch.done"),
        (10, "bad", "a", "fetch.done"),
    ]
    spark.createDataFrame(rows, "log_id long, ts string, runId string, event string").write.parquet(f"{tmp_path}/log_entry.parquet")
    got = {r["log_id"]: r["span_ms"] for r in QUERIES["log_spans"](spark, str(tmp_path)).collect()}
    assert got == {3: 20 * 60_000, 4: 250 * 60_000, 6: 1000}


def test_spans_of_the_dealt_log(spark, data):
    df = QUERIES["log_spans"](spark, data)
    relation = database(data).sql(WHOLE_SPANS)
    assert sorted_rows(df.columns, df.collect()) == sorted_rows(relation.columns, relation.fetchall())


def test_every_version_is_merged(spark, tmp_path):
    at = lambda d: datetime.datetime(2024, 1, d, tzinfo=datetime.UTC)
    rows = [
        ("a", "1", "A1", None, at(1), ["x"]),
        ("a", "1", "A2", at(2), at(2), ["y", "x"]),
        ("a", "1", "A3", at(3), at(3), None),
        ("a", "1", "A4", None, at(4), ["z", "y"]),
        ("b", "1", "B1", at(5), at(5), ["x"]),
        ("b", "1", "B2", at(6), at(6), ["y"]),
        ("b", "2", "again", at(7), at(6), ["no"]),
        ("c", "1", "C1", at(1), None, None),
        ("c", "2", "again", at(2), None, ["no"]),
        ("c", "3", "C3", at(3), at(1), ["q"]),
        ("d", "1", "D1", at(1), None, ["x"]),
        ("d", "2", "again", None, None, ["no"]),
        ("d", "3", "again", None, None, ["no"]),
        ("e", "1", "E1", at(1), at(1), ["x", "x"]),
    ]
    schema = "slug string, id string, title string, date timestamp, updated timestamp, tags array<string>"
    posts = spark.createDataFrame(rows, schema)
    posts.write.parquet(f"{tmp_path}/post.parquet")
    df = QUERIES["incremental_upsert"](spark, str(tmp_path))
    got = {r["slug"]: (r["title"], r["date"] and r["date"].day, r["updated"] and r["updated"].day, r["tags"], r["action"]) for r in df.collect()}
    assert got == {
        "a": ("A4", 2, 4, "x|y|z", "replaced"),
        "b": ("B2", 5, 6, "x|y", "replaced"),
        "c": ("C3", 1, 1, "q", "replaced"),
        "d": ("D1", 1, None, "x", "unchanged"),
        "e": ("E1", 1, 1, "x|x", "kept"),
    }
    # The same by one upsert after another.
    nth = posts.withColumn("n", F.row_number().over(Window.partitionBy("slug").orderBy(F.asc_nulls_first("updated"), "id")))
    merged = nth.where("n = 1").drop("n", "id")
    for n in (2, 3, 4):
        merged = upsert(merged, nth.where(f"n = {n}").drop("n", "id")).drop("action")
    one_by_one = merged.withColumn("tags", F.array_join("tags", "|"))
    columns = sorted(one_by_one.columns)
    assert sorted_rows(columns, one_by_one.select(*columns).collect()) == sorted_rows(columns, df.select(*columns).collect())
