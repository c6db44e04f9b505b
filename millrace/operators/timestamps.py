"""Normalising timestamp strings through a dictionary of distinct values.

The same raw strings occur again and again, so each (raw string, zone, date order) is parsed once:
distinct triples are collected by a partial and a final aggregate, those that the persisted
dictionary lacks are parsed and appended to it, and the instants are joined back to the rows. The
join is an equi-join on the triple; rows that share a hot value are spread by AQE's skew join, since
the dictionary side has one row for a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.instants import parse_instant
from millrace.plans.storage import file_system, hadoop_path, scratch_path
from millrace.sources import read_table

KEYS = ("raw", "tz", "date_order")
DICTIONARY_SCHEMA = "raw string, tz string, date_order string, micros long"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf = pdf.astype(object).where(pdf.notna(), None)
        micros = [parse_instant(*x) for x in zip(pdf["raw"], pdf["tz"], pdf["date_order"], strict=True)]
        yield pdf.assign(micros=pd.array(micros, dtype="Int64"))


def _same(left: DataFrame, right: DataFrame) -> Column:
    """Equal in all keys; a null zone or order equals a null one."""
    condition = F.lit(True)
    for k in KEYS:
        condition &= left[k].eqNullSafe(right[k])
    return condition


class InstantDictionary:
    """The table of distinct raw values at ``path``; a missing table is an empty one.

    ``extend`` is incremental: it parses only triples that aren't in the table and appends them in one
    commit, so a key is there once and nothing is deduplicated when it is read. One job at a time may
    extend a dictionary; a task that runs twice commits its rows once.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "instants")

    def exists(self) -> bool:
        return file_system(self.spark, self.path).exists(hadoop_path(self.spark, self.path))

    def read(self) -> DataFrame:
        if not self.exists():
            return self.spark.createDataFrame([], DICTIONARY_SCHEMA)
        return self.spark.read.schema(DICTIONARY_SCHEMA).parquet(self.path)

    def extend(self, values: DataFrame) -> DataFrame:
        """Parse what is new in ``values`` (columns raw, tz, date_order) and return the whole dictionary."""
        distinct = values.select(*KEYS).where(F.col("raw").isNotNull()).distinct()
        if self.exists():
            known = self.read()
            distinct = distinct.join(known, _same(distinct, known), "left_anti")
        distinct.mapInPandas(_parse, DICTIONARY_SCHEMA).write.mode("append").parquet(self.path)
        return self.read()


def session_dictionary(spark: SparkSession) -> InstantDictionary:
    """The dictionary in spark.millrace.instants, which lasts from run to run; a fresh one where that isn't set."""
    return InstantDictionary(spark, spark.conf.get("spark.millrace.instants", None))


def normalise_timestamps(df: DataFrame, column: str, tz: str, date_order: str, output: str = "instant", dictionary: InstantDictionary | None = None) -> DataFrame:
    """``df`` with ``output``: the UTC timestamp that the string in ``column`` denotes, else null.

    ``tz`` and ``date_order`` name the columns with the row's IANA zone and number order. Every row
    stays; null, blank and impossible values give null, as do zoneless values of rows without a
    zone. An empty table gives an empty one. Columns called like the dictionary's own keep their
    values, as the dictionary's are renamed before the join.
    """
    dictionary = dictionary or session_dictionary(df.sparkSession)
    parsed = dictionary.extend(df.select(F.col(column).alias("raw"), F.col(tz).alias("tz"), F.col(date_order).alias("date_order")))
    renamed = parsed.select(*(F.col(c).alias(f"__instant_{c}") for c in (*KEYS, "micros")))
    keys = dict(zip(KEYS, (column, tz, date_order), strict=True))
    condition = F.lit(True)
    for k, c in keys.items():
        condition &= df[c].eqNullSafe(renamed[f"__instant_{k}"])
    value = F.timestamp_micros("__instant_micros").alias(output)
    return df.join(renamed, condition, "left").select(*(df[c] for c in df.columns if c != output), value)


def timestamp_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per timestamp string of the articles and pages, with its site's zone and order.

    The site table is fixed (48 rows), which bounds the broadcast; beyond the session's broadcast
    threshold Catalyst joins it by shuffle, as no hint forces it.
    """
    article = read_table(spark, sf_dir, "article", "article_id", "publishedAt", "updatedAt", "site")
    page = read_table(spark, sf_dir, "extracted_article", "page_id", "published", "site")
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("raw")) for f in ("publishedAt", "updatedAt")))
    rows = article.select(F.lit("article").alias("tbl"), F.col("article_id").alias("row_id"), "site", F.explode(fields).alias("f")).select("tbl", "row_id", "f.field", "f.raw", "site")
    rows = rows.unionByName(page.select(F.lit("extracted_article").alias("tbl"), F.col("page_id").alias("row_id"), F.lit("published").alias("field"), F.col("published").alias("raw"), "site"))
    site = read_table(spark, sf_dir, "site", "site", "tz", "date_order").dropDuplicates(["site"])
    return rows.where(F.col("raw").isNotNull()).join(site, "site", "left")


def iso_micros(instant: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS.ffffffZ`` of a timestamp, whatever the session's zone."""
    utc = F.to_utc_timestamp(instant, F.current_timezone())
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every timestamp string that denotes a moment, with its UTC instant."""
    values = normalise_timestamps(timestamp_values(spark, sf_dir), "raw", "tz", "date_order")
    return values.where(F.col("instant").isNotNull()).select("tbl", "row_id", "field", iso_micros(F.col("instant")).alias("utc"))


def p4_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values and readable values per table and field and UTC day."""
    values = normalise_timestamps(timestamp_values(spark, sf_dir), "raw", "tz", "date_order")
    return values.groupBy("tbl", "field", F.to_date("instant").alias("day")).agg(F.count("*").alias("n_values"))


QUERIES = {"p4_found": p4_found, "p4_by_day": p4_by_day}
ORACLE: dict[str, str] = {}
