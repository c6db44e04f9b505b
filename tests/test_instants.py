from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.functions.instants import parse_instant
from millrace.operators.timestamps import InstantDictionary, iso_micros, normalise_timestamps, p4_found

SHANGHAI, NEW_YORK, PARIS, SYDNEY = "Asia/Shanghai", "America/New_York", "Europe/Paris", "Australia/Sydney"


def iso(raw, tz=SHANGHAI, order="ymd"):
    micros = parse_instant(raw, tz, order)
    return None if micros is None else (datetime(1970, 1, 1) + timedelta(microseconds=micros)).isoformat(timespec="microseconds")


@pytest.mark.parametrize(
    ("raw", "tz", "order", "expected"),
    [
        ("2024-01-02T03:04:05Z", SHANGHAI, "ymd", "2024-01-02T03:04:05.000000"),
        ("2024-01-02", SHANGHAI, "ymd", "2024-01-01T16:00:00.000000"),
        ("2024-01-02T03:04:05.123456+05:30", SHANGHAI, "ymd", "2024-01-01T21:34:05.123456"),
        ("2024-01-02T03:04+08", SHANGHAI, "ymd", "2024-01-01T19:04:00.000000"),
        ("03/04/2024 10:00", NEW_YORK, "mdy", "2024-03-04T15:00:00.000000"),
        ("03/04/2024 10:00", PARIS, "dmy", "2024-04-03T08:00:00.000000"),
        ("13/14/2024", PARIS, "dmy", None),
        ("1700000000", PARIS, "dmy", "2023-11-14T22:13:20.000000"),
        ("1700000000123", PARIS, "dmy", "2023-11-14T22:13:20.123000"),
        ("1700000000123456", PARIS, "dmy", "2023-11-14T22:13:20.123456"),
        ("2024年4月14日 下午6:16", SHANGHAI, "ymd", "2024-04-14T10:16:00.000000"),
        ("2024年4月14日 上午12:16", SHANGHAI, "ymd", "2024-04-13T16:16:00.000000"),
        ("17 de abril de 2023", "Europe/Madrid", "dmy", "2023-04-16T22:00:00.000000"),
        ("16 août 2025, 21:15", PARIS, "dmy", "2025-08-16T19:15:00.000000"),
        ("3. März 2024, 08:00", "Europe/Berlin", "dmy", "2024-03-03T07:00:00.000000"),
        ("June 15, 2025 8:13 AM", NEW_YORK, "mdy", "2025-06-15T12:13:00.000000"),
        ("Mon, 06 May 2024 10:10:50 +0800", SHANGHAI, "ymd", "2024-05-06T02:10:50.000000"),
        ("Mon Aug 05 2019 15:09:03 GMT+0800 (site local time)", SHANGHAI, "ymd", "2019-08-05T07:09:03.000000"),
        ("2024-04-04 10:00 UTC-4", NEW_YORK, "mdy", "2024-04-04T14:00:00.000000"),
        ("2025-02-26 08:15:54 CST", SHANGHAI, "ymd", "2025-02-26T00:15:54.000000"),
        ("2025-02-26 08:15:54 CST", "America/Chicago", "mdy", "2025-02-26T14:15:54.000000"),
        # the hour that occurs twice is the earlier one, the one that is skipped is read with the old offset
        ("2024-11-03 01:30", NEW_YORK, "mdy", "2024-11-03T05:30:00.000000"),
        ("2024-11-03 01:30 EST", NEW_YORK, "mdy", "2024-11-03T06:30:00.000000"),
        ("2024-03-10 02:30", NEW_YORK, "mdy", "2024-03-10T07:30:00.000000"),
        ("20250830T031034Z", PARIS, "dmy", "2025-08-30T03:10:34.000000"),
        ("２０２４-０１-０２", "UTC", "ymd", "2024-01-02T00:00:00.000000"),
    ],
)
def test_forms(raw, tz, order, expected):
    assert iso(raw, tz, order) == expected
    assert iso(f"  {raw} ", tz, order) == expected


@pytest.mark.parametrize("raw", [None, "", " ", "yesterday", "TBD", "n/a", "--", "0000-00-00", "2023-02-30", "2022-13-05", "2020-06-11T27:75:00", "2024-01-02T10:00 XYZ", "9" * 20])
def test_no_moment(raw):
    assert iso(raw) is None


@settings(max_examples=300, deadline=None)
@given(st.datetimes(datetime(1980, 1, 1), datetime(2037, 12, 31)), st.sampled_from([SHANGHAI, NEW_YORK, PARIS, SYDNEY]))
def test_local_times_against_zoneinfo(local, tz):
    local = local.replace(microsecond=0, fold=0)  # a time that occurs twice is the earlier instant
    expected = local.replace(tzinfo=ZoneInfo(tz)).astimezone(UTC).replace(tzinfo=None)
    assert iso(local.isoformat(), tz) == expected.isoformat(timespec="microseconds")


COLUMNS = "id int, raw string, tz string, date_order string, micros string, instant string"


def test_rows_nulls_repeats_and_clashing_names(spark, tmp_path):
    rows = [(1, "2024-01-02", SHANGHAI, "ymd", "keep", None), (1, "2024-01-02", SHANGHAI, "ymd", "keep", None), (2, None, None, None, None, None), (3, "2024-01-02", None, None, "x", "old"), (4, "x" * 100_000, SHANGHAI, "ymd", None, None)]
    out = normalise_timestamps(spark.createDataFrame(rows, COLUMNS), "raw", "tz", "date_order", dictionary=InstantDictionary(spark, str(tmp_path / "d")))
    got = sorted((r["id"], r["micros"], str(r["instant"])) for r in out.collect())
    assert got == [(1, "keep", "2024-01-01 16:00:00"), (1, "keep", "2024-01-01 16:00:00"), (2, None, "None"), (3, "x", "None"), (4, None, "None")]


def test_empty_table(spark):
    assert normalise_timestamps(spark.createDataFrame([], COLUMNS), "raw", "tz", "date_order").count() == 0


def test_dictionary_is_incremental(spark, tmp_path):
    d = InstantDictionary(spark, str(tmp_path / "d"))
    first = spark.createDataFrame([("2024-01-02", SHANGHAI, "ymd")] * 5, "raw string, tz string, date_order string")
    assert d.extend(first).count() == 1
    both = first.union(spark.createDataFrame([("2024-01-03", SHANGHAI, "ymd")], first.schema))
    assert d.extend(both).count() == 2
    assert d.read().count() == 2  # nothing was parsed twice


def test_a_second_run_parses_nothing(spark, data, tmp_path):
    spark.conf.set("spark.millrace.instants", str(tmp_path / "d"))
    try:
        first = p4_found(spark, data).count()
        rows = InstantDictionary(spark, str(tmp_path / "d")).read()
        n = rows.count()
        assert n == rows.distinct().count() > 0
        assert p4_found(spark, data).count() == first
        assert InstantDictionary(spark, str(tmp_path / "d")).read().count() == n
    finally:
        spark.conf.unset("spark.millrace.instants")


def test_iso_in_another_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        from pyspark.sql import functions as F

        df = spark.range(1).select(iso_micros(F.timestamp_micros(F.lit(1))).alias("x"))
        assert df.first()["x"] == "1970-01-01T00:00:00.000001Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
