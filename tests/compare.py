"""Rows of a query and of its SQL in one comparable form."""

import datetime
import decimal
import glob
import os

import duckdb


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return (v.astimezone(datetime.UTC).replace(tzinfo=None) if v.tzinfo else v).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def sorted_rows(columns, rows):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


def database(sf_dir):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def assert_same(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    found = sorted_rows(df.columns, df.collect())
    relation = database(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(relation.columns)
    assert found == sorted_rows(relation.columns, relation.fetchall())
