import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.packing import harmonic, p8_pack, p8_unused, pack, packed, token_counts


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 200), max_size=80), st.integers(1, 64))
def test_pack(sizes, capacity):
    item, number, first, tokens, where = pack(np.array(sizes, dtype=np.int64), capacity)
    used = np.zeros(int(where.max()) + 1 if len(where) else 0)
    np.add.at(used, where, tokens)
    assert (used <= capacity).all()
    for i, s in enumerate(sizes):
        pieces = sorted((n, f, t) for k, n, f, t in zip(item, number, first, tokens, strict=True) if k == i)
        assert sum(t for _, _, t in pieces) == s
        assert len(pieces) == max(1, -(-s // capacity))  # cut only if larger, into as few pieces as possible
        assert [f for _, f, _ in pieces] == [capacity * n for n in range(len(pieces))]


def test_little_unused():
    rng = np.random.default_rng(3)
    sizes = np.minimum(512, rng.lognormal(5, 0.8, 20_000).astype(np.int64) + 1)
    where = harmonic(sizes, 512)
    assert sizes.sum() / ((where.max() + 1) * 512) > 0.98


def test_classes_alone():
    assert len(set(harmonic(np.array([256] * 10), 512))) == 5
    assert len(set(harmonic(np.array([512] * 3), 512))) == 3
    assert len(harmonic(np.array([], dtype=np.int64), 512)) == 0


def test_tokens():
    assert token_counts([None, "", "Hello world"])[:2] == [0, 0]
    assert 1 <= token_counts(["Hello world"])[0] <= 4


def test_rows(spark):
    rows = [(1, "word " * 5000, 1), (2, None, 2), (3, "", 3), (4, "short text", 4), (4, "short text", 4), (None, "short text", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, capacity_id int").repartition(1)
    out = packed(df, "doc_id", "text", [(7, 64), (8, 4096)]).toPandas()
    assert set(out["capacity_id"]) == {7, 8}
    for c, capacity in ((7, 64), (8, 4096)):
        part = out[out["capacity_id"] == c]
        assert part.groupby("container_id")["n_tokens"].sum().max() <= capacity
        assert set(part["id"].dropna()) == {1, 2, 3, 4}
        assert (part["id"] == 4).sum() == 2
        assert part["id"].isna().sum() == 1
    assert packed(df.limit(0), "doc_id", "text", [(7, 64)]).count() == 0
    with pytest.raises(ValueError, match="below 1"):
        packed(df, "doc_id", "text", [(7, 0)])


def test_query(spark, data):
    import duckdb

    docs = {r[0] for r in duckdb.sql(f"select doc_id from '{data}/documents.parquet'").fetchall()}
    out = p8_pack(spark, data).toPandas()
    for _, part in out.groupby("capacity_id"):
        assert set(part["doc_id"]) == docs
    assert p8_unused(spark, data).toPandas()["unused"].max() < 0.2
