import numpy as np
import pytest
from compare import assert_same

from millrace.llm.cooccurrence import ORACLE, fit_null, p6_found, poisson_binomial_tail, solve_x, surprising_pairs


def exact_tail(k, p):
    dist = np.array([1.0])
    for x in p:
        dist = np.convolve(dist, [1 - x, x])
    return dist[k:].sum()


@pytest.mark.parametrize("seed", range(6))
def test_tail(seed):
    rng = np.random.default_rng(seed)
    p, rows = rng.uniform(0.01, 0.3, 4), rng.integers(5, 80, 4).astype(float)
    each = np.repeat(p, rows.astype(int))
    for k in (1, int(each.sum()), int(each.sum()) + 4, int(each.sum()) + 12):
        got = poisson_binomial_tail(np.array([k]), p[None, :], rows)[0]
        assert got == pytest.approx(exact_tail(k, each), rel=0.15, abs=0.02)


@pytest.mark.parametrize("mean", [1e-6, 1e-4, 0.01, 0.1, 1.0, 5.0])
@pytest.mark.parametrize("k", [1, 2, 3, 8, 16, 17, 30])
def test_tail_of_rare_pairs(mean, k):
    """Relative to the exact tail, however small."""
    rows = np.array([40.0, 25.0, 7.0])
    p = np.array([1.0, 3.0, 9.0])
    p *= mean / (p * rows).sum()
    exact = exact_tail(k, np.repeat(p, rows.astype(int)))
    got = poisson_binomial_tail(np.array([k]), p[None, :], rows)[0]
    assert got == pytest.approx(exact, rel=1e-6 if k <= 16 else 0.02)


def test_solved_frequencies():
    y, rows = np.array([0.1, 0.5, 2.0]), np.array([50.0, 30.0, 4.0])
    xy = solve_x(np.array([1, 7, 60, 84]), y, rows)[:, None] * y
    assert (rows * xy / (1 + xy)).sum(1) == pytest.approx([1, 7, 60, 83.5], rel=1e-6)


def test_independent_items_are_no_discoveries(spark):
    """With items drawn independently, hardly any of the sets has a surprising pair at a rate of 5 %."""
    false = 0
    for seed in range(12):
        rng = np.random.default_rng(seed)
        rates = rng.uniform(0.005, 0.2, 40)
        rows = [([f"t{i}" for i in np.flatnonzero(rng.random(40) < rates)],) for _ in range(300)]
        false += surprising_pairs(spark.createDataFrame(rows, "tags array<string>"), "tags").where("surprising").count() > 0
    assert false <= 2


def test_null_reproduces_the_margins():
    degrees, n_items = np.array([2.0, 5.0, 9.0]), np.array([10.0, 6.0, 2.0])
    sizes = np.array([1.0, 3.0, 4.0])
    total = (degrees * n_items).sum()
    n_rows = np.array([total - 3 * 8 - 4 * 5, 8.0, 5.0])
    x, y = fit_null(degrees, n_items, sizes, n_rows)
    p = np.outer(x, y) / (1 + np.outer(x, y))
    assert (p * n_rows).sum(1) == pytest.approx(degrees, rel=1e-5)
    assert (p * n_items[:, None]).sum(0) == pytest.approx(sizes, rel=1e-5)


def test_rows(spark):
    rows = [(1, ["A ", "b", "B", None, " "], "x")] * 12 + [(2, None, None), (3, [], "y"), (4, ["a"], "z"), (5, [" "], None)] + [(6, ["c", "d"], None)] * 20 + [(7, ["c"], None)] * 30 + [(8, ["d"], None)] * 30
    df = spark.createDataFrame(rows, "id int, tags array<string>, k string")
    got = {(r["tag_a"], r["tag_b"]): r for r in surprising_pairs(df, "tags").collect()}
    assert set(got) == {("a", "b"), ("c", "d")}
    ab = got["a", "b"]
    assert (ab["k"], ab["n_a"], ab["n_b"], ab["n"]) == (12, 13, 12, 93)
    assert ab["surprising"]
    assert not got["c", "d"]["surprising"]
    assert all(0 <= r["p_value"] <= r["q_value"] <= 1 for r in got.values())


def test_false_discoveries(spark):
    """q values are Benjamini-Hochberg's, across partitions."""
    rng = np.random.default_rng(1)
    rows = [([f"t{i}" for i in rng.choice(30, rng.integers(1, 6), replace=False)],) for _ in range(400)] + [(["t1", "t2"],)] * 40
    got = surprising_pairs(spark.createDataFrame(rows, "tags array<string>").repartition(3), "tags").toPandas().sort_values(["p_value", "tag_a", "tag_b"])
    tests = 30 * 29 // 2
    raw = np.minimum(1, got["p_value"] * tests / np.arange(1, len(got) + 1))
    assert got["q_value"].to_numpy() == pytest.approx(np.minimum.accumulate(raw[::-1])[::-1], rel=1e-9)
    assert got.iloc[0][["tag_a", "tag_b"]].tolist() == ["t1", "t2"]


def test_empty(spark):
    df = spark.createDataFrame([], "tags array<string>")
    assert surprising_pairs(df, "tags").count() == 0


def test_sql(spark, data):
    assert_same(spark, data, p6_found, ORACLE["p6_found"])
