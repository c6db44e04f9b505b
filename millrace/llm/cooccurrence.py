"""Items that appear together: exact pair counts against a bipartite configuration null.

Counting: equal baskets are first merged with a weight, so a hot basket costs one row, then each
basket emits its pairs one by one (bounded by the basket, never by a group of rows) and the counts are
aggregated with a map-side combine.

Null model: every item i appears in basket r with probability x_i y_r / (1 + x_i y_r), independently,
with x and y fitted so that the expected item frequencies and basket sizes are those observed.
Baskets of one size share y and items of one frequency share x, so y is fitted on the two histograms,
in which values above EXACT share a class with those within STEP of them: a few thousand classes at
most, whatever the data. x is then solved for each frequency itself.

Surprise: under the null the joint count of a pair is a sum of independent Bernoulli variables, one
for each basket, i.e. Poisson-binomial. Its upper tail is summed exactly for counts up to EXACT_TAIL;
above, it comes from the saddlepoint approximation. A tail depends on the joint count and the two
frequencies alone, so it is worked out once for each such triple. False discoveries are controlled by
Benjamini-Hochberg over all possible pairs of items.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.plans.storage import materialise
from millrace.sources import read_table

MIN_TOGETHER = 5
MIN_LIFT = 4
#: Level of one pair's tail.
NOMINAL = 0.05
#: Frequencies and sizes up to EXACT are classes of their own; above, a class spans a factor of STEP.
EXACT, STEP = 256, 1.01
#: Counts up to here have exactly summed tails, of so many further terms where the tail is small.
EXACT_TAIL, TERMS = 16, 24


def normalised_items(items: Column) -> Column:
    """Sorted set of the array's items, lower-cased, trimmed, inner spaces single, blanks and nulls dropped."""
    blanks = r"(?U)[\s\x{feff}\x{200b}]+"
    cleaned = F.transform(items, lambda t: F.trim(F.regexp_replace(F.lower(t), blanks, " ")))
    return F.array_sort(F.array_distinct(F.filter(cleaned, lambda t: t.isNotNull() & (t != ""))))


def baskets(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-empty baskets (items, n_rows): the pre-aggregation before any pair is made."""
    return df.select(normalised_items(F.col(column)).alias("items")).where(F.size("items") > 0).groupBy("items").agg(F.count("*").alias("n_rows"))


def item_counts(distinct: DataFrame) -> DataFrame:
    return distinct.select(F.explode("items").alias("item"), "n_rows").groupBy("item").agg(F.sum("n_rows").alias("n"))


def pair_counts(distinct: DataFrame) -> DataFrame:
    """(tag_a, tag_b, k) with tag_a < tag_b by code point, k the number of rows with both."""
    first = distinct.where(F.size("items") > 1).select(F.posexplode("items").alias("at", "tag_a"), "items", "n_rows")
    pairs = first.select("tag_a", F.explode(F.slice("items", F.col("at") + 2, F.size("items"))).alias("tag_b"), "n_rows")
    return pairs.groupBy("tag_a", "tag_b").agg(F.sum("n_rows").alias("k"))


def counted_pairs(distinct: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    """(tag_a, tag_b, k, n_a, n_b, n) for every pair that occurs together at least once, of ``n`` rows.

    Pairs of hot items are safe: the join with the item counts has one row a key on the count side.
    """
    a = counts.select(F.col("item").alias("tag_a"), F.col("n").alias("n_a"))
    b = counts.select(F.col("item").alias("tag_b"), F.col("n").alias("n_b"))
    return pair_counts(distinct).join(a, "tag_a").join(b, "tag_b").withColumn("n", F.lit(n).cast("long"))


def fit_null(degrees: np.ndarray, n_items: np.ndarray, sizes: np.ndarray, n_rows: np.ndarray, rounds: int = 5000, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """x for each item frequency and y for each basket size, by fixed-point iteration; warns where the margins aren't met."""
    total = float((degrees * n_items).sum())
    x, y = degrees / np.sqrt(total), sizes / np.sqrt(total)
    for _ in range(rounds):
        new_x = degrees / (n_rows * y / (1 + np.outer(x, y))).sum(axis=1)
        new_y = sizes / (n_items[:, None] * new_x[:, None] / (1 + np.outer(new_x, y))).sum(axis=0)
        step = max(np.abs(new_x / x - 1).max(), np.abs(new_y / y - 1).max())
        x, y = new_x, new_y
        if step < tolerance:
            break
    p = np.outer(x, y) / (1 + np.outer(x, y))
    off = max(np.abs((p * n_rows).sum(1) / degrees - 1).max(), np.abs((p * n_items[:, None]).sum(0) / sizes - 1).max())
    if off > 1e-3:
        warnings.warn(f"the null's margins are off by {off:.1e}", stacklevel=2)
    return x, y


def solve_x(n: np.ndarray, y: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """x of items of frequency ``n``, given y: the root of sum(rows x y / (1 + x y)) = n, by bisection on its logarithm."""
    n = np.minimum(n.astype(float), rows.sum() - 0.5)
    low, high = np.full(len(n), -60.0), np.full(len(n), 60.0)
    for _ in range(64):
        mid = (low + high) / 2
        xy = np.exp(mid)[:, None] * y
        above = (rows * xy / (1 + xy)).sum(1) > n
        low, high = np.where(above, low, mid), np.where(above, mid, high)
    return np.exp((low + high) / 2)


def histogram(counts: DataFrame, value: str, weight: Column) -> tuple[np.ndarray, np.ndarray]:
    """(mean value, weight) of each class of a column of positive numbers; a few thousand classes at most."""
    v = F.col(value).cast("double")
    bucket = F.when(v <= EXACT, v).otherwise(F.lit(float(EXACT)) + 1 + F.floor(F.log(v / EXACT) / math.log(STEP)))
    rows = counts.groupBy(bucket.alias("b")).agg(F.sum(weight).alias("w"), (F.sum(v * weight) / F.sum(weight)).alias("v")).orderBy("b").collect()
    return np.array([r["v"] for r in rows], float), np.array([r["w"] for r in rows], float)


def null_of(distinct: DataFrame, counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """y and the number of rows by class of basket sizes.

    An item that is in every basket has no finite x; its frequency is lowered by half a row.
    """
    degrees, n_items = histogram(counts, "n", F.lit(1.0))
    sizes, n_rows = histogram(distinct.select(F.size("items").alias("s"), "n_rows"), "s", F.col("n_rows"))
    if not len(degrees):
        return np.array([]), np.array([])
    d = np.minimum(degrees, n_rows.sum() - 0.5)
    s = np.minimum(sizes, n_items.sum() - 0.5)
    return fit_null(d, n_items, s, n_rows)[1], n_rows


def _exact_tail(k: np.ndarray, p: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The tail for k from 1 to EXACT_TAIL: products of the classes' binomial terms, all positive, so nothing cancels."""
    size = EXACT_TAIL + TERMS
    total = np.zeros((len(k), size))
    total[:, 0] = 1.0
    for j, n in enumerate(rows):
        terms = np.zeros((len(k), size))
        terms[:, 0] = np.exp(n * np.log1p(-p[:, j]))
        odds = p[:, j] / (1 - p[:, j])
        for m in range(1, min(size, int(n) + 1)):
            terms[:, m] = terms[:, m - 1] * odds * ((n - m + 1) / m)
        new = np.zeros_like(total)
        for m in range(min(size, int(n) + 1)):
            new[:, m:] += total[:, : size - m] * terms[:, m : m + 1]
        total = new
    at = np.arange(size)
    below = np.where(at < k[:, None], total, 0).sum(1)
    above = np.where(at >= k[:, None], total, 0).sum(1)
    # Far tails are summed themselves; near ones, which have more terms than are held, from the other side.
    return np.where(1 - below > 1e-6, 1 - below, above)


def poisson_binomial_tail(k: np.ndarray, p: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """P(S >= k) where S sums ``rows[j]`` Bernoulli(p[:, j]) variables for each class j.

    Exact for k up to EXACT_TAIL. Above, saddlepoint (Lugannani-Rice with the lattice correction) for k
    beyond the mean; at or below the mean, and within one of it, the normal approximation with a
    continuity correction.
    """
    upper = np.vectorize(lambda z: 0.5 * math.erfc(z / math.sqrt(2)), otypes=[float])
    k = k.astype(float)
    out = np.ones(len(k))
    near = (k >= 1) & (k <= EXACT_TAIL)
    if near.any():
        out[near] = _exact_tail(k[near], p[near], rows)
    rest = k > EXACT_TAIL
    if rest.any():
        q, kk = p[rest], k[rest]
        mean, var = (q * rows).sum(1), (q * (1 - q) * rows).sum(1)
        tail = upper((kk - 0.5 - mean) / np.sqrt(np.maximum(var, 1e-300)))
        far = (kk > mean + 1) & (kk < rows.sum())
        if far.any():
            tail[far] = _saddlepoint(kk[far], q[far], rows, upper)
        out[rest] = tail
    return np.clip(out, 0, 1)


def _saddlepoint(k: np.ndarray, q: np.ndarray, rows: np.ndarray, upper) -> np.ndarray:
    low, high = np.zeros(len(k)), np.full(len(k), 60.0)
    for _ in range(80):  # the tilt t with K'(t) = k
        t = (low + high) / 2
        e = q * np.exp(t)[:, None]
        above = (e / (1 - q + e) * rows).sum(1) > k
        high, low = np.where(above, t, high), np.where(above, low, t)
    e = q * np.exp(t)[:, None]
    tilted = e / (1 - q + e)
    big_k = (np.log1p(q * np.expm1(t)[:, None]) * rows).sum(1)
    spread = (tilted * (1 - tilted) * rows).sum(1)
    w = np.sqrt(np.maximum(2 * (t * k - big_k), 1e-12))
    u = (1 - np.exp(-t)) * np.sqrt(np.maximum(spread, 1e-300))
    return upper(w) + np.exp(-w * w / 2) / np.sqrt(2 * np.pi) * (1 / u - 1 / w)


def surprising_pairs(df: DataFrame, column: str, rate: float = 0.05) -> DataFrame:
    """``counted_pairs`` of an array column with lift, expected (under the null), p_value, q_value and surprising (q_value <= rate).

    q_value is Benjamini-Hochberg's over all pairs of items that could occur. Tails are worked out once
    for each triple (k, n_a, n_b), over all cores; ranks come from a range partitioning of the triples by
    p_value with a count for each partition, not from one global sort task.

    Null arrays, null and blank items count as absent; a row without items counts nowhere; repeats
    within a row count once; repeated rows all count. An empty table gives no pairs. Other columns
    are never read.
    """
    spark = df.sparkSession
    distinct = materialise(baskets(df, column), "baskets")
    counts = materialise(item_counts(distinct), "items")
    y, rows = null_of(distinct, counts)
    n_items = counts.count()
    tests = max(1, n_items * (n_items - 1) // 2)
    pairs = materialise(counted_pairs(distinct, counts, int(rows.sum())), "pairs")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 2000):  # rows times classes are held at once
                part = pdf.iloc[a : a + 2000]
                both = 1.0
                for c in ("n_a", "n_b"):
                    xy = solve_x(part[c].to_numpy(), y, rows)[:, None] * y
                    both = both * (xy / (1 + xy))
                yield part.assign(expected=(both * rows).sum(1), p_value=poisson_binomial_tail(part["k"].to_numpy(), both, rows))

    triple = ["k", "n_a", "n_b"]
    triples = pairs.groupBy(*triple).agg(F.count("*").alias("c")).repartition(spark.sparkContext.defaultParallelism)
    scored = triples.mapInPandas(score, "k long, n_a long, n_b long, c long, expected double, p_value double")
    ranged = materialise(scored.repartitionByRange("p_value", *triple).withColumn("part", F.spark_partition_id()), "scored-triples")
    per_part = {r["part"]: r["c"] for r in ranged.groupBy("part").agg(F.sum("c").alias("c")).collect()}  # one row a partition
    offsets, before = [], 0
    for part in sorted(per_part):
        offsets.append((part, before))
        before += per_part[part]
    offset = spark.createDataFrame(offsets, "part int, ahead long")
    order = Window.partitionBy("part").orderBy("p_value", *triple)
    ranked = ranged.join(offset, "part").withColumn("rank", F.col("ahead") + F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    raw_q = ranked.withColumn("raw_q", F.least(F.lit(1.0), F.col("p_value") * tests / F.col("rank")))
    # The least raw q at or after a triple: within its partition by a window, over later partitions from their minima.
    minima = {r["part"]: r["m"] for r in raw_q.groupBy("part").agg(F.min("raw_q").alias("m")).collect()}
    later, least = [], 1.0
    for part in sorted(minima, reverse=True):
        later.append((part, least))
        least = min(least, minima[part])
    behind = spark.createDataFrame(later, "part int, behind double")
    q = F.least(F.min("raw_q").over(order.rowsBetween(0, Window.unboundedFollowing)), F.col("behind"))
    valued = raw_q.join(behind, "part").select(*triple, "expected", "p_value", q.alias("q_value"))
    lift = F.col("k") * F.col("n") / (F.col("n_a") * F.col("n_b"))
    out = pairs.join(valued, triple).select("tag_a", "tag_b", "k", "n_a", "n_b", "n", lift.alias("lift"), "expected", "p_value", "q_value")
    return out.withColumn("surprising", F.col("q_value") <= rate)


def p6_surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surprising_pairs(read_table(spark, sf_dir, "article", "tags"), "tags")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that the null doesn't explain at NOMINAL, together in at least 5 rows and at least 4 times as often as chance.

    The case is one of a single pair, so it isn't held to the false-discovery rate of all pairs, which
    small tables are too small for (``p6_surprise`` has it).
    """
    pairs = surprising_pairs(read_table(spark, sf_dir, "article", "tags"), "tags")
    product = lambda x, y: F.col(x).cast("decimal(19,0)") * F.col(y).cast("decimal(19,0)")  # noqa: E731 - exact, no overflow
    return pairs.where((F.col("p_value") <= NOMINAL) & (F.col("k") >= MIN_TOGETHER) & (product("k", "n") >= MIN_LIFT * product("n_a", "n_b"))).select("tag_a", "tag_b")


QUERIES = {"p6_found": p6_found, "p6_surprise": p6_surprise}

_TAGS = """
with t as (
  select article_id, list_sort(list_distinct(list_filter(list_transform(tags, lambda x: trim(regexp_replace(lower(x), '\\s+', ' ', 'g'))), lambda x: x is not null and x <> ''))) as items
  from article), u as (select article_id, items from t where len(items) > 0),
e as (select article_id, unnest(items) as item from u),
n as (select item, count(*) as n from e group by item),
k as (select x.item as tag_a, y.item as tag_b, count(*) as k from e x join e y on x.article_id = y.article_id and x.item < y.item group by all)
"""
ORACLE = {
    "p6_found": _TAGS + "select tag_a, tag_b from k join n a on a.item = tag_a join n b on b.item = tag_b where k >= 5 and k * (select count(*) from u) >= 4 * a.n * b.n",
}
