"""Cutting oversized texts at natural boundaries, with a given overlap.

Pieces are at most ``limit`` characters (code points) long and consecutive ones share exactly
``overlap`` characters. A dynamic program over boundary positions minimises the sum of the cuts'
penalties and of the squared deviations from equal sizes. Boundaries are taken level by level: where
the coarser ones (paragraphs, lines, sentences, clauses, words) are close enough together for a
choice, finer ones are left out, and only a stretch without any gets positions between characters.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources import read_table

#: Boundaries from coarse to fine: the penalty of a cut and the pattern at whose end it is made.
LEVELS = (
    (0.0, re.compile(r"\n[ \t]*\n\s*")),
    (1.0, re.compile(r"\\\\[ \t]*\n|\n")),
    (2.0, re.compile(r"[.!?…][\"'”’)\]]*(?=\s)\s*|[。！？][”’」』）]*\s*")),
    (4.0, re.compile(r"[,;:](?=\s)\s*|[，、；：]\s*|\\\\\s*")),
    (6.0, re.compile(r"\s+")),
)
FORCED_PENALTY = 20.0
#: Weight of a piece's squared deviation from the mean size, as a share of the limit.
IMBALANCE = 8.0
#: A stretch longer than this share of the step gets finer boundaries.
REFINE = 8


def _attached(text: str, i: int) -> bool:
    """Whether position ``i`` lies inside a grapheme cluster."""
    return i < len(text) and (unicodedata.combining(text[i]) != 0 or text[i] in "‍️︎" or text[i - 1] == "‍")


def boundaries(text: str, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where ``text`` may be cut, with penalties; consecutive ones are at most ``step`` apart."""
    n = len(text)
    fine = max(1, step // REFINE)
    penalty = {0: 0.0, n: 0.0}
    wide = [(0, n)]
    for cost, pattern in LEVELS:
        left = []
        for a, b in wide:
            at, inside = a, []
            for m in pattern.finditer(text, a, b):
                if a < m.end() < b and m.end() != at:
                    at = m.end()
                    inside.append(at)
            for p in inside:
                penalty.setdefault(p, cost)
            edges = [a, *inside, b]
            left += [(x, y) for x, y in zip(edges, edges[1:], strict=False) if y - x > fine]
        wide = left
        if not wide:
            break
    for a, b in wide:
        if b - a <= step // 2:
            continue
        p = a + fine
        while p < b:
            q = p
            while q > a + 1 and _attached(text, q):
                q -= 1
            penalty.setdefault(q if q > a + 1 else p, FORCED_PENALTY)
            p += fine
    positions = np.array(sorted(penalty))
    return positions, np.array([penalty[p] for p in positions])


def split(text: str, limit: int, overlap: int = 0) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``text``, in order.

    A text within the limit is one piece, the empty text one empty piece. An overlap that leaves no
    room, at or above the limit, is lowered to half of it; a negative one counts as 0. A limit below
    1 raises ValueError.
    """
    if limit < 1:
        raise ValueError(f"limit {limit} is below 1")
    n = len(text)
    if n <= limit:
        return [(0, n)]
    overlap = max(0, overlap)
    if overlap >= limit:
        overlap = limit // 2
    step = limit - overlap
    positions, penalty = boundaries(text, step)
    count = -(-(n - overlap) // step)
    target = (n + (count - 1) * overlap) / count
    m = len(positions)
    cost, back = np.full(m, np.inf), np.zeros(m, int)
    # The first piece starts at 0 without an overlap: as if a cut had been at ``overlap``.
    starts = positions - overlap
    starts[0] = 0
    cost[0] = 0.0
    for j in range(1, m):
        end = positions[j]
        i = int(np.searchsorted(positions, end - step))
        lo = 0 if end <= limit else max(1, i)
        choice = np.arange(lo, j)
        if lo == 0:  # the start, and cuts behind the overlap
            choice = np.concatenate(([0], choice[(choice >= max(1, i)) & (positions[choice] > overlap)]))
        else:
            choice = choice[positions[choice] > overlap]
        if not len(choice):
            continue
        sizes = end - starts[choice]
        ok = (sizes <= limit) & (sizes > overlap)
        total = np.where(ok, cost[choice] + IMBALANCE * ((sizes - target) / limit) ** 2, np.inf)
        k = int(total.argmin())
        cost[j], back[j] = total[k] + penalty[j], choice[k]
    if not np.isfinite(cost[-1]):  # boundaries too coarse for the overlap: cut at full length
        cuts = list(range(limit, n, step))
    else:
        cuts, j = [], m - 1
        while j:
            cuts.append(int(positions[j]))
            j = int(back[j])
        cuts = cuts[::-1][:-1]
    edges = [0, *(c - overlap for c in cuts)]
    return list(zip(edges, [*cuts, n], strict=True))


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for key, node, field, text, limit, overlap in pdf.itertuples(index=False):
            for k, (a, b) in enumerate(split(text, int(limit), int(overlap))):
                rows.append((key, node, field, k, a, b, text[a:b]))
        yield pd.DataFrame(rows, columns=["batch_id", "node_id", "field", "piece_no", "start", "end", "piece"])


def oversized_pieces(df: DataFrame) -> DataFrame:
    """(batch_id, node_id, field, piece_no, start, end, piece) of every node text longer than its row's limit.

    ``df`` has batch_id, nodes, maxBatchChars and overlapChars. Lengths are counted here, whatever a
    stored total says, and on the JVM side, so only oversized texts reach Python. Null arrays, nodes
    and texts, and rows whose limit is null or below 1, give no pieces; a null overlap is 0. Repeated
    rows give repeated pieces. An empty table gives none.
    """
    node = df.select("batch_id", F.col("maxBatchChars").alias("m"), F.coalesce("overlapChars", F.lit(0)).alias("o"), F.explode("nodes").alias("n"))
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"n.{f}").alias("value")) for f in ("text", "latex")))
    long = node.where(F.col("m") >= 1).where((F.length("n.text") > F.col("m")) | (F.length("n.latex") > F.col("m")))
    texts = long.select("batch_id", F.col("n.nodeId").alias("node_id"), F.explode(fields).alias("f"), "m", "o").where(F.length("f.value") > F.col("m"))
    narrow = texts.select("batch_id", "node_id", "f.field", "f.value", "m", "o")
    return narrow.mapInPandas(_cut, "batch_id long, node_id string, field string, piece_no int, start int, end int, piece string")


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oversized_pieces(read_table(spark, sf_dir, "translation_batch", "batch_id", "nodes", "maxBatchChars", "overlapChars"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_pieces(spark, sf_dir).where(F.col("piece_no") == 0).select("batch_id", "node_id").distinct()


QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces}
ORACLE = {
    "p3_found": """
select distinct batch_id, n.nodeId as node_id
from (select batch_id, maxBatchChars as m, unnest(nodes) as n from translation_batch)
where m >= 1 and (length(n.text) > m or length(n.latex) > m)""",
}
