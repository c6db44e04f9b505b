"""Block trees given as rows (page, block, parent, pos): depth-first order and the first match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.urls import ADAPTERS
from millrace.operators.documents import heading_parents, headings
from millrace.plans.storage import materialise
from millrace.sources import read_table

DEPTH = 32


def with_paths(blocks: DataFrame, page: str, block: str, parent: str, pos: str, depth: int = DEPTH) -> DataFrame:
    """Blocks with ``path``: positions from the root down, so that paths sort depth-first.

    One equi-join a level on (page, parent), each level written before the next, until a level is
    empty. Blocks whose parents aren't there, and cycles, never get a path; deeper trees than
    ``depth`` raise ValueError. Null parents are roots.
    """
    level = materialise(blocks.where(F.col(parent).isNull()).withColumn("path", F.array(F.col(pos).cast("long"))), "blocks")
    out = level
    for _ in range(depth):
        above = level.select(F.col(page).alias("__page"), F.col(block).alias("__block"), F.col("path").alias("__path"))
        below = blocks.join(above, (F.col(page) == F.col("__page")) & (F.col(parent) == F.col("__block")))
        level = materialise(below.withColumn("path", F.array_append("__path", F.col(pos).cast("long"))).drop("__page", "__block", "__path"), "blocks")
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError(f"blocks are nested more than {depth} deep")


def first_match(blocks: DataFrame, page: str, block: str, parent: str, pos: str, condition: Column) -> DataFrame:
    """(page, block): the first block of each page, depth-first, that meets the condition."""
    paths = with_paths(blocks, page, block, parent, pos)
    return paths.where(condition).groupBy(page).agg(F.min_by(block, "path").alias(block))


def _first_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first heading of each document's outline that has an "a" in it, depth-first."""
    rows = heading_parents(headings(read_table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text"))
    return first_match(rows.withColumn("at", F.col("pos")), "id", "pos", "parent", "at", F.col("text").contains("a"))


QUERIES = {
    "src_notion_blocks": _first_headings,
    "sort_adapters": lambda s, d: s.createDataFrame([(i, name) for i, (name, _) in enumerate(ADAPTERS)], "rank long, adapter string"),
}

ORACLE = {
    "src_notion_blocks": r"""with b as (select doc_id as id, regexp_extract_all(regexp_replace(text, '(?ms)^```.*?(?:^```[^\n]*$|\z)', '', 'g'), '(?m)^#{1,6} +[^\n]+$') as l from documents),
h as (select id, cast(unnest(range(0, len(l))) as bigint) as pos, unnest(l) as line from b where len(l) > 0)
select id, min(pos) as pos from h where contains(trim(regexp_replace(line, '^#{1,6} +', '')), 'a') group by id""",
    "sort_adapters": "select cast(rank as bigint) as rank, adapter from (values (0, 'zhihu'), (1, 'medium'), (2, 'wechat'), (3, 'others')) as t(rank, adapter)",
}
