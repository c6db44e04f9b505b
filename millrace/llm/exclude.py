"""Rows of Markdown texts and of pages that hold residue instead of content."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import boilerplate
from millrace.llm.lookalikes import transducer
from millrace.llm.pages import HEADINGS, Block
from millrace.llm.residue import COVERAGE, coverage, has_placeholder, residue_kind, without_code
from millrace.plans.parallel import spread
from millrace.sources import read_table

SCHEMA = "id long, kind string"


def _markdown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        kinds = [residue_kind(without_code(x)) if isinstance(x, str) else None for x in pdf["text"]]
        yield pd.DataFrame({"id": pdf["id"], "kind": kinds}).dropna(subset=["kind"])


def residue_in_markdown(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, kind) of the Markdown texts that are residue.

    Null and empty texts, and texts of code alone, are none. Repeated rows give repeated results; no
    other column matters; an empty table gives none.
    """
    return spread(df.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))).mapInPandas(_markdown, SCHEMA)


def page_residue(html: str, model: boilerplate.Model) -> str | None:
    """Kind of residue of a page: placeholders count in any block, coverage in the article's place."""
    p = boilerplate.page(html)
    if not p.blocks:
        return None
    apply = transducer().form
    if has_placeholder("\n\n".join(apply(b.plain) for b in p.blocks)):
        return "placeholder"
    chosen = boilerplate.body(p, model)
    if chosen:
        return _covered([p.blocks[i] for i in chosen])
    # No article was found: a part of the page that is a notice stands in its place.
    parts: dict[int, list[Block]] = {}
    for b in p.blocks:
        if 2 * b.links < len(b.text):
            parts.setdefault(id(b.container), []).append(b)
    return next(filter(None, map(_covered, parts.values())), None)


def _covered(found: list[Block]) -> str | None:
    """Kind of the phrases that cover ``found``; a title above them isn't content."""
    texts = [transducer().form(b.plain.strip()) for b in found]
    shares = coverage("\n\n".join(texts))
    if shares and sum(shares.values()) < COVERAGE:
        prose = [t for b, t in zip(found, texts, strict=True) if b.name not in HEADINGS]
        shares = coverage("\n\n".join(prose)) if any(prose) else shares
    return max(shares, key=shares.get) if sum(shares.values()) >= COVERAGE else None


def residue_in_pages(df: DataFrame, id_column: str, html: str, model: boilerplate.Model | None = None) -> DataFrame:
    """(id, kind) of the pages that are residue; null, empty and tagless pages are none."""
    model = model or boilerplate.train(df, html)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kinds = [page_residue(x, model) if isinstance(x, str) else None for x in pdf["html"]]
            yield pd.DataFrame({"id": pdf["id"], "kind": kinds}).dropna(subset=["kind"])

    return spread(df.select(F.col(id_column).cast("long").alias("id"), F.col(html).alias("html"))).mapInPandas(judge, SCHEMA)


def residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, row_id, kind) over all articles and pages."""
    articles = residue_in_markdown(read_table(spark, sf_dir, "article", "article_id", "markdown"), "article_id", "markdown")
    pages = residue_in_pages(read_table(spark, sf_dir, "extracted_article", "page_id", "html"), "page_id", "html", boilerplate.trained(spark, sf_dir))
    both = articles.withColumn("tbl", F.lit("article")).unionByName(pages.withColumn("tbl", F.lit("extracted_article")))
    return both.select("tbl", F.col("id").alias("row_id"), "kind")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(spark, sf_dir).select("tbl", "row_id").distinct()


def p7_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residue by table and kind."""
    return residue(spark, sf_dir).groupBy("tbl", "kind").agg(F.count("*").alias("n_rows"))


QUERIES = {"p7_found": p7_found, "p7_kinds": p7_kinds}
ORACLE: dict[str, str] = {}
