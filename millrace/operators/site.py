"""Small rules of a rendered site, as expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.urls import provider
from millrace.sources import read_table

#: Attempts of a page before it is given up, and bounds of the wait between them in milliseconds.
ATTEMPTS, FIRST_WAIT, LONGEST_WAIT = 3, 1000, 10_000
# Fixed value: what a page's list of footnotes is called.
FOOTNOTES = "脚注"


def aligned(value: Column, prefix: str, start: str) -> Column:
    """Class of an alignment: ``prefix-center``, and ``prefix-`` and the start's name for anything else."""
    return F.when(F.coalesce(value == "center", F.lit(False)), f"{prefix}-center").otherwise(f"{prefix}-{start}")


def enabled_actions(actions: Column) -> Column:
    """Kinds of the actions that are enabled, in order; ``actions`` are structs (kind, enabled)."""
    return F.transform(F.filter(actions, lambda a: F.coalesce(a["enabled"], F.lit(False))), lambda a: a["kind"])


def footnote_label(html: Column) -> Column:
    """A page with the heading of its footnotes (h2 with the id footnote-label) in the site's language."""
    return F.regexp_replace(html, r"(?s)(<h2\b[^>]*\bid=[\"']?footnote-label[\"']?[^>]*>)[^<]+", "$1" + FOOTNOTES)


def retry_schedule(attempts: Column) -> Column:
    """Waits before the second and later of so many attempts (ATTEMPTS at most), doubling up to LONGEST_WAIT."""
    n = F.least(attempts, F.lit(ATTEMPTS)) - 1
    waits = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.least(F.lit(FIRST_WAIT) * F.pow(F.lit(2), i - 1), F.lit(LONGEST_WAIT)).cast("long"))
    return F.when(n >= 1, waits).otherwise(F.array().cast("array<long>"))


def code_figure(language: Column, title: Column, code: Column, highlights: Column) -> Column:
    """A code block as a figure: its title, and a numbered line each, marked where it is to be highlighted. Colours are left to the reader's style sheet."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = lambda x, i: F.concat(F.lit('<span data-line="'), (i + 1).cast("string"), F.when(F.array_contains(highlights, i + 1), '" data-highlighted="').otherwise(""), F.lit('">'), escape(x), F.lit("</span>"))
    lines = F.array_join(F.transform(F.split(code, "\n"), line), "\n")
    head = F.when(title.isNotNull(), F.concat(F.lit("<figcaption>"), escape(title), F.lit("</figcaption>"))).otherwise("")
    return F.concat(F.lit("<figure>"), head, F.lit('<pre data-language="'), escape(language), F.lit('"><code>'), lines, F.lit("</code></pre></figure>"))


def _figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.operators.documents import _blocks

    numbers = F.array(F.lit(1), (F.col("n") % 3 + 1).cast("int"))
    title = F.when(F.col("n") % 2 == 0, F.concat(F.lit("block <"), F.col("n").cast("string"), F.lit(">")))
    return _blocks(spark, sf_dir).select("id", "n", code_figure(F.col("lang"), title, F.col("code"), numbers).alias("figure"))


def _first_place(html: str) -> str | None:
    """The first of a site's places that has text enough for an article."""
    from millrace.functions.dom import parse, select
    from millrace.operators.pages import LEAST_TEXT, ZHIHU

    root = parse(html)
    return next((s for s in ZHIHU if (e := next(select(root, s), None)) is not None and len(e.text().strip()) >= LEAST_TEXT), None)


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.operators.pages import _strings

    return _strings(_first_place)(spark, sf_dir)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a list of footnotes behind them, its heading in the site's language."""
    html = F.concat("html", F.lit('<h2 class="sr-only" id="footnote-label">Footnotes</h2><ol></ol>'))
    return read_table(spark, sf_dir, "extracted_article", "page_id", "html").select("page_id", footnote_label(html).alias("html"))


def _article(*columns: str):
    return lambda s, d: read_table(s, d, "article", "article_id", *columns)


QUERIES = {
    "math_align_class": lambda s, d: _article("site")(s, d).select("article_id", *(aligned(F.when(F.col("article_id") % 3 == 0, "center").when(F.col("article_id") % 3 == 1, "left"), prefix, start).alias(prefix) for prefix, start in (("text", "left"), ("justify", "start"), ("items", "start")))),
    "filter_actions": lambda s, d: _article("tags")(s, d).select("article_id", F.array_join(enabled_actions(F.array(*(F.struct(F.lit(kind).alias("kind"), test.alias("enabled")) for kind, test in (("toc", F.size("tags") > 2), ("share", F.col("article_id") % 2 == 0), ("top", F.lit(True)))))), "|").alias("actions")),
    "str_footnote_label": _labels,
    "zhihu_retry": lambda s, d: _article("canonicalUrl")(s, d).select("article_id", F.array_join(F.when(provider(F.col("canonicalUrl")) == "zhihu", retry_schedule(F.lit(ATTEMPTS))).otherwise(retry_schedule((F.col("article_id") % 3 + 1).cast("int"))), ",").alias("waits")),
    "wait_content": _places,
    "code_figure": _figures,
}


def _oracle() -> dict[str, str]:
    from millrace.operators.documents import _B, _ZHIHU

    escaped = lambda x: f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    return {
        "math_align_class": "select article_id, case when c then 'text-center' else 'text-left' end as text, case when c then 'justify-center' else 'justify-start' end as justify, case when c then 'items-center' else 'items-start' end as items from (select article_id, article_id % 3 = 0 as c from article)",
        "filter_actions": "select article_id, concat_ws('|', case when len(tags) > 2 then 'toc' end, case when article_id % 2 = 0 then 'share' end, 'top') as actions from article",
        "str_footnote_label": f"select page_id, html || '<h2 class=\"sr-only\" id=\"footnote-label\">{FOOTNOTES}</h2><ol></ol>' as html from extracted_article",
        "zhihu_retry": f"select article_id, case when {_ZHIHU} or article_id % 3 = 2 then '1000,2000' when article_id % 3 = 1 then '1000' else '' end as waits from article",
        "code_figure": _B + f"""select id, n, '<figure>' || case when n % 2 = 0 then '<figcaption>block &lt;' || n || '&gt;</figcaption>' else '' end || '<pre data-language="' || {escaped("lang")} || '"><code>' || array_to_string(list_transform(list_zip(l, range(1, len(l) + 1)), lambda z: '<span data-line="' || z[2] || case when z[2] in (1, n % 3 + 1) then '" data-highlighted="' else '' end || '">' || {escaped("z[1]")} || '</span>'), chr(10)) || '</code></pre></figure>' as figure
 from (select id, n, lang, string_split(code, chr(10)) as l from c)""",
    }


ORACLE = _oracle()
