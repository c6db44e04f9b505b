"""Markdown that needs a tokenizer: fences, inline code, formulas, nodes, emphasis checks, and the whole clean-up."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import code, text
from millrace.functions.frontmatter import flattened, parse
from millrace.operators import sync
from millrace.operators.documents import _RATIOS, FENCE
from millrace.plans.parallel import spread
from millrace.sources import read_table

INLINE_CODE = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.DOTALL)
MATH = re.compile(r"\\\$|\$\$(?P<block>.*?)\$\$|\$\$|\$(?P<inline>(?:\\\$|[^$])*)\$", re.DOTALL)


def front_matter(markdown: str) -> tuple[str, str]:
    """(front matter, body): a leading ``---`` block up to its closing line; without one all is body."""
    if markdown.startswith("---"):
        at = markdown.find("\n---", 3)
        if at >= 0:
            return markdown[: at + 4], markdown[at + 4 :]
    return "", markdown


def front_matter_fields(markdown: str) -> list[tuple[str, str]]:
    """(path, JSON value) of the front matter's leaves, nested keys and lists included."""
    return flattened(parse(front_matter(markdown)[0]))


def fence_segments(markdown: str) -> list[tuple[str, str]]:
    """(kind, content) of front matter, text and fenced code; a fence closes at a line that starts with its own marker."""
    head, body = front_matter(markdown)
    out = [("frontmatter", head)] if head else []
    kind, lines, marker = "text", [], ""
    for line in body.splitlines(keepends=True):
        if not marker and (m := re.match(r"[ \t]*(```+|~~~+)", line)):
            if lines:
                out.append((kind, "".join(lines)))
            kind, lines, marker = "code", [line], m[1]
        elif marker and line.lstrip(" \t").startswith(marker):
            out.append((kind, "".join([*lines, line])))
            kind, lines, marker = "text", [], ""
        else:
            lines.append(line)
    if lines:
        out.append((kind, "".join(lines)))
    return out


def inline_segments(body: str) -> list[tuple[str, str]]:
    """(kind, content) of text and of code between equal runs of backticks."""
    out, at = [], 0
    for m in INLINE_CODE.finditer(body):
        if m.start() > at:
            out.append(("text", body[at : m.start()]))
        out.append(("code", m[0]))
        at = m.end()
    if at < len(body):
        out.append(("text", body[at:]))
    return out


def _formula(m: re.Match[str]) -> str:
    inner = m["inline"]
    if inner is None:
        return m[0]
    if "\n" in inner or "\\begin{" in inner or "\\[" in inner:
        return f"\n$$\n{inner.strip()}\n$$\n"
    if inner.startswith(" ") or inner.endswith(" "):
        return f"${inner.strip()}$"
    return m[0]


_VISIBLE = str.maketrans(dict.fromkeys(text.WIDE_SPACES, " ") | dict.fromkeys(text.DROPPED, None))


def fix_math_counted(markdown: str) -> tuple[str, int]:
    """(text, changes): inline formulas trimmed, those of several lines promoted to blocks; code, escapes and open formulas untouched."""
    out, changes = [], 0

    def formula(m: re.Match[str]) -> str:
        nonlocal changes
        new = _formula(m)
        changes += new != m[0]
        return new

    for kind, content in fence_segments(markdown.translate(_VISIBLE)):
        if kind == "text":
            content = "".join(MATH.sub(formula, x) if k == "text" else x for k, x in inline_segments(content))
        out.append(content)
    return "".join(out), changes


def fix_math(markdown: str) -> str:
    return fix_math_counted(markdown)[0]


def node_rows(markdown: str) -> list[tuple[str, str, str, str]]:
    """(node id, kind, value, context) of what a translation works on, in order.

    A heading comes before its own text; formulas are blocks between ``$$``; code gives nothing.
    """
    out: list[tuple[str, str, str, str]] = []

    def add(kind: str, name: str, value: str, context: str) -> None:
        out.append((f"node_{len(out)}_{name}", kind, value, context))

    for kind, content in fence_segments(markdown):
        if kind != "text":
            continue
        for block in re.split(r"\n[ \t]*\n", content):
            block = block.strip("\n")
            if not block.strip():
                continue
            if m := re.fullmatch(r"\s*\$\$\s*(.*?)\s*\$\$\s*", block, re.DOTALL):
                add("math", "math", m[1], "")
                continue
            context = "paragraph"
            if m := re.match(r"(#{1,6})[ \t]+(.*)", block):
                block, context = m[2], "heading"
                add("text", "heading", block, "heading")
            for alt in re.findall(r"!\[([^\]]+)\]\([^)]*\)", block):
                add("text", "image", alt, "image-alt")
            bare = re.sub(r"!\[[^\]]*\]\([^)]*\)", "", block)
            for k, piece in inline_segments(bare):
                if k == "text" and piece.strip():
                    add("text", "text", piece, context)
    return out


EMPHASIS = re.compile(r"(?<!\\)(?P<mark>__?)(?=\S)(?P<inner>(?:(?!\n\n).)+?)(?<=\S)(?P=mark)", re.DOTALL)


def suspicious_emphasis(markdown: str) -> list[tuple[int, int, str]]:
    """(line, column, raw) of underscore emphasis that touches a letter or digit: mostly an identifier cut in two."""
    head, _ = front_matter(markdown)
    out, at = [], 0
    for kind, content in fence_segments(markdown):
        if kind == "text":
            inner = at
            for k, piece in inline_segments(content):
                if k == "text":
                    for m in EMPHASIS.finditer(piece):
                        start, end = inner + m.start(), inner + m.end()
                        around = markdown[start - 1 : start] + markdown[end : end + 1]
                        if start >= len(head) and re.search("[A-Za-z0-9]", around):
                            line = markdown.count("\n", 0, start) + 1
                            out.append((line, start - (markdown.rfind("\n", 0, start) + 1) + 1, " ".join(m[0].split())))
                inner += len(piece)
        at += len(content)
    return out


def _rows(f: Callable[[str], list[tuple]], columns: str):
    """A query of the rows that ``f`` finds in each article's Markdown."""
    names = [c.split()[0] for c in columns.split(", ")]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [(i, n, *row) for i, m in zip(pdf["article_id"], pdf["markdown"], strict=True) if isinstance(m, str) for n, row in enumerate(f(m))]
                yield pd.DataFrame(rows, columns=["article_id", "n", *names])

        return spread(read_table(spark, sf_dir, "article", "article_id", "markdown")).mapInPandas(run, f"article_id long, n int, {columns}")

    return query


def fixed_math(column: Column | str) -> Column:
    """``fix_math`` as a column expression; null texts stay null."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(fix_math, na_action="ignore")

    return run(column)


def fixed_captions(df: DataFrame) -> DataFrame:
    """Blocks (id, n, text) with captions behind an image paragraph set in italics."""
    from pyspark.sql.window import Window

    before = F.lag("text").over(Window.partitionBy("id").orderBy("n"))
    is_caption = F.coalesce(F.trim(before).rlike(r"^!\[[^\]]*\]\([^)]+\)$"), F.lit(False)) & text.caption(F.col("text"))
    return df.withColumn("fixed", is_caption).withColumn("text", F.when(F.col("fixed"), F.concat(F.lit("_"), F.trim("text"), F.lit("_"))).otherwise(F.col("text")))


def _caption_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the documents; images get a caption behind them where the next piece is prose."""
    piece = read_table(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n\n")).alias("n", "text"))
    named = piece.withColumn("text", F.when((F.col("n") % 2 == 1) & (F.length("text") < 100), F.concat(F.lit("Figure 1: "), "text")).otherwise(F.col("text")))
    return fixed_captions(named).select("id", F.col("n").cast("long").alias("n"), "text", "fixed")


@F.pandas_udf(T.StructType([T.StructField("markdown", T.StringType()), T.StructField("changes", T.LongType())]))
def _mathed(texts: pd.Series) -> pd.DataFrame:
    done = [fix_math_counted(t) if isinstance(t, str) else (None, 0) for t in texts]
    return pd.DataFrame({"markdown": [m for m, _ in done], "changes": [n for _, n in done]})


#: Pieces of a text: fenced blocks, runs of lines that hold something, and line feeds.
PIECES = FENCE + r"|(?:^(?! {0,3}(?:`{3,}|~{3,}))[^\n]+(?:\n|\z))+|\n"
_MARK = r"^ {0,3}(?:`{3,}|~{3,})"
_MATH_BLOCK = r"(?s)^\s*\$\$(.*?)\$\$\s*$"
_NO_PROSE = r"^(?:\s*$| {0,3}(?:`{3,}|~{3,})|\s*!\[[^\]]*\]\([^)]+\)\s*$|\s*(?:[-*_]\s*){3,}$|\s*\|)"
_LEAD = r"(?s)^(\s*(?:#{1,6}[ \t]+|>[ \t]?|[-*+][ \t]+|\d+[.)][ \t]+)?)"
STEPS = ("fences", "captions", "translation", "math", "cleanup")


def pipeline(df: DataFrame, id_column: str, markdown: str, translator: str | None = "mock", steps: tuple[str, ...] = STEPS) -> DataFrame:
    """The whole import of a text, and what was done: one row for each row of ``df``.

    Columns: id, markdown, language, changed, translated, code_fences_fixed, image_captions_fixed, math_patched,
    math_fallbacks (formulas whose translation is no formula become code), math_delimiters_fixed,
    empty_lines_compressed, frontmatter_updated.

    In order: fences without a language get one by their code; a numbered paragraph behind an image becomes
    its caption; English texts are translated piece by piece by ``translator`` (a name, None for none), and
    their front matter says so; formulas' delimiters and blank lines are put right. All but the formulas
    are JVM expressions over the pieces of the row itself, so nothing is shuffled. Null texts stay null and
    unchanged; repeated rows give repeated results.
    """
    source = df.select(F.col(id_column).cast("long").alias("id"), F.col(markdown).alias("original"))
    parts = source.withColumn("__parts", text.split_front_matter(F.col("original"))).select("id", "original", F.col("__parts.frontmatter").alias("head"), F.col("__parts.body").alias("body"))
    judged = text.with_ratios(parts, "body", "ratios").withColumn("pieces", F.regexp_extract_all("body", F.lit(PIECES), F.lit(0)))
    is_fence = lambda x: x.rlike(_MARK)

    def fenced(x: Column) -> Column:
        info = F.trim(F.regexp_extract(x, FENCE, 2))
        named = F.concat(F.regexp_extract(x, f"({_MARK})", 1), code.code_language(F.regexp_extract(x, FENCE, 3)), F.regexp_replace(x, _MARK + r"[ \t]*", ""))
        return F.when(is_fence(x) & (info == "") & x.contains("\n"), named).otherwise(x)

    def captioned(x: Column, i: Column) -> Column:
        before = F.when(F.get("__fenced", i - 1) == "\n", F.get("__fenced", i - 2))
        body = F.regexp_replace(x, r"\n$", "")
        hit = F.coalesce(F.trim(F.regexp_replace(before, r"\n$", "")).rlike(r"^!\[[^\]]*\]\([^)]+\)$"), F.lit(False)) & text.caption(body)
        return F.when(hit, F.concat(F.lit("_"), text.js_trim(body), F.lit("_"), F.when(x.endswith("\n"), "\n").otherwise(""))).otherwise(x)

    translate = sync.translator(translator) if translator and "translation" in steps else None
    wanted = text.should_translate(F.col("ratios")) if translate else F.lit(False)

    def translated(x: Column) -> Column:
        is_math = x.rlike(_MATH_BLOCK)
        lead = F.regexp_extract(x, _LEAD, 1)
        latex = translate(F.lit("math"), F.lit(None).cast("string"), text.js_trim(F.regexp_extract(x, _MATH_BLOCK, 1)))
        bad = text.math_problem(latex)
        math = F.when(bad.isNull(), F.concat(F.lit("$$\n"), latex, F.lit("\n$$\n"))).otherwise(F.concat(F.lit("```latex\n"), latex, F.lit("\n```\n")))
        prose = F.concat(lead, translate(F.lit("text"), F.substr(x, F.length(lead) + 1), F.lit(None).cast("string")))
        done = F.when(is_math, F.struct(math.alias("value"), F.when(bad.isNull(), "math").otherwise("fallback").alias("how"))).when(~x.rlike(_NO_PROSE), F.struct(prose.alias("value"), F.lit("text").alias("how")))
        return F.coalesce(done, F.struct(x.alias("value"), F.lit("none").alias("how")))

    kept = lambda x: F.struct(x.alias("value"), F.lit("none").alias("how"))
    named = judged.withColumn("__fenced", F.transform("pieces", fenced) if "fences" in steps else F.col("pieces"))
    shown = named.withColumn("__shown", F.transform("__fenced", captioned) if "captions" in steps else F.col("__fenced"))
    spoken = shown.withColumn("__wanted", wanted).withColumn("__spoken", F.when(F.col("__wanted"), F.transform("__shown", translated)).otherwise(F.transform("__shown", kept)) if translate else F.transform("__shown", kept))
    how = lambda kind: F.size(F.filter("__spoken", lambda p: p["how"] == kind)).cast("long")
    differ = lambda a, b: F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda x: x)).cast("long")
    lang = F.regexp_extract("head", r"(?m)^lang:[ \t]*['\"]?([\w-]*)", 1)
    is_new = F.col("__wanted") & ((how("text") + how("math") + how("fallback")) > 0)
    marks = F.lit("lang: zh\ntranslatedFrom: en\n")
    bare = F.regexp_replace("head", r"(?m)^(?:lang|translatedFrom):[^\n]*\n", "")
    head = F.when(F.col("head") == "", F.concat(F.lit("---\n"), marks, F.lit("---\n\n"))).otherwise(F.concat(F.regexp_replace(bare, r"\n---\z", "\n"), marks, F.lit("---")))
    counted = spoken.select(
        "id", "original", F.col("ratios.language").alias("language"), is_new.alias("translated"), (is_new & lang.isin("", "en")).alias("frontmatter_updated"),
        differ("pieces", "__fenced").alias("code_fences_fixed"), differ("__fenced", "__shown").alias("image_captions_fixed"), how("math").alias("math_patched"), how("fallback").alias("math_fallbacks"),
        head.alias("__new_head"), F.col("head"), F.array_join(F.transform("__spoken", lambda p: p["value"]), "").alias("__body"),
    )
    mathed = counted.withColumn("__m", _mathed("__body") if "math" in steps else F.struct(F.col("__body").alias("markdown"), F.lit(0).cast("long").alias("changes")))
    clean = mathed.withColumn("__clean", text.compress_lines(F.col("__m.markdown")) if "cleanup" in steps else F.col("__m.markdown"))
    out = F.concat(F.when(F.col("frontmatter_updated"), F.col("__new_head")).otherwise(F.col("head")), F.col("__clean"))
    runs = text.cleanup_count(F.col("__m.markdown")) if "cleanup" in steps else F.lit(0)
    numbers = ("code_fences_fixed", "image_captions_fixed", "math_patched", "math_fallbacks")
    return clean.select("id", out.alias("markdown"), "language", (~F.col("original").eqNullSafe(out)).alias("changed"), F.coalesce("translated", F.lit(False)).alias("translated"), *(F.coalesce(F.greatest(n, F.lit(0)), F.lit(0)).cast("long").alias(n) for n in numbers), F.coalesce("__m.changes", F.lit(0)).cast("long").alias("math_delimiters_fixed"), F.coalesce(runs, F.lit(0)).cast("long").alias("empty_lines_compressed"), F.coalesce("frontmatter_updated", F.lit(False)).alias("frontmatter_updated"))


QUERIES = {
    "frontmatter_parse": _rows(front_matter_fields, "key string, value string"),
    "win_fence_state": _rows(fence_segments, "kind string, content string"),
    "str_inline_code": _rows(inline_segments, "kind string, content string"),
    "str_math_delims": lambda s, d: read_table(s, d, "article", "article_id", "markdown").select("article_id", fixed_math("markdown").alias("markdown")),
    "md_extract_nodes": _rows(node_rows, "node_id string, kind string, value string, context string"),
    "md_node_text": _rows(lambda m: [(v,) for name, _, v, _ in node_rows(m) if name.endswith("_heading")], "value string"),
    "str_underscore_guard": _rows(suspicious_emphasis, "line int, col int, raw string"),
    "md_fix_captions": _caption_blocks,
    "md_pipeline": lambda s, d: pipeline(spread(read_table(s, d, "article", "article_id", "markdown")), "article_id", "markdown"),
    "md_pipeline_fences": lambda s, d: pipeline(spread(read_table(s, d, "article", "article_id", "markdown")), "article_id", "markdown", None, ("fences", "cleanup")).select("id", "language", "code_fences_fixed", "empty_lines_compressed"),
}
_CAPTIONS = r"""with b as (select doc_id as id, cast(unnest(range(0, len(l))) as bigint) as n, unnest(l) as t from (select doc_id, string_split(text, chr(10) || chr(10)) as l from documents)),
p as (select id, n, case when n % 2 = 1 and length(t) < 100 then 'Figure 1: ' || t else t end as t from b),
q as (select id, n, t, coalesce(regexp_matches(trim(lag(t) over (partition by id order by n)), '^!\[[^\]]*\]\([^)]+\)$'), false) and length(t) <= 120 and not regexp_matches(t, '^[#\-*>`]') and trim(t) <> '' and regexp_matches(trim(t), '(?i)^(figure\s+\d+|fig\.\s*\d+|table\s+\d+|image\s+\d+|图\s*\d+|表\s*\d+|\d+[:.：]\s*)') as fixed from p)
"""
# Fences without a language, by the marker that the tables use; blank runs; language by characters.
_PIPELINE = _RATIOS.replace("select article_id, regexp_replace", "select article_id, regexp_replace", 1) + r"""select article_id as id, language, cast(coalesce(len(list_filter(regexp_extract_all(markdown, '(?ms)^ {0,3}```([^\n`]*)\n(.*?)(?:^ {0,3}```[`~]*[ \t]*$|\z)'), lambda x: regexp_matches(x, '\A {0,3}```[ \t]*\n'))), 0) as bigint) as code_fences_fixed,
 cast(coalesce(len(regexp_extract_all(case when starts_with(markdown, '---') and p > 0 then substr(markdown, p + 7) else markdown end, '\n{3,}')), 0) as bigint) as empty_lines_compressed
 from l join (select article_id as i, markdown, strpos(substr(markdown, 4), chr(10) || '---') as p from article) on i = article_id"""
# Front matter and body, and the body's fences by the marker that the tables use.
_FENCED = r"(?ms)^[ \t]*```[^\n]*\n.*?(?:^[ \t]*```[^\n]*(?:\n|\z)|\z)"
_SPLIT = r"""with a as (select article_id, markdown, case when starts_with(markdown, '---') then strpos(substr(markdown, 4), chr(10) || '---') else 0 end as p from article where markdown is not null),
b as (select article_id, case when p > 0 then substr(markdown, 1, p + 6) else '' end as head, case when p > 0 then substr(markdown, p + 7) else markdown end as body from a)
"""
ORACLE = {
    "frontmatter_parse": r"""select article_id, cast(row_number() over (partition by article_id order by pos) - 1 as integer) as n, regexp_extract(line, '^([^\s:#][^:#]*):', 1) as key, case when v in ('true', 'false') then v else to_json(v)::varchar end as value
from (select *, trim(regexp_extract(line, '^[^\s:#][^:#]*:(.*)$', 1)) as v from (select article_id, unnest(range(0, len(l))) as pos, unnest(l) as line from (select article_id, string_split(substr(markdown, 5, strpos(substr(markdown, 4), chr(10) || '---') - 2), chr(10)) as l from article where starts_with(markdown, '---') and strpos(substr(markdown, 4), chr(10) || '---') > 0)) where regexp_matches(line, '^[^\s:#][^:#]*:'))""",
    "md_pipeline_fences": _PIPELINE,
    "md_fix_captions": _CAPTIONS + "select id, n, case when fixed then '_' || trim(t) || '_' else t end as text, fixed from q",
    "win_fence_state": _SPLIT + rf""", s as (select article_id, list_filter(list_prepend({{'kind': 'frontmatter', 'content': head}}, flatten(list_transform(list_zip(regexp_split_to_array(body, '{_FENCED}'), list_append(regexp_extract_all(body, '{_FENCED}'), '')), lambda z: [{{'kind': 'text', 'content': coalesce(z[1], '')}}, {{'kind': 'code', 'content': coalesce(z[2], '')}}]))), lambda x: x.content <> '') as l from b)
select article_id, cast(n as integer) as n, x.kind as kind, x.content as content from (select article_id, unnest(range(0, len(l))) as n, unnest(l) as x from s)""",
    "md_node_text": _SPLIT + rf""", s as (select article_id, list_transform(list_filter(list_transform(regexp_split_to_array(regexp_replace(body, '{_FENCED}', chr(10) || chr(10), 'g'), '\n[ \t]*\n'), lambda x: trim(x, chr(10))), lambda x: regexp_matches(x, '\A#{{1,6}}[ \t]+')), lambda x: regexp_extract(x, '\A#{{1,6}}[ \t]+([^\n]*)', 1)) as l from b)
select article_id, cast(unnest(range(0, len(l))) as integer) as n, unnest(l) as value from s where len(l) > 0""",
}
