"""Queries of text, address, code and log expressions over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import code, slugs, text, urls
from millrace.operators.tags import slug_sql
from millrace.plans.parallel import spread
from millrace.sources import read_table


def C(name: str) -> Column:
    return F.col(name)


def _over(table: str, *columns: str):
    """A query that selects expressions from whole ``table``."""

    def make(*expressions: Column, distinct: bool = False):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = spread(read_table(spark, sf_dir, table, *columns)).select(*expressions)
            return df.distinct() if distinct else df

        return run

    return make


#: A fenced block: its marker, what follows that, and the code.
FENCE = r"(?ms)^ {0,3}(`{3,}|~{3,})([^\n`]*)(?:\n(.*?)(?:^ {0,3}\1[`~]*[ \t]*$|\z)|\z)"


def fence_blocks(df: DataFrame, id_column: str, markdown: str) -> DataFrame:
    """(id, n, lang, meta, code) of the fenced blocks of each text, numbered in order.

    A fence is three or more backticks or tildes, indented by up to three spaces. It closes at a line of
    as many or more of its own sign and nothing else; an open one runs to the end. Null texts have none.
    """
    found = df.select(C(id_column).alias("id"), F.posexplode(F.regexp_extract_all(C(markdown), F.lit(FENCE), F.lit(0))).alias("n", "block"))
    info = F.trim(F.regexp_extract("block", FENCE, 2))
    return found.select("id", C("n").cast("long").alias("n"), F.regexp_extract(info, r"^(\S*)", 1).alias("lang"), F.trim(F.regexp_replace(info, r"^\S*", "")).alias("meta"), F.regexp_replace(F.regexp_extract("block", FENCE, 3), r"\n$", "").alias("code"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fence_blocks(spread(read_table(spark, sf_dir, "article", "article_id", "markdown")), "article_id", "markdown")


def _over_blocks(*expressions):
    return lambda s, d: _blocks(s, d).select("id", "n", *expressions)


def diagram_numbers(blocks: DataFrame, languages: tuple[str, ...] = ("mermaid",)) -> DataFrame:
    """(id, n, lang, nth): blocks in one of ``languages``, numbered from 0 among those of that language in their text.

    Diagrams are the blocks in mermaid.
    """
    named = blocks.select("id", "n", F.lower("lang").alias("lang")).where(C("lang").isin(*languages))
    return named.withColumn("nth", (F.row_number().over(Window.partitionBy("id", "lang").orderBy("n")) - 1).cast("long"))


def headings(df: DataFrame, id_column: str, markdown: str) -> DataFrame:
    """(id, pos, depth, text) of the headings of each text outside fences."""
    bare = F.regexp_replace(C(markdown), FENCE, "")
    lines = df.select(C(id_column).alias("id"), F.posexplode(F.regexp_extract_all(bare, F.lit(r"(?m)^#{1,6} +[^\n]+$"), F.lit(0))).alias("pos", "line"))
    words = F.regexp_replace(F.trim(F.regexp_replace("line", r"^#{1,6} +", "")), r"\s*¶\s*$", "")
    return lines.select("id", C("pos").cast("long").alias("pos"), F.length(F.regexp_extract("line", "^(#+)", 1)).cast("long").alias("depth"), words.alias("text"))


def heading_parents(rows: DataFrame) -> DataFrame:
    """(id, pos, depth, text, parent): the nearest heading in front that is less deep.

    For each depth the last position in front is a running maximum, so no row meets another: one
    window over a document's headings, not a join of them with themselves.
    """
    order = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(C("depth") == d, C("pos"))).over(order) for d in range(1, 6)]
    parent = F.greatest(F.lit(None).cast("long"), *(F.when(C("depth") > d + 1, p) for d, p in enumerate(last)))
    return rows.withColumn("parent", parent)


def _headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headings(spread(read_table(spark, sf_dir, "documents", "doc_id", "text")), "doc_id", "text")


def heading_slugs(rows: DataFrame) -> DataFrame:
    """Ids of headings, unique in their document: the nth of a slug gets ``-n``."""
    base = rows.withColumn("base", slugs.normalise_slug(C("text")))
    n = F.row_number().over(Window.partitionBy("id", "base").orderBy("pos")) - 1
    return base.withColumn("k", n).select("id", "pos", F.when(C("k") == 0, C("base")).otherwise(F.concat("base", F.lit("-"), C("k").cast("string"))).alias("slug"))


def agreed_line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line and column of each document's first link."""
    doc = read_table(spark, sf_dir, "documents", "doc_id", "text")
    at = F.locate("](", C("text"))
    before = F.substr(C("text"), F.lit(1), at - 1)
    line = F.regexp_count(before, F.lit("\n")) + 1
    column = F.length(F.regexp_extract(before, r"([^\n]*)\z", 1)) + 1
    return doc.where(at > 0).select("doc_id", line.cast("long").alias("line"), column.cast("long").alias("column"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "log_entry")


RANK = {"debug": 0, "info": 1, "warn": 2, "error": 3}


def level_rank(level: Column) -> Column:
    ranks = F.create_map(*(F.lit(x) for pair in RANK.items() for x in pair))
    return F.coalesce(ranks[F.lower(F.coalesce(level, F.lit("info")))], F.lit(1))


def logs_at_least(logs: DataFrame, level: str) -> DataFrame:
    """Entries at or above ``level``; unknown and missing levels are info."""
    return logs.where(level_rank(C("level")) >= RANK.get(level, 1))


# Signs of a blocked page in its title, its path and its visible text.
BLOCKED = {
    "login": (r"(?i)登录|login|sign.?in", r"(?i)\/(?:signin|login)(?:\/|$)", r"(?i)请先登录|登录后(?:继续|查看|访问|浏览)|登录知乎|使用(?:知乎)?账号登录|手机号登录"),
    "captcha": (r"(?i)验证|captcha|security.?check|human.?verification", r"(?i)\/(?:captcha|security-check|account\/unhuman)(?:\/|$)", r"(?i)安全验证|请完成.{0,10}验证|拖动.{0,20}滑块|验证码|captcha|security.?check|human.?verification|verify you are human"),
    "anti-spider": ("", "", r"(?i)反作弊|访问异常|请求存在异常|access.?denied"),
}
#: Characters of an article that is one whatever else the page says.
LEAST_ARTICLE = 100


def article_text(html: Column) -> Column:
    """Text of the first article element of a page, without tags; empty where there is none."""
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<article\b[^>]*>(.*?)</article>", 1), "<[^>]+>", ""))


def sync_counters(logs: DataFrame) -> DataFrame:
    """For each run: pages seen, processed, skipped and failed, and ``partial`` if any failed, else ``ok``. Re-delivered entries count once."""
    page, failed = C("event") == "sync.page", F.lower("level") == "error"
    counts = logs.dropDuplicates(["log_id"]).groupBy("runId").agg(
        F.count_if(page).alias("total_pages"), F.count_if(page & F.coalesce(C("status") == "ok", F.lit(False))).alias("processed"), F.count_if(C("event") == "image.skipped").alias("skipped"), F.count_if(F.coalesce(failed, F.lit(False))).alias("errors")
    )
    return counts.withColumn("status", F.when(C("errors") > 0, "partial").otherwise("ok"))


def blocked_reason(title: Column, path: Column, visible: Column, has_article: Column) -> Column:
    """Why a page is no article: login, captcha or anti-spider; null where it has one or nothing is found."""
    of = lambda kind: title.rlike(BLOCKED[kind][0]) | path.rlike(BLOCKED[kind][1]) | visible.rlike(BLOCKED[kind][2])
    login, human, spider = of("login"), of("captcha"), visible.rlike(BLOCKED["anti-spider"][2])
    return F.when(has_article, F.lit(None).cast("string")).when(login, "login").when(human, "captcha").when(spider, "anti-spider")


def srcset_score(descriptor: Column) -> Column:
    """Width, density times 1000, or the number itself; -1 for none."""
    number = F.regexp_extract(descriptor, r"^([\d.]+)", 1).try_cast("double")
    return F.coalesce(F.when(descriptor.endswith("x"), number * 1000).otherwise(number), F.lit(-1.0))


def best_source(srcset: Column) -> Column:
    """Address of the largest candidate of a srcset; the first of equals."""
    entries = F.transform(F.split(srcset, r",\s+"), lambda e, i: F.struct(srcset_score(F.regexp_extract(F.trim(e), r"\s(\S+)$", 1)).alias("score"), (-i).alias("i"), F.split(F.trim(e), r"\s+")[0].alias("url")))
    return F.array_max(entries)["url"]


def image_placeholder(content_type: Column, size: Column, width: Column, height: Column) -> Column:
    """Not an image, empty, or small in bytes and in pixels."""
    small = (size < 60 * 1024) & (width.isNull() | height.isNull() | (width < 200) | (height < 150))
    return F.coalesce(~content_type.startswith("image/"), F.lit(True)) | (size == 0) | small


def built() -> dict[str, Callable[[], Callable[[SparkSession, str], DataFrame]]]:
    """What makes each query, by name. Expressions need a session, so a query's are made when it runs, and only its own."""
    TRACKED = F.concat(C("canonicalUrl"), F.when(C("canonicalUrl").contains("?"), "&").otherwise("?"), F.lit("UTM_Source=feed&view=full&share_code=abc"))
    SECRET = F.concat(C("canonicalUrl"), F.lit("?token="), F.md5("canonicalUrl"), F.lit(" Bearer  "), F.md5("title"), F.lit("; sid="), F.md5("canonicalUrl"))
    META = F.concat(F.lit('title="'), C("site"), F.lit('" {'), (C("article_id") % 7 + 1).cast("string"), F.lit("-3,9} nolines x"))
    _article = _over("article", "article_id", "title", "markdown", "canonicalUrl", "source", "site", "images", "cover", "author", "tags", "publishedAt")
    _page = _over("extracted_article", "page_id", "url", "html", "baseUrl", "title")
    _doc = _over("documents", "doc_id", "text", "title")
    I, D, G = C("article_id"), C("doc_id"), C("page_id")
    M, U, T = C("markdown"), C("canonicalUrl"), C("text")
    _words, _minutes = text.reading_stats(T)
    _ext_mime = F.when(I % 3 == 0, "image/webp; q=1").when(I % 3 == 1, "text/html")
    _img = F.get(C("images"), F.lit(0))["url"]

    return {
        # addresses and adapters
        "adapter_resolve": lambda: _article(I, urls.provider(U).alias("provider")),
        "match_zhihu": lambda: _article(I, urls.is_zhihu(U).alias("zhihu")),
        "match_medium": lambda: _article(I, urls.is_medium(U).alias("medium")),
        "match_wechat": lambda: _article(I, urls.is_wechat(U).alias("wechat")),
        "match_others": lambda: _article(I, F.lit(True).alias("others")),
        "reject_arxiv": lambda: _article(I, urls.is_arxiv(F.concat(F.lit("https://arxiv.org/"), F.when(I % 2 == 0, "pdf").otherwise("list"), F.lit("/"), I.cast("string"))).alias("arxiv")),
        "reject_pdf": lambda: _article(I, urls.is_pdf(F.concat(U, F.when(I % 2 == 0, ".PDF/").otherwise("x"))).alias("pdf")),
        "zhihu_entity_link": lambda: _article(I, urls.is_entity_link(F.when(I % 2 == 0, F.lit("https://zhida.zhihu.com/search?q=a&zhida_source=entity")).otherwise(U)).alias("entity")),
        "zhihu_keywords": lambda: _article(I, F.array_join(F.array_distinct(F.filter(F.transform(F.split(F.regexp_replace("title", " ", ","), "[,，]"), text.js_trim), lambda x: x != "")), "|").alias("keywords")),
        "zhihu_date": lambda: _article(I, F.when(C("publishedAt").rlike(r"^\d{4}-\d\d-\d\dT[\d:.]+(Z|[+-]\d\d:\d\d)$"), F.date_format(F.from_utc_timestamp(F.regexp_replace("publishedAt", r"T(\d\d:\d\d)(?=[Z+-])", "T$1:00").try_cast("timestamp"), "Asia/Shanghai"), "yyyy-MM-dd")).otherwise(F.regexp_extract("publishedAt", r"^(\d{4}-\d\d-\d\d)", 1)).alias("day")),
        "zhihu_blocked": lambda: lambda s, d: read_table(s, d, "extracted_article", "page_id", "title", "url", "html").select("page_id", blocked_reason(C("title"), urls.part(C("url"), "PATH"), F.regexp_replace(text.strip_scripts(C("html")), "<[^>]+>", " "), F.length(article_text(C("html"))) >= LEAST_ARTICLE).alias("reason")),
        "str_sanitize_url": lambda: _article(I, urls.sanitise_url(F.concat(U, F.lit("?a=1&utm_source=x&b=2#c"))).alias("url")),
        "str_import_url": lambda: _article(I, urls.import_url(F.concat(F.lit(" "), TRACKED)).alias("url")),
        "sort_query_params": lambda: _article(I, urls.import_url(F.concat(F.regexp_extract(U, "^([^?#]*)", 1), F.lit("?z=1&b=2&a=3&b=1"))).alias("url")),
        "str_import_owner": lambda: _article(I, urls.import_owner(C("source"), U).alias("owner")),
        "str_normalize_url": lambda: _page(G, urls.normalise_url(F.regexp_extract("html", r'href="([^"]*)"', 1), C("baseUrl")).alias("url")),
        "str_normalize_base": lambda: _page(G, urls.normalise_base(C("baseUrl")).alias("base")),
        "str_normalize_base_site": lambda: _page(G, urls.normalise_site_base(F.regexp_extract("url", r"^https?://[^/]+/(\w+)", 1)).alias("base")),
        "str_prefix_images": lambda: _article(I, urls.prefix_images(M, "/site").alias("markdown")),
        "str_external_link": lambda: _page(G, urls.is_external(F.regexp_extract("html", r'href="([^"]*)"', 1)).alias("external")),
        "rewrite_paths": lambda: _article(I, F.replace(M, F.lit("/images/"), F.lit("/media/")).alias("markdown")),
        "wechat_placeholder_guard": lambda: _article(I, F.coalesce(M.contains("data:image/svg+xml"), F.lit(False)).alias("rejected")),
        # names
        "str_normalize_slug": lambda: _article(I, slugs.normalise_slug(C("title")).alias("slug")),
        "str_slug_from_title": lambda: _article(I, slugs.slug_from_title(F.lit(None).cast("string"), C("title"), C("site")).alias("slug")),
        "str_latin_slug": lambda: _article(I, slugs.latin_slug(C("title"), {"缓": "huan", "存": "cun", "图": "tu", "片": "pian", "的": "de"}).alias("slug")),
        "str_slug_from_stem": lambda: lambda s, d: read_table(s, d, "post", "id", "updated").select("id", "updated", slugs.normalise_slug(F.regexp_extract("id", r"([^/]+)\.md$", 1)).alias("slug")),
        "str_short_hash": lambda: _article(I, slugs.short_hash(U).alias("hash")),
        "str_image_name": lambda: _article(I, F.when(_img.isNotNull(), slugs.image_name(F.lit(0), _img)).alias("name")),
        "str_image_ext": lambda: _article(I, slugs.image_extension(_ext_mime, F.coalesce(_img, U)).alias("ext")),
        "str_image_ext_notion": lambda: _article(I, slugs.image_extension_by_url(_ext_mime, F.coalesce(_img, U)).alias("ext")),
        "str_safe_image_id": lambda: _article(I, slugs.safe_image_id(C("title")).alias("image_id")),
        # texts
        "str_invisible": lambda: _article(I, text.normalise_invisible(M).alias("markdown")),
        "str_unescape_math": lambda: _article(I, text.unescape_math(F.concat(F.lit(r"\$\$"), M, F.lit(r"\$"))).alias("markdown")),
        "str_sanitize_mdx": lambda: _article(I, text.sanitise_mdx(F.concat(F.lit("<"), U, F.lit("> <!-- -->"), M)).alias("markdown")),
        "str_compress_lines": lambda: _doc(D, text.compress_lines(T).alias("text")),
        "agg_cleanup_count": lambda: _doc(D, text.cleanup_count(T).cast("long").alias("n_runs")),
        "str_reading_time": lambda: _doc(D, _words.alias("words"), _minutes.alias("minutes")),
        "str_detect_lang": lambda: _article(I, text.text_content(M).alias("text")),
        "agg_lang_ratio": lambda: lambda s, d: text.with_ratios(spread(read_table(s, d, "article", "article_id", "markdown")), "markdown", "r").select("article_id", C("r.language").alias("language"), F.round("r.confidence", 6).alias("confidence"), F.round("r.englishRatio", 6).alias("english_ratio"), F.round("r.chineseRatio", 6).alias("chinese_ratio")),
        "should_translate": lambda: lambda s, d: text.with_ratios(spread(read_table(s, d, "article", "article_id", "markdown")), "markdown", "r").select("article_id", text.should_translate(C("r")).alias("translate")),
        "strip_script": lambda: _page(G, text.strip_scripts(C("html")).alias("html")),
        "str_callout": lambda: _doc(D, text.strip_callout(F.concat(F.lit("📌 "), T)).alias("text")),
        "str_base64": lambda: _article(I, text.base64_text(C("title")).alias("encoded"), text.unbase64_text(text.base64_text(C("title"))).alias("decoded")),
        "str_json_escape": lambda: _article(I, text.json_escape(M).alias("escaped")),
        "str_truncate_hash": lambda: _article(I, text.truncate_with_hash(U, 40).alias("url")),
        "str_excerpt": lambda: lambda s, d: spread(read_table(s, d, "documents", "doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).where(~text.blank(C("line"))).select("doc_id", C("n").cast("long").alias("n"), F.regexp_replace(text.js_trim(C("line")), r"(?U)\s+", " ").alias("excerpt")),
        "str_body_offset": lambda: _doc(D, text.front_matter_end(T).cast("long").alias("offset")),
        "frontmatter_split": lambda: _doc(D, text.split_front_matter(T)["body"].alias("body")),
        "win_line_offset": lambda: agreed_line_offsets,
        "caption_predicate": lambda: lambda s, d: spread(read_table(s, d, "documents", "doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("n", "p")).select("doc_id", C("n").cast("long").alias("n"), text.caption(F.concat(F.when(C("n") % 2 == 0, "Figure 3: ").otherwise(""), C("p"))).alias("caption")),
        "sink_change_only": lambda: _article(I, text.compress_lines(text.normalise_invisible(M)).alias("markdown"), M.alias("old")),
        # code
        "str_code_lang": lambda: _over_blocks(code.code_language(C("code")).alias("lang")),
        "agg_code_scores": lambda: _over_blocks(*(v.cast("long").alias(k) for k, v in code.code_scores(C("code")).items())),
        "sort_priority": lambda: _over_blocks(code.code_language(C("code")).alias("lang"), C("lang").alias("given")),
        "gha_predicate": lambda: _over_blocks(code.is_workflow(C("code")).alias("workflow")),
        "str_code_alias": lambda: _over_blocks(code.code_alias(C("lang")).alias("lang")),
        "str_code_trim": lambda: _over_blocks(text.trim_code(C("code")).alias("code")),
        "md_fix_fences": lambda: _over_blocks(F.when(C("lang") == "", code.code_language(C("code"))).otherwise(C("lang")).alias("lang"), (C("lang") == "").alias("fixed")),
        "win_mermaid_index": lambda: lambda s, d: diagram_numbers(_blocks(s, d), ("mermaid", "html", "yaml")),  # the tables have no mermaid
        "win_line_number": lambda: lambda s, d: _blocks(s, d).select("id", "n", F.posexplode(F.split("code", "\n")).alias("at", "line")).select("id", "n", (C("at") + 1).cast("long").alias("line_no"), "line"),
        "str_code_meta": lambda: _article(I, code.code_meta(META)["title"].alias("title"), code.code_meta(META)["showLineNumbers"].alias("line_numbers"), F.array_join(code.code_meta(META)["highlights"], ",").alias("highlights"), code.code_meta(META)["meta"].alias("meta")),
        "str_highlight_set": lambda: _article(I, F.array_join(code.highlight_set(F.concat(I.cast("string"), F.lit(", 3,x,-1,3"))), ",").alias("lines")),
        # headings
        "filter_toc_depth": lambda: lambda s, d: _headings(s, d).where(C("depth").between(2, 3)),
        "win_toc_parent": lambda: lambda s, d: heading_parents(_headings(s, d)).select("id", "pos", "depth", "parent"),
        "win_toc_flatten": lambda: lambda s, d: _headings(s, d).select("id", "pos", "text"),
        "win_heading_slug": lambda: lambda s, d: heading_slugs(_headings(s, d)),
        "agg_min_heading": lambda: lambda s, d: _headings(s, d).groupBy("id").agg(F.min("depth").alias("least")),
        "win_blank_streak": lambda: lambda s, d: spread(read_table(s, d, "documents", "doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("before", F.lag("line").over(Window.partitionBy("doc_id").orderBy("n"))).where(~((F.trim("line") == "") & (F.trim(F.coalesce("before", F.lit("x"))) == ""))).select("doc_id", C("n").cast("long").alias("n"), "line"),
        # logs
        "filter_log_level": lambda: lambda s, d: logs_at_least(_log(s, d), "warn").select("log_id", "ingested_at", "level"),
        "sensitive_key": lambda: lambda s, d: _log(s, d).where(C("fields").isNotNull()).select("log_id", "ingested_at", F.explode(F.map_keys("fields")).alias("key")).withColumn("sensitive", code.is_sensitive(F.concat("key", F.when(C("log_id") % 2 == 0, "Token").otherwise("")))),
        "str_redact_value": lambda: _article(I, code.redact_value(SECRET).alias("value")),
        "map_redact_fields": lambda: lambda s, d: _log(s, d).where(C("fields").isNotNull()).select("log_id", "ingested_at", F.to_json(code.redact_fields(F.map_concat("fields", F.map_from_arrays(F.array(F.lit("authToken")), F.array(F.md5("msg")))))).alias("fields")),
        "map_redact_nested": lambda: lambda s, d: _log(s, d).where(C("fields").isNotNull()).select("log_id", "ingested_at", F.to_json(F.transform_values("fields", lambda k, v: code.redact_value(v))).alias("fields")),
        "map_sanitize_error": lambda: lambda s, d: _log(s, d).where(F.lower("level") == "error").select("log_id", "ingested_at", F.to_json(F.struct(code.redact_value(C("msg")).alias("message"), C("event").alias("name"))).alias("error")),
        "map_serialize_error": lambda: lambda s, d: _log(s, d).where(F.lower("level") == "error").select("log_id", "ingested_at", F.to_json(F.struct(C("msg").alias("message"), F.struct(C("event").alias("message"), F.struct(C("script").alias("message")).alias("cause")).alias("cause"))).alias("error")),
        "str_fields_pretty": lambda: lambda s, d: _log(s, d).where(C("fields").isNotNull()).select("log_id", "ingested_at", code.fields_pretty(C("fields")).alias("pretty")),
        "str_duration": lambda: lambda s, d: _log(s, d).where(C("durationMs").isNotNull()).select("log_id", "ingested_at", text.duration_label(C("durationMs")).alias("label")),
        "str_to_boolean": lambda: lambda s, d: _log(s, d).select("log_id", "ingested_at", text.to_boolean(F.when(C("status") == "ok", " Yes").when(C("status") == "partial", "off").otherwise(C("status"))).alias("flag")),
        "sink_jsonl_log": lambda: lambda s, d: _log(s, d).select("log_id", "ingested_at", F.to_json(F.struct("ts", "level", code.redact_value(C("msg")).alias("msg"), "runId", "script", "event", "durationMs", "status", code.redact_fields(C("fields")).alias("fields"))).alias("line")),
        "agg_sync_counters": lambda: lambda s, d: sync_counters(_log(s, d)),
        "agg_img_counts": lambda: lambda s, d: _log(s, d).agg(F.count_if(C("event") == "image.saved").alias("succeeded"), F.count_if(C("event") == "image.skipped").alias("failed"), F.count_if(C("event").startswith("image.")).alias("total")),
        # numbers
        "math_srcset_score": lambda: _article(I, srcset_score(F.when(I % 3 == 0, F.concat((I % 900).cast("string"), F.lit("w"))).when(I % 3 == 1, F.lit("1.5x")).otherwise("big")).alias("score")),
        "sort_srcset": lambda: _article(I, best_source(F.concat(U, F.lit(" 320w, "), U, F.lit("/l 2x, "), U, F.lit("/m 640w"))).alias("url")),
        "math_backoff": lambda: _article(I, F.least(F.lit(1000) * F.pow(F.lit(2), I % 6), F.lit(10000)).cast("long").alias("delay_ms")),
        "project_chapter_label": lambda: _article(I, F.when(I % 13 == 0, "导论").otherwise(F.concat(F.lit("第 "), (I % 13).cast("string"), F.lit(" 章"))).alias("label")),
        "project_source_url": lambda: _article(I, F.concat(F.lit("https://"), C("site"), F.lit("/blob/"), F.sha1("site"), F.lit("/"), slugs.normalise_slug(C("title")), F.lit(".md")).alias("url")),
        "project_frontmatter": lambda: _article(I, F.coalesce(text.none_if_blank(C("title")), F.lit("Untitled")).alias("title"), F.coalesce(C("author"), urls.host(U)).alias("author")),
        "image_placeholder": lambda: _article(I, image_placeholder(F.when(I % 4 == 0, "text/html").otherwise("image/png"), I * 40 % 90000, I % 400, I % 300).alias("placeholder")),
    }


NAMES = tuple(
    """
    adapter_resolve match_zhihu match_medium match_wechat match_others reject_arxiv reject_pdf zhihu_entity_link zhihu_keywords zhihu_date zhihu_blocked
    str_sanitize_url str_import_url sort_query_params str_import_owner str_normalize_url str_normalize_base str_normalize_base_site str_prefix_images
    str_external_link rewrite_paths wechat_placeholder_guard str_normalize_slug str_slug_from_title str_latin_slug str_slug_from_stem str_short_hash str_image_name
    str_image_ext str_image_ext_notion str_safe_image_id str_invisible str_unescape_math str_sanitize_mdx str_compress_lines agg_cleanup_count
    str_reading_time str_detect_lang agg_lang_ratio should_translate strip_script str_callout str_base64 str_json_escape str_truncate_hash str_excerpt
    str_body_offset frontmatter_split win_line_offset caption_predicate sink_change_only str_code_lang agg_code_scores sort_priority gha_predicate
    str_code_alias str_code_trim md_fix_fences win_mermaid_index win_line_number str_code_meta str_highlight_set filter_toc_depth win_toc_parent
    win_toc_flatten win_heading_slug agg_min_heading win_blank_streak filter_log_level sensitive_key str_redact_value map_redact_fields map_redact_nested
    map_sanitize_error map_serialize_error str_fields_pretty str_duration str_to_boolean sink_jsonl_log agg_sync_counters agg_img_counts math_srcset_score
    sort_srcset math_backoff project_chapter_label project_source_url project_frontmatter image_placeholder
    """.split()
)
QUERIES = {name: (lambda spark, sf_dir, name=name: built()[name]()(spark, sf_dir)) for name in NAMES}

_N = "chr(10)"
_CONTENT = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(markdown, '\A---\n[\s\S]*?\n---\n', ''), '```[\s\S]*?```', '', 'g'), '`[^`\n]+`', '', 'g'), 'https?://[^\s)]+', '', 'g'), '!\[([^\]]*)\]\([^)]+\)', '\1', 'g'), '\[([^\]]*)\]\([^)]+\)', '\1', 'g')"
_RATIOS = rf"""with c as (select article_id, {_CONTENT} as t from article), n as (select article_id, length(regexp_replace(t, '[^A-Za-z0-9_\x{{4e00}}-\x{{9fff}}]', '', 'g')) as total, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) as en, length(regexp_replace(t, '[^\x{{4e00}}-\x{{9fff}}]', '', 'g')) as zh from c),
r as (select article_id, case when total >= 10 then en / cast(total as double) else 0.0 end as e, case when total >= 10 then zh / cast(total as double) else 0.0 end as z from n),
l as (select article_id, e, z, case when e >= 0.6 then 'en' when z >= 0.6 then 'zh' when e > z then 'en' when z > e then 'zh' else 'unknown' end as language, case when e = z then 0.0 when e >= 0.6 then e when z >= 0.6 then z else greatest(e, z) end as confidence from r)
"""
_HOST = "lower(regexp_extract(canonicalUrl, '^https?://([^/?#:]+)', 1))"
_ON = lambda name: f"({_HOST} = '{name}' or ends_with({_HOST}, '.{name}'))"
_ZHIHU = f"({_ON('zhihu.com')} and contains(canonicalUrl, 'zhuanlan.zhihu.com/p/'))"
_H = r"""with b as (select doc_id as id, regexp_extract_all(regexp_replace(text, '(?ms)^ {0,3}```([^\n`]*)\n(.*?)(?:^ {0,3}```[`~]*[ \t]*$|\z)', '', 'g'), '(?m)^#{1,6} +[^\n]+$') as l from documents),
h as (select id, cast(unnest(range(0, len(l))) as bigint) as pos, unnest(l) as line from b where len(l) > 0),
x as (select id, pos, cast(length(regexp_extract(line, '^(#+)', 1)) as bigint) as depth, regexp_replace(trim(regexp_replace(line, '^#{1,6} +', '')), '\s*¶\s*$', '') as text from h)
"""
# RE2 has no back references; the tables' fences are of three backticks (four in none), so the marker is spelled out.
_FORM = r"(?ms)^ {0,3}```([^\n`]*)\n(.*?)(?:^ {0,3}```[`~]*[ \t]*$|\z)"
_B = rf"""with f as (select article_id as id, regexp_extract_all(markdown, '{_FORM}') as l from article where markdown is not null),
g as (select id, cast(unnest(range(0, len(l))) as bigint) as n, unnest(l) as block from f where len(l) > 0),
k as (select id, n, trim(regexp_extract(block, '{_FORM}', 1)) as info, regexp_replace(regexp_extract(block, '{_FORM}', 2), '\n\z', '') as code from g),
c as (select id, n, regexp_extract(info, '^(\S*)', 1) as lang, code from k)
"""


def _signs(lang: str) -> str:
    """SQL that counts a language's signs in ``code``."""
    quoted = [sign.replace("'", "''") for sign in code.LANGUAGE_SIGNS[lang]]
    return " + ".join(f"cast(regexp_matches(code, '{q}') as bigint)" for q in quoted)


_SCORES = ", ".join(f"{_signs(lang)} as {lang}" for lang in code.LANGUAGE_SIGNS)
_WORKFLOW = r"((regexp_matches(code, '(?m)^name:\s*.+$') or regexp_matches(code, '(?m)^on:\s*$') or regexp_matches(code, '(?m)^on:\s+\[')) and (regexp_matches(code, '(?m)^jobs:\s*$') or regexp_matches(code, '(?m)^\s+steps:\s*$')))"
_BEST = "case " + " ".join(f"when {lang} = best then '{lang}'" for lang in code.LANGUAGE_SIGNS) + " end"
_CODE_LANG = _B + rf""", s as (select *, greatest({", ".join(code.LANGUAGE_SIGNS)}) as best from (select *, {_SCORES} from c)),
d as (select id, n, lang as given, code, case when trim(code, ' ' || chr(10) || chr(9) || chr(13)) = '' then 'text' when regexp_matches(trim(code, ' ' || chr(10)), '(?i)\A#!\s*/[^\n]*python[23]?') then 'python' when regexp_matches(trim(code, ' ' || chr(10)), '(?i)\A#!\s*/(bin/)?(ba)?sh') then 'bash'
 when {_WORKFLOW} then 'yaml' when best > 0 then {_BEST} else 'text' end as lang from s)
"""
_ALIAS = "case " + " ".join(f"when lang = '{a}' then '{b}'" for a, b in code.ALIASES.items()) + " when lang in (" + ", ".join(f"'{x}'" for x in code.KNOWN) + ") then lang else 'text' end"
_SPACES = " || ".join(f"chr({ord(c)})" for c in text.WIDE_SPACES)
_GONE = " || ".join(f"chr({ord(c)})" for c in text.DROPPED)
_INVISIBLE = f"translate(markdown, {_SPACES} || {_GONE}, repeat(' ', {len(text.WIDE_SPACES)}))"
_LEVEL = "case lower(coalesce(level, 'info')) when 'debug' then 0 when 'warn' then 2 when 'error' then 3 else 1 end"
_SECRET = "canonicalUrl || '?token=' || md5(canonicalUrl) || ' Bearer  ' || md5(title) || '; sid=' || md5(canonicalUrl)"
_URL_EXT = "nullif(lower(regexp_extract(regexp_replace(u, '[?#].*$', ''), '(?i)(\\.(?:jpe?g|png|webp|gif|bmp|avif|svg))$', 1)), '')"
_IMG = "(select article_id, case when article_id % 3 = 0 then '.webp' end as m, coalesce(images[1].url, canonicalUrl) as u from article)"
_VISIBLE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>', '', 'g'), '(?is)<style\b[^>]*>.*?</style>', '', 'g'), '(?is)<noscript\b[^>]*>.*?</noscript>', '', 'g'), '(?is)<template\b[^>]*>.*?</template>', '', 'g'), '<[^>]+>', ' ', 'g')"
def _kept(u: str, test: str) -> str:
    """SQL of an address's parameters that pass a test of their name ``k``."""
    return f"list_filter(list_filter(string_split(regexp_extract({u}, '\\?([^#]*)', 1), '&'), lambda p: p <> ''), lambda p: {test.replace('k', 'string_split(p, ' + chr(39) + '=' + chr(39) + ')[1]')})"


def _rebuilt(u: str, kept: str) -> str:
    return f"case when contains({u}, '?') then regexp_extract({u}, '^([^?#]*)', 1) || case when len({kept}) > 0 then '?' || array_to_string({kept}, '&') else '' end || regexp_extract({u}, '(#.*)$', 1) else {u} end"


_TRACKED = "(" + ", ".join(f"'{x}'" for x in urls.TRACKING) + ")"
_IMPORTED = _kept("u", f"not (starts_with(lower(k), 'utm_') or lower(k) in {_TRACKED})")
_IMPORTED = f"list_transform(list_sort(list_transform(list_zip({_IMPORTED}, range(1, len({_IMPORTED}) + 1)), lambda z: {{'k': string_split(z[1], '=')[1], 'i': z[2], 'p': z[1]}})), lambda s: s.p)"


def _redacted(x: str) -> str:
    """SQL of a value without its secrets."""
    return rf"regexp_replace(regexp_replace(regexp_replace({x}, '(?i)([?&])(token|secret|password|auth|apikey|api_key|key)=([^&\s]+)', '\1\2=[REDACTED]', 'g'), '(?i)Bearer\s+([\w\-.~+/=]{{6}})[\w\-.~+/=]+([\w\-.~+/=]{{4}})', 'Bearer \1...\2', 'g'), '([a-zA-Z0-9_-]+)=([^;,\s&=]{{6}})[^;,\s&=]+([^;,\s&=]{{4}})', '\1=\2...\3', 'g')"


_IS_SENSITIVE = "regexp_matches(e.key, '(?i)" + "|".join(code.SENSITIVE) + "')"
_FIELDS = f"list_transform(map_entries(fields), lambda e: cast(to_json(e.key) as varchar) || ':' || coalesce(cast(to_json(case when {_IS_SENSITIVE} then '[REDACTED]' else {_redacted('e.value')} end) as varchar), 'null'))"
_MORE_ORACLE = {
    "str_sanitize_url": f"select article_id, {_rebuilt('u', _kept('u', f'k not in {_TRACKED}'))} as url from (select article_id, canonicalUrl || '?a=1&utm_source=x&b=2#c' as u from article)",
    "str_import_url": f"select article_id, {_rebuilt('u', _IMPORTED)} as url from (select article_id, trim(canonicalUrl || case when contains(canonicalUrl, '?') then '&' else '?' end || 'UTM_Source=feed&view=full&share_code=abc') as u from article)",
    "sort_query_params": "select article_id, regexp_extract(canonicalUrl, '^([^?#]*)', 1) || '?a=3&b=2&b=1&z=1' as url from article",
    "str_import_owner": f"select article_id, 'import:' || lower(trim(source)) || ':' || {_rebuilt('u', _IMPORTED)} as owner from (select article_id, source, trim(canonicalUrl) as u from article)",
    "str_latin_slug": f"select article_id, case when {slug_sql('title')} <> '' then {slug_sql('title')} else {slug_sql('spelled')} end as slug from (select article_id, title, replace(replace(replace(replace(replace(title, '缓', ' huan '), '存', ' cun '), '图', ' tu '), '片', ' pian '), '的', ' de ') as spelled from article)",
    "map_redact_fields": f"select log_id, ingested_at, '{{' || array_to_string(list_append({_FIELDS}, '\"authToken\":\"[REDACTED]\"'), ',') || '}}' as fields from log_entry where fields is not null",
    "map_redact_nested": f"select log_id, ingested_at, '{{' || array_to_string({_FIELDS.replace(_IS_SENSITIVE, 'false')}, ',') || '}}' as fields from log_entry where fields is not null",
    "map_sanitize_error": f"""select log_id, ingested_at, '{{' || concat_ws(',', '"message":' || cast(to_json({_redacted("msg")}) as varchar), '"name":' || cast(to_json(event) as varchar)) || '}}' as error from log_entry where lower(level) = 'error'""",
    "map_serialize_error": """select log_id, ingested_at, '{' || concat_ws(',', '"message":' || cast(to_json(msg) as varchar), '"cause":{' || concat_ws(',', '"message":' || cast(to_json(event) as varchar), '"cause":{' || coalesce('"message":' || cast(to_json(script) as varchar), '') || '}') || '}') || '}' as error from log_entry where lower(level) = 'error'""",
    "sink_jsonl_log": f"""select log_id, ingested_at, '{{' || concat_ws(',', '"ts":' || cast(to_json(ts) as varchar), '"level":' || cast(to_json(level) as varchar), '"msg":' || cast(to_json({_redacted("msg")}) as varchar), '"runId":' || cast(to_json(runId) as varchar), '"script":' || cast(to_json(script) as varchar), '"event":' || cast(to_json(event) as varchar), '"durationMs":' || durationMs, '"status":' || cast(to_json(status) as varchar),
 case when fields is not null then '"fields":{{' || array_to_string({_FIELDS}, ',') || '}}' end) || '}}' as line from log_entry""",
}
ORACLE = {
    "zhihu_blocked": f"""select page_id, case when a >= 100 then null when regexp_matches(title, '{BLOCKED["login"][0]}') or regexp_matches(path, '{BLOCKED["login"][1]}') or regexp_matches(v, '{BLOCKED["login"][2]}') then 'login'
 when regexp_matches(title, '{BLOCKED["captcha"][0]}') or regexp_matches(path, '{BLOCKED["captcha"][1]}') or regexp_matches(v, '{BLOCKED["captcha"][2]}') then 'captcha'
 when regexp_matches(v, '{BLOCKED["anti-spider"][2]}') then 'anti-spider' end as reason from (select page_id, title, length(trim(regexp_replace(regexp_extract(html, '(?is)<article\\b[^>]*>(.*?)</article>', 1), '<[^>]+>', '', 'g'))) as a, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) as path, {_VISIBLE} as v from extracted_article)""",
    "str_normalize_url": """select page_id, case when h = '' then '' when starts_with(h, '//') then 'https:' || h when regexp_matches(h, '(?i)^https?://') then h when starts_with(h, '/') then o || h else o || '/' || h end as url
from (select page_id, regexp_extract(html, 'href="([^"]*)"', 1) as h, regexp_extract(baseUrl, '^(https?://[^/?#]+)', 1) as o from extracted_article)""",
    "str_truncate_hash": """select article_id, case when length(u) <= 40 then u else substr(u, 1, 40) || '... [truncated, hash: ' || substr(printf('%x', abs(h)), 1, 8) || ']' end as url
from (select article_id, canonicalUrl as u, list_reduce(list_prepend(cast(0 as bigint), list_transform(string_split(canonicalUrl, ''), lambda c: cast(ascii(c) as bigint))), lambda a, x: ((a * 31 + x + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) as h from article)""",
    "zhihu_keywords": f"select article_id, array_to_string(list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda z: list_position(l, z[1]) = z[2]), lambda z: z[1]), '|') as keywords from (select article_id, list_filter(list_transform(regexp_split_to_array(replace(title, ' ', ','), '[,，]'), lambda x: trim(x, {_SPACES} || ' ' || chr(10) || chr(9) || chr(65279) || chr(8287))), lambda x: x <> '') as l from article)",
    "str_highlight_set": "select article_id, case when article_id = 3 then '3' else article_id || ',3' end as lines from article",
    "str_code_meta": "select article_id, site as title, false as line_numbers, array_to_string(range(least(article_id % 7 + 1, 3), greatest(article_id % 7 + 1, 3) + 1), ',') || ',9' as highlights, 'x' as meta from article",
    "adapter_resolve": f"select article_id, case when {_ZHIHU} then 'zhihu' when {_ON('medium.com')} then 'medium' when {_ON('mp.weixin.qq.com')} then 'wechat' else 'others' end as provider from article",
    "match_zhihu": f"select article_id, {_ZHIHU} as zhihu from article",
    "match_medium": f"select article_id, {_ON('medium.com')} as medium from article",
    "match_wechat": f"select article_id, {_ON('mp.weixin.qq.com')} as wechat from article",
    "match_others": "select article_id, true as others from article",
    "reject_arxiv": "select article_id, article_id % 2 = 0 as arxiv from article",
    "reject_pdf": r"select article_id, coalesce(regexp_matches(regexp_extract(canonicalUrl || case when article_id % 2 = 0 then '.PDF/' else 'x' end, '^https?://[^/?#]+([^?#]*)', 1), '(?i)\.pdf/*$'), false) as pdf from article",
    "zhihu_entity_link": "select article_id, article_id % 2 = 0 as entity from article",
    "zhihu_date": r"select article_id, case when regexp_matches(publishedAt, '^\d{4}-\d\d-\d\dT[\d:.]+(Z|[+-]\d\d:\d\d)$') then strftime(try_cast(publishedAt as timestamptz) at time zone 'Asia/Shanghai', '%Y-%m-%d') else case when publishedAt is not null then regexp_extract(publishedAt, '^(\d{4}-\d\d-\d\d)', 1) end end as day from article",
    "str_normalize_base": "select page_id, case when ends_with(baseUrl, '/') then baseUrl else baseUrl || '/' end as base from extracted_article",
    "str_normalize_base_site": r"select page_id, case when ends_with(b, '/') then b else b || '/' end as base from (select page_id, case when starts_with(b, '/') then b else '/' || b end as b from (select page_id, regexp_extract(url, '^https?://[^/]+/(\w+)', 1) as b from extracted_article))",
    "str_prefix_images": r"select article_id, regexp_replace(markdown, '(!\[[^\]]*\]\()/([^/])', '\1/site/\2', 'g') as markdown from article",
    "str_external_link": "select page_id, not regexp_matches(h, '^(#|/|\\./|\\.\\./)') as external from (select page_id, regexp_extract(html, 'href=\"([^\"]*)\"', 1) as h from extracted_article)",
    "rewrite_paths": "select article_id, replace(markdown, '/images/', '/media/') as markdown from article",
    "wechat_placeholder_guard": "select article_id, coalesce(contains(markdown, 'data:image/svg+xml'), false) as rejected from article",
    "str_normalize_slug": f"select article_id, {slug_sql('title')} as slug from article",
    "str_slug_from_title": f"select article_id, coalesce(nullif({slug_sql('title')}, ''), nullif({slug_sql('site')}, ''), site) as slug from article",
    "str_slug_from_stem": "select id, updated, " + slug_sql(r"regexp_extract(id, '([^/]+)\.md$', 1)") + " as slug from post",
    "str_short_hash": "select article_id, substr(sha256(canonicalUrl), 1, 6) as hash from article",
    "str_image_name": "select article_id, case when images[1].url is not null then '001-' || substr(md5(images[1].url), 1, 8) end as name from article",
    "str_image_ext": f"select article_id, coalesce(m, {_URL_EXT}, '.jpg') as ext from {_IMG}",
    "str_image_ext_notion": f"select article_id, coalesce({_URL_EXT}, m, '.png') as ext from {_IMG}",
    "str_safe_image_id": "select article_id, case when k <> '' then k else substr(md5(title), 1, 12) end as image_id from (select article_id, title, regexp_replace(title, '[^a-zA-Z0-9_-]', '', 'g') as k from article)",
    "str_invisible": f"select article_id, {_INVISIBLE} as markdown from article",
    "str_unescape_math": r"select article_id, replace(replace('\$\$' || markdown || '\$', '\$\$', '$'), '\$', '$') as markdown from article",
    "str_sanitize_mdx": r"select article_id, regexp_replace(regexp_replace(regexp_replace('<' || canonicalUrl || '> <!-- -->' || markdown, '<(https?://[^>\s]+)>', '[\1](\1)', 'g'), '<!--\s*-->', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g') as markdown from article",
    "str_compress_lines": r"select doc_id, replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), chr(13) || chr(10), chr(10)) as text from documents",
    "agg_cleanup_count": r"select doc_id, cast(len(regexp_extract_all(text, '\n{3,}')) as bigint) as n_runs from documents",
    "str_reading_time": r"select doc_id, words, case when words > 0 then greatest(1, cast(ceil(words / 450.0) as bigint)) else 0 end as minutes from (select doc_id, cast(len(regexp_extract_all(b, '\p{Han}')) + len(regexp_extract_all(b, '[A-Za-z0-9]+')) as bigint) as words from (select doc_id, regexp_replace(text, '<[^>]+>', ' ', 'g') as b from documents))",
    "str_detect_lang": f"select article_id, {_CONTENT} as text from article",
    "agg_lang_ratio": _RATIOS + "select article_id, language, round(confidence, 6) as confidence, round(e, 6) as english_ratio, round(z, 6) as chinese_ratio from l",
    "should_translate": _RATIOS + "select article_id, language = 'en' and confidence >= 0.6 as translate from l",
    "strip_script": r"select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>', '', 'g'), '(?is)<style\b[^>]*>.*?</style>', '', 'g'), '(?is)<noscript\b[^>]*>.*?</noscript>', '', 'g'), '(?is)<template\b[^>]*>.*?</template>', '', 'g') as html from extracted_article",
    "str_callout": "select doc_id, regexp_replace(text, '^\\s+', '') as text from documents",
    "str_base64": "select article_id, to_base64(encode(title)) as encoded, title as decoded from article",
    "str_json_escape": r"""select article_id, replace(replace(replace(replace(replace(markdown, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') as escaped from article""",
    "str_excerpt": rf"select doc_id, n, regexp_replace(replace(excerpt, chr(160), ' '), '\s+', ' ', 'g') as excerpt from (select doc_id, n, trim(line, {_SPACES} || ' ' || chr(9) || chr(13) || chr(65279)) as excerpt from (select doc_id, cast(unnest(range(0, len(l))) as bigint) as n, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from documents))) where excerpt <> ''",
    "str_body_offset": "select doc_id, cast(case when starts_with(text, '---') and p > 0 then p + 3 + 3 else 0 end as bigint) as \"offset\" from (select doc_id, text, strpos(substr(text, 4), chr(10) || '---') as p from documents)",
    "frontmatter_split": "select doc_id, case when starts_with(text, '---') and p > 0 then substr(text, p + 7) else text end as body from (select doc_id, text, strpos(substr(text, 4), chr(10) || '---') as p from documents)",
    "win_line_offset": "select doc_id, cast(len(string_split(b, chr(10))) as bigint) as line, cast(length(string_split(b, chr(10))[-1]) + 1 as bigint) as \"column\" from (select doc_id, substr(text, 1, strpos(text, '](') - 1) as b from documents where strpos(text, '](') > 0)",
    "sink_change_only": rf"select article_id, replace(regexp_replace({_INVISIBLE}, '\n{{3,}}', chr(10) || chr(10), 'g'), chr(13) || chr(10), chr(10)) as markdown, markdown as old from article",
    "caption_predicate": r"select doc_id, cast(n as bigint) as n, length(p) <= 120 and not regexp_matches(p, '^[#\-*>`]') and trim(p) <> '' and regexp_matches(trim(p), '(?i)^(figure\s+\d+|fig\.\s*\d+|table\s+\d+|image\s+\d+|图\s*\d+|表\s*\d+|\d+[:.：]\s*)') as caption from (select doc_id, n, case when n % 2 = 0 then 'Figure 3: ' else '' end || p as p from (select doc_id, unnest(range(0, len(l))) as n, unnest(l) as p from (select doc_id, string_split(text, chr(10) || chr(10)) as l from documents)))",
    "str_code_lang": _CODE_LANG + "select id, n, lang from d",
    "sort_priority": _CODE_LANG + "select id, n, lang, given from d",
    "agg_code_scores": _B + f"select id, n, {_SCORES} from c",
    "gha_predicate": _B + f"select id, n, {_WORKFLOW} as workflow from c",
    "str_code_alias": _B + f"select id, n, {_ALIAS} as lang from (select id, n, lower(lang) as lang from c)",
    "str_code_trim": _B + r"select id, n, regexp_replace(regexp_replace(code, '\n{3,}', chr(10) || chr(10), 'g'), '\s+\z', '') as code from c",
    "md_fix_fences": _CODE_LANG + "select id, n, case when given = '' then lang else given end as lang, given = '' as fixed from d",
    "win_mermaid_index": _B + "select id, n, lang, row_number() over (partition by id, lang order by n) - 1 as nth from (select id, n, lower(lang) as lang from c) where lang in ('mermaid', 'html', 'yaml')",
    "win_line_number": _B + "select id, n, cast(unnest(range(1, len(l) + 1)) as bigint) as line_no, unnest(l) as line from (select id, n, string_split(code, chr(10)) as l from c)",
    "filter_toc_depth": _H + "select * from x where depth between 2 and 3",
    "win_toc_parent": _H + "select a.id, a.pos, a.depth, max(b.pos) as parent from x a left join x b on a.id = b.id and b.pos < a.pos and b.depth < a.depth group by all",
    "win_toc_flatten": _H + "select id, pos, text from x",
    "win_heading_slug": _H + f"select id, pos, case when k = 0 then base else base || '-' || k end as slug from (select id, pos, base, row_number() over (partition by id, base order by pos) - 1 as k from (select id, pos, {slug_sql('text')} as base from x))",
    "agg_min_heading": _H + "select id, min(depth) as least from x group by id",
    "win_blank_streak": "select doc_id, n, line from (select doc_id, n, line, lag(line) over (partition by doc_id order by n) as b from (select doc_id, cast(unnest(range(0, len(l))) as bigint) as n, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from documents))) where not (trim(line) = '' and trim(coalesce(b, 'x')) = '')",
    "filter_log_level": f"select log_id, ingested_at, level from log_entry where {_LEVEL} >= 2",
    "sensitive_key": "select log_id, ingested_at, key, regexp_matches(key || case when log_id % 2 = 0 then 'Token' else '' end, '(?i)" + "|".join(code.SENSITIVE) + "') as sensitive from (select log_id, ingested_at, unnest(map_keys(fields)) as key from log_entry where fields is not null)",
    "str_redact_value": rf"select article_id, regexp_replace(regexp_replace(regexp_replace({_SECRET}, '(?i)([?&])(token|secret|password|auth|apikey|api_key|key)=([^&\s]+)', '\1\2=[REDACTED]', 'g'), '(?i)Bearer\s+([\w\-.~+/=]{{6}})[\w\-.~+/=]+([\w\-.~+/=]{{4}})', 'Bearer \1...\2', 'g'), '([a-zA-Z0-9_-]+)=([^;,\s&=]{{6}})[^;,\s&=]+([^;,\s&=]{{4}})', '\1=\2...\3', 'g') as value from article",
    "str_fields_pretty": "select log_id, ingested_at, array_to_string(list_transform(map_entries(fields), lambda e: ' ' || e.key || '=' || coalesce(e.value, 'null')), '') as pretty from log_entry where fields is not null",
    "str_duration": "select log_id, ingested_at, case when durationMs < 1000 then durationMs || 'ms' when durationMs < 60000 then printf('%.2fs', durationMs / 1000.0) else printf('%.2fm', durationMs / 60000.0) end as label from log_entry where durationMs is not null",
    "str_to_boolean": "select log_id, ingested_at, case when status = 'ok' then true when status = 'partial' then false when lower(trim(status)) in ('1', 'true', 'yes', 'y', 'on') then true when lower(trim(status)) in ('0', 'false', 'no', 'n', 'off') then false end as flag from log_entry",
    "agg_sync_counters": """select *, case when errors > 0 then 'partial' else 'ok' end as status from (select runId, count(*) filter (event = 'sync.page') as total_pages, count(*) filter (event = 'sync.page' and status = 'ok') as processed,
 count(*) filter (event = 'image.skipped') as skipped, count(*) filter (lower(level) = 'error') as errors from (select distinct on (log_id) * from log_entry) group by runId)""",
    "agg_img_counts": "select count(*) filter (event = 'image.saved') as succeeded, count(*) filter (event = 'image.skipped') as failed, count(*) filter (starts_with(event, 'image.')) as total from log_entry",
    "math_srcset_score": "select article_id, case when article_id % 3 = 0 then cast(article_id % 900 as double) when article_id % 3 = 1 then 1500.0 else -1.0 end as score from article",
    "sort_srcset": "select article_id, canonicalUrl || '/l' as url from article",
    "math_backoff": "select article_id, cast(least(1000 * 2 ** (article_id % 6), 10000) as bigint) as delay_ms from article",
    "project_chapter_label": "select article_id, case when article_id % 13 = 0 then '导论' else '第 ' || article_id % 13 || ' 章' end as label from article",
    "project_source_url": f"select article_id, 'https://' || site || '/blob/' || sha1(site) || '/' || {slug_sql('title')} || '.md' as url from article",
    "project_frontmatter": f"select coalesce(nullif(trim(title), ''), 'Untitled') as title, coalesce(author, {_HOST}) as author, article_id from article",
    "image_placeholder": "select article_id, article_id % 4 = 0 or s = 0 or (s < 61440 and (w < 200 or h < 150)) as placeholder from (select article_id, article_id * 40 % 90000 as s, article_id % 400 as w, article_id % 300 as h from article)",
} | _MORE_ORACLE
