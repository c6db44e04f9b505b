"""Queries of the file sources and sinks: what is written from the tables is read back by the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import urls
from millrace.functions.text import blank
from millrace.operators import sync
from millrace.operators.documents import C
from millrace.operators.posts import P, published
from millrace.plans import config
from millrace.plans.storage import scratch_path
from millrace.sources import files, read_table, sinks
from millrace.sources.paged import read_paged
from millrace.sources.writers import write_files

PAGE = 25


def _folder():
    """Where a post's file lies: by its import, some among files that walks leave out."""
    n = F.length("slug") % 5
    return F.when(n == 0, "notion").when(n == 1, "node_modules/x").when(n == 2, "others").when(n == 3, "dist").otherwise("wechat")


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published(read_table(spark, sf_dir, "post")).select("slug", "title", "body")


def site_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the published posts as Markdown files; those with an even title are tests."""
    root = scratch_path(spark, "site")
    name = F.concat("slug", F.when(F.length("title") % 2 == 0, ".test.md").otherwise(".md"))
    text = F.concat(F.lit("---\ntitle: "), "title", F.lit("\n---\n"), F.coalesce("body", F.lit("")))
    write_files(_posts(spark, sf_dir), root, F.concat(_folder(), F.lit("/"), name), text).write.format("noop").mode("overwrite").save()
    return root


def _below(df: DataFrame, root: str) -> DataFrame:
    """(path, n_chars) relative to ``root``."""
    bare = root.split(":", 1)[-1].rstrip("/")
    return df.select(F.url_decode(F.regexp_replace(F.regexp_extract("path", f"{bare.rsplit('/', 1)[-1]}/(.*)$", 1), r"\+", "%2B")).alias("path"), F.length("value").cast("long").alias("n_chars"))


def _scan(how):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = site_files(spark, sf_dir)
        return _below(how(spark, root), root)

    return query


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file of a folder through a function, written to another folder and read back."""
    root, target = site_files(spark, sf_dir), scratch_path(spark, "mapped")
    source = files.markdown_files(spark, root, ())
    relative = F.url_decode(F.regexp_replace(F.regexp_extract("path", f"{root.rsplit('/', 1)[-1]}/(.*)$", 1), r"\+", "%2B"))
    write_files(source, target, relative, F.concat("value", F.lit("\n"))).write.format("noop").mode("overwrite").save()
    return _below(files.markdown_files(spark, target, ()), target)


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = _posts(spark, sf_dir)
    return write_files(posts, scratch_path(spark, "markdown"), F.concat("slug", F.lit("/index.md")), F.col("body"))


def _deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = site_files(spark, sf_dir)
    kept, deleted = sinks.delete_articles(files.markdown_files(spark, root, ()), "notion")
    return _below(kept.withColumn("value", F.lit("")), root).select("path", F.lit(False).alias("deleted")).unionByName(_below(deleted.withColumn("value", F.lit("")), root).select("path", F.lit(True).alias("deleted")))


def _upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.write_upserted(*sync._stored_and_incoming(spark, sf_dir), scratch_path(spark, "upserted"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "extracted_article", "page_id", "html")


def _html_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "pages")
    write_files(_pages(spark, sf_dir), root, F.concat(F.col("page_id").cast("string"), F.lit(".html")), F.col("html")).write.format("noop").mode("overwrite").save()
    found = files.whole_files(spark, root, "*.html")
    return found.select(F.regexp_extract("path", r"(\d+)\.html$", 1).cast("long").alias("page_id"), F.length("value").cast("long").alias("n_chars"), (~blank(C("value"))).alias("usable"))


def _listing(follow: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Posts as a remote listing for each way of import, in pages of PAGE."""
        from pyspark.sql.window import Window

        root = scratch_path(spark, "listing")
        kind = F.coalesce("source.kind", F.lit("none"))
        posts = published(read_table(spark, sf_dir, "post")).select(kind.alias("kind"), "slug", "title")
        numbered = posts.withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy("slug")) - 1).withColumn("total", F.count("*").over(Window.partitionBy("kind")))
        page = numbered.groupBy("kind", F.floor(F.col("n") / PAGE).alias("page"), "total").agg(F.array_sort(F.collect_list(F.struct("n", "slug", "title"))).alias("results"))  # PAGE rows
        more = (F.col("page") + 1) * PAGE < F.col("total")
        answer = F.to_json(F.struct("results", more.alias("has_more"), F.when(more, F.concat(F.lit("c"), (F.col("page") + 1).cast("string"))).alias("next_cursor")))
        name = F.when(F.col("page") == 0, "start").otherwise(F.concat(F.lit("c"), F.col("page").cast("string")))
        write_files(page.withColumn("answer", answer), root, F.concat("kind", F.lit("/"), name, F.lit(".json")), F.col("answer")).write.format("noop").mode("overwrite").save()
        return read_paged(spark, root, follow).select("listing", "position", F.get_json_object("object", "$.slug").alias("slug"))

    return query


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.report_lines(sync._audit(spark, sf_dir), "key")


def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settings in force, one row each."""
    from dataclasses import asdict

    return spark.createDataFrame([(k, str(v)) for k, v in asdict(config.load()).items()], "name string, value string")


def _colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested colours of a theme as variables: here those of each site, flattened in the executors."""
    site = read_table(spark, sf_dir, "site", "site", "source", "tz")
    colours = F.map_from_arrays(F.array(F.lit("text-main"), F.lit("text-muted"), F.lit("page")), F.array(F.concat(F.lit("#"), F.substring(F.md5("site"), 1, 6)), F.concat(F.lit("#"), F.substring(F.md5("source"), 1, 6)), F.concat(F.lit("#"), F.substring(F.md5("tz"), 1, 6))))
    return site.select("site", F.explode(config.variable_lines(colours)).alias("line"))


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapters in the order in which they are asked."""
    return spark.createDataFrame([(i, name) for i, (name, _) in enumerate(urls.ADAPTERS)], "position long, name string")


def _static_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The routes of a site, a partition for each kind of page: posts, tags and listing pages, read back from the written table."""
    from millrace.operators.posts import PAGE_SIZE
    from millrace.operators.tags import tag_index

    posts = published(read_table(spark, sf_dir, "post")).select("slug", "title", "tags", "date")
    post = posts.select(F.lit("post").alias("kind"), F.concat(F.lit("/"), "slug", F.lit("/")).alias("route"))
    tag = tag_index(posts).select(F.lit("tag").alias("kind"), F.concat(F.lit("/tags/"), "slug", F.lit("/")).alias("route"))
    last = F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(PAGE_SIZE))).cast("long")
    page = posts.agg(last.alias("last")).select(F.lit("page").alias("kind"), F.explode(F.sequence(F.lit(2).cast("long"), F.greatest(F.lit(2).cast("long"), "last"))).alias("n"), "last").where("n <= last").select("kind", F.concat(F.lit("/page/"), F.col("n").cast("string"), F.lit("/")).alias("route"))
    path = scratch_path(spark, "routes")
    post.unionByName(tag).unionByName(page).write.partitionBy("kind").parquet(path)
    return spark.read.parquet(path).select("kind", "route")


def moved_images(df: DataFrame, path: str, old: str, new: str) -> DataFrame:
    """(path, target, moved): image paths below ``old`` moved below ``new``; one whose target is taken by another file stays where it is."""
    rows = df.select(F.col(path).alias("path")).where(F.col("path").isNotNull()).distinct()
    wanted = F.when(F.col("path").startswith(old), F.concat(F.lit(new), F.substr(F.col("path"), F.lit(len(old) + 1)))).otherwise(F.col("path"))
    named = rows.withColumn("wanted", wanted)
    taken = rows.select(F.col("path").alias("wanted"), F.lit(True).alias("taken"))
    out = named.join(taken, "wanted", "left")
    moved = (F.col("wanted") != F.col("path")) & F.col("taken").isNull()
    return out.select("path", F.when(moved, F.col("wanted")).otherwise(F.col("path")).alias("target"), moved.alias("moved"))


def _moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = read_table(spark, sf_dir, "article", "images").select(F.explode("images").alias("i")).select(F.col("i.localPath").alias("path"))
    return moved_images(image, "path", "/images/", "/media/")


QUERIES = {
    "scan_markdown_walk": _scan(lambda s, root: files.markdown_files(s, root, ())),
    "scan_markdown_ignore": _scan(lambda s, root: files.markdown_files(s, root)),
    "scan_expand_targets": _scan(lambda s, root: files.targets(s, root, ["notion", "wechat"])),
    "scan_find_files": _scan(lambda s, root: files.source_files(s, root, (".md",))),
    "sink_markdown": _written,
    "sink_dir_map": _mapped,
    "delete_article": _deleted,
    "sink_upsert_notion": _upserted,
    "sink_report_md": _report,
    "src_html_file": _html_files,
    "src_html_file_guard": lambda s, d: read_table(s, d, "article", "article_id", "canonicalUrl").select("article_id", files.snapshot_allowed_for(urls.provider(C("canonicalUrl"))).alias("allowed")),
    "src_notion_db": _listing(False),
    "src_notion_pages": _listing(True),
    "src_env": _settings,
    "src_yaml_config": lambda s, d: config.settings_of(read_table(s, d, "site", "site", "source", "tz", "date_order")),
    "json_config_flatten": _colours,
    "adapter_registry": _registry,
    "str_run_id": lambda s, d: read_table(s, d, "log_entry", "log_id", "ingested_at").select("log_id", "ingested_at", config.run_id_column().rlike("^[0-9a-f]{8}$").alias("valid")),
    "sink_static_site": _static_site,
    "migrate_images": _moved,
}

_SITE = P + """, f as (select slug, case length(slug) % 5 when 0 then 'notion' when 1 then 'node_modules/x' when 2 then 'others' when 3 then 'dist' else 'wechat' end as folder, slug || case when length(title) % 2 = 0 then '.test.md' else '.md' end as name, '---' || chr(10) || 'title: ' || title || chr(10) || '---' || chr(10) || coalesce(body, '') as text from p)
select folder || '/' || name as path, length(text) as n_chars from f"""
_KEPT = " where folder not in ('node_modules/x', 'dist')"
_ADAPTER = r"case when regexp_matches(h, '(^|\.)zhihu\.com$') and contains(canonicalUrl, 'zhuanlan.zhihu.com/p/') then true else false end"
ORACLE = {
    "scan_markdown_walk": _SITE,
    "scan_markdown_ignore": _SITE + _KEPT,
    "scan_expand_targets": _SITE + " where folder in ('notion', 'wechat')",
    "scan_find_files": _SITE + _KEPT + " and not contains(name, '.test.')",
    "sink_dir_map": _SITE.replace("length(text) as n_chars", "length(text) + 1 as n_chars"),
    "sink_markdown": P + "select slug || '/index.md' as path, cast(octet_length(encode(coalesce(body, ''))) as bigint) as n_bytes from p",
    "delete_article": _SITE.replace("length(text) as n_chars", "folder = 'notion' as deleted"),
    "sink_upsert_notion": sync._VERSIONS + "select action, count(*) as n from (select *, max(n) over (partition by slug) as top from m) where n = top group by action",
    "sink_report_md": sync._AUDITED + "select key, '| ' || key || ' | ' || n_uses || ' | ' || n_proper || ' | ' || status || ' |' as line from s",
    "src_html_file": "select page_id, length(html) as n_chars, trim(html) <> '' as usable from extracted_article where html is not null and html <> ''",
    "src_html_file_guard": f"select article_id, {_ADAPTER} as allowed from (select article_id, canonicalUrl, lower(regexp_extract(canonicalUrl, '^https?://([^/?#:]+)', 1)) as h from article)",
    "src_notion_db": P + f"select listing, position, slug from (select coalesce(source.kind, 'none') as listing, cast(row_number() over (partition by coalesce(source.kind, 'none') order by slug) - 1 as integer) as position, slug from p) where position < {PAGE}",
    "src_notion_pages": P + "select coalesce(source.kind, 'none') as listing, cast(row_number() over (partition by coalesce(source.kind, 'none') order by slug) - 1 as integer) as position, slug from p",
    "src_env": "select * from (values ('page_size', '6'), ('window', '2'), ('related', '4'), ('batch_chars', '6000'), ('comments', 'True')) t(name, value)",
    "src_yaml_config": "select site, source, tz, date_order, date_order in ('mdy', 'dmy', 'ymd') and source is not null as valid from site",
    "json_config_flatten": "select site, '--color-' || n || ': #' || substr(md5(v), 1, 6) || ';' as line from (select site, unnest(['text-main', 'text-muted', 'page']) as n, unnest([site, source, tz]) as v from site)",
    "adapter_registry": "select * from (values (cast(0 as bigint), 'zhihu'), (1, 'medium'), (2, 'wechat'), (3, 'others')) t(position, name)",
    "str_run_id": "select log_id, ingested_at, true as valid from log_entry",
    "migrate_images": "select distinct path, case when starts_with(path, '/images/') then '/media/' || substr(path, 9) else path end as target, starts_with(path, '/images/') as moved from (select unnest(images).localPath as path from article) where path is not null",
}
