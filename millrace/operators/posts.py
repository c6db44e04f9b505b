"""Queries over the collection of posts: filters, order, pages, neighbours, months, related posts, cards."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.slugs import short_hash
from millrace.functions.text import blank, caption, js_trim, none_if_blank, reading_stats
from millrace.functions.urls import post_url, with_base
from millrace.plans.ordering import numbered, with_neighbours
from millrace.sources import read_table

PAGE_SIZE = 6
RELATED = 4


def status_of(status: Column) -> Column:
    """Status with its default and in one spelling."""
    return F.lower(F.coalesce(none_if_blank(status), F.lit("published")))


def published(posts: DataFrame) -> DataFrame:
    """Published posts with a slug, a title and a date, the latest version of each slug.

    Versions with equal ``updated`` are settled by id. Null status means published; nulls elsewhere
    stay. Hot slugs are safe: the window keeps one row by a group limit pushed in front of its shuffle.
    """
    kept = posts.where((status_of(F.col("status")) == "published") & F.col("slug").isNotNull() & F.col("title").isNotNull() & F.col("date").isNotNull())
    latest = Window.partitionBy("slug").orderBy(F.desc_nulls_last("updated"), "id")
    return kept.withColumn("__v", F.row_number().over(latest)).where(F.col("__v") == 1).drop("__v")


def newest_first() -> list[Column]:
    return [F.desc("date"), F.asc("slug")]


def validated(posts: DataFrame) -> DataFrame:
    """Posts with defaults filled in, and ``violations``: an array of what is wrong with the row, empty for valid ones."""
    bad_url = F.col("source_url").isNotNull() & ~F.col("source_url").rlike("^https?://")
    bad_status = F.col("status").isNotNull() & ~F.lower("status").isin("published", "draft")
    checks = ((F.col("title").isNull(), "title: required"), (F.col("date").isNull(), "date: required"), (bad_status, "status: not one of published, draft"), (bad_url, "source_url: no URL"))
    violations = F.filter(F.array(*(F.when(c, F.lit(m)) for c, m in checks)), lambda m: m.isNotNull())
    return posts.withColumns({"violations": violations, "status": status_of(F.col("status")), "tags": F.coalesce("tags", F.array().cast("array<string>")), "comments": F.coalesce("comments", F.lit(True))})


def by_month(posts: DataFrame) -> DataFrame:
    """(month, n_posts, position, slug): the posts of each month, newest first.

    A month has any number of posts, so they stay rows: their positions are those of the global order less
    the posts of later months, of which there is one number a month. Posts without a date have none.
    """
    dated = posts.where(F.col("date").isNotNull()).withColumn("month", F.date_format("date", "yyyy-MM"))
    months = dated.groupBy("month").agg(F.count("*").alias("n_posts"))
    ahead = F.coalesce(F.sum("n_posts").over(Window.orderBy(F.desc("month")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = numbered(dated.select("month", "date", "slug"), [F.desc("date"), F.desc("slug")], "at")
    return rows.join(months.withColumn("ahead", ahead), "month").select("month", "n_posts", (F.col("at") - F.col("ahead")).alias("position"), "slug")


def related(posts: DataFrame, limit: int = RELATED) -> DataFrame:
    """(slug, rank, related): the newest other posts that share a tag, at most ``limit`` of each.

    A member of a post's result that shares tag t is among t's ``limit`` newest others, so only the
    ``limit + 1`` newest posts of each tag can be related: a hot tag meets its own posts with a
    handful of rows, never with all.
    """
    tagged = posts.select("slug", "date", F.explode(F.array_distinct(F.filter(F.transform("tags", js_trim), lambda t: t != ""))).alias("tag"))
    newest = Window.partitionBy("tag").orderBy(*newest_first())
    top = tagged.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= limit + 1)
    others = top.select("tag", F.col("slug").alias("related"), F.col("date").alias("related_date"))
    pairs = tagged.select("slug", "tag").join(others, "tag").where(F.col("slug") != F.col("related")).select("slug", "related", "related_date").distinct()
    order = Window.partitionBy("slug").orderBy(F.desc("related_date"), F.asc("related"))
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("slug", "rank", "related")


def pages(posts: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """Posts with their position and page in the listing."""
    rows = numbered(posts, newest_first(), "position")
    return rows.withColumn("page", (F.floor((F.col("position") - 1) / F.lit(size)) + 1).cast("long"))


def pagination(current: Column, total: Column, window: int = 5) -> Column:
    """Page numbers and gaps (``ellipsis``) as an array of strings; null where the arguments are out of range."""
    # Half a window to either side of the current page, moved inside 1..total where that is less than a window.
    start = F.greatest(F.lit(1), F.least(current - window // 2, total - F.lit(window) + 1))
    end = F.least(total, F.greatest(current + window // 2, F.lit(window)))
    text = lambda a: F.transform(a, lambda x: x.cast("string"))
    gap, none = F.array(F.lit("ellipsis")), F.array().cast("array<string>")
    inner = F.filter(F.sequence(start, end), lambda i: (i > 1) & (i < total))
    items = F.concat(F.array(F.lit("1")), F.when(start > 2, gap).otherwise(none), text(inner), F.when(end < total - 1, gap).otherwise(none), F.when(total > 1, F.array(total.cast("string"))).otherwise(none))
    valid = (total >= 1) & (current >= 1) & (current <= total) & (F.lit(window) >= 1)
    return F.when(valid, F.when(total <= window, text(F.sequence(F.lit(1).cast("long"), total))).otherwise(items))


def cards(posts: DataFrame) -> DataFrame:
    """Listing cards: three tags, how many more, cover and reading time."""
    words, minutes = reading_stats(F.coalesce("body", F.lit("")))
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    return posts.select("slug", "title", F.slice(tags, 1, 3).alias("first_tags"), F.greatest(F.size(tags) - 3, F.lit(0)).cast("long").alias("more_tags"), F.col("cover").isNotNull().alias("has_cover"), words.alias("words"), minutes.alias("minutes"))


def _posts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return published(read_table(spark, sf_dir, "post")).select(*columns)


def _query(*columns: str):
    """Decorator: a query over the published posts, narrowed to ``columns``."""

    def wrap(f):
        return lambda spark, sf_dir: f(_posts(spark, sf_dir, *columns))

    return wrap


def last_update() -> Column:
    """The date of the last change, by whichever field has it."""
    return F.coalesce("updatedAt", "updated", "lastmod")


def menu_active(path: Column, href: Column, external: bool = False, columns_index: str = "/columns", columns: tuple[str, ...] = ("/small", "/quick")) -> Column:
    """Whether a menu item is that of the page at ``path``: the start page itself; else a page or one below it; the index of columns also on a column's own routes."""
    if external:
        return F.lit(False)
    closed = lambda c: F.when(c.endswith("/"), c).otherwise(F.concat(c, F.lit("/")))
    here, item = closed(path), closed(href)
    in_column = reduce(or_, (here.startswith(f"{c}/") for c in columns), F.lit(False))
    return F.when(href == "/", here == "/").otherwise(here.startswith(item) | ((href == F.lit(columns_index)) & in_column))


def _menu(posts: DataFrame) -> DataFrame:
    """Which items of a menu are those of the pages of posts, of columns and of the start page."""
    routes = F.array(F.concat(F.lit("/"), "slug", F.lit("/")), F.concat(F.lit("/columns/"), "slug"))
    paths = posts.select(F.explode(routes).alias("path")).unionByName(posts.select(F.lit("/").alias("path")).distinct())
    items = (("home", "/", False), ("section", "/small", False), ("columns", "/columns", False), ("outside", "https://small.example/", True))
    return paths.select("path", *(menu_active(F.col("path"), F.lit(href), external).alias(name) for name, href, external in items))


def _date_display(posts: DataFrame) -> DataFrame:
    day = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))
    later = (last_update() > F.col("date")) & (F.to_date(last_update()) != F.to_date("date"))
    return posts.select("slug", day(F.col("date")).alias("published_label"), F.when(later, day(last_update())).otherwise("").alias("updated_label"))


def _unique_slugs(posts: DataFrame) -> DataFrame:
    """First owner of a title slug keeps it, others get a hash of their id; a counter settles equal hashes."""
    from millrace.functions.slugs import normalise_slug

    wanted = posts.select("id", F.coalesce(F.nullif(normalise_slug(F.col("title")), F.lit("")), F.lit("post")).alias("wanted"))
    n = F.row_number().over(Window.partitionBy("wanted").orderBy("id"))
    hashed = wanted.withColumn("slug", F.when(n == 1, F.col("wanted")).otherwise(F.concat("wanted", F.lit("-"), short_hash(F.col("id")))))
    again = F.row_number().over(Window.partitionBy("slug").orderBy("id"))
    return hashed.withColumn("k", again).select("id", F.when(F.col("k") == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), F.col("k").cast("string"))).alias("slug"))


def _total_pages(posts: DataFrame) -> DataFrame:
    return posts.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(PAGE_SIZE))).cast("long").alias("total_pages"))


def _page_items(posts: DataFrame) -> DataFrame:
    """The pagination of every page; the number of pages is one value."""
    total = F.lit(_total_pages(posts).first()["total_pages"])
    return pages(posts).select("page").distinct().select("page", F.array_join(pagination(F.col("page"), total), " ").alias("items"))


IMAGE = r"^!\[[^\]]*\]\([^)]+\)$"


def image_captions(rows: DataFrame, id_column: str, body: str) -> DataFrame:
    """(id, block_no, caption): the paragraphs that are one image, with the caption in the paragraph behind, else null."""
    block = rows.select(id_column, F.posexplode(F.split(body, "\n\n")).alias("n", "text"))
    behind = F.lead("text").over(Window.partitionBy(id_column).orderBy("n"))
    return block.select(id_column, F.col("n").cast("long").alias("block_no"), F.trim("text").rlike(IMAGE).alias("image"), F.when(caption(behind), behind).alias("caption")).where("image").select(id_column, "block_no", "caption")


def _captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images of the articles; short paragraphs begin like a caption in every other article, as the tables have hardly any."""
    article = read_table(spark, sf_dir, "article", "article_id", "markdown")
    named = F.when(F.col("article_id") % 2 == 0, F.regexp_replace("markdown", r"\n\n([^\n#>!*`-][^\n]{0,99})(?=\n\n)", "\n\nFigure 1: $1")).otherwise(F.col("markdown"))
    return image_captions(article.select("article_id", named.alias("markdown")), "article_id", "markdown")


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites as chapters in the order of their names: (slug, order), a table of a few rows."""
    return numbered(read_table(spark, sf_dir, "site", "site").select(F.col("site").alias("slug")), [F.asc("slug")], "order")


QUERIES = {
    "sort_chapter": chapters,
    "win_chapter_prev_next": lambda s, d: with_neighbours(chapters(s, d), [F.asc("order")], "slug", "prev_slug", "next_slug").select("slug", "prev_slug", "next_slug"),
    "scan_collection": lambda s, d: read_table(s, d, "post", "slug", "id", "title", "date"),
    "scan_slug_dir": lambda s, d: read_table(s, d, "post", "id").select("id", F.regexp_extract("id", r"([^/]+)\.md$", 1).alias("stem")).where(F.col("stem").endswith("-1")),
    "filter_published": _query("slug", "title", "date")(lambda p: p),
    "filter_notion_status": lambda s, d: read_table(s, d, "post", "id", "updated", "status").where(F.col("status").isNull() | (F.col("status") == "Published")),
    "filter_title_search": _query("slug", "title")(lambda p: p.where(F.lower("title").contains("cache"))),
    "validate_schema": lambda s, d: validated(read_table(s, d, "post")).select("id", "updated", "status", F.size("tags").cast("long").alias("n_tags"), F.array_join("violations", "; ").alias("violations")),
    "sort_date_desc": _query("slug", "date")(lambda p: numbered(p, newest_first(), "position").select("slug", "position")),
    "limit_page_one": _query("slug", "date")(lambda p: p.orderBy(*newest_first()).limit(PAGE_SIZE).select("slug", "date")),
    "limit_tags3": _query("slug", "tags")(lambda p: p.select("slug", F.array_join(F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, 3), "|").alias("first_tags"))),
    "win_prev_next": _query("slug", "date")(lambda p: with_neighbours(p, newest_first(), "slug", "prev_slug", "next_slug").select("slug", "prev_slug", "next_slug")),
    "win_page_number": _query("slug", "date")(lambda p: pages(p).select("slug", "position", "page")),
    "agg_year_month": _query("slug", "date")(by_month),
    "agg_post_count": _query("slug")(lambda p: p.agg(F.count("*").alias("n_posts"))),
    "agg_total_pages": _query("slug")(_total_pages),
    "agg_latest_date": _query("date")(lambda p: p.agg(F.greatest(F.max("date"), F.lit("1970-01-01").cast("timestamp")).alias("latest"))),
    "join_related": _query("slug", "date", "tags")(lambda p: related(p).withColumn("rank", F.col("rank").cast("long"))),
    "limit_related": _query("slug", "date", "tags")(lambda p: related(p, 2).withColumn("rank", F.col("rank").cast("long"))),
    "join_visible": _query("slug", "title")(lambda p: p.join(p.where(F.lower("title").contains("cache")).select("slug"), "slug", "left_semi").select("slug")),
    "set_overlap": _query("slug", "tags")(lambda p: p.select("slug", F.coalesce(F.arrays_overlap(F.col("tags"), F.array(F.lit("gpu"), F.lit("memory"))), F.lit(False)).alias("overlaps"))),
    "set_tag_union": _query("slug", "tags")(lambda p: p.select("slug", F.array_join(F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.lit("gpu"), F.lit("imported"))), "|").alias("tags"))),
    "project_card": _query("slug", "title", "tags", "cover", "body")(lambda p: cards(p).withColumn("first_tags", F.array_join("first_tags", "|"))),
    "project_share": _query("slug", "title")(lambda p: p.select("slug", F.concat(F.lit("["), "title", F.lit("]("), post_url(F.col("slug"), F.lit("/")), F.lit(")")).alias("markdown"), F.concat("title", F.lit("\n"), post_url(F.col("slug"), F.lit("/"))).alias("plain"))),
    "project_posts_json": _query("slug", "title")(lambda p: p.select("slug", F.to_json(F.struct("slug", "title")).alias("json"))),
    "menu_active": _query("slug")(_menu),
    "date_updated": _query("slug", "updatedAt", "updated", "lastmod")(lambda p: p.select("slug", last_update().alias("updated"))),
    "date_format": _query("slug", "date", "lastmod")(lambda p: p.select("slug", F.date_format("date", "yyyy-MM-dd").alias("day"), F.coalesce(F.date_format("lastmod", "yyyy-MM-dd"), F.lit("")).alias("lastmod_day"))),
    "date_display": _query("slug", "date", "updatedAt", "updated", "lastmod")(_date_display),
    "date_normalize": lambda s, d: read_table(s, d, "post", "id", "updated", "imported_at").select("id", "updated", F.col("imported_at").try_cast("timestamp").alias("imported")),
    "win_unique_slug": lambda s, d: _unique_slugs(read_table(s, d, "post", "id", "title", "updated").where(F.col("title").isNotNull()).select("id", "title").distinct()),
    "win_pagination_items": _query("slug", "date")(_page_items),
    "str_with_base": _query("slug", "cover")(lambda p: p.select("slug", with_base(F.col("cover"), F.lit("site/")).alias("cover"))),
    "str_post_url": _query("slug")(lambda p: p.select("slug", post_url(F.col("slug"), F.lit("/blog")).alias("url"))),
    "delete_match_dirs": lambda s, d: read_table(s, d, "post", "slug", "id").where((F.col("slug") == "small") | F.col("slug").startswith("small-")).select("slug", "id").distinct(),
    "delete_resolve": lambda s, d: read_table(s, d, "post", "slug", "id").where(F.col("slug").isNotNull()).groupBy("slug").agg(F.count_distinct("id").alias("n_paths"), F.min("id").alias("path")).where(F.col("n_paths") == 1).select("slug", "path"),
    "delete_cover_path": lambda s, d: read_table(s, d, "post", "cover").where(F.col("cover").isNotNull()).select("cover", F.when(F.col("cover").rlike("^https?://") | F.col("cover").contains(".."), F.lit(None).cast("string")).otherwise(F.concat(F.lit("public/"), F.regexp_replace("cover", "^/+", ""))).alias("path")).distinct(),
    "join_caption": _captions,
}

P = """with p as (select * from (select *, row_number() over (partition by slug order by updated desc nulls last, id) as v from post
where lower(coalesce(nullif(trim(status), ''), 'published')) = 'published' and slug is not null and title is not null and "date" is not null) where v = 1)
"""
_TAGGED = ", t as (select distinct slug, \"date\", trim(tag) as tag from (select slug, \"date\", unnest(tags) as tag from p) where trim(tag) <> '')"
_RELATED = P + _TAGGED + """, r as (select distinct a.slug, b.slug as related, b."date" as d from t a join t b on a.tag = b.tag and a.slug <> b.slug)
select slug, rank, related from (select slug, related, row_number() over (partition by slug order by d desc, related) as rank from r) where rank <= """
_PAGINATION = """select page, case when total <= 5 then array_to_string(range(1, total + 1), ' ') else
 '1' || case when ws > 2 then ' ellipsis' else '' end || coalesce(' ' || nullif(array_to_string(list_filter(range(ws, we + 1), lambda i: i > 1 and i < total), ' '), ''), '') || case when we < total - 1 then ' ellipsis' else '' end || ' ' || total end as items
from (select page, total, case when e0 - s0 + 1 < 5 and s0 <> 1 and e0 = total then greatest(total - 4, 1) else s0 end as ws, case when e0 - s0 + 1 < 5 and s0 = 1 then least(5, total) else e0 end as we
 from (select page, total, greatest(page - 2, 1) as s0, least(page + 2, total) as e0 from (select unnest(range(1, total + 1)) as page, total from (select greatest(1, cast(ceil(count(*) / 6.0) as bigint)) as total from p))))"""
ORACLE = {
    "sort_chapter": 'select site as slug, row_number() over (order by site) as "order" from site',
    "win_chapter_prev_next": "select site as slug, lag(site) over (order by site) as prev_slug, lead(site) over (order by site) as next_slug from site",
    "scan_collection": 'select slug, id, title, "date" from post',
    "scan_slug_dir": "select id, stem from (select id, regexp_extract(id, '([^/]+)\\.md$', 1) as stem from post) where stem like '%-1'",
    "filter_published": P + 'select slug, title, "date" from p',
    "filter_notion_status": "select id, updated, status from post where status is null or status = 'Published'",
    "filter_title_search": P + "select slug, title from p where contains(lower(title), 'cache')",
    "validate_schema": """select id, updated, lower(coalesce(nullif(trim(status), ''), 'published')) as status, cast(len(coalesce(tags, [])) as bigint) as n_tags,
 array_to_string(list_filter([case when title is null then 'title: required' end, case when "date" is null then 'date: required' end,
 case when lower(status) not in ('published', 'draft') then 'status: not one of published, draft' end, case when source_url is not null and not regexp_matches(source_url, '^https?://') then 'source_url: no URL' end], lambda x: x is not null), '; ') as violations from post""",
    "sort_date_desc": P + 'select slug, row_number() over (order by "date" desc, slug) as position from p',
    "limit_page_one": P + 'select slug, "date" from p order by "date" desc, slug limit 6',
    "limit_tags3": P + "select slug, coalesce(array_to_string(list_slice(tags, 1, 3), '|'), '') as first_tags from p",
    "win_prev_next": P + 'select slug, lag(slug) over (order by "date" desc, slug) as prev_slug, lead(slug) over (order by "date" desc, slug) as next_slug from p',
    "win_page_number": P + 'select slug, position, cast(floor((position - 1) / 6) as bigint) + 1 as page from (select slug, row_number() over (order by "date" desc, slug) as position from p)',
    "agg_year_month": P + "select month, count(*) over (partition by month) as n_posts, row_number() over (partition by month order by \"date\" desc, slug desc) as position, slug from (select strftime(\"date\", '%Y-%m') as month, \"date\", slug from p)",
    "agg_post_count": P + "select count(*) as n_posts from p",
    "agg_total_pages": P + "select greatest(1, cast(ceil(count(*) / 6.0) as bigint)) as total_pages from p",
    "agg_latest_date": P + "select greatest(max(\"date\"), timestamptz '1970-01-01 00:00:00+00') as latest from p",
    "join_related": _RELATED + "4",
    "limit_related": _RELATED + "2",
    "join_visible": P + "select slug from p where slug in (select slug from p where contains(lower(title), 'cache'))",
    "set_overlap": P + "select slug, coalesce(list_has_any(tags, ['gpu', 'memory']), false) as overlaps from p",
    "set_tag_union": P + """select slug, array_to_string(list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda z: list_position(l, z[1]) = z[2]), lambda z: z[1]), '|') as tags
from (select slug, list_concat(coalesce(tags, []), ['gpu', 'imported']) as l from p)""",
    "project_card": P + """select slug, title, coalesce(array_to_string(list_slice(tags, 1, 3), '|'), '') as first_tags, cast(greatest(len(coalesce(tags, [])) - 3, 0) as bigint) as more_tags, cover is not null as has_cover, words, case when words > 0 then greatest(1, cast(ceil(words / 450.0) as bigint)) else 0 end as minutes
from (select *, cast(len(regexp_extract_all(b, '\\p{Han}')) + len(regexp_extract_all(b, '[A-Za-z0-9]+')) as bigint) as words from (select *, regexp_replace(coalesce(body, ''), '<[^>]+>', ' ', 'g') as b from p))""",
    "project_share": P + "select slug, '[' || title || '](/' || slug || '/)' as markdown, title || chr(10) || '/' || slug || '/' as plain from p",
    "menu_active": P + """select path, path = '/' as home, starts_with(c, '/small/') as section, starts_with(c, '/columns/') or starts_with(c, '/small/') or starts_with(c, '/quick/') as columns, false as outside
 from (select path, case when ends_with(path, '/') then path else path || '/' end as c from (select '/' || slug || '/' as path from p union all select '/columns/' || slug from p union all select '/'))""",
    "date_updated": P + "select slug, coalesce(updatedAt, updated, lastmod) as updated from p",
    "date_format": P + "select slug, strftime(\"date\", '%Y-%m-%d') as day, coalesce(strftime(lastmod, '%Y-%m-%d'), '') as lastmod_day from p",
    "date_display": P + "select slug, strftime(\"date\", '%Y-%m-%d') as published_label, case when u > \"date\" and strftime(u, '%Y-%m-%d') <> strftime(\"date\", '%Y-%m-%d') then strftime(u, '%Y-%m-%d') else '' end as updated_label from (select *, coalesce(updatedAt, updated, lastmod) as u from p)",
    "date_normalize": "select id, updated, try_cast(imported_at as timestamptz) as imported from post",
    "win_pagination_items": P + _PAGINATION,
    "str_with_base": P + "select slug, case when starts_with(cover, '/') and not starts_with(cover, '//') then case when starts_with(cover, '/site/') then cover else '/site' || cover end else cover end as cover from p",
    "str_post_url": P + "select slug, '/blog/' || slug || '/' as url from p",
    "delete_match_dirs": "select distinct slug, id from post where slug = 'small' or starts_with(slug, 'small-')",
    "delete_resolve": "select slug, min(id) as path from post where slug is not null group by slug having count(distinct id) = 1",
    "delete_cover_path": "select distinct cover, case when regexp_matches(cover, '^https?://') or contains(cover, '..') then null else 'public/' || ltrim(cover, '/') end as path from post where cover is not null",
    "join_caption": """select article_id, cast(n - 1 as bigint) as block_no, case when length(nxt) <= 120 and not regexp_matches(nxt, '^[#\\-*>`]') and trim(nxt) <> '' and regexp_matches(trim(nxt), '(?i)^(figure\\s+\\d+|fig\\.\\s*\\d+|table\\s+\\d+|image\\s+\\d+|图\\s*\\d+|表\\s*\\d+|\\d+[:.：]\\s*)') then nxt end as caption
from (select article_id, n, txt, lead(txt) over (partition by article_id order by n) as nxt from (select article_id, n, case when article_id % 2 = 0 and n > 1 and n < size and regexp_matches(txt, '\\A[^\\n#>!*`-][^\\n]{0,99}\\z') then 'Figure 1: ' || txt else txt end as txt
 from (select article_id, unnest(range(1, len(b) + 1)) as n, unnest(b) as txt, len(b) as size from (select article_id, string_split(markdown, chr(10) || chr(10)) as b from article where markdown is not null))))
where regexp_matches(trim(txt), '^!\\[[^\\]]*\\]\\([^)]+\\)$')""",
    "project_posts_json": P + """select slug, '{"slug":' || cast(to_json(slug) as varchar) || ',"title":' || cast(to_json(title) as varchar) || '}' as json from p""",
}
