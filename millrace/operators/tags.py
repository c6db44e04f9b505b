"""The tag index: counts, latest dates, unique slugs, posts by tag, orders and searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.slugs import slugify_tag
from millrace.functions.text import js_trim
from millrace.operators.posts import P, newest_first, published
from millrace.sources import read_table


def tag_rows(posts: DataFrame) -> DataFrame:
    """(slug, date, pos, tag): one row per tag of a post; blanks dropped, repeats kept, case kept."""
    rows = posts.select("slug", "date", F.posexplode("tags").alias("pos", "tag"))
    return rows.select("slug", "date", "pos", js_trim(F.col("tag")).alias("tag")).where(F.col("tag") != "")


def tag_index(posts: DataFrame) -> DataFrame:
    """(name, slug, count, latest): the index over the posts' tags.

    Counts and dates are partial aggregates before any shuffle, so a tag on a third of all posts is no
    hot task. Of the tags with one slug the first seen, by the newest post and its tag order, keeps it;
    the nth gets ``-n``. Null and empty tag arrays add nothing; an empty table gives an empty index.
    """
    # First seen: the newest post; of equal dates the first slug, then the tag's position.
    seen = F.struct((-F.unix_micros("date")).alias("age"), F.col("slug"), F.col("pos"))
    names = tag_rows(posts).groupBy(F.col("tag").alias("name")).agg(F.count("*").alias("count"), F.greatest(F.max("date"), F.lit("1970-01-01").cast("timestamp")).alias("latest"), F.min(seen).alias("seen"))
    slugged = names.withColumn("base", slugify_tag(F.col("name")))
    n = F.row_number().over(Window.partitionBy("base").orderBy("seen"))
    return slugged.withColumn("n", n).select("name", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("n").cast("string"))).alias("slug"), "count", "latest")


def posts_of_tags(posts: DataFrame) -> DataFrame:
    """(tag_slug, post_slug): which posts carry a tag; joined by name with the index, unmatched dropped."""
    rows = tag_rows(posts).select("slug", "tag").distinct()
    index = tag_index(posts).select(F.col("name").alias("tag"), F.col("slug").alias("tag_slug"))
    return rows.join(index, "tag").select("tag_slug", F.col("slug").alias("post_slug"))


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published(read_table(spark, sf_dir, "post", "slug", "id", "title", "date", "updated", "status", "tags"))


def _over_index(f):
    return lambda spark, sf_dir: f(tag_index(_posts(spark, sf_dir)))


def _position(index: DataFrame, *order) -> DataFrame:
    from millrace.plans.ordering import numbered

    return numbered(index, list(order), "position").select("name", "position")


QUERIES = {
    "agg_tag_index": _over_index(lambda t: t),
    "win_slug_disambiguate": _over_index(lambda t: t.select("name", "slug")),
    "join_tag_slug": lambda s, d: posts_of_tags(_posts(s, d)),
    "join_tag_posts": lambda s, d: posts_of_tags(_posts(s, d)).where(F.col("tag_slug") == "gpu").select("post_slug"),
    "filter_nonblank_tags": lambda s, d: _posts(s, d).select("slug", F.array_join(F.filter(F.transform("tags", js_trim), lambda t: t != ""), "|").alias("tags")),
    "filter_tag_search": _over_index(lambda t: t.where(F.lower("name").contains("in")).select("name", "count")),
    "sort_tags_count": _over_index(lambda t: _position(t, F.desc("count"), F.asc("name"))),
    "sort_tags_name": _over_index(lambda t: _position(t, F.asc("name"))),
    "sort_tags_recent": _over_index(lambda t: _position(t, F.desc("latest"), F.asc("name"))),
    "sort_tags_client": _over_index(lambda t: _position(t, F.desc("count"), F.asc("slug"))),
    "project_tags_json": _over_index(lambda t: t.select("name", F.to_json(F.struct("name", "slug", "count", F.date_format("latest", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("latestDate"))).alias("json"))),
    "str_slugify_tag": lambda s, d: tag_rows(_posts(s, d)).select("tag").distinct().select("tag", slugify_tag(F.col("tag")).alias("slug")),
}

_FROM, _TO = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "AAAAAACEEEEIIIINOOOOOOUUUUYaaaaaaceeeeiiiinoooooouuuuyy"


def slug_sql(x: str) -> str:
    """SQL of a slug."""
    x = f"translate({x}, '{_FROM}', '{_TO}')"
    for a, b in (("ß", "ss"), ("œ", "oe"), ("Œ", "OE"), ("æ", "ae"), ("Æ", "AE"), ("$", "dollar"), ("%", "percent"), ("&", "and"), ("-", " ")):
        x = f"replace({x}, '{a}', '{b}')"
    return f"lower(replace(trim(regexp_replace(regexp_replace({x}, '[^A-Za-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')), ' ', '-'))"


def tag_slug_sql(x: str) -> str:
    encoded = f"url_encode(replace(lower({x}), ' ', '-'))"
    for a, b in (("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%2A", "*")):
        encoded = f"replace({encoded}, '{a}', '{b}')"
    return f"case when {slug_sql(x)} <> '' then {slug_sql(x)} else {encoded} end"


_ROWS = P + """, r as (select slug, "date", pos, trim(tag) as tag from (select slug, "date", unnest(range(0, len(tags))) as pos, unnest(tags) as tag from p) where trim(tag) <> '')"""
_INDEX = _ROWS + f""", i as (select tag as name, count(*) as c, greatest(max("date"), timestamptz '1970-01-01 00:00:00+00') as latest, min((-epoch_us("date"), slug, pos)) as seen from r group by tag),
t as (select name, case when n = 1 then base else base || '-' || n end as slug, c as "count", latest from (select *, row_number() over (partition by base order by seen) as n from (select *, {tag_slug_sql("regexp_replace(name, '\\s+', ' ', 'g')")} as base from i)))
"""
_UNIQUE = f"""with w as (select id, coalesce(nullif({slug_sql("title")}, ''), 'post') as wanted from (select distinct id, title from post where title is not null)),
h as (select id, case when row_number() over (partition by wanted order by id) = 1 then wanted else wanted || '-' || substr(sha256(id), 1, 6) end as slug from w)
select id, case when k = 1 then slug else slug || '-' || k end as slug from (select id, slug, row_number() over (partition by slug order by id) as k from h)"""
ORACLE = {
    "agg_tag_index": _INDEX + 'select name, slug, "count", latest from t',
    "win_slug_disambiguate": _INDEX + "select name, slug from t",
    "join_tag_slug": _INDEX + "select distinct t.slug as tag_slug, r.slug as post_slug from r join t on r.tag = t.name",
    "join_tag_posts": _INDEX + "select distinct r.slug as post_slug from r join t on r.tag = t.name where t.slug = 'gpu'",
    "filter_nonblank_tags": P + "select slug, array_to_string(list_filter(list_transform(tags, lambda x: trim(x)), lambda x: x <> ''), '|') as tags from p",
    "filter_tag_search": _INDEX + "select name, \"count\" from t where contains(lower(name), 'in')",
    "sort_tags_count": _INDEX + 'select name, row_number() over (order by "count" desc, name) as position from t',
    "sort_tags_name": _INDEX + "select name, row_number() over (order by name) as position from t",
    "sort_tags_recent": _INDEX + "select name, row_number() over (order by latest desc, name) as position from t",
    "sort_tags_client": _INDEX + 'select name, row_number() over (order by "count" desc, slug) as position from t',
    "str_slugify_tag": _ROWS + f"select distinct tag, {tag_slug_sql("regexp_replace(tag, '\\s+', ' ', 'g')")} as slug from r",
    "project_tags_json": _INDEX + """select name, '{"name":' || cast(to_json(name) as varchar) || ',"slug":' || cast(to_json(slug) as varchar) || ',"count":' || "count" || ',"latestDate":"' || strftime(latest, '%Y-%m-%dT%H:%M:%S.%g') || 'Z"}' as json from t""",
    "win_unique_slug": _UNIQUE,  # a query of posts, whose SQL needs that of a slug
}
