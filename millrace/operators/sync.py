"""Incremental upsert, lookups of stored posts, and the batches and patches of translation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.text import math_problem
from millrace.sources import read_table

BATCH_CHARS = 6000


def incremental_upsert(current: DataFrame, incoming: DataFrame, key: str = "slug", version: str = "updated") -> DataFrame:
    """``current`` with ``incoming`` merged in, and ``action``: kept, unchanged, replaced or inserted.

    A row is unchanged if its version equals the stored one (null equals null). A replaced row keeps the
    stored date and has the stored tags first. Both sides should have one row per key; rows with a null
    key never match and are kept or inserted. Nothing but the two tables' keys is shuffled with their rows.
    """
    c, i = current.alias("c"), incoming.alias("i")
    both = c.join(i, F.col(f"c.{key}") == F.col(f"i.{key}"), "full_outer")
    # The key may be null on either side, so presence is told by a marker, not by the key.
    here, there = F.col("c.__here").isNotNull(), F.col("i.__there").isNotNull()
    same = here & there & F.col(f"c.{version}").eqNullSafe(F.col(f"i.{version}"))
    action = F.when(~there, "kept").when(~here, "inserted").when(same, "unchanged").otherwise("replaced")
    none = F.array().cast("array<string>")

    def merged(column: str) -> Column:
        if column == "date":
            return F.coalesce(F.col("c.date"), F.col("i.date"))
        if column == "tags":
            return F.when(here & there & ~same, F.array_union(F.coalesce(F.col("c.tags"), none), F.coalesce(F.col("i.tags"), none))).otherwise(F.when(there & ~same, F.col("i.tags")).otherwise(F.col("c.tags")))
        return F.when(there & ~same, F.col(f"i.{column}")).otherwise(F.col(f"c.{column}"))

    columns = [x for x in current.columns if x != "__here"]
    return both.select(*(merged(x).alias(x) for x in columns), action.alias("action"))


def upsert(current: DataFrame, incoming: DataFrame, key: str = "slug", version: str = "updated") -> DataFrame:
    return incremental_upsert(current.withColumn("__here", F.lit(True)), incoming.withColumn("__there", F.lit(True)), key, version)


def nodes(batches: DataFrame) -> DataFrame:
    """(batch_id, pos, node): the nodes of every batch in order."""
    return batches.select("batch_id", F.posexplode("nodes").alias("pos", "node"))


def value_of(node: str) -> Column:
    return F.coalesce(F.col(f"{node}.text"), F.col(f"{node}.latex"), F.lit(""))


def greedy_batches(sizes: Column, limit: int = BATCH_CHARS) -> Column:
    """Batch number of each size: a batch takes what still fits; an oversize one is alone."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(-1).alias("n"), F.lit(0).cast("long").alias("used"), F.lit(True).alias("closed"))

    def step(acc: Column, size: Column) -> Column:
        fresh = acc["closed"] | (acc["used"] + size > limit)
        n = F.when(fresh, acc["n"] + 1).otherwise(acc["n"])
        used = F.when(fresh, size).otherwise(acc["used"] + size)
        return F.struct(F.array_append(acc["out"], n).alias("out"), n.alias("n"), used.cast("long").alias("used"), (size > limit).alias("closed"))

    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def batched(batches: DataFrame, limit: int = BATCH_CHARS) -> DataFrame:
    """(batch_id, pos, size, part): nodes packed in order into parts of at most ``limit`` characters."""
    sizes = F.transform(F.coalesce("nodes", F.array().cast(batches.schema["nodes"].dataType)), lambda n: F.length(F.coalesce(n["text"], n["latex"], F.lit(""))).cast("long"))
    packed = batches.select("batch_id", F.arrays_zip(sizes.alias("size"), greedy_batches(sizes, limit).alias("part")).alias("z"))
    return packed.select("batch_id", F.posexplode("z").alias("pos", "z")).select("batch_id", F.col("pos").cast("long").alias("pos"), F.col("z.size").alias("size"), F.col("z.part").cast("long").alias("part"))


# Translators: functions from a node's (kind, text, latex) to its replacement.
TRANSLATORS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "mock": lambda kind, text, latex: F.when(kind == "math", F.regexp_replace(latex, r"\$+", "")).otherwise(F.concat(F.lit("[ZH] "), text)),
    "identity": lambda kind, text, latex: F.when(kind == "math", latex).otherwise(text),
}


def translator(name: str) -> Callable[[Column, Column, Column], Column]:
    """The translator of that name; an unknown one is the mock."""
    return TRANSLATORS.get(name, TRANSLATORS["mock"])


def patches(batches: DataFrame, name: str) -> DataFrame:
    """(batch_id, node_id, kind, value, confidence): one patch for each node."""
    n = nodes(batches)
    value = translator(name)(F.col("node.kind"), F.col("node.text"), F.col("node.latex"))
    return n.select("batch_id", F.col("node.nodeId").alias("node_id"), F.col("node.kind").alias("kind"), value.alias("value"), F.coalesce("node.confidence", F.lit("low")).alias("confidence"))


def apply_patches(all_nodes: DataFrame, all_patches: DataFrame) -> DataFrame:
    """Nodes with their patches' values; the last patch of a node wins, a node without one is unchanged.

    ``all_patches`` has a position ``pos``; the winner is found by a partial aggregate before the join.
    """
    last = all_patches.groupBy("batch_id", "node_id").agg(F.max_by("value", "pos").alias("patched"))
    return all_nodes.join(last, ["batch_id", "node_id"], "left").withColumn("value", F.coalesce("patched", "value")).drop("patched")


def with_fallback(all_nodes: DataFrame, all_patches: DataFrame) -> DataFrame:
    """The patches, and for each node that has none its own value (formulas with low confidence)."""
    missing = all_nodes.join(all_patches, ["batch_id", "node_id"], "left_anti")
    own = missing.select("batch_id", "node_id", "kind", "value", F.when(F.col("kind") == "math", "low").alias("confidence"))
    return all_patches.select("batch_id", "node_id", "kind", "value", "confidence").unionByName(own)


def cache_key(batch_nodes: Column, model: str) -> Column:
    """Hash of ``id:text|id:text`` and the model's name."""
    parts = F.transform(batch_nodes, lambda n: F.concat(n["nodeId"], F.lit(":"), F.coalesce(n["text"], n["latex"], F.lit(""))))
    return F.sha2(F.concat(F.array_join(parts, "|"), F.lit(model)), 256)


def parsed_patches(response: Column) -> Column:
    """Patches of a JSON answer keyed by node id; null where it is no such JSON."""
    return F.from_json(response, "map<string,struct<kind:string,text:string,latex:string,confidence:string>>", {"mode": "PERMISSIVE"})


def validated_patches(batches: DataFrame, response: str) -> DataFrame:
    """(batch_id, node_id, value, confidence, source): each node's patch from the answer, or itself.

    A patch is taken if it is there, of the node's kind and, for formulas, valid; confidence defaults to low.
    """
    parsed = batches.withColumn("__patches", parsed_patches(F.col(response)))
    n = parsed.select("batch_id", "__patches", F.explode("nodes").alias("node"))
    patch = F.try_element_at("__patches", F.col("node.nodeId"))
    picked = n.select("batch_id", "node", patch.alias("patch"))
    value = F.when(F.col("node.kind") == "math", F.col("patch.latex")).otherwise(F.col("patch.text"))
    fits = (F.col("patch.kind") == F.col("node.kind")) & value.isNotNull() & ((F.col("node.kind") != "math") | math_problem(value).isNull())
    taken = F.coalesce(fits, F.lit(False))
    return picked.select("batch_id", F.col("node.nodeId").alias("node_id"), F.when(taken, value).otherwise(value_of("node")).alias("value"), F.when(taken, F.coalesce("patch.confidence", F.lit("low"))).otherwise("low").alias("confidence"), F.when(taken, "patch").otherwise("identity").alias("source"))


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "translation_batch")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(_batches(spark, sf_dir)).select("batch_id", F.col("pos").cast("long").alias("pos"), F.col("node.nodeId").alias("node_id"), F.col("node.kind").alias("kind"), value_of("node").alias("value"))


def _even(df: DataFrame) -> DataFrame:
    """Patches of the nodes at even positions: the mock's."""
    return df.where(F.col("pos") % 2 == 0).select("batch_id", "node_id", "kind", F.concat(F.lit("[ZH] "), "value").alias("value"), F.lit("high").alias("confidence"), "pos")


def _stored_and_incoming(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """First versions of slugs as stored rows, and as incoming one row of all the later ones.

    That row merges as the later versions do one after another: the newest title and version, the first
    date there is, and the tags of all in order. A version equal to the one in front is not applied.
    Versions are in the order of ``updated``, so those that are applied are the first of each of its values:
    everything is an aggregate that combines before it shuffles, and a slug may have any number of versions.
    """
    columns = ["slug", "title", "date", "updated", "tags"]
    versions = read_table(spark, sf_dir, "post", *columns, "id").where(F.col("slug").isNotNull())
    # One row for each slug and version; in a struct null is the least, as in the order of versions.
    one = versions.groupBy("slug", "updated").agg(F.min(F.struct("id", "title", "tags", "date")).alias("row"), F.min(F.when(F.col("date").isNotNull(), F.struct("id", "date"))).alias("dated"), F.count("*").alias("n"))
    first = one.groupBy("slug").agg(F.min(F.struct("updated", "row")).alias("first"), F.max("updated").alias("newest"), F.min(F.when(F.col("dated").isNotNull(), F.struct("updated", "dated"))).alias("dated"), F.sum("n").alias("n"))
    current = first.select("slug", "first.row.title", "first.row.date", "first.updated", "first.row.tags")
    applied = one.join(first.select("slug", F.col("first.updated").alias("stored")), "slug").where(~F.col("updated").eqNullSafe(F.col("stored")))
    tag = applied.select("slug", "updated", F.posexplode("row.tags").alias("pos", "tag")).groupBy("slug", "tag").agg(F.min(F.struct("updated", "pos")).alias("seen"))
    ordered = F.array_sort(F.collect_list(F.struct("seen", "tag")))  # the different tags of a slug
    tags = tag.groupBy("slug").agg(F.transform(ordered, lambda t: t["tag"]).alias("tags"))
    titles = applied.groupBy("slug").agg(F.max(F.struct("updated", "row.title")).alias("last"))
    many = first.where("n > 1").join(titles, "slug", "left").join(tags, "slug", "left")
    return current.select(*columns), many.select("slug", F.col("last.title").alias("title"), F.col("dated.dated.date").alias("date"), F.col("newest").alias("updated"), "tags")


def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = upsert(*_stored_and_incoming(spark, sf_dir))
    return out.select("slug", "title", "date", "updated", F.array_join("tags", "|").alias("tags"), "action")


def existing_dates(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """``incoming`` (key, slug, source_id, source_date) with post_id and kept_date: that of the stored post of its slug, else of its id, else its source's.

    ``stored`` has slug, source_id, post_id and date. A stored side with several rows for a slug or an id
    counts with its first post and date, found by an aggregate before either join.
    """
    by = lambda c, name: stored.where(F.col(c).isNotNull()).groupBy(c).agg(F.min("post_id").alias(f"{name}_post"), F.min("date").alias(f"{name}_date"))
    both = incoming.join(by("slug", "slug"), "slug", "left").join(by("source_id", "id"), "source_id", "left")
    return both.select("key", "slug", F.coalesce("slug_post", "id_post").alias("post_id"), F.coalesce("slug_date", "id_date", "source_date").alias("kept_date"))


def _join_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with the stored post of their address's slug, or of their id in its file name, and the date that is kept."""
    last = lambda c: F.regexp_extract(c, "([^/?#]+)(?:[?#].*)?$", 1)
    posts = read_table(spark, sf_dir, "post", "slug", "id", "date", "source_url").select("slug", last("source_url").alias("source_id"), F.col("id").alias("post_id"), "date")
    article = read_table(spark, sf_dir, "article", "article_id", "canonicalUrl", "imported_at").select(F.col("article_id").alias("key"), F.regexp_replace(last("canonicalUrl"), r"\.html?$", "").alias("slug"), last("canonicalUrl").alias("source_id"), F.col("imported_at").alias("source_date"))
    return existing_dates(article, posts).withColumnRenamed("key", "article_id")


def _slug_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First file per slug; its owner is the page it came from, its import, or the file."""
    owner = F.coalesce("notion.id", F.concat(F.lit("import:"), "source_url"), F.concat(F.lit("file:"), "id"))
    posts = read_table(spark, sf_dir, "post", "slug", "id", "updated", "notion", "source_url").where(F.col("slug").isNotNull())
    return posts.groupBy("slug").agg(F.min_by(owner, F.struct("id", "updated")).alias("owner"))


def _image_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image addresses in the order they are first seen in an article, and where they are kept."""
    img = read_table(spark, sf_dir, "article", "article_id", "images").select("article_id", F.posexplode("images").alias("pos", "img")).where(F.col("img.url").isNotNull())
    first = img.groupBy("article_id", F.col("img.url").alias("url")).agg(F.min("pos").cast("long").alias("pos"), F.max("img.localPath").alias("local_path"))
    return first.select("article_id", "url", "pos", "local_path")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch spans of a run: each end with the nearest start in front, in its own hour or an earlier one.

    The hour is part of the window's key, so the run that holds a tenth of the log isn't one task; the last
    start of each hour is carried forward over the run's hours, of which there are few.
    """
    log = read_table(spark, sf_dir, "log_entry", "log_id", "ts", "runId", "event").dropDuplicates(["log_id"]).withColumn("at", F.col("ts").try_cast("timestamp")).where(F.col("at").isNotNull() & F.col("runId").isNotNull())
    fetch = log.where(F.col("event").isin("fetch.start", "fetch.done")).withColumn("hour", F.date_trunc("hour", "at"))
    start = F.when(F.col("event") == "fetch.start", F.col("at"))
    earlier = Window.partitionBy("runId").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    carried = fetch.groupBy("runId", "hour").agg(F.max(start).alias("latest")).select("runId", "hour", F.max("latest").over(earlier).alias("carried"))
    order = Window.partitionBy("runId", "hour").orderBy("at", "log_id").rowsBetween(Window.unboundedPreceding, -1)
    near = fetch.withColumn("near", F.last(start, ignorenulls=True).over(order)).where("event = 'fetch.done'")
    spans = near.join(carried, ["runId", "hour"]).withColumn("started", F.coalesce("near", "carried")).where("started is not null")
    return spans.select("log_id", ((F.unix_micros("at") - F.unix_micros("started")) / F.lit(1000)).cast("long").alias("span_ms"))


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit status of the articles' tags as configured keys, by how the posts use them.

    A key is used by every post that has it in any form; a form other than the key's own is an issue.
    """
    cleaned = lambda c: F.lower(F.trim(c))
    keys = read_table(spark, sf_dir, "article", "tags").select(F.explode("tags").alias("raw")).select(cleaned("raw").alias("key")).where(F.col("key") != "").distinct()
    tag = read_table(spark, sf_dir, "post", "tags").select(F.explode("tags").alias("raw")).withColumn("key", cleaned("raw"))
    seen = tag.groupBy("key").agg(F.count("*").alias("n_uses"), F.count_if(F.col("raw") == F.col("key")).alias("n_proper"))
    joined = keys.join(seen, "key", "left").select("key", F.coalesce("n_uses", F.lit(0)).alias("n_uses"), F.coalesce("n_proper", F.lit(0)).alias("n_proper"))
    return joined.select("key", "n_uses", "n_proper", audit_status(F.col("n_uses"), F.col("n_proper") == F.col("n_uses"), F.col("n_uses") - F.col("n_proper"), F.col("n_proper") > 0).alias("status"))


def audit_status(uses: Column, proper: Column, issues: Column, read: Column) -> Column:
    """UNUSED without uses, USED with proper ones only, SHADOWED with issues but also read as it is, else READ_ONLY."""
    return F.when(uses == 0, "UNUSED").when(proper, "USED").when((issues > 0) & read, "SHADOWED").otherwise("READ_ONLY")


def batch_outcomes(all_nodes: DataFrame) -> DataFrame:
    """(batch_id, total, filled, cached): nodes of each batch, those with a value, and whether an earlier batch has the same content.

    The first batch of equal content, by id, asks the translator; later ones are answered from the cache.
    """
    content = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node_id", "value"))), lambda n: F.concat(n["node_id"], F.lit(":"), n["value"])), "|"), 256)
    one = all_nodes.groupBy("batch_id").agg(F.count("*").alias("total"), F.count_if(F.length("value") > 0).alias("filled"), content.alias("key"))
    first = one.groupBy("key").agg(F.min("batch_id").alias("first"))
    return one.join(first, "key").select("batch_id", "total", "filled", (F.col("batch_id") != F.col("first")).alias("cached"))


def failed_nodes(all_nodes: DataFrame) -> DataFrame:
    """(batch_id, node_id), each once: the nodes of the batches that failed."""
    failed = batch_outcomes(all_nodes).where(F.col("filled") < F.col("total")).select("batch_id")
    return all_nodes.join(failed, "batch_id", "left_semi").select("batch_id", "node_id").distinct()


def batch_counters(all_nodes: DataFrame) -> DataFrame:
    """One row: batches, those that succeeded (every node has a value), failed, and came from the cache."""
    whole = F.col("filled") == F.col("total")
    out = batch_outcomes(all_nodes)
    return out.agg(F.count("*").alias("total_batches"), F.count_if(whole).alias("success_batches"), F.count_if(~whole).alias("failed_batches"), F.count_if(whole & F.col("cached")).alias("cache_hits"))


def _config_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which scripts' log messages mention which keys: a token equi-join in place of a contains join."""
    keys = read_table(spark, sf_dir, "site", "source").select(F.lower("source").alias("key")).union(read_table(spark, sf_dir, "post", "slug").select(F.lit("images").alias("key"))).distinct()
    words = read_table(spark, sf_dir, "log_entry", "log_id", "script", "msg").select("script", F.explode(F.array_distinct(F.split(F.lower("msg"), "[^a-z]+"))).alias("key"))
    return words.groupBy("script", "key").agg(F.count("*").alias("n")).join(keys, "key").select("key", "script", "n")


QUERIES = {
    "incremental_upsert": _upsert,
    "join_existing": _join_existing,
    "agg_slug_owner": _slug_owner,
    "join_image_map": _image_map,
    "log_spans": _spans,
    "audit_status": _audit,
    "agg_audit_summary": lambda s, d: _audit(s, d).groupBy("status").agg(F.count("*").alias("n")),
    "join_config_usage": _config_usage,
    "join_column": lambda s, d: read_table(s, d, "article", "article_id", "site").join(read_table(s, d, "site", "site", "tz"), "site").select("article_id", "tz"),
    "win_node_index": lambda s, d: _nodes(s, d).select("batch_id", "pos", F.concat(F.lit("node_"), F.col("pos").cast("string"), F.lit("_"), "kind").alias("node")),
    "win_greedy_batch": lambda s, d: batched(_batches(s, d)),
    "agg_batch_chars": lambda s, d: batched(_batches(s, d)).groupBy("batch_id", "part").agg(F.sum("size").alias("chars")),
    "agg_batch_counters": lambda s, d: batch_counters(_nodes(s, d)),
    "join_patch": lambda s, d: apply_patches(_nodes(s, d), _even(_nodes(s, d))).select("batch_id", "node_id", "value"),
    "join_patch_fallback": lambda s, d: with_fallback(_nodes(s, d), _even(_nodes(s, d))),
    "set_merge_patches": lambda s, d: patches(_batches(s, d).where("seq % 2 = 0"), "mock").unionByName(patches(_batches(s, d).where("seq % 2 = 1"), "identity")),
    "set_unique_nodeids": lambda s, d: failed_nodes(_nodes(s, d)),
    "udf_translate_mock": lambda s, d: patches(_batches(s, d), "mock").select("batch_id", "node_id", "value"),
    "udf_translate_identity": lambda s, d: patches(_batches(s, d), "identity").select("batch_id", "node_id", "value"),
    "str_cache_key": lambda s, d: _batches(s, d).select("batch_id", cache_key(F.col("nodes"), "model-1").alias("key")),
    "json_parse_patches": lambda s, d: validated_patches(_batches(s, d).withColumn("answer", F.to_json(F.map_from_entries(F.transform(F.filter("nodes", lambda n: n["kind"] == "text"), lambda n: F.struct(n["nodeId"], F.struct(n["kind"].alias("kind"), F.concat(F.lit("P: "), n["text"]).alias("text"))))))), "answer"),
    "math_valid": lambda s, d: _nodes(s, d).where("kind = 'math'").select("batch_id", "node_id", math_problem(F.col("value")).alias("problem")),
    "notion_cover": lambda s, d: read_table(s, d, "post", "id", "updated", "cover", "source").select("id", "updated", F.when(F.col("source.kind") == "notion", F.col("cover")).otherwise(F.col("source.url")).alias("cover")),
    "notion_image_url": lambda s, d: read_table(s, d, "article", "article_id", "images").select("article_id", F.explode("images").alias("i")).select("article_id", F.col("i.url").alias("raw"), F.when(F.col("i.localPath").isNotNull(), F.col("i.localPath")).otherwise(F.col("i.url")).alias("url")),
    "notion_image_md": lambda s, d: read_table(s, d, "article", "article_id", "title", "images").select("article_id", "title", F.explode("images").alias("i")).select("article_id", F.concat(F.lit("!["), F.coalesce("title", F.lit("")), F.lit("]("), F.coalesce("i.localPath", "i.url"), F.lit(")")).alias("markdown")),
    "notion_plain_text": lambda s, d: _batches(s, d).select("batch_id", F.coalesce(F.nullif(F.array_join(F.transform("nodes", lambda n: F.coalesce(n["text"], F.lit(""))), ""), F.lit("")), F.lit("Untitled")).alias("text")),
}

_NODES = """with n as (select batch_id, cast(unnest(range(0, len(nodes))) as bigint) as pos, unnest(nodes) as node from translation_batch where nodes is not null),
v as (select batch_id, pos, node.nodeId as node_id, node.kind as kind, coalesce(node.text, node.latex, '') as value from n)
"""
_VERSIONS = """with recursive w as (select slug, title, "date", updated, coalesce(tags, []) as tags, tags as raw, row_number() over (partition by slug order by updated nulls first, id) as n from post where slug is not null),
m as (select slug, title, "date", updated, raw as tags, n, 'kept' as action from w where n = 1
 union all select m.slug, case when w.updated is distinct from m.updated then w.title else m.title end, coalesce(m."date", w."date"), w.updated,
  case when w.updated is distinct from m.updated then list_concat(coalesce(m.tags, []), w.tags) else m.tags end, w.n, case when w.updated is distinct from m.updated or m.action = 'replaced' then 'replaced' else 'unchanged' end from m join w on w.slug = m.slug and w.n = m.n + 1)
"""
_UNION = "list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda z: list_position(l, z[1]) = z[2]), lambda z: z[1])"
_AUDITED = """with k as (select distinct lower(trim(raw)) as key from (select unnest(tags) as raw from article) where lower(trim(raw)) <> ''),
a as (select lower(trim(raw)) as key, count(*) as n_uses, count(*) filter (raw = lower(trim(raw))) as n_proper from (select unnest(tags) as raw from post) group by 1),
s as (select k.key, coalesce(n_uses, 0) as n_uses, coalesce(n_proper, 0) as n_proper, case when n_uses is null then 'UNUSED' when n_uses = n_proper then 'USED' when n_proper > 0 then 'SHADOWED' else 'READ_ONLY' end as status from k left join a on a.key = k.key)
"""
_BATCHES = """with recursive n as (select batch_id, cast(unnest(range(0, len(nodes))) as bigint) as pos, cast(unnest(list_transform(nodes, lambda x: length(coalesce(x.text, x.latex, '')))) as bigint) as size from translation_batch where len(nodes) > 0),
r as (select batch_id, pos, size, cast(0 as bigint) as part, size as used from n where pos = 0
 union all select n.batch_id, n.pos, n.size, case when r.size > 6000 or r.used + n.size > 6000 then r.part + 1 else r.part end, case when r.size > 6000 or r.used + n.size > 6000 then n.size else r.used + n.size end from r join n on n.batch_id = r.batch_id and n.pos = r.pos + 1)
"""
_COUNT = lambda c: f"len(regexp_extract_all(b, '\\{c}'))"
ORACLE = {
    "win_greedy_batch": _BATCHES + "select batch_id, pos, size, part from r",
    "agg_batch_chars": _BATCHES + "select batch_id, part, cast(sum(size) as bigint) as chars from r group by all",
    "math_valid": _NODES + f"""select batch_id, node_id, case when contains(value, '$$') then 'Contains $$ delimiter' when contains(value, '$') then 'Contains $ delimiter' when contains(value, '\\[') or contains(value, '\\]') then 'Contains \\[ or \\] delimiter' when regexp_matches(value, '<[^>]+>') then 'Contains HTML tags'
 when {_COUNT('{')} <> {_COUNT('}')} then 'Unbalanced braces: ' || ({_COUNT('{')} - {_COUNT('}')}) when {_COUNT('[')} <> {_COUNT(']')} then 'Unbalanced square brackets: ' || ({_COUNT('[')} - {_COUNT(']')}) when {_COUNT('(')} <> {_COUNT(')')} then 'Unbalanced parentheses: ' || ({_COUNT('(')} - {_COUNT(')')}) end as problem
from (select *, regexp_replace(value, '\\\\.', '', 'g') as b from v) where kind = 'math'""",
    "incremental_upsert": _VERSIONS + f"""select slug, title, "date", updated, case when action = 'replaced' then (select array_to_string({_UNION}, '|') from (select tags as l)) else array_to_string(tags, '|') end as tags, action
 from (select *, max(n) over (partition by slug) as top from m) where n = top""",
    "join_existing": """with p as (select slug, min(id) as post_id, min("date") as stored from post where slug is not null group by slug),
 q as (select regexp_extract(source_url, '([^/?#]+)(?:[?#].*)?$', 1) as source_id, min(id) as post_id, min("date") as stored from post where source_url is not null group by 1),
 a as (select article_id, imported_at, regexp_extract(canonicalUrl, '([^/?#]+)(?:[?#].*)?$', 1) as source_id from article), b as (select *, regexp_replace(source_id, '\\.html?$', '') as slug from a)
select article_id, b.slug, coalesce(p.post_id, q.post_id) as post_id, coalesce(p.stored, q.stored, imported_at) as kept_date from b left join p on b.slug = p.slug left join q on b.source_id = q.source_id""",
    "agg_slug_owner": "select slug, coalesce(notion.id, 'import:' || source_url, 'file:' || id) as owner from (select *, row_number() over (partition by slug order by id, updated nulls first) as n from post where slug is not null) where n = 1",
    "join_image_map": "select article_id, url, min(pos) as pos, max(lp) as local_path from (select article_id, cast(unnest(range(0, len(images))) as bigint) as pos, unnest(images).url as url, unnest(images).localPath as lp from article) where url is not null group by article_id, url",
    "log_spans": """with l as (select distinct on (log_id) log_id, try_cast(ts as timestamptz) as moment, runId, event from log_entry), f as (select * from l where moment is not null and runId is not null and event in ('fetch.start', 'fetch.done')),
s as (select *, last_value(case when event = 'fetch.start' then moment end ignore nulls) over (partition by runId order by moment, log_id rows between unbounded preceding and 1 preceding) as started from f)
select log_id, cast(trunc((epoch_us(moment) - epoch_us(started)) / 1000.0) as bigint) as span_ms from s where event = 'fetch.done' and started is not null""",
    "audit_status": _AUDITED + "select * from s",
    "agg_audit_summary": _AUDITED + "select status, count(*) as n from s group by status",
    "join_config_usage": """with k as (select distinct lower(source) as key from site union select 'images'), w as (select script, unnest(list_distinct(regexp_split_to_array(lower(msg), '[^a-z]+'))) as key from log_entry)
select k.key, script, count(*) as n from w join k on k.key = w.key group by all""",
    "join_column": "select article_id, tz from article join site using (site)",
    "win_node_index": _NODES + "select batch_id, pos, 'node_' || pos || '_' || kind as node from v",
    "agg_batch_counters": _NODES + """, o as (select batch_id, bool_and(length(value) > 0) as whole, string_agg(node_id || ':' || value, '|' order by pos) as content from v group by batch_id),
 c as (select *, batch_id <> min(batch_id) over (partition by content) as cached from o)
 select count(*) as total_batches, count(*) filter (whole) as success_batches, count(*) filter (not whole) as failed_batches, count(*) filter (whole and cached) as cache_hits from c""",
    "join_patch": _NODES + "select batch_id, node_id, case when pos % 2 = 0 then '[ZH] ' || value else value end as value from v",
    "join_patch_fallback": _NODES + "select batch_id, node_id, kind, case when pos % 2 = 0 then '[ZH] ' || value else value end as value, case when pos % 2 = 0 then 'high' when kind = 'math' then 'low' end as confidence from v",
    "set_merge_patches": "with n as (select batch_id, seq, unnest(nodes) as node from translation_batch) select batch_id, node.nodeId as node_id, node.kind as kind, case when seq % 2 = 1 then case when node.kind = 'math' then node.latex else node.text end when node.kind = 'math' then regexp_replace(node.latex, '\\$+', '', 'g') else '[ZH] ' || node.text end as value, coalesce(node.confidence, 'low') as confidence from n where seq is not null",
    "set_unique_nodeids": _NODES + "select distinct v.batch_id, v.node_id from v join (select batch_id from v group by batch_id having not bool_and(length(value) > 0)) f on f.batch_id = v.batch_id",
    "udf_translate_mock": _NODES + "select batch_id, node.nodeId as node_id, case when node.kind = 'math' then regexp_replace(node.latex, '\\$+', '', 'g') else '[ZH] ' || node.text end as value from n",
    "udf_translate_identity": _NODES + "select batch_id, node.nodeId as node_id, case when node.kind = 'math' then node.latex else node.text end as value from n",
    "str_cache_key": "select batch_id, sha256(array_to_string(list_transform(nodes, lambda n: n.nodeId || ':' || coalesce(n.text, n.latex, '')), '|') || 'model-1') as key from translation_batch",
    "notion_cover": "select id, updated, case when source.kind = 'notion' then cover else source.url end as cover from post",
    "notion_image_url": "select article_id, i.url as raw, coalesce(i.localPath, i.url) as url from (select article_id, unnest(images) as i from article)",
    "notion_image_md": "select article_id, '![' || coalesce(title, '') || '](' || coalesce(i.localPath, i.url) || ')' as markdown from (select article_id, title, unnest(images) as i from article)",
    "notion_plain_text": "select batch_id, coalesce(nullif(array_to_string(list_transform(nodes, lambda n: coalesce(n.text, '')), ''), ''), 'Untitled') as text from translation_batch",
    "json_parse_patches": _NODES + "select batch_id, node_id, case when kind = 'text' and node_text is not null then 'P: ' || value else value end as value, 'low' as confidence, case when kind = 'text' and node_text is not null then 'patch' else 'identity' end as source from (select v.*, n.node.text as node_text from v join n on v.batch_id = n.batch_id and v.pos = n.pos)",
}
