import pytest
from pyspark.sql import functions as F

from millrace.operators.timestamps import timestamp_values
from millrace.plans import config
from millrace.plans.ordering import numbered, with_neighbours
from millrace.sources import files, sinks
from millrace.streaming.sync import current_generation, log_counts, upsert_stream, wait


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "blog" / "sub").mkdir(parents=True)
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "blog" / "a.md").write_text("---\ntitle: A\n---\nbody a")
    (tmp_path / "blog" / "sub" / "b.md").write_text("body b")
    (tmp_path / "node_modules" / "c.md").write_text("no")
    (tmp_path / "blog" / "x.test.ts").write_text("no")
    (tmp_path / "blog" / "x.ts").write_text("yes")
    return tmp_path


def names(df):
    return sorted(r["path"].rsplit("/", 1)[1] for r in df.collect())


def test_walks(spark, tree):
    found = files.markdown_files(spark, str(tree))
    assert names(found) == ["a.md", "b.md"]
    assert names(files.by_slug(found, "b")) == ["b.md"]
    assert names(files.targets(spark, str(tree), ["blog/sub"])) == ["b.md"]
    assert names(files.targets(spark, str(tree), [])) == ["a.md", "b.md"]
    assert names(files.source_files(spark, str(tree), (".ts",))) == ["x.ts"]
    assert files.markdown_files(spark, str(tree / "none")).count() == 0
    assert {r["body"] for r in files.with_front_matter(found).collect()} == {"\nbody a", "body b"}
    with pytest.raises(ValueError, match="no HTML"):
        files.html_file(spark, str(tree / "none.html"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "x"), ("b", None), (None, "z")], "slug string, body string")
    out = str(tmp_path / "out")
    assert sinks.write_markdown(df, out, "slug", "body", dry_run=True).count() == 2
    assert not (tmp_path / "out").exists()
    sinks.write_markdown(df, out, "slug", "body")
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_markdown(df, out, "slug", "body")
    sinks.write_markdown(df, out, "slug", "body", overwrite=True)
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), (None, None), (None, "x")], "new string, old string")
    assert sinks.changed_only(pairs, "new", "old").count() == 2
    assert "| n |" in sinks.report(spark.range(1).withColumnRenamed("id", "n"), "r")
    sinks.write_log_lines(spark.createDataFrame([("{}",)], "line string"), str(tmp_path / "log"))
    sinks.write_log_lines(spark.createDataFrame([("{}",)], "line string"), str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == 2


def test_deletion(spark):
    paths = spark.createDataFrame([(p,) for p in ("img/x/1.png", "img/x-2/1.png", "img/xy/1.png", "blog/x.md")], "path string")
    kept, deleted = sinks.delete_articles(paths, "x")
    assert sorted(r[0] for r in deleted.collect()) == ["blog/x.md", "img/x-2/1.png", "img/x/1.png"]
    assert [r[0] for r in kept.collect()] == ["img/xy/1.png"]
    many = spark.createDataFrame([(f"img/x-{i}/1.png",) for i in range(30)], "path string")
    with pytest.raises(ValueError, match="more than"):
        sinks.delete_articles(many, "x")


def test_upsert_stream(spark, tmp_path):
    schema = "slug string, title string, date string, updated string, tags array<string>"
    source, table, check = (str(tmp_path / n) for n in ("in", "table", "check"))
    spark.createDataFrame([("a", "A", "d", "1", ["x"]), ("b", "B", "d", "1", [])], schema).write.parquet(source)
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    wait(upsert_stream(stream(), table, check))
    spark.createDataFrame([("a", "A2", "d2", "2", ["y"]), ("a", "A1", "d1", "0", ["q"])], schema).write.mode("append").parquet(source)
    wait(upsert_stream(stream(), table, check))
    got = {r["slug"]: (r["title"], r["date"], r["tags"]) for r in current_generation(spark, table).collect()}
    assert got == {"a": ("A2", "d", ["x", "y"]), "b": ("B", "d", [])}


def test_upsert_stream_rewrites_touched_buckets_only(spark, tmp_path):
    schema = "slug string, title string, date string, updated string, tags array<string>"
    source, table, check = (str(tmp_path / n) for n in ("in", "table", "check"))
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    many = [(f"s{i}", "A", "d", "1", []) for i in range(500)]
    for n in range(5):
        spark.createDataFrame(many if n == 0 else [("s7", f"B{n}", "d", f"{n + 1}", [])], schema).coalesce(1).write.mode("append").parquet(source)
        wait(upsert_stream(stream(), table, check))
        assert current_generation(spark, table).count() == 500
    folders = {p.name: [b for b in p.iterdir() if b.name.startswith("bucket=")] for p in (tmp_path / "table").iterdir() if p.name.startswith("generation=")}
    assert len(folders["generation=0"]) >= 60  # the other buckets are still those of the first batch
    assert set(folders) == {"generation=0", "generation=3", "generation=4"}
    assert all(len(f) == 1 for name, f in folders.items() if name != "generation=0")
    assert len(list((tmp_path / "table" / "_manifests").glob("*.json"))) == 2
    assert current_generation(spark, table).where("slug = 's7'").first()["title"] == "B4"
    # as the batch before left it, for one that runs again
    assert current_generation(spark, table, 4).where("slug = 's7'").first()["title"] == "B3"


def test_log_stream(spark, tmp_path):
    schema = "log_id long, ts string, level string"
    source = str(tmp_path / "logs")
    rows = [(1, "2024-01-01T00:10:00Z", "INFO"), (1, "2024-01-01T00:10:00Z", "INFO"), (2, "2024-01-01T00:20:00Z", None), (3, "bad", "info")]
    spark.createDataFrame(rows, schema).write.parquet(source)
    q = log_counts(spark.readStream.schema(schema).parquet(source)).writeStream.format("memory").queryName("counts").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    wait(q)
    assert [(r["level"], r["n"]) for r in spark.table("counts").collect()] == [("info", 2)]


def test_late_log_rows_count(spark, tmp_path):
    schema = "log_id long, ts string, level string"
    source = str(tmp_path / "logs")
    for rows in ([(1, "2024-01-20T00:10:00Z", "INFO")], [(2, "2024-01-21T00:10:00Z", "info")], [(3, "2024-01-10T00:10:00Z", "info"), (1, "2024-01-20T00:10:00Z", "INFO")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    logs = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = log_counts(logs).writeStream.format("memory").queryName("late").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    wait(q)
    assert sorted((r["window"]["start"].day, r["n"]) for r in spark.table("late").collect()) == [(10, 1), (20, 1), (21, 1)]


def test_global_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    rows = numbered(df, [F.asc("k")], "n").collect()
    assert sorted((r["k"], r["n"]) for r in rows) == [(i, i + 1) for i in range(1000)]
    near = {r["k"]: (r["b"], r["a"]) for r in with_neighbours(df, [F.asc("k")], "k", "b", "a").collect()}
    assert near[0] == (None, 1)
    assert near[999] == (998, None)
    assert numbered(df.where("k < 0"), [F.asc("k")], "n").count() == 0


def test_settings(tmp_path, monkeypatch):
    f = tmp_path / "s.json"
    f.write_text('{"page_size": 9, "other": 1}')
    assert config.load(str(f)).page_size == 9
    with pytest.raises(ValueError, match="page_size"):
        config.checked({"page_size": 0, "comments": "x"})
    monkeypatch.setenv("MILLRACE_RELATED", "7")
    config.load.cache_clear()
    assert config.load().related == 7
    config.load.cache_clear()


def test_site_join_is_not_forced(spark, data):
    assert timestamp_values(spark, data).count() > 0


def test_small_helpers():
    assert config.css_variables({"a": {"b": "#fff"}, "c": 1}) == ["--color-a-b: #fff;", "--color-c: 1;"]
    assert len(config.run_id()) == 8


def test_block_trees(spark):
    from millrace.operators.blocks import first_match, with_paths

    rows = [("p", "a", None, 0, "text"), ("p", "b", None, 1, "image"), ("p", "c", "a", 0, "text"), ("p", "d", "c", 0, "image"), ("q", "e", None, 0, "text"), ("q", "f", "gone", 0, "image")]
    df = spark.createDataFrame(rows, "page string, block string, parent string, pos int, kind string")
    assert [tuple(r) for r in first_match(df, "page", "block", "parent", "pos", F.col("kind") == "image").collect()] == [("p", "d")]
    assert with_paths(df, "page", "block", "parent", "pos").count() == 5
    assert first_match(df.limit(0), "page", "block", "parent", "pos", F.lit(True)).count() == 0
    with pytest.raises(ValueError, match="deep"):
        with_paths(df, "page", "block", "parent", "pos", depth=2)
