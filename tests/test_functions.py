"""Input and output pairs of the expressions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import code, slugs, text, urls
from millrace.functions.dom import parse
from millrace.operators.documents import best_source, image_placeholder, logs_at_least
from millrace.operators.markdown import fence_segments, fix_math, inline_segments, node_rows, suspicious_emphasis
from millrace.operators.pages import clean_zhihu, generic, image_source, keywords, main_element, medium, to_markdown, wechat, zhihu
from millrace.operators.posts import pagination, related
from millrace.operators.sync import greedy_batches, upsert


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("raw", "slug"),
    [("Café 123", "cafe-123"), ("Price: $100", "price-dollar100"), ("50% off & more", "50percent-off-and-more"), ("snake_case", "snakecase"), ("a-b  c", "a-b-c"), ("web.3.0", "web30"), ("缓存", ""), ("", ""), ("Straße", "strasse")],
)
def test_slug(spark, raw, slug):
    assert value(spark, slugs.normalise_slug(F.lit(raw))) == slug


@pytest.mark.parametrize(("raw", "slug"), [("Web3.0", "web30"), (" static  sites ", "static-sites"), ("前端", "%E5%89%8D%E7%AB%AF"), ("前 端!", "%E5%89%8D-%E7%AB%AF!")])
def test_tag_slug(spark, raw, slug):
    assert value(spark, slugs.slugify_tag(F.lit(raw))) == slug


def test_latin_slug(spark):
    assert value(spark, slugs.latin_slug(F.lit("缓存"), {"缓": "huan", "存": "cun"})) == "huan-cun"
    assert value(spark, slugs.latin_slug(F.lit("Cache 缓存"), {"缓": "huan"})) == "cache"


@pytest.mark.parametrize(
    ("raw", "kept"),
    [("https://a.example/x?view=full&UTM_Source=feed&share_code=abc", "https://a.example/x?view=full"), (" https://a.example/x?b=2&a=1&b=1#f ", "https://a.example/x?a=1&b=2&b=1#f"), ("https://a.example/x?utm_id=1", "https://a.example/x"), ("plain", "plain")],
)
def test_import_url(spark, raw, kept):
    assert value(spark, urls.import_url(F.lit(raw))) == kept


def test_providers(spark):
    cases = {"https://zhuanlan.zhihu.com/p/1": "zhihu", "https://www.zhihu.com/x": "others", "https://x.medium.com/a": "medium", "https://mp.weixin.qq.com/s/1": "wechat", "no address": "others"}
    for url, name in cases.items():
        assert value(spark, urls.provider(F.lit(url))) == name
    urls.register_adapter("test", lambda u: u.contains("t.example"))
    try:
        assert value(spark, urls.provider(F.lit("https://t.example/"))) == "test"
        assert urls.ADAPTERS[-1][0] == "others"
    finally:
        urls.ADAPTERS[:] = [a for a in urls.ADAPTERS if a[0] != "test"]


@pytest.mark.parametrize(("path", "base", "out"), [("/a", "site", "/site/a"), ("/site/a", "/site/", "/site/a"), ("/site", "site", "/site"), ("/a", "/", "/a"), ("//cdn/a", "site", "//cdn/a"), ("https://x", "site", "https://x")])
def test_with_base(spark, path, base, out):
    assert value(spark, urls.with_base(F.lit(path), F.lit(base))) == out


def test_normalise_url(spark):
    base = F.lit("https://a.example/p/q")
    for raw, out in {"//c/x": "https://c/x", "http://b/": "http://b/", "/r": "https://a.example/r", "s": "https://a.example/p/s", "": ""}.items():
        assert value(spark, urls.normalise_url(F.lit(raw), base)) == out
    assert value(spark, urls.normalise_url(F.lit("s"))) == ""


@pytest.mark.parametrize(
    ("raw", "out"),
    [
        ("https://a/?token=abc&x=1", "https://a/?token=[REDACTED]&x=1"),
        ("Bearer abcdefghijklmnop", "Bearer abcdef...mnop"),
        ("bearer short", "bearer short"),
        ("sid=abcdefghijklmnop; a=b", "sid=abcdef...mnop; a=b"),
        ("sid=abcdefghij", "sid=abcdefghij"),
        ("plain", "plain"),
    ],
)
def test_redaction(spark, raw, out):
    assert value(spark, code.redact_value(F.lit(raw))) == out


def test_sensitive_keys_and_maps(spark):
    assert value(spark, code.is_sensitive(F.lit("hasAuthor")))
    assert not value(spark, code.is_sensitive(F.lit("title")))
    assert value(spark, code.is_sensitive(F.lit("myField"), ("myfield",)))
    fields = F.create_map(F.lit("apiKey"), F.lit("x"), F.lit("n"), F.lit("sid=abcdefghijklmnop"))
    assert value(spark, code.redact_fields(fields)) == {"apiKey": "[REDACTED]", "n": "sid=abcdef...mnop"}


@pytest.mark.parametrize(
    ("source", "lang"),
    [("def f(x):\n    import os", "python"), ("#!/usr/bin/env python3\nx", "python"), ("#!/bin/sh\nx", "bash"), ("FROM a\nRUN b", "dockerfile"), ('{"a": "b"}', "json"), ("#include <x>\nstd::cout << 1;", "cpp"), ("name: x\non:\njobs:\n  a: b", "yaml"), ("hello", "text"), ("  \n", "text")],
)
def test_code_language(spark, source, lang):
    assert value(spark, code.code_language(F.lit(source))) == lang


def test_code_meta(spark):
    m = value(spark, code.code_meta(F.lit('{5-3, 9} file="a b.py" nolines extra')))
    assert (m["title"], m["showLineNumbers"], m["highlights"], m["meta"]) == ("a b.py", False, [3, 4, 5, 9], "extra")
    empty = value(spark, code.code_meta(F.lit(None).cast("string")))
    assert (empty["title"], empty["showLineNumbers"], empty["highlights"], empty["meta"]) == (None, True, [], "")


def test_reading_time(spark):
    words, minutes = text.reading_stats(F.lit("<p>你好 world 123</p>"))
    assert (value(spark, words), value(spark, minutes)) == (4, 1)
    words, minutes = text.reading_stats(F.lit(""))
    assert (value(spark, words), value(spark, minutes)) == (0, 0)


def test_text_cleaning(spark):
    assert value(spark, text.normalise_invisible(F.lit("a b​c﻿"))) == "a bc"
    assert value(spark, text.compress_lines(F.lit("a\n\n\n\nb\r\nc"))) == "a\n\nb\nc"
    assert value(spark, text.compress_lines(F.lit("a\r\n\r\n\r\nb"))) == "a\n\n\nb"
    assert value(spark, text.unescape_math(F.lit(r"\$\$x\$\$ and \$y\$"))) == "$x$ and $y$"
    assert value(spark, text.sanitise_mdx(F.lit("<https://a.example/b> <!--  --> x"))) == "[https://a.example/b](https://a.example/b)  x"
    assert value(spark, text.duration_label(F.lit(999))) == "999ms"
    assert value(spark, text.duration_label(F.lit(1230))) == "1.23s"
    assert value(spark, text.duration_label(F.lit(90000))) == "1.50m"
    assert value(spark, text.split_front_matter(F.lit("---\na: b\n---\nbody")))["body"] == "\nbody"
    assert value(spark, text.split_front_matter(F.lit("---\nopen")))["body"] == "---\nopen"
    assert value(spark, text.caption(F.lit("图 3 结果")))
    assert not value(spark, text.caption(F.lit("Some prose")))
    assert value(spark, text.math_problem(F.lit(r"\frac{a}{b"))) == "Unbalanced braces: 1"
    assert value(spark, text.math_problem(F.lit("$x"))) == "Contains $ delimiter"
    assert value(spark, text.math_problem(F.lit(r"\{a"))) is None
    assert value(spark, text.truncate_with_hash(F.lit("abc"), 2)) == "ab... [truncated, hash: 17862]"
    assert value(spark, text.to_boolean(F.lit(" Yes "))) is True
    assert value(spark, text.to_boolean(F.lit("maybe"))) is None


def test_language_ratios(spark):
    rows = [("plain English text with words",), ("这是一段中文文本内容很多字",), ("short",), ("",), (None,), ("```\ncode code code code\n```\n中文内容比较多一些字啊",)]
    got = [r["r"]["language"] for r in text.with_ratios(spark.createDataFrame(rows, "t string"), "t", "r").select("r").collect()]
    assert got == ["en", "zh", "unknown", "unknown", "unknown", "zh"]


@pytest.mark.parametrize(
    ("page", "total", "window", "items"),
    [(1, 10, 5, "1 2 3 4 5 ellipsis 10"), (4, 10, 5, "1 2 3 4 5 6 ellipsis 10"), (5, 10, 1, "1 ellipsis 5 ellipsis 10"), (9, 10, 5, "1 ellipsis 6 7 8 9 10"), (1, 3, 5, "1 2 3"), (1, 1, 5, "1"), (5, 10, 2, "1 ellipsis 4 5 6 ellipsis 10")],
)
def test_pagination(spark, page, total, window, items):
    assert value(spark, pagination(F.lit(page).cast("long"), F.lit(total).cast("long"), window)) == items.split()


def test_pagination_out_of_range(spark):
    assert value(spark, pagination(F.lit(0).cast("long"), F.lit(3).cast("long"))) is None
    assert value(spark, pagination(F.lit(1).cast("long"), F.lit(0).cast("long"))) is None


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 9000), max_size=12))
def test_greedy_batches(spark, sizes):
    got = value(spark, greedy_batches(F.array(*map(F.lit, sizes)).cast("array<long>"), 6000))
    assert got == sorted(got)
    for b in set(got):
        members = [s for s, n in zip(sizes, got, strict=True) if n == b]
        assert sum(members) <= 6000 or len(members) == 1


def test_greedy_batches_example(spark):
    assert value(spark, greedy_batches(F.array(*map(F.lit, [3000, 2500, 1000, 7000, 100])).cast("array<long>"), 6000)) == [0, 0, 1, 2, 3]


def test_related_against_brute_force(spark):
    import random

    rng = random.Random(5)
    posts = [(f"p{i}", i % 17, rng.sample(["a", "b", "c", " d", ""], rng.randint(0, 3))) for i in range(60)]
    df = spark.createDataFrame([(s, d, t) for s, d, t in posts], "slug string, day int, tags array<string>").withColumn("date", F.timestamp_seconds("day"))
    got = {(r["slug"], r["rank"]): r["related"] for r in related(df, 3).collect()}
    clean = lambda t: {x.strip() for x in t} - {""}
    expected = {}
    for s, _, t in posts:
        others = sorted((p for p in posts if p[0] != s and clean(p[2]) & clean(t)), key=lambda p: (-p[1], p[0]))
        expected |= {(s, n): p[0] for n, p in enumerate(others[:3], 1)}
    assert got == expected


def test_upsert(spark):
    schema = "slug string, title string, date string, updated string, tags array<string>"
    stored = spark.createDataFrame([("a", "A", "d1", "1", ["x"]), ("b", "B", None, "1", None), ("c", "C", "d3", None, ["z"]), (None, "N", "d", "1", [])], schema)
    incoming = spark.createDataFrame([("a", "A2", "d9", "2", ["y", "x"]), ("b", "B2", "d2", "1", ["q"]), ("d", "D", "d4", "1", ["w"]), ("c", "C2", "d0", None, [])], schema)
    got = {r["title"]: (r["action"], r["date"], r["tags"]) for r in upsert(stored, incoming).collect()}
    assert got == {"A2": ("replaced", "d1", ["x", "y"]), "B": ("unchanged", "d2", None), "C": ("unchanged", "d3", ["z"]), "D": ("inserted", "d4", ["w"]), "N": ("kept", "d", [])}


def test_logs_and_images(spark):
    logs = spark.createDataFrame([("debug",), ("WARN",), (None,), ("odd",), ("error",)], "level string")
    assert logs_at_least(logs, "warn").count() == 2
    assert logs_at_least(logs, "info").count() == 4
    assert value(spark, best_source(F.lit("a 320w, b 2x, c 640w"))) == "b"
    assert value(spark, image_placeholder(F.lit("image/png"), F.lit(100), F.lit(10), F.lit(10)))
    assert not value(spark, image_placeholder(F.lit("image/png"), F.lit(100_000), F.lit(10), F.lit(10)))
    assert value(spark, image_placeholder(F.lit(None).cast("string"), F.lit(100_000), F.lit(900), F.lit(900)))


def test_math_delimiters():
    assert fix_math("A B $ x $ and \\$kept$") == "A B $x$ and \\$kept$"
    assert fix_math("Text ```$kept$``` $ spaced $ $line\nwith newline$ $$unclosed") == "Text ```$kept$``` $spaced$ \n$$\nline\nwith newline\n$$\n $$unclosed"
    assert fix_math("---\ntitle: t\ncontent $a \\$ b$") == "---\ntitle: t\ncontent $a \\$ b$"
    assert fix_math("```js\n$ code $\n```\n$ x $") == "```js\n$ code $\n```\n$x$"


def test_fences():
    kinds = fence_segments("---\ntitle: demo\n---\npara\n```js\n$code$\n```\n~~~py\ncode\n")
    assert [k for k, _ in kinds] == ["frontmatter", "text", "code", "code"]
    assert "".join(c for _, c in kinds) == "---\ntitle: demo\n---\npara\n```js\n$code$\n```\n~~~py\ncode\n"
    assert [k for k, _ in fence_segments("```js\ncode\n~~~\nstill code")] == ["code"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="a`~$\n -\\", max_size=60))
def test_segments_lose_nothing(markdown):
    assert "".join(c for _, c in fence_segments(markdown)) == markdown
    assert "".join(c for _, c in inline_segments(markdown)) == markdown


def test_nodes_and_emphasis():
    rows = node_rows("# Title\n\nSome `code` text ![alt](x.png)\n\n$$\na+b\n$$\n")
    assert [(k, v, c) for _, k, v, c in rows] == [("text", "Title", "heading"), ("text", "Title", "heading"), ("text", "alt", "image-alt"), ("text", "Some ", "paragraph"), ("text", " text ", "paragraph"), ("math", "a+b", "")]
    assert suspicious_emphasis("a_b_c and _fine_ `x_y_z`\n\nfoo _bar_baz") == [(1, 2, "_b_"), (3, 5, "_bar_")]


def test_pages():
    body = "word " * 40
    page = f'<html><head><title>T</title><meta name="author" content="A B"></head><body><nav>menu</nav><article><h1>H</h1><p>{body}<p>two<div class="share">s</div></article></body></html>'
    title, author, _, _, html, base, host = generic(page, "https://a.example/x")
    assert (title, author, base, host) == ("H", "A B", "https://a.example", "a.example")
    assert "menu" not in html
    assert "share" not in html
    assert "two" in html


def test_markdown_of_a_page():
    html = '<article><h2>Head</h2><p>Text <strong>bold</strong> <a href="/l">link</a> <span class="ztext-math" data-tex="y = Wx">z</span></p><ul><li>one<li>two</ul><pre><code class="language-python">import x\n</code></pre><figure><img data-src="//c.example/i.png" alt="i"><figcaption>cap</figcaption></figure><blockquote><p>q</blockquote><table><tr><th>a<th>b<tr><td>1<td>2</table></article>'
    md, images = to_markdown(html, "https://a.example/p")
    assert md == "## Head\n\nText **bold** [link](https://a.example/l) $y = Wx$\n\n- one\n- two\n\n```python\nimport x\n```\n\n![i](https://c.example/i.png)\n\ncap\n\n> q\n\n| a | b |\n| --- | --- |\n| 1 | 2 |"
    assert images == ["https://c.example/i.png"]


def test_images_and_zhihu():
    assert image_source({"src": "data:x", "srcset": "a 1x"}, None) == ""
    assert image_source({"srcset": "https://a/1 320w, https://a/2 2x"}, None) == "https://a/2"
    assert image_source({"src": "i.png"}, "https://a.example/p/q") == "https://a.example/p/i.png"
    assert clean_zhihu('<h3>a</h3><h4>b</h4><a href="https://zhida.zhihu.com/search?zd_token=1">t</a><script>x</script>') == "<h2>a</h2><h3>b</h3>t"
    assert clean_zhihu("<h1>a</h1>") == "<h1>a</h1>"


LONG = "The cache keeps rows for long articles. " * 5


def test_main_element_by_the_order_of_places():
    assert main_element(parse(f"<main><article>{LONG}</article></main>")).name == "article"
    assert main_element(parse(f"<div class=post>{LONG}</div><main>{LONG}</main>")).name == "main"
    assert main_element(parse(f"<div class=post>{LONG}more</div><main>{LONG}</main>")).classes() == ["post"]
    assert main_element(parse(f"<div>short</div><div id=a>{LONG}</div><div id=b>{LONG}</div>")).attrs["id"] == "a"
    assert main_element(parse("<article>short</article>")) is None


def test_site_adapters():
    head = '<title>Tab</title><meta name="author" content="Ann"><meta name="publish_date" content="2024-03-01">'
    page = f'<head>{head}<meta name="Keywords" content="a, b，a"></head><article><h1 class="Post-Title">Head</h1>{LONG}</article><p class="byline">By Bob</p>'
    assert zhihu(page, "")[:3] == ("Head", "Ann", "2024-03-01")
    assert zhihu(f'<title>Tab</title><time datetime="2024-05-06">x</time><div class="RichText">{LONG}</div><a class="UserLink-link">Cy</a>', "")[:3] == ("Tab", "Cy", "2024-05-06")
    assert zhihu('<meta itemprop="datePublished" content="2023-01-01"><meta name="date" content="2024-01-01"><article>x</article>', "")[:3] == ("Zhihu Article", None, "2023-01-01")
    assert zhihu("<p>no article</p>", "") == (None,) * 7
    assert keywords(page) == ["a", "b"]
    assert medium(page, "")[:3] == ("Head", "Ann", "2024-03-01")
    assert medium('<title>Tab</title><article>x</article><a rel="author">Di</a>', "")[:3] == ("Tab", "Di", None)
    assert medium(head, "") == (None,) * 7
    assert wechat('<title>Tab</title><p class="byline">By Bob</p><b class="profile_nickname">Ed</b><i id="publish_time">1 May</i><div id="js_content">x</div>', "")[:3] == ("Tab", "Ed", "1 May")
    assert wechat(page, "") == (None,) * 7
