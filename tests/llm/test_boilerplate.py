from hypothesis import given
from hypothesis import strategies as st

from millrace.llm import boilerplate
from millrace.llm.boilerplate import Model, article_run, best_run, body, fit, labels, main_blocks, page, part_tags
from millrace.llm.pages import blocks


def names(html):
    return [(b.name, b.text.strip()) for b in blocks(html)]


def test_blocks():
    assert names("<div>a<p>b<p>c</div><p>d</p>tail") == [("p", "b"), ("p", "c"), ("p", "d")]
    assert names("<UL><LI>a<LI>b</UL>") == [("li", "a"), ("li", "b")]
    assert names("<ul><li>a<li>b<ul><li>c</ul></ul>") == [("li", "a"), ("li", "c")]
    assert names("<table><tr><td>1<td>2<tr><th>3</table>") == [("td", "1"), ("td", "2"), ("th", "3")]
    assert names("<blockquote>q</blockquote><blockquote><p>x</blockquote>") == [("blockquote", "q"), ("p", "x")]
    assert names("<div><section>in</section></div>") == [("div", "in")]
    assert names("<p>&nbsp;</p><p> </p><!-- <p>no</p> --><script><p>no</p></script><noscript><p>no</p></noscript>") == []
    assert names("<pre><code>a &lt; b</code></pre>") == [("pre", "a < b")]
    assert names("<p>a <b>b</b> <code>c</code></p>") == [("p", "a b c")]
    assert names(None) == names("") == names("no tags") == []
    assert names("<p title='a > b'>x</p><p>open") == [("p", "x"), ("p", "open")]
    assert [b.plain for b in blocks("<p>a <code>b</code> c</p>")] == ["a  c"]


def test_best_run():
    assert best_run([5, 5, -1, 9], [0, 0, 0, 0]) == (0, 4)
    assert best_run([5, 5, 50], [0, 0, -100]) == (2, 3)
    assert best_run([-5, -5], [0, 0]) is None
    assert best_run([], []) is None


@given(st.lists(st.tuples(st.integers(-9, 9), st.integers(-5, 0)), max_size=12))
def test_the_run_is_the_greatest(blocks_):
    """No contiguous run of blocks, with the tags between them, has a greater sum."""
    values, gaps = [v for v, _ in blocks_], [g for _, g in blocks_]
    total = lambda a, b: sum(values[a:b]) + sum(gaps[a + 1 : b])
    best = max((total(a, b) for a in range(len(values)) for b in range(a + 1, len(values) + 1)), default=0)
    run = best_run(values, gaps)
    assert (total(*run) if run else 0) == max(0, best)


def test_nothing_outside_the_run(data):
    import pandas as pd

    html = pd.read_parquet(f"{data}/extracted_article.parquet", columns=["html"])["html"].dropna()
    model = fit(html.tolist())
    for text in html:
        p = page(text)
        scores, tags = model.scores(p), part_tags(p)
        run = article_run(scores, tags, model) or (0, 0)
        assert all(run[0] <= i < run[1] for i in body(p, model, scores, tags))


def sample(i, named=True):
    """A page with a menu, an article with a byline and a newsletter inside, comments and a footer."""
    topic = ("cache", "kernel", "parser", "index")[i % 4]
    box = ('<main><article class="prose">', "</article></main>") if named else ('<div class="x1"><div class="x2">', "</div></div>")
    part = ('<section class="newsletter">', "</section>") if named else ('<div class="x3">', "</div>")
    comments = ('<section class="comments">', "</section>") if named else ('<div class="x4">', "</div>")
    return (
        f'<!DOCTYPE html><html><head><title>t</title><meta name="author" content="Ann Bee {i}"></head><body><div class="m"><div><a href="/">Home</a></div><div><a href="/a">About us</a></div></div>'
        f"{box[0]}<h1>The {topic} explained in part {i}</h1><p{" class=byline" if named else ""}>By Ann Bee {i}</p><p>The {topic} keeps {i} rows for long articles. It was measured twice.</p>"
        f"{part[0]}<p>Subscribe to our newsletter today.</p>{part[1]}<ul><li>Small {topic}</li><li>The {topic} is warm.</li></ul><p>In the end the {topic} keeps working on older phones.</p>{box[1]}"
        f"{comments[0]}<h3>Comments ({i})</h3><div>user{i}</div><p>The {topic} keeps {i} rows for long articles. It was measured twice and I like it very much indeed.</p>{comments[1]}"
        f"<div class='f'><p>© 2024 All rights reserved.</p></div></body></html>"
    )


def expected(p):
    out = {b.number for b in p.blocks if b.container.name == "article" or "x2" in b.container.attrs}
    return {n for n in out if not p.blocks[n].text.startswith("By ")}


def test_fit_and_body_on_unnamed_pages():
    model = fit([sample(i) for i in range(60)])
    for i in range(60, 80):
        p = page(sample(i, named=False))
        assert set(body(p, model)) == expected(p)


def test_labels():
    p = page(sample(1))
    assert {i for i, y in enumerate(labels(p)) if y} >= expected(p)
    assert labels(page(sample(1, named=False))) is None
    assert isinstance(fit([]), Model)


def test_rows(spark):
    notice = '<body><main><h1>404 Not Found. The page you asked for does not exist or has moved.</h1></main><div class="f"><p>© 2024 All rights reserved.</p></div></body>'
    long_page = f"<main><h1>Title here</h1><p>{'The cache keeps rows. ' * 20_000}</p></main>"
    rows = [(1, sample(3), "a"), (1, sample(3), "a"), (2, None, None), (3, "", "x"), (4, notice, "n"), (5, long_page, "l"), (None, sample(5), "z")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    model = fit([sample(i) for i in range(60)])
    out = main_blocks(df, "page_id", "html", model).collect()
    by_id = {}
    for r in out:
        by_id.setdefault(r["id"], []).append(r["block_no"])
    assert set(by_id) == {1, 5, None}
    assert len(by_id[1]) == 2 * len(by_id[None]) > 0
    assert main_blocks(df.limit(0), "page_id", "html", model).count() == 0
    assert main_blocks(df.limit(0), "page_id", "html").count() == 0  # nothing to fit on


def test_query(spark, data):
    assert boilerplate.p1_found(spark, data).columns == ["page_id", "block_no"]
    assert boilerplate.p1_article(spark, data).count() > 0


def test_author_behind_a_long_head():
    html = sample(1).replace("<title>", "<style>" + ".a { color: red }\n" * 1000 + "</style><title>")
    assert html.index('name="author"') > 4000
    marked = [b.text.strip() for b, s in zip(page(html).blocks, page(html).signs, strict=True) if "author" in s]
    assert marked == ["By Ann Bee 1"]
