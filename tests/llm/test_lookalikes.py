import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import lookalikes
from millrace.llm.lookalikes import Conflict, canonical, look_alike_pairs, merge, transducer


@pytest.mark.parametrize(
    ("a", "b"),
    [("Ｗａｒｍ　ｄａｙ", "Warm day"), ("gardé", "gardé"), ("tһе саt", "the cat"), ("ﾊﾟﾃﾞｨ", "パディ"), ("⼀更", "一更"), ("a​b­c‎", "abc"), ("a b c", "a b c"), ("ﬁne", "fine"), ("a‑b‐c", "a-b-c"), ("，：！", ",:!"), ("е́", "é"), ("Ζ", "Z")],
)
def test_alike(a, b):
    assert canonical(a) == canonical(b)


@pytest.mark.parametrize(("a", "b"), [("Case", "case"), ("deja", "déjà"), ("x²", "x2"), ("①", "1"), ("½", "1/2"), ("a–b", "a-b"), ("ab", "a b"), ("No", "№"), ("л", "n"), ("и", "u"), ("й", "и"), ("、", ","), ("l", "I")])
def test_different(a, b):
    assert canonical(a) != canonical(b)


def test_nothing_and_plain():
    assert canonical(None) is None
    assert canonical("") == ""
    assert canonical("plain ascii\n\ttext") == "plain ascii\n\ttext"


@settings(max_examples=500, deadline=None)
@given(st.text(max_size=30))
def test_idempotent(text):
    once = canonical(text)
    assert canonical(once) == once


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_letters_agree(text):
    """Letters and digits are those of the whole form."""
    keep = lambda t: "".join(c for c in t if c.isalnum())
    assert keep(transducer().letters_of(text)) == keep(canonical(text))


@settings(max_examples=1000, deadline=None)
@given(st.text(max_size=30) | st.text(alphabet="aéeе\u0301\u0327\u200bﾊﾟﾞ가각\u1100\u1161\u11a8　，ſﬁ⼀", max_size=12))
def test_both_ways_give_one_form(text):
    assert transducer().form(text) == transducer().apply(text)


def test_conflicts():
    assert merge([("a", "b"), ("a", "b")]) == {"a": "b"}
    with pytest.raises(Conflict):
        merge([("a", "b"), ("a", "c")])


def test_pairs(spark):
    rows = [(1, "Warm day", "x"), (2, "Ｗａｒｍ day", "x"), (3, "Warm day", "x"), (4, "warm day", "y"), (5, None, None), (6, "", ""), (7, "Wаrm day", "z" * 100_000), (7, "Wаrm day", "z" * 100_000)]
    df = spark.createDataFrame(rows, "article_id long, title string, markdown string").selectExpr("*", "title as form", "article_id as id")
    got = {(r["id_a"], r["id_b"], r["field"]) for r in look_alike_pairs(df, "article_id", ["title", "markdown"]).collect()}
    assert got == {(1, 2, "title"), (2, 3, "title"), (1, 7, "title"), (2, 7, "title"), (3, 7, "title")}
    assert look_alike_pairs(df.limit(0), "article_id", ["title"]).count() == 0


def test_classes(spark, monkeypatch):
    """Of a large form the output is linear, and every row is linked to a look-alike stored otherwise."""
    rows = [(i, ("Warm day", "Ｗａｒｍ day", "Wаrm day")[min(i % 7, 2)]) for i in range(700)] + [(1000, "Other"), (1001, "Оther"), (1002, "alone"), (None, "Ｗarm day")]
    df = spark.createDataFrame(rows, "article_id long, title string")
    texts = dict(rows)
    classes = {r["id"]: r for r in lookalikes.look_alike_classes(df, "article_id", ["title"]).collect()}
    assert len(classes) == 702
    assert {r["class_id"] for r in classes.values()} == {0, 1000}
    assert all(texts[r["variant_id"]] == texts[i] for i, r in classes.items())
    full = {(r["id_a"], r["id_b"]) for r in look_alike_pairs(df, "article_id", ["title"]).collect()}
    assert full == {(a, b) for a in classes for b in classes if a < b and classes[a]["class_id"] == classes[b]["class_id"] and texts[a] != texts[b]}
    monkeypatch.setattr(lookalikes, "ALL_PAIRS", 10)
    links = {(r["id_a"], r["id_b"]) for r in look_alike_pairs(df, "article_id", ["title"]).collect()}
    assert links <= full
    assert len(links) <= 701
    assert {i for pair in links for i in pair} == set(classes)


def brute_pairs(rows, field="title"):
    return sorted({(min(a, b), max(a, b), field) for a, x in rows for b, y in rows if a is not None and b is not None and a != b and x and y and x != y and canonical(x) == canonical(y)})


def test_pairs_of_a_large_form(spark):
    """All pairs, also of a form with more than 1,000 rows, once each."""
    rows = [(i, "Warm day") for i in range(1050)] + [(i, ("Ｗａｒｍ day", "Wаrm day")[i % 2]) for i in range(1050, 1055)] + [(7, "Wаrm day"), (None, "Ｗarm day"), (2000, "Other"), (2001, "Оther")]
    df = spark.createDataFrame(rows, "article_id long, title string")
    assert sorted(tuple(r) for r in look_alike_pairs(df, "article_id", ["title"]).collect()) == brute_pairs(rows)


@pytest.mark.parametrize("chunk", [1, 3, 100])
def test_pairs_across_chunks(spark, monkeypatch, chunk):
    """One result wherever the chunks end: variants of one row and of many, ids with several values and forms."""
    monkeypatch.setattr(lookalikes, "CHUNK", chunk)
    rows = [(i, "Warm\u200b day" if i < 9 else "W" + "\u200b" * (i - 8) + "arm day") for i in range(14)] + [(i, "Other" if i % 3 else "Оther") for i in range(20, 32)]
    rows += [(3, "Wаrm day"), (4, "Other"), (21, "Warm day"), (22, "Wаrm day"), (22, "Warm day"), (22, "Оther"), (-5, "Warm day"), (None, "Warm day")]
    df = spark.createDataFrame(rows, "article_id long, title string")
    assert sorted(tuple(r) for r in look_alike_pairs(df, "article_id", ["title"]).collect()) == brute_pairs(rows)


def test_brute_force(spark, data):
    import duckdb

    rows = duckdb.sql(f"select article_id, title, markdown from '{data}/article.parquet'").fetchall()
    expected = set()
    for field in (1, 2):
        for a in rows:
            for b in rows:
                if a[0] < b[0] and a[field] and b[field] and a[field] != b[field] and canonical(a[field]) == canonical(b[field]):
                    expected.add((a[0], b[0], ("title", "markdown")[field - 1]))
    assert {tuple(r) for r in lookalikes.p5_found(spark, data).collect()} == expected
    assert lookalikes.p5_normalise(spark, data).count() == len(rows)
