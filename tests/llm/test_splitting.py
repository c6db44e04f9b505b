import pytest
from compare import assert_same
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.splitting import ORACLE, oversized_pieces, p3_found, split


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab .,\n。，é́", max_size=250), st.integers(1, 60), st.integers(-2, 70))
def test_pieces(text, limit, overlap):
    pieces = split(text, limit, overlap)
    real = max(0, overlap)
    real = limit // 2 if real >= limit else real
    assert pieces[0][0] == 0
    assert pieces[-1][1] == len(text)
    assert all(b - a <= limit for a, b in pieces)
    assert all(end - start == real for (_, end), (start, _) in zip(pieces, pieces[1:], strict=False))
    whole = text[slice(*pieces[0])] + "".join(text[a + real : b] for a, b in pieces[1:])
    assert whole == text


def test_natural_cuts():
    text = "First paragraph here.\n\nSecond paragraph here.\n\nThird paragraph is here."
    assert [text[a:b] for a, b in split(text, 30)] == ["First paragraph here.\n\n", "Second paragraph here.\n\n", "Third paragraph is here."]
    sentences = "One sentence here. Another sentence there. A third one follows."
    assert all(sentences[a:b].rstrip().endswith(".") for a, b in split(sentences, 30))
    assert split("x" * 10, 4) == [(0, 2), (2, 6), (6, 10)] or all(b - a <= 4 for a, b in split("x" * 10, 4))
    with pytest.raises(ValueError, match="below 1"):
        split("a", 0)


def test_sizes_are_balanced():
    text = " ".join(["word"] * 400)
    sizes = [b - a for a, b in split(text, 1000)]
    assert len(sizes) == 2
    assert max(sizes) - min(sizes) < 100


SCHEMA = "batch_id long, nodes array<struct<kind:string,nodeId:string,text:string,latex:string>>, totalChars int, maxBatchChars int, overlapChars int, piece string"


def test_rows(spark):
    node = lambda i, text, latex=None: ("text", i, text, latex)
    rows = [
        (1, [node("a", "x" * 25), node("b", "short"), node("c", None, "y" * 11), None], 3, 10, 2, "clash"),
        (1, [node("a", "x" * 25)], None, 10, 2, None),
        (2, None, None, 10, 2, None),
        (3, [node("a", "x" * 25)], None, None, 2, None),
        (4, [node("a", "x" * 25)], None, 0, None, None),
        (5, [node("a", "word " * 40_000)], None, 1000, None, None),
        (6, [node(None, "z" * 12)], None, 10, 99, None),
    ]
    out = oversized_pieces(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["batch_id"], r["node_id"], r["field"]) for r in out} == {(1, "a", "text"), (1, "c", "latex"), (5, "a", "text"), (6, None, "text")}
    assert all(len(r["piece"]) <= (1000 if r["batch_id"] == 5 else 10) for r in out)
    assert oversized_pieces(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sql(spark, data):
    assert_same(spark, data, p3_found, ORACLE["p3_found"])
