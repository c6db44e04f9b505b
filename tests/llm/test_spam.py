import pytest

from millrace.llm.spam import curves, language_group, p10_curves, p10_found, repeats_itself, spam_share

PROSE = "The cache keeps its rows for long articles. Nobody expected the parser to hold that many pages in practice. "


@pytest.mark.parametrize(
    "text",
    [
        "\n".join(f"https://a{i}.example/go/{i}" for i in range(12)),
        "\n".join(f"- [cheap hosting {i}](https://shop.example/{i})" for i in range(12)),
        " ".join(f'<a href="https://shop.example/t/{i}">seo plugin {i}</a>' for i in range(12)),
        "#cheaphosting #seoplugin " * 20,
        "cheap hosting top | seo plugin 24h | cheap hosting pro | seo plugin 7 | " * 6,
        "cheap hosting\nseo plugin\ncheap hosting\ncheap hosting\nseo plugin\nseo plugin\n" * 3,
        "If you want cheap hosting deals, our cheap hosting deals are the cheap hosting deals for you. " * 8,
        "格安サーバーを探すなら格安サーバー。" * 10,
        "PHONE CASE SKU-4832 / red / IMAGE TOOL SKU-7109 / new / PHONE CASE SKU-1 / XL / " * 4,
        PROSE + "\n" + "cheap hosting top, seo plugin 24h, " * 30,
    ],
)
def test_spam(text):
    assert spam_share(text) > 0.5


@pytest.mark.parametrize(
    "text",
    [
        None,
        "",
        " \n ",
        PROSE * 5,
        PROSE * 5 + "\n\n- [a link](https://a.example/1)\n- [b link](https://a.example/2)",
        PROSE * 3 + "\n\n#storage #weekly #notes",
        "# Glossary\n\n- Cache: a store of rows that were read before.\n- Parser: it reads the text of a page.\n- Index: it finds rows by their key.",
        "1. [Caches](https://a.example/32) How rows are kept after they were read once.\n\n2. [Parsers](https://b.example/9) Why the text of a page is read from left to right.",
        "- Small caches\n- Warm parsers\n- Honest indexes\n- Quick pages\n" + PROSE,
        "```python\nx = 1\nx = 1\nx = 1\n```\n" + PROSE,
        "缓慢的图片转换器比稳定的图片转换器更容易解释。我们测得七页，这对分词器来说已经很稳定了。为什么矩阵需要内存块呢？",
    ],
)
def test_honest(text):
    assert spam_share(text) <= 0.5


def test_repeats():
    assert repeats_itself("get cheap hosting today because cheap hosting means cheap hosting.")
    assert not repeats_itself("the cache keeps its rows for long articles and short ones.")
    assert not repeats_itself("")


def test_groups():
    assert [language_group(x, "abc") for x in ("en", "EN-us", None, "")] == ["en", "en", "latin", "latin"]
    assert language_group(None, "漢字かな") == "ja"
    assert language_group(None, "中文") == "zh"


def test_rows(spark):
    spam = "cheap hosting top | seo plugin 24h | " * 60
    rows = [(i, PROSE * (3 + i % 3) + f"Part {i} says more about row number {i}.", "en", 1.0) for i in range(60)]
    rows += [(100, spam, "en", None), (100, spam, "en", None), (101, None, None, None), (102, "", "en", None), (103, PROSE * 4000, None, None), (None, spam, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, share double").repartition(3)
    out = curves(df, "doc_id", "text", "lang").toPandas()
    assert len(out) == 63  # 60 pages, the repeated one once, the long one, the one without an id
    flagged = out[out["flagged"] & (out["share"] > 0.5)]
    assert set(flagged["doc_id"].fillna(-1)) == {100, -1}
    assert curves(df.limit(0), "doc_id", "text", "lang").count() == 0


def test_slope_is_the_regression(spark):
    """Of a page whose words all differ in frequency, the fit is the ordinary weighted regression."""
    import numpy as np

    counts = [40, 21, 13, 8, 5, 2]
    text = " ".join(f"{chr(97 + i) * 3} " * n for i, n in enumerate(counts))
    row = curves(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string"), "doc_id", "text", "lang").first()
    rank = np.arange(1, len(counts) + 1)
    w, x, y = np.log((rank + 0.5) / (rank - 0.5)), np.log(rank), np.log(counts)
    slope = np.polyfit(x, y, 1, w=np.sqrt(w))[0]
    assert row["slope"] == pytest.approx(slope, rel=1e-6)


def test_divergence_has_every_word(spark):
    """The mass by octaves of frequency holds words of any rank, and is compared with the median page's."""
    import numpy as np

    def text(n, again):
        words = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(n)]
        return "\n".join(" ".join(words[a : a + 10]) + "." for a in range(0, n, 10)) + (" zzzz" * again)

    rows = [(1, text(9000, 0), "en"), (2, text(9000, 0), "en"), (3, text(12000, 4000), "en")]
    out = curves(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang").toPandas().set_index("doc_id")
    usual = np.array([1.0] + [0.01] * 7) / 1.07
    p = np.array([12000 / 16000, 4000 / 16000])
    assert out["divergence"][3] == pytest.approx(float((p * np.log(p / usual[[0, 7]])).sum()), rel=1e-5)
    assert out["divergence"][1] == pytest.approx(np.log(1.07), rel=1e-5)


def test_the_curve_flags_by_itself(spark, data):
    """Most spam is flagged, and most other pages aren't, by the curve alone and at any length."""
    out = p10_curves(spark, "/root/testdata/sf0.1").toPandas()  # enough pages of most languages and lengths
    spam = out["share"] > 0.5
    assert out["flagged"][spam].mean() >= 0.95
    assert out["flagged"][~spam].mean() <= 0.3


def test_queries(spark, data):
    assert p10_found(spark, data).columns == ["doc_id"]
    assert p10_curves(spark, data).count() > 0
