"""Front matter and the import of a text as a whole."""

import pytest

from millrace.functions.frontmatter import flattened, parse
from millrace.operators.markdown import fix_math_counted, pipeline


def test_front_matter():
    head = """---
title: "A: b"
# a comment
date: 2024-01-02
draft: false
n: 3
share: 1.5
none:
tags:
  - caches
  - 'it''s'
inline: [a, "b, c", 2]
source:
  url: https://a.example/x  # where from
  author:
    name: Ann
items:
- id: 1
  name: x
- id: 2
text: |
  first
    second

  third
folded: >
  one
  two
---"""
    assert parse(head) == {
        "title": "A: b", "date": "2024-01-02", "draft": False, "n": 3, "share": 1.5, "none": None, "tags": ["caches", "it's"], "inline": ["a", "b, c", 2],
        "source": {"url": "https://a.example/x", "author": {"name": "Ann"}}, "items": [{"id": 1, "name": "x"}, {"id": 2}], "text": "first\n  second\n\nthird\n", "folded": "one two\n",
    }
    assert flattened({"a": {"b": 1}, "c": ["x", {"d": None}], "e": []}) == [("a.b", "1"), ("c[0]", '"x"'), ("c[1].d", "null"), ("e", "[]")]
    assert parse("") == parse("---\n---") == parse("no mapping") == {}


def test_math_changes_are_counted():
    assert fix_math_counted("a $ x $ b $y$ and `$ z $`") == ("a $x$ b $y$ and `$ z $`", 1)


TEXT = """---
title: x
---

# A heading about caches

The cache keeps its rows $ a+b $ for long.



![i](/a.png)

Figure 1: the cache

```
def f():
    import os
```

$$
x^2
$$

$$
(x
$$

- item one
"""


@pytest.fixture(scope="module")
def rows(spark):
    chinese = "纯中文的文本内容在这里，没有公式，只有文字和一段代码。\n\n~~~\necho hi\n~~~\n"
    data = [(1, TEXT, "a"), (1, TEXT, "a"), (2, None, None), (3, "", "x"), (4, chinese, "y"), (5, TEXT.replace("title: x", "lang: fr"), None), (None, "word " * 100_000, None)]
    df = spark.createDataFrame(data, "i long, m string, language string")
    return {r["id"]: r for r in pipeline(df, "i", "m").collect()}, pipeline(df, "i", "m").count()


def test_whole_import(rows):
    r = rows[0][1]
    assert r["markdown"].startswith("---\ntitle: x\nlang: zh\ntranslatedFrom: en\n---\n\n# [ZH] A heading about caches\n\n[ZH] The cache keeps its rows $a+b$ for long.\n\n![i](/a.png)\n\n[ZH] _Figure 1: the cache_\n\n```python\ndef f():")
    assert "$$\nx^2\n$$" in r["markdown"]
    assert "```latex\n(x\n```" in r["markdown"]
    assert r["markdown"].endswith("- [ZH] item one\n")
    counts = ("code_fences_fixed", "image_captions_fixed", "math_patched", "math_fallbacks", "math_delimiters_fixed", "empty_lines_compressed")
    assert [r[c] for c in counts] == [1, 1, 1, 1, 1, 1]
    assert (r["language"], r["changed"], r["translated"], r["frontmatter_updated"]) == ("en", True, True, True)


def test_other_rows(rows):
    by_id, n = rows
    assert n == 7
    assert (by_id[2]["markdown"], by_id[2]["changed"]) == (None, False)
    assert (by_id[3]["markdown"], by_id[3]["changed"]) == ("", False)
    assert (by_id[4]["language"], by_id[4]["translated"], by_id[4]["code_fences_fixed"]) == ("zh", False, 1)
    assert "~~~bash\necho hi\n~~~" in by_id[4]["markdown"]
    assert by_id[5]["translated"]
    assert not by_id[5]["frontmatter_updated"]
    assert by_id[None]["markdown"].startswith("---\nlang: zh\ntranslatedFrom: en\n---\n\n[ZH] word")


def test_steps(spark):
    df = spark.createDataFrame([(1, TEXT)], "i long, m string")
    nothing = pipeline(df, "i", "m", None, ()).first()
    assert (nothing["markdown"], nothing["changed"]) == (TEXT, False)
    fences = pipeline(df, "i", "m", None, ("fences",)).first()
    assert fences["markdown"] == TEXT.replace("```\ndef", "```python\ndef")
    assert pipeline(df.limit(0), "i", "m").count() == 0
