import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.leakage import Bitmap, leaked_items, p9_found, tokens, window_hashes
from millrace.llm.lookalikes import canonical

ITEMS = [
    (1, "en", "When rack Alpha lost power the Beta scheduler moved 10 jobs in 20 seconds and dropped only 3. How many are left?"),
    (2, "en", "When rack Gamma lost power the Delta scheduler moved 77 jobs in 88 seconds and dropped only 9. How many are left?"),
    (3, "en", "When rack Eps lost power the Zeta scheduler moved 5 jobs in 6 seconds and dropped only 7. How many are left?"),
    (4, "zh", "机架Ostdo断电以后杉杉渡调度程序在262秒内迁移了508个任务。请问还剩下多少台机器？"),
    (5, "zh", "机架Brato断电以后檀柏溪调度程序在11秒内迁移了22个任务。请问还剩下多少台机器？"),
    (6, "zh", "机架Limra断电以后柏檀岭调度程序在33秒内迁移了44个任务。请问还剩下多少台机器？"),
    (7, "en", "too short"),
    (8, None, None),
]


ITEM, DOC = "item_id long, lang string, text string", "doc_id long, text string"


def found(spark, texts, items):
    """For each text its items, True for a literal leak."""
    out = [{} for _ in texts]
    for r in leaked_items(spark.createDataFrame(list(enumerate(texts)), DOC), "doc_id", "text", spark.createDataFrame(items, ITEM), "item_id", "text", "lang").collect():
        out[r["doc_id"]][r["item_id"]] = r["literal"]
    return out


CASES = [
    ("x y. When rack Alpha lost power the Beta scheduler moved 10 jobs. z", {1: True}),
    ("WHEN **RACK** ALPHA, LOST\nPOWER the Ｂｅｔａ sched\u200buler moved 10 jobs", {1: True}),
    ("When rack Alpha lost power the Beta scheduler moved ten", {}),  # nine words
    ("前面机架Ostdo断电以后杉杉渡调度后面", {4: True}),
    ("机架Ｏｓｔｄｏ断电，以后 杉杉渡\n调度程序", {4: True}),
    ("机架Ostdo断电以后杉杉渡改", {}),  # 14 letters
    ("", {}),
    ("too short", {}),
]


def test_literal(spark):
    got = found(spark, [t for t, _ in CASES], ITEMS)
    assert [{i: e for i, e in g.items() if e} for g in got] == [f for _, f in CASES]


def test_other_parameters(spark):
    text = "When rack Omega lost power the Sigma scheduler moved 411 jobs in 512 hours and dropped only 613. How many are left?"
    # one name for two: the placeholders don't fit
    one_name = "When rack Omega lost power the Omega scheduler moved 4 jobs in 4 seconds"
    letters = "机架Zunto断电以后松林渡调度程序在99秒内迁移了12个任务。请问还剩下多少台机器？"
    got = found(spark, [text, one_name, letters], ITEMS)
    assert got[:2] == [{1: False, 2: False, 3: False}, {}]
    assert got[2] == {4: False, 5: False, 6: False}


def test_rows(spark):
    rows = [(1, ITEMS[0][2], "a"), (1, ITEMS[0][2], "a"), (2, None, None), (3, "", "b"), (4, "word " * 50_000 + ITEMS[1][2], None), (None, ITEMS[3][2], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    items = spark.createDataFrame(ITEMS, "item_id long, lang string, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaked_items(docs, "doc_id", "text", items, "item_id", "text", "lang").where("literal").collect()}
    assert got == {(1, 1), (4, 2), (None, 4)}
    assert leaked_items(docs, "doc_id", "text", items.limit(0), "item_id", "text", "lang").count() == 0
    assert leaked_items(docs.limit(0), "doc_id", "text", items, "item_id", "text", "lang").count() == 0


def test_brute_force(spark, data):
    items = duckdb.sql(f"select item_id, lang, text from '{data}/eval_item.parquet'").fetchall()
    docs = duckdb.sql(f"select doc_id, text from '{data}/documents.parquet'").fetchall()
    norm = lambda t: re.findall(r"[^\W_]+", canonical(t).casefold())
    expected = set()
    for d, text in docs:
        words = norm(text)
        there, letters = {tuple(words[k : k + 10]) for k in range(len(words) - 9)}, "".join(words)
        for i, lang, item in items:
            own = norm(item)
            joined = "".join(own)
            if any(joined[k : k + 16] in letters for k in range(len(joined) - 15)) if lang == "zh" else any(tuple(own[k : k + 10]) in there for k in range(len(own) - 9)):
                expected.add((d, i))
    assert {tuple(r) for r in p9_found(spark, data).collect()} == expected


@pytest.mark.parametrize("count", [1, 2, 3, 8])
def test_literal_leaks_without_shared_words(spark, count):
    """Items that share no words have no templates, yet each window of theirs is found."""
    rows = []
    for n in range(count):
        rows.append((2 * n, "en", " ".join(f"w{n}x{k}" if k % 4 else str(k) for k in range(14))))
        rows.append((2 * n + 1, "zh", "".join(chr(0x4E00 + 40 * n + k) for k in range(18)) + f"Word{n}Kubernetes{n}配置"))
    texts, expected = [], []
    for item, lang, text in rows:
        if lang == "en":
            words = text.split()
            for k in range(5):
                texts += ["before " + " ".join(words[k : k + 10]) + " after", "before " + " ".join(words[k : k + 9]) + " after"]
                expected += [{item}, set()]
        else:
            for k in range(len(text) - 15):
                texts += ["前" + text[k : k + 16] + "后", "前" + text[k : k + 15] + "后"]
                expected += [{item}, set()]
    assert [{i for i, e in f.items() if e} for f in found(spark, texts, rows)] == expected


@given(st.lists(st.integers(0, 3), max_size=40), st.sampled_from([1, 6, 10, 16]))
@settings(max_examples=200, deadline=None)
def test_window_hashes(values, size):
    """Equal runs have equal hashes, other runs others."""
    numbers = np.array(values, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    hashes = window_hashes(numbers, size).tolist()
    runs = [tuple(values[i : i + size]) for i in range(len(values) - size + 1)]
    assert len(hashes) == len(runs)
    assert len(set(zip(runs, hashes, strict=True))) == len(set(runs)) == len(set(hashes))


def test_bitmap(spark):
    """Every hash of the column may be held, few others may."""
    rng = np.random.default_rng(3)
    inside, outside = rng.integers(-(2**63), 2**63, 3000), rng.integers(-(2**63), 2**63, 30_000)
    bitmap = Bitmap.of(spark.createDataFrame([(int(x),) for x in inside], "h long"), "h", len(inside))
    assert bitmap.may_hold(inside.view(np.uint64)).all()
    assert bitmap.may_hold(outside.view(np.uint64)).mean() < 0.02


def test_each_window_of_few_items(spark, data):
    items = duckdb.sql(f"select item_id, lang, text from '{data}/eval_item.parquet' where item_id % 24 = 0").fetchall()
    schema = "item_id long, lang string, text string"
    docs = [(n, f"x {' '.join(w[k : k + 10])} y") for n, (w, k) in enumerate((tokens(t), k) for _, lang, t in items if lang != "zh" for k in range(0, max(0, len(tokens(t)) - 9)))]
    found = leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame(items, schema), "item_id", "text", "lang")
    assert {r["doc_id"] for r in found.where("literal").collect()} == {n for n, _ in docs}
