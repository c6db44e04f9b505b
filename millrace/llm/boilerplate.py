"""The main body of a web page: a maximum-scoring run of words and tags.

Every word carries a score, every tag that opens a block a fixed one, and every tag that opens or closes
a part of the page a penalty; one linear scan finds the contiguous run with the greatest sum. The scores
are fitted on labelled pages: pages whose own markup names the article (FIXED selectors below) label
their blocks, and a logistic regression over the block's words, element, links, length and the words that
open its part of the page learns to tell them apart. The markup's names are used as labels only,
never as features, so the model works on pages without them. The score of a block's tag, the penalty of a
part's and the threshold of a block are chosen on the same labelled pages.

The run is the article: nothing outside it comes out. Within it, blocks whose words score below the
threshold (bylines, share lines, newsletters) are left out. A run that is an error, barrier or script
notice is no article.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.pages import Block, Node, blocks, signs
from millrace.llm.residue import is_notice
from millrace.llm.sampling import least_hashes, sample_files
from millrace.plans.parallel import spread
from millrace.sources import read_table

#: Bound on the labelled pages that the model is fitted on.
LABELLED_PAGES = 1500
#: About how many of the pages name their article, at the least.
NAMED_SHARE = 0.25
#: Bound on its features.
MAX_FEATURES = 30_000
#: Ridge on its weights: labels are few for rare words.
RIDGE = 3.0

# Names that pages give to their article and to what surrounds or interrupts it.
ARTICLE_NAMES = frozenset("post-richtext entry-content article-content post-content post-body article-body prose markdown-body rich_media_content js_content".split())
OTHER_NAMES = frozenset(
    "byline share newsletter related card comments comment thread sidebar menu site-header site-footer cookie-banner nav navigation breadcrumb toc ads ad promo subscribe social recommend author-info".split()
)
_AUTHOR = re.compile(r"<meta\s[^>]*name=[\"']?author[\"']?\s[^>]*content=[\"']([^\"']+)[\"']", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+|\d+")
_SPACELESS = re.compile("[぀-ヿ㐀-鿿]")
_DIGITS = frozenset("0123456789")
_SENTENCE_END = tuple(".!?。！？…")


def _lexical(text: str) -> list[str]:
    """Words of a text for the model; runs of letters without spaces between words give pairs of letters."""
    words = _WORD.findall(text.lower())
    if not _SPACELESS.search(text):
        return ["0" if w[0] in _DIGITS else w for w in words]
    out = []
    for w in words:
        if w[0] in _DIGITS:
            out.append("0")
        elif w[0] >= "぀":
            out += map("".join, zip(w, w[1:], strict=False)) if len(w) > 1 else (w,)
        else:
            out.append(w)
    return out


def _bucket(n: int) -> int:
    return min(7, n.bit_length())


@dataclass(slots=True)
class Page:
    """Blocks of a page; for each its distinct words, its other signs, the block that opens its part (-1: itself), and its length in words."""

    blocks: list[Block]
    own: list[dict[str, None]]
    signs: list[tuple[str, ...]]
    opener: list[int]
    words: list[int]

    def features(self) -> list[list[str]]:
        """What the model is fitted on: words, signs, and the words and element that open the part."""
        out = []
        for own, marks, k in zip(self.own, self.signs, self.opener, strict=True):
            f = ["w:" + w for w in own]
            f += marks
            if k >= 0:
                f += self.opening(k)
            out.append(f)
        return out

    def opening(self, k: int) -> list[str]:
        """Features that block ``k`` gives to the blocks of the part that it opens."""
        return [f"ot:{self.blocks[k].name}", *(("o:" + w for w in self.own[k]) if self.words[k] <= 12 else ("o:long",))]


def page(html: str | None) -> Page:
    found = blocks(html)
    if not found:
        return Page([], [], [], [], [])
    m = _AUTHOR.search(html)
    author = m[1].strip().lower() if m else None
    opening: dict[int, int] = {}
    place = "before" if any(b.name == "h1" for b in found) else "no-h1"
    out = Page(found, [], [], [], [])
    for i, b in enumerate(found):
        text = b.text.strip()
        lexical = _lexical(text)
        n, letters = len(lexical), len(text)
        if b.name == "h1":
            place = "after"
        marks = ["bias", "t:" + b.name, f"n:{_bucket(n)}", f"l:{min(4, int(4 * b.links / letters)) if letters else 0}", place]
        if n <= 12:
            marks.append(f"f:{lexical[0] if lexical else ''}|{min(n, 7) // 2}")
        if text.endswith(_SENTENCE_END):
            marks.append("stop")
        if author and letters < 200 and author in text.lower():
            marks.append("author")
        k = opening.setdefault(id(b.container), i)
        if k == i:
            marks.append("opens")
        out.own.append(dict.fromkeys(lexical))
        out.signs.append(tuple(marks))
        out.opener.append(-1 if k == i else k)
        out.words.append(n)
    return out


def _above(block: Block) -> Iterator[Node]:
    node = block.node
    while node is not None:
        yield node
        node = node.parent


def labels(p: Page) -> list[bool] | None:
    """For each block whether its page's markup puts it in the article; None where the markup doesn't say."""
    out, known = [], False
    for b in p.blocks:
        inside = other = False
        for node in _above(b):
            names = signs(node)
            if not OTHER_NAMES.isdisjoint(names) or node.name in ("aside", "nav", "footer"):
                other = True
            if node.name in ("main", "article") or not ARTICLE_NAMES.isdisjoint(names):
                inside = True
        known |= inside
        out.append(inside and not other)
    return out if known and any(out) else None


@dataclass
class Model:
    """Weights by feature, the scores of the tags of a block and of a part, and the least score of a block of the article."""

    weights: dict[str, float] = field(default_factory=dict)
    block_tag: float = 4.0
    part_tag: float = -2.0
    threshold: float = -1.0

    def __post_init__(self):
        # Words by themselves, so that no feature name is built for the many words of a page.
        self._words = {f[2:]: w for f, w in self.weights.items() if f.startswith("w:")}

    def scores(self, p: Page) -> list[float]:
        word, get = self._words.get, self.weights.get
        opening: dict[int, float] = {}
        out = []
        for own, marks, k in zip(p.own, p.signs, p.opener, strict=True):
            s = 0.0
            for w in own:
                s += word(w, 0.0)
            for f in marks:
                s += get(f, 0.0)
            if k >= 0:
                if k not in opening:
                    opening[k] = sum(get(f, 0.0) for f in p.opening(k))
                s += opening[k]
            out.append(s)
        return out


def best_run(values: list[float], gaps: list[float]) -> tuple[int, int] | None:
    """Greatest-sum run: ``values[i]`` of block i, ``gaps[i]`` of the tags before it. None where no block is positive."""
    best, run, start, found = 0.0, 0.0, 0, None
    for i, value in enumerate(values):
        if run > 0:
            run += gaps[i]
        if run <= 0:
            run, start = 0.0, i
        run += value
        if run > best:
            best, found = run, (start, i + 1)
    return found


def _chain(node: Node | None) -> list[Node]:
    """Containers from ``node`` to the root."""
    out = []
    while node is not None:
        out.append(node)
        node = node.parent.container if node.parent else None
    return out


def part_tags(p: Page) -> list[int]:
    """Before each block, how many tags open or close a part between it and the block before."""
    out, before, last = [], [], None
    for b in p.blocks:
        if b.container is last:
            out.append(0)
            continue
        here, last = _chain(b.container), b.container
        shared = len({id(x) for x in before} & {id(x) for x in here})
        out.append(len(before) + len(here) - 2 * shared)
        before = here
    return out


def article_run(scores: list[float], tags: list[int], model: Model) -> tuple[int, int] | None:
    """The run of blocks that is the article."""
    return best_run([s + model.block_tag for s in scores], [n * model.part_tag for n in tags])


def body(p: Page, model: Model, scores: list[float] | None = None, tags: list[int] | None = None) -> list[int]:
    """Numbers of the article's blocks: those of the run but for its bylines and the like."""
    scores = model.scores(p) if scores is None else scores
    run = article_run(scores, part_tags(p) if tags is None else tags, model)
    return [i for i in range(*run) if scores[i] > model.threshold] if run else []


def fit(pages: list[str], seed: int = 7, rounds: int = 120) -> Model:
    """Model from labelled pages; with none, the plain scores words +1 in text, -1 in links."""
    data = []
    for html in pages:
        p = page(html)
        y = labels(p)
        if y is not None:
            data.append((p, y, p.features()))
    if not data:
        return Model({"bias": 1.0, **{f"l:{i}": -2.0 for i in range(2, 5)}})
    counts = Counter(f for *_, features in data for fs in features for f in fs)
    kept = [f for f, n in counts.most_common(MAX_FEATURES) if n >= 3]
    index = {f: i for i, f in enumerate(kept)}
    flat, starts, y = [], [], []
    for _, labelled, features in data:
        for fs, yes in zip(features, labelled, strict=True):
            starts.append(len(flat))
            flat += [index[f] for f in fs if f in index]
            y.append(yes)
    flat_a, y_a = np.array(flat), np.array(y, float)
    sizes = np.diff(np.append(starts, len(flat)))
    rows = np.repeat(np.arange(len(y)), sizes)
    w, g2 = np.zeros(len(kept)), np.full(len(kept), 1e-8)
    for _ in range(rounds):  # full-batch AdaGrad with a ridge
        z = np.bincount(rows, w[flat_a], len(y))
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y_a
        grad = np.bincount(flat_a, error[rows], len(kept)) + RIDGE * w
        g2 += grad * grad
        w -= 0.5 * grad / np.sqrt(g2)
    model = Model({f: round(float(w[i]), 4) for f, i in index.items()})
    scored = [({i for i, v in enumerate(yes) if v}, p, model.scores(p), part_tags(p)) for p, yes, _ in data]
    best = -1.0
    for part_tag, block_tag, threshold in product((-4.0, -2.0, -1.0, -0.5), (1.0, 2.0, 3.0, 4.0, 6.0), (-2.0, -1.0, 0.0)):
        trial = Model(model.weights, block_tag, part_tag, threshold)
        right = wrong = missed = 0
        for truth, p, scores, tags in scored:
            got = set(body(p, trial, scores, tags))
            right, wrong, missed = right + len(got & truth), wrong + len(got - truth), missed + len(truth - got)
        f1 = 2 * right / max(1, 2 * right + wrong + missed)
        if f1 > best + 1e-9:
            best, model.block_tag, model.part_tag, model.threshold = f1, block_tag, part_tag, threshold
    return model


def train(df: DataFrame, html: str, bound: int = LABELLED_PAGES) -> Model:
    """Fit on at most ``bound`` pages whose markup names the article, those of least hash."""
    named = "|".join(("<main\\b", *sorted(ARTICLE_NAMES)))
    found = least_hashes(df.select(F.col(html).alias("html")), F.col("html"), bound, F.col("html").rlike(f"(?i){named}"), NAMED_SHARE)
    return fit([r["html"] for r in found])


def main_blocks(df: DataFrame, id_column: str, html: str, model: Model | None = None) -> DataFrame:
    """(id, block_no, tag, text): the blocks of each page's article.

    Null, empty and tagless pages, pages of links only and notices have none. Repeated rows give
    repeated blocks, as do rows without an id. Other columns don't matter. An empty table gives none.
    """
    model = model or train(df, html)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, numbers, tags, texts = [], [], [], []
            for i, text in zip(pdf["id"], pdf["html"], strict=True):
                if not isinstance(text, str):
                    continue
                p = page(text)
                chosen = body(p, model)
                if chosen and not is_notice("\n\n".join(p.blocks[k].plain.strip() for k in chosen)):
                    for k in chosen:
                        b = p.blocks[k]
                        ids.append(i)
                        numbers.append(b.number)
                        tags.append(b.name)
                        texts.append(b.text)
            if ids:
                yield pd.DataFrame({"id": ids, "block_no": numbers, "tag": tags, "text": texts})

    narrow = df.select(F.col(id_column).cast("long").alias("id"), F.col(html).alias("html"))
    return spread(narrow).mapInPandas(extract, "id long, block_no int, tag string, text string")


def trained(spark: SparkSession, sf_dir: str) -> Model:
    """The model of the table's pages."""
    return train(sample_files(spark, sf_dir, "extracted_article", "html"), "html")


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_blocks(read_table(spark, sf_dir, "extracted_article", "page_id", "html"), "page_id", "html", trained(spark, sf_dir))


def p1_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every page's article, and its number of blocks."""
    ordered = F.array_sort(F.collect_list(F.struct("block_no", "text")))  # the blocks of one page
    return _articles(spark, sf_dir).groupBy(F.col("id").alias("page_id")).agg(F.count("*").alias("n_blocks"), F.array_join(F.transform(ordered, lambda b: F.trim(b["text"])), "\n\n").alias("text"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _articles(spark, sf_dir).select(F.col("id").alias("page_id"), "block_no").distinct()


QUERIES = {"p1_found": p1_found, "p1_article": p1_article}
ORACLE: dict[str, str] = {}
