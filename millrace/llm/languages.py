"""Language of documents and of their pieces, with confidence: words first, then shorter and shorter n-grams.

A known word scores its smoothed log frequency in each language. An unseen word backs off to its
n-grams of 4 letters, those unknown to n-grams of 3, 2 and 1. Runs of letters in scripts without
spaces are unseen words from the start, with pairs of letters as the longest n-gram. The model is fitted
here, on a bounded number of documents with recorded labels; as some labels are wrong, the fitted
model labels the sample itself once and is fitted again.

A text in none of the model's languages is "other": one of which significantly fewer words are known
in its best language than LEAST_KNOWN of them. The test asks for more than a few words, so a short
piece keeps its best language.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.lookalikes import transducer
from millrace.llm.residue import FILLER_WORDS, PLACEHOLDER
from millrace.llm.sampling import least_hashes, sample_files
from millrace.plans.parallel import spread
from millrace.sources import read_table

#: Bound on the documents that the model is fitted on.
LABELLED_DOCUMENTS = 3000
#: Bounds on what it keeps.
MAX_WORDS, MAX_GRAMS = 60_000, 120_000

#: Least confidence of a foreign piece.
SURE = 0.85
#: Share of words (letters, where there are no spaces) that are known of a text in one of the languages, whatever it is about.
LEAST_KNOWN = 0.4
#: Standard deviations below that share from which a text is in another language.
SIGNIFICANT = 2.0
OTHER = "other"

# Names of the languages that labels use.
LABELS = {
    "en": "en eng english englisch anglais inglés 英语 英文",
    "zh": "zh zho chi cmn chinese chinesisch chinois chino 中文 汉语 简体中文",
    "de": "de deu ger german deutsch allemand alemán 德语",
    "fr": "fr fra fre french französisch français francés 法语",
    "es": "es spa spanish spanisch espagnol español 西班牙语",
    "ja": "ja jpn japanese japanisch japonais japonés 日本語 日语",
}
LANGUAGE_OF = {name: lang for lang, names in LABELS.items() for name in names.split()}
LANGUAGES = tuple(LABELS)
MISSING = ("", "und", "undetermined", "unknown", "none", "null", "n/a", "mul", "zxx", "mis")

_RUN = re.compile(r"[^\W\d_]+")
_KANA_OR_HAN = "぀-ヿ㐀-鿿豈-﫿"
_LETTERS = re.compile(f"[{_KANA_OR_HAN}]")
_SPLIT = re.compile(f"[{_KANA_OR_HAN}]+|[^{_KANA_OR_HAN}]+")
_URL = re.compile(r"(?:https?://|www\.)\S+|\]\([^)\s]*\)")
_TICKS = re.compile(r"(`+)(?!`).*?(?<!`)\1(?!`)", re.DOTALL)
_IMAGE = re.compile(r"!\[[^\]]*\]\([^)]*\)")
_HTML = re.compile(r"<[^<>\n]+>|&[a-zA-Z]{2,8};")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])|\n")


def label_language(label: str | None) -> str | None:
    """Language that a recorded label names: None where it is missing, "?" where it is none of ours."""
    text = (label or "").strip().lower()
    if text in MISSING:
        return None
    return LANGUAGE_OF.get(text) or LANGUAGE_OF.get(re.split(r"[-_ ]", text)[0], "?")


def label_column(label: Column) -> Column:
    """``label_language`` as an expression."""
    text = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    names = F.create_map(*(F.lit(x) for pair in LANGUAGE_OF.items() for x in pair))
    return F.when(text.isin(*MISSING), F.lit(None).cast("string")).otherwise(F.coalesce(names[text], names[F.split(text, "[-_ ]")[0]], F.lit("?")))


def words_of(text: str) -> list[str]:
    """Lower-case words of a text in the one form; runs of letters without spaces stay whole."""
    runs = _RUN.findall(text.lower())
    if not _LETTERS.search(text):
        return runs
    return [part for run in runs for part in (_SPLIT.findall(run) if run[0] > "ˀ" or _LETTERS.search(run) else (run,))]


def _grams(word: str, n: int) -> list[str]:
    padded = word if word[0] > "぀" else f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@dataclass
class Model:
    """Scores by word and by n-gram, a value for each language."""

    words: dict[str, tuple[float, ...]] = field(default_factory=dict)
    grams: dict[str, tuple[float, ...]] = field(default_factory=dict)

    def __post_init__(self):
        self._memo: dict[str, tuple[float, ...]] = {}

    def __getstate__(self):
        return {"words": self.words, "grams": self.grams}

    def __setstate__(self, state):
        self.__init__(**state)

    def word(self, w: str) -> tuple[float, ...]:
        score = self.words.get(w) or self._memo.get(w)
        if score is None:
            score = self._backed_off(w)
            if len(self._memo) < 300_000:
                self._memo[w] = score
        return score

    def _backed_off(self, w: str) -> tuple[float, ...]:
        """Mean score of the n-grams of the greatest length of which any is known, letters longer weighing more."""
        spaceless = w[0] > "぀"
        for n in (2, 1) if spaceless else (4, 3, 2, 1):
            known = [self.grams[g] for g in _grams(w, n) if g in self.grams]
            if known:
                # A run without spaces holds about one word for two letters.
                weight = max(1.0, len(w) / 2) if spaceless else 1.0
                return tuple(weight * sum(k) / len(known) for k in zip(*known, strict=True))
        return (0.0,) * len(LANGUAGES)

    def known(self, words: Iterable[str], lang: str | None) -> tuple[float, int]:
        """(known, all) words of a text for a language; of runs without spaces the letters count, by two."""
        k = LANGUAGES.index(lang) if lang in LANGUAGES else -1
        known, n = 0.0, 0
        for w in words:
            if w[0] > "぀":
                n += (len(w) + 1) // 2
                if k >= 0:
                    known += sum((s := self.grams.get(c)) is not None and s[k] > 0 for c in w) / 2
            else:
                n += 1
                if k >= 0 and (s := self.words.get(w)) is not None:
                    known += 1.0 if s[k] > 0 else 0.5 if s[k] > -1 else 0.0
        return known, n

    def scores(self, words: Iterable[str]) -> list[float]:
        total = [0.0] * len(LANGUAGES)
        for w, n in Counter(words).items():
            for i, x in enumerate(self.word(w)):
                total[i] += n * x
        return total


def detect(words: list[str], model: Model) -> tuple[str | None, float]:
    """Language and confidence of a bag of words; (None, 0) without words or evidence.

    Confidence is the best language's posterior with the evidence tempered, as words aren't independent.
    """
    if not words:
        return None, 0.0
    total = model.scores(words)
    best = max(range(len(total)), key=total.__getitem__)
    if max(total) - min(total) < 1e-9:
        return None, 0.0
    temper = max(1.0, math.sqrt(len(words)))
    return LANGUAGES[best], 1 / sum(math.exp(max(-50.0, (x - total[best]) / temper)) for x in total)


def is_other(known: float, n: int) -> bool:
    """Whether ``known`` of ``n`` words are too few for a text in one of the model's languages."""
    return known < n * LEAST_KNOWN - SIGNIFICANT * math.sqrt(n * LEAST_KNOWN * (1 - LEAST_KNOWN))


def _table(counts: dict[str, Counter], totals: list[float], bound: int, least: int) -> dict[str, tuple[float, ...]]:
    """Log frequency by language, less the mean over languages: what an item says for each.

    ``totals`` are the sizes of the languages' samples in words of all scripts, so a language that has
    hardly any words of a script doesn't make much of the few.
    """
    overall = Counter()
    for c in counts.values():
        overall.update(c)
    out = {}
    for item, n in overall.most_common(bound):
        if n < least:
            break
        logs = [math.log((counts[lang][item] + 0.5) / (total + 0.5 * len(overall))) for lang, total in zip(LANGUAGES, totals, strict=True)]
        mean = sum(logs) / len(logs)
        out[item] = tuple(round(max(-6.0, min(6.0, x - mean)), 3) for x in logs)
    return out


def fit(samples: list[tuple[str, list[str]]]) -> Model:
    """Model from (language, words) pairs: fitted, applied to the sample, and fitted again."""
    model = None
    for _ in range(2):
        words: dict[str, Counter] = defaultdict(Counter)
        for lang, ws in samples:
            if lang in LANGUAGES:
                words[lang].update(ws)
        grams: dict[str, Counter] = defaultdict(Counter)
        for lang in LANGUAGES:
            for w, n in words[lang].items():
                for k in (2, 1) if w[0] > "぀" else (4, 3, 2, 1):
                    for g in _grams(w, k):
                        grams[lang][g] += n
        known = {lang: Counter({w: n for w, n in c.items() if w[0] <= "぀"}) for lang, c in words.items()}
        known = defaultdict(Counter, known)
        sizes = [sum(n * (1 if w[0] <= "぀" else max(1, len(w) / 2)) for w, n in words[lang].items()) for lang in LANGUAGES]
        model = Model(_table(known, sizes, MAX_WORDS, 3), _table(grams, [4 * n for n in sizes], MAX_GRAMS, 3))
        samples = [(detect(ws, model)[0] or lang, ws) for lang, ws in samples]
    return model


def pieces(markdown: str) -> list[tuple[int, str]]:
    """(number, text) of the prose pieces of a text as stored, their letters in the one form; pieces are split at blank lines.

    Headings, code, formulas, images, front matter and bare placeholders are no prose; text beside
    them in a piece is. Inline code, addresses and tags are dropped from a piece.
    """
    out = []
    form = transducer().letters_of
    fence, math_open, front = "", False, markdown.startswith("---\n")
    for number, piece in enumerate(markdown.split("\n\n")):
        if front:
            front = not (piece.rstrip().endswith("\n---") or (number and piece.strip() == "---"))
            continue
        lines = []
        for line in piece.split("\n"):
            bare = line.strip()
            if fence:
                if bare.startswith(fence):
                    fence = ""
                continue
            if bare.startswith(("```", "~~~")):
                fence = bare[:3]
                continue
            dollars = line.count("$$")
            if math_open or dollars:
                if dollars % 2:
                    math_open = not math_open
                continue
            if bare.startswith("#") and bare.lstrip("#")[:1] in (" ", ""):
                continue
            lines.append(line)
        text = form("\n".join(lines))
        if "`" in text:
            text = _TICKS.sub(" ", text)
        if "](" in text or "://" in text or "www." in text:
            text = _URL.sub(" ", _IMAGE.sub(" ", text))
        if "<" in text or "&" in text:
            text = _HTML.sub(" ", text)
        if any(s in text for s in ("{", "%", "[", "【", "$", "@@", "_", "XXXX")):
            text = PLACEHOLDER.sub(" ", text)
        if _RUN.search(text):
            out.append((number, text))
    return out


@dataclass(slots=True)
class Found:
    """A document's language and confidence, and its foreign pieces as (number, language, confidence)."""

    language: str | None
    confidence: float
    foreign: list[tuple[int, str, float]]


def _is_filler(words: list[str]) -> bool:
    return len(words) >= 3 and sum(w in FILLER_WORDS for w in words) * 2 > len(words)


def analyse(markdown: str, model: Model) -> Found:
    """The language of most prose pieces, by letters where two have as many, and the pieces wholly in another."""
    judged = []
    votes, letters, evidence = Counter(), Counter(), Counter()
    all_known, all_words = 0.0, 0
    for number, text in pieces(markdown):
        words = words_of(text)
        if not words or _is_filler(words):
            continue
        lang, confidence = detect(words, model)
        known, n = model.known(words, lang)
        all_known, all_words = all_known + known, all_words + n
        if is_other(known, n):
            lang, confidence = OTHER, 1 - known / n
        if lang is None:
            continue
        judged.append((number, text, lang, confidence))
        votes[lang] += 1
        size = sum(map(len, words))
        letters[lang] += size
        evidence[lang] += confidence * size
    if is_other(all_known, all_words):  # many short pieces together
        return Found(OTHER, 1 - all_known / all_words, [])
    if not votes:
        return Found(None, 0.0, [])
    main = max(votes, key=lambda x: (votes[x], letters[x], x))
    foreign = []
    for number, text, lang, confidence in judged:
        if lang == main or lang == OTHER or confidence < SURE:
            continue
        # Wholly: no sentence of the piece is clearly in the main language.
        parts = [words_of(s) for s in _SENTENCE.split(text)]
        if len(parts) > 1 and any(len(p) >= 3 and (d := detect(p, model))[0] == main and d[1] > 0.8 for p in parts):
            continue
        foreign.append((number, lang, confidence))
    return Found(main, evidence[main] / sum(letters.values()), foreign)


def train(articles: DataFrame, labels: DataFrame, bound: int = LABELLED_DOCUMENTS) -> Model:
    """Fit on at most ``bound`` of ``articles`` (article_id, markdown), those of least hash, with their labels (article_id, language)."""
    sample = least_hashes(articles.where(F.col("markdown").isNotNull()), F.col("article_id"), bound)
    ids = articles.sparkSession.createDataFrame([(r["article_id"],) for r in sample if r["article_id"] is not None], "article_id long")
    known = {r["article_id"]: label_language(r["language"]) for r in labels.join(F.broadcast(ids), "article_id", "left_semi").select("article_id", "language").collect()}  # at most ``bound`` rows
    data = []
    for row in sample:
        lang, text = known.get(row["article_id"]), row["markdown"]
        if lang in LANGUAGES:
            words = [w for _, piece in pieces(text) for w in words_of(piece)]
            if words and not _is_filler(words):
                data.append((lang, words))
    return fit(data)


SCHEMA = "article_id long, piece_no int, lang string, confidence double"


def detected(articles: DataFrame, model: Model) -> DataFrame:
    """(article_id, piece_no, lang, confidence): piece_no -1 is the document, others are its foreign pieces.

    A document in none of the model's languages has the language "other". ``articles`` has article_id and markdown. Null and empty texts and texts without prose have no
    rows. Repeated rows give repeated results. An empty table gives none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["article_id"], pdf["markdown"], strict=True):
                if isinstance(text, str) and text:
                    found = analyse(text, model)
                    if found.language:
                        rows.append((i, -1, found.language, found.confidence))
                        rows += [(i, *piece) for piece in found.foreign]
            yield pd.DataFrame(rows, columns=["article_id", "piece_no", "lang", "confidence"])

    return spread(articles.select(F.col("article_id").cast("long").alias("article_id"), "markdown")).mapInPandas(run, SCHEMA)


def p2_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every article and foreign piece."""
    articles = read_table(spark, sf_dir, "article", "article_id", "markdown")
    labels = read_table(spark, sf_dir, "language_detection", "article_id", "language")
    return detected(articles, train(sample_files(spark, sf_dir, "article", "article_id", "markdown"), labels))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing or wrong labels (piece_no -1) and foreign pieces of the articles with a label row.

    A document in a language beyond the model's is no case. Only the results are joined with the labels, never the texts.
    """
    labels = read_table(spark, sf_dir, "language_detection", "article_id", "language").select("article_id", label_column(F.col("language")).alias("label"))
    rows = p2_languages(spark, sf_dir).join(labels, "article_id")
    return rows.where(F.col("lang") != OTHER).where((F.col("piece_no") >= 0) | F.col("label").isNull() | (F.col("label") != F.col("lang"))).select("article_id", "piece_no", "lang").distinct()


QUERIES = {"p2_found": p2_found, "p2_languages": p2_languages}
ORACLE: dict[str, str] = {}
