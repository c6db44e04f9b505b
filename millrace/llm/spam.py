"""Keyword-stuffed pages and lists of links, by their rank-frequency curves.

A page has two curves: of its words and of its pairs of consecutive words. Prose hardly ever repeats a
pair, keywords and links do, so the pairs tell more. One pass over the texts gives each page the spectra
of both, i.e. how many distinct words or pairs occur f times, for every f: all that a rank-frequency
curve holds, in a few numbers. SQL windows turn a spectrum into ranks, fit log frequency against log
rank, and measure the fit's residual and how far the curve's mass, by octaves of frequency, diverges from
the usual one of pages of the same language and comparable length. What is usual are medians of all
pages of the group, which a minority of spam doesn't move.

A page whose curve of pairs is extreme in slope, residual or divergence, or whose curve of words is in
slope (too steep or too flat), is flagged, whatever its length.
An exact check follows: the share of its text in keyword phrases, links and tags, which tells spam from
honest lists with as regular a curve. The share is counted in the first pass too, as reading the flagged
texts again would shuffle or re-scan them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.plans.parallel import spread
from millrace.plans.storage import materialise
from millrace.sources import read_table

#: A page is spam if keywords, links and tags are more than this share of its text.
SHARE = 0.5

_URL = r"(?:https?://|www\.)[^\s<>()\[\]\"'，。、！？]+"
_LINK = re.compile(rf"<a\s[^>]*>(?P<a>.*?)</a>|(?<!!)\[(?P<m>[^\]\n]*)\]\([^)\s]*\)|{_URL}", re.IGNORECASE | re.DOTALL)
_CODE = re.compile(r"^[ \t]{0,3}(```+|~~~+)[^\n]*\n.*?(?:^[ \t]{0,3}\1[`~]*[ \t]*$|\Z)|^\$\$.*?\$\$[ \t]*$", re.DOTALL | re.MULTILINE)
_MARKER = re.compile(r"^\s*(?:[-*+•>]|\d+[.)]|#{1,6}(?=\s))\s*")
_SENTENCE = re.compile(r"[^.!?。！？…]*(?:[.!?…]+(?=\s|$|[\"'”’)\]])|[。！？]+|[.!?…]+|$)[\"'”’」』)\]]*")
_WORD = re.compile(r"[^\W\d_]+|\d+")
_TAG = re.compile(r"(?<![\w&/])#[^\s#.,;|]{2,}")
_PARTS = re.compile(r"[^\s|,/;·•、，][^|,/;·•、，]{0,40}[|,/;·•、，]")
_LETTERS = re.compile(r"[^\W\d_]")
_SPACELESS = re.compile("[぀-ヿ㐀-鿿]")
_RUNS_ON = re.compile("[぀-\U0010ffff]")


def _units(text: str) -> list[str]:
    """Words, and pairs of letters of runs without spaces; numbers are one word."""
    words = _WORD.findall(text)
    if text.isascii() or not _RUNS_ON.search(text):
        return ["0" if w[0].isdigit() else w for w in words]
    out = []
    for w in words:
        if w[0].isdigit():
            out.append("0")
        elif w[0] >= "぀" and len(w) > 1:
            out.extend(map("".join, zip(w, w[1:], strict=False)))
        else:
            out.append(w)
    return out


def repeats_itself(sentence: str, spaced: bool = False) -> bool:
    """A sentence that only repeats a phrase: repeated pairs of words cover a third of it or more, or a word a quarter.

    ``spaced`` says that it has no letters of scripts without spaces.
    """
    words = _WORD.findall(sentence)
    n = len(words)
    if spaced and (n < 5 or n - len(set(words)) < 2):
        return False
    if sum(map(len, words)) < 6:
        return False
    if not spaced and _SPACELESS.search(sentence):  # phrases are runs of letters
        run = "".join(words)
        grams = [run[i : i + 4] for i in range(len(run) - 3)]
        once = len(set(grams))
        if once == len(grams) or len(run) < 8:
            return False
        counts = Counter(grams)
        covered = bytearray(len(run))
        for i, g in enumerate(grams):
            if counts[g] > 1:
                covered[i : i + 4] = b"\1\1\1\1"
        return 5 * sum(covered) >= 2 * len(run)
    if n < 5 or n - len(set(words)) < 2:
        return False
    pairs = list(zip(words, words[1:], strict=False))
    if len(set(pairs)) < len(pairs):
        counts = Counter(pairs)
        covered = {k for i, pair in enumerate(pairs) if counts[pair] > 1 for k in (i, i + 1)}
        if 3 * len(covered) >= n:
            return True
    most = max(Counter(w for w in words if len(w) > 3).values(), default=0)
    return most >= 3 and 4 * most >= n


def spam_share(text: str | None) -> float:
    """Share of ``text`` that is keyword phrases, links or product tags; 0 for null and blank texts.

    Code and formulas count as content. A line of links with a sentence beside them is content, a
    line of links alone isn't.
    """
    if not text or text.isspace():
        return 0.0
    total = bad = 0
    fragments: list[tuple[list[str], int, bool]] = []
    body = text
    if "```" in text or "~~~" in text or "$$" in text:
        body = _CODE.sub("", text)
        total += len("".join(text.split())) - len("".join(body.split()))
    spaced = body.isascii() or not _SPACELESS.search(body)
    for line in body.lower().split("\n"):
        line = line.strip()
        if not line:
            continue
        bare = _MARKER.sub("", line, count=1)
        if "://" in bare or "](" in bare or "<a " in bare or "www." in bare:
            rest = _LINK.sub(" ", bare).strip()
            shown = sum(_shown(m) for m in _LINK.finditer(bare))
            letters = len(_LETTERS.findall(rest))
            if letters < 12 or (2 * letters < shown and not _ended(rest)):
                bad += shown + letters
                total += shown + letters
                continue
            total += shown
            bare = rest
        size = len(bare)
        total += size
        tags = _TAG.findall(bare) if "#" in bare else None
        if tags and 2 * sum(map(len, tags)) > size:
            bad += size
            continue
        for piece in _SENTENCE.findall(bare):
            sentence = piece.strip()
            if not sentence:
                continue
            if repeats_itself(sentence, spaced):
                bad += len(sentence)
            elif not _ended(sentence):
                fragments.append((_units(sentence), len(sentence), sentence[-1] in "|,/·" or len(_PARTS.findall(sentence)) > 2))
    # A fragment is keywords if it is a row of short parts or its words come again in fragments of the page.
    counts = Counter(u for units, _, _ in fragments for u in units)
    for units, n, row in fragments:
        if units and (row or 2 * sum(counts[u] > 1 for u in units) >= len(units)):
            bad += n
    return bad / total if total else 0.0


def _shown(link: re.Match[str]) -> int:
    """Letters of a link that a reader sees, and a little for its address."""
    label = link["a"] if link["a"] is not None else link["m"]
    return len(link[0]) if label is None else len(label) + min(12, len(link[0]) - len(label))


def _ended(sentence: str) -> bool:
    return sentence.rstrip("\"'”’」』)] ")[-1:] in (".", "!", "?", "。", "！", "？", "…")


SPECTRUM = "doc_id long, version long, lang string, n_units int, share double, spectrum array<struct<c:int,f:int,n:int>>"
#: The curves of a page.
CURVES = ("words", "pairs")
#: Octaves of frequency; the last one has no end.
OCTAVES = 8
#: Lengths are comparable within a power of two; all pages shorter than twice 2 ** LEAST_LENGTH words are.
LEAST_LENGTH = 6
#: A language and length with fewer pages is held against all pages of the length, or else all pages.
LEAST_PAGES = 100
#: A slope, residual or divergence is extreme beyond the median plus so many times the distance from the
#: median to the quartile of the other side, which spam doesn't move. A page that is spam for little more
#: than half has nearly the curve of prose, so the curve flags early, and the exact check takes back what
#: is honest.
EXTREME = 4.0


def language_group(lang: str | None, text: str) -> str:
    """Two-letter language of a label; without one, the script."""
    label = (lang or "").strip().lower()[:2]
    if label.isalpha() and len(label) == 2:
        return label
    if re.search("[぀-ヿ]", text):
        return "ja"
    return "zh" if re.search("[一-鿿]", text) else "latin"


def _spectrum(units: list[str]) -> list[dict[str, int]]:
    """How many distinct words (c 0) and pairs (c 1) occur f times."""
    words = Counter(Counter(units).values())
    pairs = Counter(Counter(zip(units, units[1:], strict=False)).values())
    return [{"c": c, "f": f, "n": n} for c, spectrum in enumerate((words, pairs)) for f, n in spectrum.items()]


def _spectra(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        langs, sizes, shares, spectra = [], [], [], []
        for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
            if not isinstance(text, str):
                text = ""
            units = _units(text.lower())
            langs.append(language_group(lang if isinstance(lang, str) else None, text))
            sizes.append(len(units))
            shares.append(spam_share(text))
            spectra.append(_spectrum(units))
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "version": pdf["version"], "lang": langs, "n_units": sizes, "share": shares, "spectrum": spectra})


def curves(df: DataFrame, id_column: str, text: str, lang: str) -> DataFrame:
    """One row per page: slope, residual and divergence of its curves, whether it is flagged, and the exact share.

    Columns doc_id, lang, n_units, slope, residual, divergence, pair_slope, pair_residual, pair_divergence,
    flagged, share. Null and blank texts have no curve and no row. Rows equal in id and text count once;
    one id with several texts has a row for each. Other columns don't matter. An empty table gives none.
    """
    narrow = df.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("version"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    pages = spread(narrow).mapInPandas(_spectra, SPECTRUM).dropDuplicates(["doc_id", "version"])
    page = ["doc_id", "version", "lang", "length", "n_units", "share"]
    length = F.greatest(F.lit(LEAST_LENGTH), F.floor(F.log2(F.col("n_units").cast("double"))).cast("int")).alias("length")
    points = pages.where(F.col("n_units") > 0).select("doc_id", "version", "lang", length, "n_units", "share", F.explode("spectrum").alias("s")).select(*page, "s.*")
    above = Window.partitionBy("doc_id", "version", "c").orderBy(F.desc("f")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = points.withColumn("last", F.sum("n").over(above))
    first = F.col("last") - F.col("n") + 1
    x = (F.log(first.cast("double")) + F.log(F.col("last").cast("double"))) / 2
    # Words of one frequency share a stretch of ranks; it weighs as much as it is long on the log axis.
    weight = F.log((F.col("last") + 0.5) / (first - 0.5))
    octave = F.least(F.lit(OCTAVES - 1), F.floor(F.log2(F.col("f").cast("double"))))
    s = ranked.select(*page, "c", x.alias("x"), F.log(F.col("f").cast("double")).alias("y"), weight.alias("w"), (F.col("f") * F.col("n")).alias("mass"), octave.alias("octave"))
    wx, wy = F.col("w") * F.col("x"), F.col("w") * F.col("y")
    sums = {"sw": F.col("w"), "sx": wx, "sy": wy, "sxx": wx * F.col("x"), "sxy": wx * F.col("y"), "syy": wy * F.col("y"), "total": F.col("mass")}
    sums |= {f"o{b}": F.when(F.col("octave") == b, F.col("mass")).otherwise(0) for b in range(OCTAVES)}
    totals = s.groupBy(*page, "c").agg(*(F.sum(e).alias(name) for name, e in sums.items()))
    vx = F.col("sxx") - F.col("sx") ** 2 / F.col("sw")
    vy = F.col("syy") - F.col("sy") ** 2 / F.col("sw")
    vxy = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("sw")
    slope = F.when(vx > 1e-9, vxy / vx).otherwise(0.0)
    one = totals.select(*page, "c", slope.alias("slope"), F.sqrt(F.greatest(F.lit(0.0), vy - slope * vxy) / F.col("sw")).alias("residual"), F.array(*((F.col(f"o{b}") / F.col("total")).cast("float") for b in range(OCTAVES))).alias("curve"))
    of = lambda c: F.max(F.when(F.col("c") == c, F.struct("slope", "residual", "curve")))  # noqa: E731 - one row for each page and curve
    # Written once: the groups' medians and quartiles and the result all read it. Same partitioning as the sums.
    fitted = materialise(one.groupBy(*page).agg(*(of(c).alias(name) for c, name in enumerate(CURVES))), "curves")

    def by_group(measured: DataFrame, *aggregates: Column) -> DataFrame:
        """The aggregates by language and length; where a group is small, those of its length, else of all pages. Few rows whatever the corpus."""
        levels = (["lang", "length"], ["length"], ["all"])
        own, by_length, everywhere = (measured.withColumn("all", F.lit(0)).groupBy(*keys).agg(F.count("*").alias(f"n{i}"), F.struct(*(a.alias(f"a{k}") for k, a in enumerate(aggregates))).alias(f"g{i}")) for i, keys in enumerate(levels))
        joined = own.withColumn("all", F.lit(0)).join(by_length, "length").join(everywhere, "all")
        usual = F.when(F.col("n0") >= LEAST_PAGES, F.col("g0")).when(F.col("n1") >= LEAST_PAGES, F.col("g1")).otherwise(F.col("g2"))
        return joined.select("lang", "length", usual.alias("usual")).select("lang", "length", "usual.*")

    medians = by_group(fitted, *(F.array(*(F.percentile_approx(F.col(f"{name}.curve")[b], 0.5, 1000) for b in range(OCTAVES))) for name in CURVES))

    def divergence(name: str, usual: str) -> Column:
        """Kullback-Leibler, with at least a hundredth of the usual mass in each octave."""
        q = lambda b: F.greatest(F.coalesce(F.col(usual)[b], F.lit(0.0)), F.lit(1e-2))
        total = sum((q(b) for b in range(1, OCTAVES)), q(0))
        p = lambda b: F.col(f"{name}.curve")[b].cast("double")
        return sum((F.when(p(b) > 0, p(b) * F.log(p(b) * total / q(b))).otherwise(0.0) for b in range(1, OCTAVES)), F.when(p(0) > 0, p(0) * F.log(p(0) * total / q(0))).otherwise(0.0))

    measured = fitted.join(medians, ["lang", "length"]).select(
        "doc_id", "lang", "length", "n_units", "share",
        *(F.col(f"{name}.{m}").alias(f"{prefix}{m}") for name, prefix in zip(CURVES, ("", "pair_"), strict=True) for m in ("slope", "residual")),
        divergence("words", "a0").alias("divergence"), F.coalesce(divergence("pairs", "a1"), F.lit(0.0)).alias("pair_divergence"),
    )
    quartiles = by_group(measured, *(F.percentile_approx(c, [0.25, 0.5, 0.75], 1000) for c in ("pair_slope", "pair_residual", "pair_divergence", "slope")))

    def beyond(c: str, q: str, sign: int) -> Column:
        # The quartile of the other side: spam can't move it, even where it is up to half of a group.
        middle, quarter = F.col(q)[1], F.col(q)[1 - sign]
        return (F.col(c) - middle) * sign > EXTREME * F.greatest((middle - quarter) * sign, F.lit(1e-2))

    flagged = beyond("pair_slope", "a0", -1) | beyond("pair_residual", "a1", 1) | beyond("pair_divergence", "a2", 1) | beyond("slope", "a3", -1) | beyond("slope", "a3", 1)
    out = measured.join(quartiles, ["lang", "length"])
    return out.select("doc_id", "lang", "n_units", "slope", "residual", "divergence", "pair_slope", "pair_residual", "pair_divergence", F.coalesce(flagged, F.lit(False)).alias("flagged"), "share")


def p10_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves(read_table(spark, sf_dir, "documents", "doc_id", "text", "lang"), "doc_id", "text", "lang")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages flagged by their curve whose text is keywords, links and tags for more than half."""
    return p10_curves(spark, sf_dir).where(F.col("flagged") & (F.col("share") > SHARE)).select("doc_id").distinct()


QUERIES = {"p10_found": p10_found, "p10_curves": p10_curves}
ORACLE: dict[str, str] = {}
