"""Evaluation texts inside training texts, also with other numbers, names and units.

Texts are brought to one form and cut into words (letters, where a script has no spaces). Each item gives
two kinds of windows, kept as a table of hashes:

* literal ones, of 10 words or 16 letters, which find a leak whatever words the items share;
* templates, in which numbers, units and words that few items share are typed placeholders, with the
  values of the placeholders beside them. Of a hit the values are compared: they may be equal (a literal
  leak), or stand for one another consistently (the item with other parameters).

The corpus is read once, however many items there are. The windows of its documents meet those of the items
in a hash join; before it, each task drops the windows that no item can have by a bitmap of the items'
hashes. That bitmap is all that travels to the workers: MAX_BITS bits at most, whatever the number of
items. A window that it lets through wrongly finds no partner in the join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.lookalikes import transducer
from millrace.plans.parallel import spread
from millrace.plans.storage import materialise
from millrace.sources import read_table

#: Consecutive words, and letters where there are no spaces, that make a leak.
WORDS, LETTERS = 10, 16
#: Words of a template for items of words, and letters for items of letters.
TEMPLATE_LETTERS = 6
#: Least number of a template's words that are no placeholders.
ANCHORS = 3
#: A word that fewer items use is a name or another value.
SHARED_BY = 3
#: Bits of a bitmap for each hash, and bounds on all of them, as powers of two: 16 MB at most.
BITS_A_HASH, MIN_BITS, MAX_BITS = 128, 15, 27

_LETTER = "぀-ヿ㐀-鿿豈-﫿"
_TOKEN = re.compile(rf"[{_LETTER}]|(?:(?![{_LETTER}])[^\W_])+")
_RUN = re.compile(r"[^\W_]+")
_HAS_LETTER = re.compile(f"[{_LETTER}]")
_ONLY_LETTERS = re.compile(f"[{_LETTER}]+").fullmatch
_ONE_LETTER = frozenset(map(chr, (*range(0x3040, 0x3100), *range(0x3400, 0x4DC0), *range(0x4E00, 0xA000), *range(0xF900, 0xFB00)))).__contains__
# Units of measure that a re-parameterised item may exchange.
UNITS = frozenset(
    "second seconds minute minutes hour hours day days week weeks month months year years percent meter meters metre metres kilometer kilometers mile miles "
    "gram grams kilogram kilograms litre litres liter liters byte bytes kilobyte kilobytes megabyte megabytes gigabyte gigabytes dollar dollars euro euros "
    "sekunde sekunden minute minuten stunde stunden tag tage tagen woche wochen monat monate jahr jahre prozent "
    "seconde secondes heure heures jour jours semaine semaines mois ans segundo segundos minutos hora horas día días semana semanas año años".split()
)
#: Kinds of windows.
LITERAL_WORDS, LITERAL_LETTERS, TEMPLATE_OF_WORDS, TEMPLATE_OF_LETTERS = range(4)
#: The two low bits of a word's number say what it is.
WORD, NUMBER, UNIT, NAME = range(4)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(text: str) -> list[str]:
    """Words in the one form, case folded; letters one by one in scripts without spaces."""
    runs = _RUN.findall(transducer().letters_of(text).casefold())
    if not _HAS_LETTER.search(text):
        return runs
    out: list[str] = []
    for run in runs:
        if _ONLY_LETTERS(run):
            out.extend(run)
        elif run[0] > "〿" or _HAS_LETTER.search(run):
            out.extend(_TOKEN.findall(run))
        else:
            out.append(run)
    return out


class Numbers(dict):
    """Word to a 64-bit number, the same everywhere; its low bits are the word's type. Kept up to a bound."""

    LIMIT = 300_000

    def __missing__(self, word: str) -> int:
        number = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") & ~3
        number |= NUMBER if word.isdigit() else UNIT if word in UNITS else WORD
        if len(self) < self.LIMIT:
            self[word] = number
        return number


@dataclass(frozen=True)
class Bitmap:
    """Membership of 64-bit hashes by their first ``bits`` bits: never a wrong no, at times a wrong yes."""

    bits: int
    octets: np.ndarray

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.bits)
        return (self.octets[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0

    @staticmethod
    def of(df: DataFrame, column: str, n: int) -> Bitmap:
        """Bitmap of a column of about ``n`` hashes, made on the workers in parts of 4 KB."""
        bits = min(MAX_BITS, max(MIN_BITS, (BITS_A_HASH * max(1, n)).bit_length()))
        at = F.shiftrightunsigned(F.col(column), 64 - bits)
        parts = df.groupBy(F.shiftright(at, 15).cast("int").alias("part")).agg(F.bitmap_construct_agg((at.bitwiseAND(F.lit((1 << 15) - 1))).cast("long")).alias("octets"))
        octets = np.zeros(1 << (bits - 3), np.uint8)
        for r in parts.collect():  # at most 2 ** (MAX_BITS - 15) rows of 4 KB
            octets[r["part"] << 12 : (r["part"] + 1) << 12] = np.frombuffer(r["octets"], np.uint8)
        return Bitmap(bits, octets)


def _mixed(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(31))) * _Q


def window_hashes(numbers: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` numbers, by runs of powers of two."""
    if len(numbers) < size:
        return np.empty(0, np.uint64)
    out, done = None, 0
    run, length, factor = numbers.astype(np.uint64), 1, int(_P)
    while done < size:
        if size & length:  # append this power's run to what there is
            n = len(numbers) - done - length + 1
            out = run[:n].copy() if out is None else out[:n] * np.uint64(factor) + run[done : done + n]
            done += length
        if done < size:
            run = run[:-length] * np.uint64(factor) + run[length:]
            length, factor = 2 * length, factor * factor % (1 << 64)
    return _mixed(out)


def checks(numbers: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A second, independent hash of the runs at the positions ``at``."""
    h = np.zeros(len(at), np.uint64)
    for k in range(size):
        h = _mixed((h ^ numbers[at + k]) + _P)
    return h


#: ``place`` is a window's first word; of literal letters, a template at any of place..last lies within the window.
WINDOWS = "kind int, hash long, check long, place int, last int, slots array<long>"


@dataclass(frozen=True)
class Filters:
    """What a task knows of the items: the words that they share, and, for documents, the hashes of their windows."""

    shared: Bitmap
    windows: Bitmap | None
    kinds: frozenset[int]


def windows(texts: list[str], filters: Filters, numbers: Numbers, letters: list[bool] | None = None) -> tuple[np.ndarray, dict[str, object]]:
    """(index of the text, columns of WINDOWS) of the windows of ``texts`` that pass the filters.

    ``letters`` says of items whether they are of letters; documents, without it, have windows of both kinds.
    """
    words = [tokens(t) for t in texts]
    flat = [w for ws in words for w in ws]
    own = np.fromiter(map(numbers.__getitem__, flat), np.uint64, len(flat))
    text_of = np.repeat(np.arange(len(texts)), [len(ws) for ws in words])
    first = np.cumsum([0, *(len(ws) for ws in words)])
    kind_of = np.zeros(len(texts), bool) if letters is None else np.array(letters, bool)
    found: list[tuple[np.ndarray, ...]] = []
    slots: list[list[int] | None] = []

    def keep(kind: int, sequence: np.ndarray, texts_of: np.ndarray, size: int, wanted: np.ndarray | None, word_of: np.ndarray | None = None) -> None:
        h = window_hashes(sequence, size)
        if not len(h):
            return
        ok = texts_of[: len(h)] == texts_of[size - 1 :]
        if wanted is not None:
            ok &= wanted[: len(h)]
        if filters.windows is not None:
            ok &= filters.windows.may_hold(h)
        at = np.flatnonzero(ok)
        owner = texts_of[at]
        place = (at if word_of is None else word_of[at]) - first[owner]
        last = place if word_of is None else np.maximum(place, word_of[at + size - 1] - first[owner] - TEMPLATE_LETTERS + 1)
        found.append((np.full(len(at), kind, np.int32), h[at].view(np.int64), checks(sequence, at, size).view(np.int64), place.astype(np.int32), last.astype(np.int32), owner))
        if kind in (TEMPLATE_OF_WORDS, TEMPLATE_OF_LETTERS):
            values = own.view(np.int64)
            slots.extend(values[a : a + size][sequence[a : a + size] <= NAME].tolist() for a in at.tolist())
        else:
            slots.extend([None] * len(at))

    of_words, of_letters = (None, None) if letters is None else (~kind_of[text_of], kind_of[text_of])
    if LITERAL_WORDS in filters.kinds:
        keep(LITERAL_WORDS, own, text_of, WORDS, of_words)
    if LITERAL_LETTERS in filters.kinds:
        signs = np.frombuffer("".join(flat).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        word_of = np.repeat(np.arange(len(flat)), np.fromiter(map(len, flat), np.int64, len(flat)))
        keep(LITERAL_LETTERS, _mixed(signs + _P), text_of[word_of], LETTERS, None if letters is None else kind_of[text_of[word_of]], word_of)
    if filters.kinds & {TEMPLATE_OF_WORDS, TEMPLATE_OF_LETTERS}:
        kind = own & np.uint64(3)
        codes = np.where(kind == WORD, np.where(filters.shared.may_hold(own), own, np.uint64(NAME)), kind)
        fixed = np.concatenate(([0], np.cumsum(codes > NAME)))

        def anchored(size: int) -> np.ndarray:
            return fixed[size:] - fixed[:-size] >= ANCHORS

        if TEMPLATE_OF_WORDS in filters.kinds and len(flat) >= WORDS:
            keep(TEMPLATE_OF_WORDS, codes, text_of, WORDS, anchored(WORDS) if of_words is None else anchored(WORDS) & of_words[: len(flat) - WORDS + 1])
        if TEMPLATE_OF_LETTERS in filters.kinds and len(flat) >= TEMPLATE_LETTERS:
            # Windows without any letter are left to the items of words.
            lettered = np.concatenate(([0], np.cumsum(np.fromiter(map(_ONE_LETTER, flat), bool, len(flat)))))
            wanted = anchored(TEMPLATE_LETTERS) & (lettered[TEMPLATE_LETTERS:] > lettered[:-TEMPLATE_LETTERS])
            keep(TEMPLATE_OF_LETTERS, codes, text_of, TEMPLATE_LETTERS, wanted if of_letters is None else wanted & of_letters[: len(wanted)])
    if not found:
        empty = np.empty(0, np.int64)
        return empty, {"kind": empty, "hash": empty, "check": empty, "place": empty, "last": empty, "slots": []}
    kinds, hashes, second, places, lasts, owners = (np.concatenate(c) for c in zip(*found, strict=True))
    return owners, {"kind": kinds, "hash": hashes, "check": second, "place": places, "last": lasts, "slots": slots}


def is_of_letters(lang: str | None, text: str) -> bool:
    """An item counts in letters if its language has no spaces; without a language, if most of its words are letters."""
    if lang:
        return lang.lower()[:2] in ("zh", "ja")
    words = tokens(text)
    return 2 * sum(len(w) == 1 and w > "぀" for w in words) > len(words)


def _item_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    numbers = Numbers()
    for pdf in batches:
        for i, text in zip(pdf["item_id"], pdf["text"], strict=True):
            own = np.array(list({numbers[w] for w in tokens(text)}), np.uint64)
            own = own[own & np.uint64(3) == WORD]
            yield pd.DataFrame({"word": own.view(np.int64), "item_id": i})


ALL_KINDS = frozenset((LITERAL_WORDS, LITERAL_LETTERS, TEMPLATE_OF_WORDS, TEMPLATE_OF_LETTERS))


def index_of(items: DataFrame) -> tuple[DataFrame, Filters]:
    """The windows of ``items`` (item_id, lang, text) as a written table, and the filters for the documents."""
    counted = items.mapInPandas(_item_words, "word long, item_id long").groupBy("word").agg(F.count_distinct("item_id").alias("n"))
    common = materialise(counted.where(F.col("n") >= SHARED_BY), "shared-words")
    shared = Bitmap.of(common, "word", common.count())

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, filters = Numbers(), Filters(shared, None, ALL_KINDS)
        for pdf in batches:
            texts = pdf["text"].tolist()
            owner, columns = windows(texts, filters, numbers, [is_of_letters(lang if isinstance(lang, str) else None, t) for lang, t in zip(pdf["lang"], texts, strict=True)])
            if len(owner):
                yield pd.DataFrame({**columns, "item_id": pdf["item_id"].to_numpy()[owner]})

    table = materialise(items.mapInPandas(cut, f"{WINDOWS}, item_id long").dropDuplicates(["kind", "hash", "check", "place", "item_id"]), "item-windows")
    sizes = {r["kind"]: r["n"] for r in table.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # four rows at most
    return table, Filters(shared, Bitmap.of(table, "hash", sum(sizes.values())), frozenset(sizes))


def leaked_items(docs: DataFrame, id_column: str, text: str, items: DataFrame, item_column: str, item_text: str, item_lang: str) -> DataFrame:
    """(doc_id, item_id, literal): each document with the items that leaked into it.

    ``literal`` is false where only the item with other parameters was found. Null and empty texts on
    either side leak nothing, as do items shorter than the window and items without an id. Repeated
    rows give a pair once. Items without a language count by their script. Other columns don't matter,
    whatever their names. Empty tables give no rows.
    """
    rows = items.select(F.col(item_column).cast("long").alias("item_id"), F.col(item_lang).alias("lang"), F.col(item_text).alias("text")).where(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    table, filters = index_of(rows)
    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("version"), F.col(text).alias("text"))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = Numbers()
        for pdf in batches:
            pdf = pdf[pdf["text"].notna()]
            for a in range(0, len(pdf), 256):  # as many texts as are held as words at once
                part = pdf.iloc[a : a + 256]
                owner, columns = windows(part["text"].tolist(), filters, numbers)
                if len(owner):
                    yield pd.DataFrame({**columns, "doc_id": part["doc_id"].array[owner], "version": part["version"].to_numpy()[owner]})

    there = materialise(spread(narrow).mapInPandas(find, f"{WINDOWS}, doc_id long, version long"), "document-windows")
    here = table.select("kind", "hash", "check", "item_id", F.col("place").alias("item_place"), F.col("slots").alias("item_slots"))
    hits = there.join(here, ["kind", "hash", "check"])
    literal = hits.where(F.col("kind").isin(LITERAL_WORDS, LITERAL_LETTERS)).groupBy("doc_id", "item_id").agg(F.lit(True).alias("literal"))
    # A place that is a literal leak of some item is no leak of another with other parameters.
    known = there.where(F.col("kind").isin(LITERAL_WORDS, LITERAL_LETTERS)).join(here, ["kind", "hash", "check"], "left_semi")
    explained = known.select("doc_id", "version", (F.col("kind") + 2).alias("kind"), F.explode(F.sequence("place", "last")).alias("place")).distinct()
    same = [explained[c].eqNullSafe(there[c]) for c in ("doc_id", "version", "kind", "place")]
    unexplained = there.where(F.col("kind").isin(TEMPLATE_OF_WORDS, TEMPLATE_OF_LETTERS)).join(explained, same, "left_anti")
    # Every value of the item stands for one value of the document and the other way round.
    one = F.size(F.array_distinct(F.arrays_zip("item_slots", "slots")))
    fits = (one == F.size(F.array_distinct("slots"))) & (one == F.size(F.array_distinct("item_slots")))
    fitting = unexplained.join(here, ["kind", "hash", "check"]).where(fits).select("kind", "doc_id", "version", "item_id", "place", (F.col("place") - F.col("item_place")).alias("line")).distinct()
    # With other parameters, as many consecutive words must fit as a literal leak has.
    need = F.when(F.col("kind") == TEMPLATE_OF_WORDS, 1).otherwise(LETTERS - TEMPLATE_LETTERS + 1)
    line = ["doc_id", "version", "kind", "item_id", "line"]
    run = F.col("place") - F.row_number().over(Window.partitionBy(*line).orderBy("place"))
    other = fitting.withColumn("run", run).groupBy(*line, "run").agg(F.count("*").alias("n")).where(F.col("n") >= need).groupBy("doc_id", "item_id").agg(F.lit(False).alias("literal"))
    return literal.unionByName(other).groupBy("doc_id", "item_id").agg(F.max("literal").alias("literal"))


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the items in it, literally or with other parameters."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    items = read_table(spark, sf_dir, "eval_item", "item_id", "lang", "text")
    return leaked_items(docs, "doc_id", "text", items, "item_id", "text", "lang")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_leaks(spark, sf_dir).where("literal").select("doc_id", "item_id")


QUERIES = {"p9_found": p9_found, "p9_leaks": p9_leaks}
ORACLE: dict[str, str] = {}
