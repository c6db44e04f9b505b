"""One consistent form for text that looks the same: a longest-match transducer over grapheme clusters.

The mapping is built by rule from the Unicode database plus short lists of look-alike letters, is
checked for conflicts, closed (no output needs mapping again) and compiled once. Applying it is one
left-to-right pass: the pattern takes the longest run "character with its combining and invisible
followers" that can change, and a table gives the run's output; the table's rows are computed from
the mapping when a cluster is first seen.

Merged: full- and half-width forms, composed and combining marks (in canonical order), compatibility
ideographs, radicals and ligatures, invisible characters, kinds of space, look-alike letters of
other alphabets, hyphens drawn alike. Kept apart: case, missing accents, super- and subscripts,
circled and squared forms, fractions, dashes of other lengths.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.parallel import spread
from millrace.plans.storage import materialise
from millrace.sources import read_table

# Letters drawn like Latin ones, and hyphens; source letters, then what they look like.
LOOK_ALIKES = {
    "АВЕЅІЈКМНОРСТУХԌԚԜҮ": "ABESIJKMHOPCTYXGQWY",  # Cyrillic
    "аеѕіјорсухһԁԛԝү": "aesijopcyxhdqwy",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ": "ABEZHIKMNOPTYXCJ",  # Greek
    "ονϲϳ": "ovcj",
    "օսհոց": "ouhng",  # Armenian
    "ɡ‐": "g-",
}
# Compatibility forms that are drawn differently from what they stand for.
DRAWN_DIFFERENTLY = frozenset("ſŉϐϑϒϕϖϰϱϴϵ№")
DECOMPOSITIONS = ("", "<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>", "<small>")
INVISIBLE_CATEGORIES = ("Cf",)
# Drawn as nothing though not of category Cf.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ" + "".join(map(chr, range(0xFE00, 0xFE10)))
VISIBLE_FORMAT = "؀؁؂؃؄؅۝܏࣢"
FOLLOWERS = "ﾞﾟ"  # half-width voicing marks, letters to Unicode but marks to the eye


class Conflict(ValueError):
    """Two rules give one source different outputs, or an output would be mapped again."""


def merge(rules: Iterable[tuple[str, str]]) -> dict[str, str]:
    """The mapping of all rules; raises Conflict where two of them disagree."""
    mapping: dict[str, str] = {}
    for source, output in rules:
        if mapping.setdefault(source, output) != output:
            raise Conflict(f"{source!r} maps to {mapping[source]!r} and to {output!r}")
    return mapping


def _decomposed(c: str) -> str:
    """Full decomposition of ``c`` by the allowed kinds only."""
    kind, _, rest = unicodedata.decomposition(c).rpartition(">")
    kind = f"{kind}>" if kind else ""
    if not rest or kind not in DECOMPOSITIONS:
        return c
    return "".join(_decomposed(chr(int(x, 16))) for x in rest.split())


def base_rules() -> Iterator[tuple[str, str]]:
    """One rule for each code point that a width, accent, space or visibility rule changes.

    Look-alike letters are left to their own rules.
    """
    letters = "".join(LOOK_ALIKES)
    for n in range(sys.maxunicode + 1):
        c = chr(n)
        if 0xD800 <= n <= 0xDFFF or 0xAC00 <= n <= 0xD7A3 or c in DRAWN_DIFFERENTLY or c in letters:
            continue
        category = unicodedata.category(c)
        if (category in INVISIBLE_CATEGORIES and c not in VISIBLE_FORMAT) or c in INVISIBLE:
            yield c, ""
        elif category == "Zs":
            yield c, " "
        elif c in "  ":
            yield c, "\n"
        else:
            d = _decomposed(c)
            if d != c and not d.startswith(" "):  # spacing accents keep their form
                yield c, d


def look_alike_rules() -> Iterator[tuple[str, str]]:
    for sources, outputs in LOOK_ALIKES.items():
        for source, output in zip(sources, outputs, strict=True):
            yield source, output


def compiled_mapping() -> dict[str, str]:
    """Source character to its final decomposed output; closed, so outputs are fixed points."""
    letters = merge(look_alike_rules())
    mapping = merge(base_rules())
    if both := letters.keys() & mapping.keys():
        raise Conflict(f"{both} have a look-alike and another rule")
    out = {}
    for source in mapping.keys() | letters.keys():
        output = "".join(letters.get(c, c) for c in mapping.get(source, source))
        if output != source:
            out[source] = output
    for source, output in out.items():
        if again := [c for c in output if out.get(c, c) != c]:
            raise Conflict(f"{source!r} gives {again}, which have rules themselves")
    return out


class Transducer(dict):
    """Cluster to output. Missing clusters are computed from the mapping and kept, up to a bound.

    A cluster is the longest run of a changeable character and its followers, or of followers behind
    a character that has no rule. The pattern starts with one character class, so the scan over
    unchanged text stays in the regular expression engine's inner loop.
    """

    LIMIT = 200_000

    def __init__(self):
        super().__init__()
        self.mapping = compiled_mapping()
        # Composed letters come back to themselves through decomposition and composition: they need no match.
        starts = {c for c, out in self.mapping.items() if unicodedata.normalize("NFC", out) != c}
        followers = {c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c)[0] == "M"}
        followers |= {c for c, out in self.mapping.items() if not out} | set(FOLLOWERS)
        self.pattern = re.compile(rf"[{_classes(starts | followers)}][{_classes(followers)}]*")
        self.single = frozenset(c for c in starts | followers if self.mapping.get(c, c) != c)
        # For readers of letters and digits alone, signs and spaces needn't be mapped.
        self.lettered = frozenset(c for c in starts | followers if c in self.mapping and (not self.mapping[c] or any(o.isalnum() or o in "\u3099\u309a" for o in self.mapping[c])))

    def __missing__(self, cluster: str) -> str:
        output = unicodedata.normalize("NFC", "".join(self.mapping.get(c, c) for c in cluster))
        if len(self) < self.LIMIT:
            self[cluster] = output
        return output

    def letters_of(self, text: str) -> str:
        """``text`` with the one form's letters and digits; signs and spaces stay as they are.

        Outputs are fixed points, so the few characters to change can be replaced one after another.
        """
        if text.isascii():
            return text
        for c in self.lettered.intersection(text):
            text = text.replace(c, self.mapping[c])
        return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)

    def form(self, text: str) -> str:
        """The same as ``apply``, for texts with few different characters to change: they are replaced one after another."""
        if text.isascii():
            return text
        for c in self.single.intersection(text):
            text = text.replace(c, self.mapping[c])
        return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)

    def apply(self, text: str) -> str:
        if text.isascii():
            return text
        text = self.pattern.sub(lambda m: self[m.group()], text)
        # A follower behind a character without a rule is composed with it here.
        return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def _classes(characters: Iterable[str]) -> str:
    """The characters as ranges of a character class."""
    runs: list[list[int]] = []
    for n in sorted(map(ord, characters)):
        if runs and runs[-1][1] == n - 1:
            runs[-1][1] = n
        else:
            runs.append([n, n])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" if a < b else f"\\U{a:08x}" for a, b in runs)


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    return Transducer()


def canonical(text: str | None) -> str | None:
    """The one form of ``text``; null stays null and the empty text empty."""
    return None if text is None else transducer().apply(text)


@F.pandas_udf(T.StringType())
def _canonical_udf(texts: pd.Series) -> pd.Series:
    return texts.map(canonical, na_action="ignore")


def canonical_text(column: Column | str) -> Column:
    """``canonical`` as a column expression (Arrow batches)."""
    return _canonical_udf(column)


def p5_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and text of every article in the one form."""
    df = read_table(spark, sf_dir, "article", "article_id", "title", "markdown")
    return df.select("article_id", canonical_text("title").alias("title"), canonical_text("markdown").alias("markdown"))


def _digest(text: str) -> bytes:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each text its id, field, and 128-bit digests of its one form and of the text as stored."""
    apply = transducer().apply
    for pdf in batches:
        ids, fields, forms, stored = [], [], [], []
        for field in pdf.columns[1:]:
            for i, text in zip(pdf["id"], pdf[field], strict=True):
                if isinstance(text, str) and text:
                    form = apply(text)
                    ids.append(i)
                    fields.append(field)
                    stored.append(raw := _digest(text))
                    forms.append(raw if form is text or form == text else _digest(form))
        if ids:
            yield pd.DataFrame({"id": ids, "field": fields, "form": forms, "stored": stored})


#: None: every form gives all its pairs. A caller that only needs connected classes may set a number; forms with more rows then give links.
ALL_PAIRS: int | None = None
#: Rows of a chunk. Pairs are made chunk by chunk, so that those of a large form are spread over all tasks.
CHUNK = 100


def look_alikes(df: DataFrame, id_column: str, fields: list[str]) -> DataFrame:
    """(id, field, form, stored, n_rows): the rows whose value in ``field`` has a form that is stored in several ways, written once.

    Only digests are shuffled. The aggregate combines before the shuffle, so exact copies of one text,
    however many, are a few rows by then.
    """
    narrow = df.select(F.col(id_column).alias("id"), *fields)
    forms = materialise(spread(narrow).mapInPandas(_forms, "id long, field string, form binary, stored binary").dropDuplicates(), "forms")
    varied = forms.groupBy("field", "form").agg(F.min("stored").alias("least"), F.max("stored").alias("most"), F.count("*").alias("n_rows")).where(F.col("least") != F.col("most"))
    return materialise(forms.join(varied.select("field", "form", "n_rows"), ["field", "form"]), "look-alikes")


def _representatives(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """By form: its first stored value and that value's least id, and the least id of any other value."""
    variants = members.groupBy("field", "form", "stored").agg(F.min("id").alias("least"))
    first = variants.groupBy("field", "form").agg(F.min(F.struct("least", "stored")).alias("first"))
    others = variants.join(first, ["field", "form"]).where(F.col("stored") != F.col("first.stored"))
    return first, others.groupBy("field", "form").agg(F.min("least").alias("second"))


def look_alike_classes(df: DataFrame, id_column: str, fields: list[str]) -> DataFrame:
    """(id, field, class_id, variant_id): for each row with look-alikes its class, and the class's stored value that it has.

    class_id is the least id of all rows of the form, variant_id the least id of those stored alike: two
    rows look alike if their class is the same, and differ as stored if their variant isn't. One row for
    each row and field, so the result is linear however large a class is. Null and empty values and rows
    without an id have none; repeated rows count once. An empty table gives none.
    """
    members = look_alikes(df, id_column, fields).where(F.col("id").isNotNull())
    variants = members.groupBy("field", "form", "stored").agg(F.min("id").alias("variant_id"))
    classes = variants.groupBy("field", "form").agg(F.min("variant_id").alias("class_id"))
    return members.join(variants, ["field", "form", "stored"]).join(classes, ["field", "form"]).select("id", "field", "class_id", "variant_id")


def _placed(members: DataFrame) -> DataFrame:
    """Members by the place of their stored value among the ``total`` rows of the form, which are sorted by it.

    The rows of a value are at ``start`` to ``end``, each in a chunk of about CHUNK rows. ``again`` marks ids
    with several values in the field. Only variants are sorted; their rows are placed by a hash.
    """
    form = Window.partitionBy("field", "form")
    variants = members.groupBy("field", "form", "stored").agg(F.count("*").alias("n"))
    variants = variants.withColumn("end", F.sum("n").over(form.orderBy("stored").rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("total", F.sum("n").over(form))
    start = F.col("end") - F.col("n")
    chunk = F.floor((start + F.pmod(F.xxhash64("id"), F.col("n"))) / CHUNK)
    again = F.count("*").over(Window.partitionBy("field", "id")) > 1
    placed = members.join(variants, ["field", "form", "stored"]).select("id", "field", "form", start.alias("start"), "end", "total", chunk.alias("chunk"), again.alias("again"))
    return spread(materialise(placed, "places"))


def _crossed(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id_a, id_b, field) for each placed row of ``a`` and each one of ``b`` whose stored value comes later in the form.

    A row goes once to each chunk that has such rows, so the work follows the number of pairs, also where
    most rows of a form are exact copies. A merge join, as the size of the repeated rows can't be estimated.
    """
    chunk_of = lambda place: F.floor(place / CHUNK)
    later = F.sequence(chunk_of(F.col("end")), chunk_of(F.col("total") - 1))
    earlier = F.sequence(F.lit(0).cast("long"), chunk_of(F.col("start") - 1))
    a = a.where(F.col("end") < F.col("total")).select("field", "form", F.col("chunk").alias("chunk_a"), F.explode(later).alias("chunk_b"), F.col("id").alias("a"), "end")
    b = b.where(F.col("start") > 0).select("field", "form", F.explode(earlier).alias("chunk_a"), F.col("chunk").alias("chunk_b"), F.col("id").alias("b"), "start")
    pairs = a.join(b.hint("merge"), ["field", "form", "chunk_a", "chunk_b"]).where((F.col("end") <= F.col("start")) & (F.col("a") != F.col("b")))
    return pairs.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), "field")


def _all_pairs(members: DataFrame) -> DataFrame:
    """(id_a, id_b, field): all pairs of ``members``; only those of ids with several values may repeat and are sorted out."""
    placed = _placed(members)
    once, again = placed.where(~F.col("again")), placed.where("again")
    return _crossed(once, once).unionByName(_crossed(again, placed).unionByName(_crossed(once, again)).distinct())


def _links(members: DataFrame) -> DataFrame:
    """(id_a, id_b, field): each of ``members`` with the representative of another stored value of its form."""
    first, second = _representatives(members)
    other = F.when(F.col("stored") == F.col("first.stored"), F.col("second")).otherwise(F.col("first.least"))
    links = members.join(first.join(second, ["field", "form"]), ["field", "form"]).select("id", other.alias("other"), "field").where(F.col("id") != F.col("other"))
    return links.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b"), "field").distinct()


def look_alike_pairs(df: DataFrame, id_column: str, fields: list[str]) -> DataFrame:
    """(id_a, id_b, field): two rows whose values in ``field`` differ as stored and have one form.

    All such pairs, however many rows have the form: n rows stored in two ways give up to n * n / 4.
    ``look_alike_classes`` says the same in n rows. Null and empty values, and values equal as stored, give
    no pair; ids are compared as numbers; repeated rows of one id give a pair once. An empty table gives none.
    Only where ALL_PAIRS is set, a form with more rows gives links: linear, and connecting its whole class.
    """
    members = look_alikes(df, id_column, fields).where(F.col("id").isNotNull())
    if ALL_PAIRS is None:
        return _all_pairs(members)
    few, many = members.where(F.col("n_rows") <= ALL_PAIRS), members.where(F.col("n_rows") > ALL_PAIRS)
    return _all_pairs(few).unionByName(_links(many)).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alike_pairs(read_table(spark, sf_dir, "article", "article_id", "title", "markdown"), "article_id", ["title", "markdown"])


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article and field with look-alikes, its class and the variant that it is stored as."""
    classes = look_alike_classes(read_table(spark, sf_dir, "article", "article_id", "title", "markdown"), "article_id", ["title", "markdown"])
    return classes.withColumnRenamed("id", "article_id")


QUERIES = {"p5_found": p5_found, "p5_classes": p5_classes, "p5_normalise": p5_normalise}
ORACLE: dict[str, str] = {}
