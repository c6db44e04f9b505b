"""String expressions over whole documents; all stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Exotic spaces that become a plain one, and characters that are dropped.
WIDE_SPACES = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u3000"
DROPPED = "\u200b\u200c\u200d\u2061\ufeff"
WORDS_PER_MINUTE = 450
# Emoji that open a callout.
CALLOUTS = "💡|⚠️|📌|❗|✅|ℹ️|📣|📝"


def js_trim(c: Column) -> Column:
    """Trim of every Unicode space and the byte order mark."""
    return F.regexp_replace(c, r"(?U)^[\s\x{feff}]+|[\s\x{feff}]+$", "")


def blank(c: Column) -> Column:
    return F.coalesce(js_trim(c) == "", F.lit(True))


def none_if_blank(c: Column) -> Column:
    return F.when(~blank(c), js_trim(c))


def normalise_invisible(c: Column) -> Column:
    """Exotic spaces to plain ones; zero-width characters and the byte order mark dropped."""
    return F.translate(c, WIDE_SPACES + DROPPED, " " * len(WIDE_SPACES))


def compress_lines(c: Column) -> Column:
    """Runs of three or more line feeds to two, then CRLF to LF, in this order."""
    return F.replace(F.regexp_replace(c, "\n{3,}", "\n\n"), F.lit("\r\n"), F.lit("\n"))


def cleanup_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit("\n{3,}"))


def sanitise_mdx(c: Column) -> Column:
    """Autolinks to Markdown links, blank comments dropped, blank runs collapsed."""
    linked = F.regexp_replace(c, r"<(https?://[^>\s]+)>", "[$1]($1)")
    return F.regexp_replace(F.regexp_replace(linked, r"<!--\s*-->", ""), "\n{3,}", "\n\n")


def unescape_math(c: Column) -> Column:
    r"""``\$\$`` and ``\$`` to one dollar sign."""
    return F.replace(F.replace(c, F.lit(r"\$\$"), F.lit("$")), F.lit(r"\$"), F.lit("$"))


def reading_stats(c: Column) -> tuple[Column, Column]:
    """(words, minutes): Han characters and runs of Latin letters and digits outside tags."""
    bare = F.regexp_replace(c, r"<[^>]+>", " ")
    # One pass: the alternatives exclude each other.
    words = F.regexp_count(bare, F.lit(r"\p{IsHan}|[A-Za-z0-9]+"))
    minutes = F.when(words > 0, F.greatest(F.lit(1), F.ceil(words / F.lit(WORDS_PER_MINUTE)))).otherwise(0)
    return words.cast("long"), minutes.cast("long")


def text_content(c: Column) -> Column:
    """Text without front matter, code, addresses and link syntax."""
    steps = ((r"\A---\n[\s\S]*?\n---\n", ""), (r"```[\s\S]*?```", ""), (r"`[^`\n]+`", ""), (r"https?://[^\s)]+", ""), (r"!\[([^\]]*)\]\([^)]+\)", "$1"), (r"\[([^\]]*)\]\([^)]+\)", "$1"))
    return reduce(lambda x, s: F.regexp_replace(x, *s), steps, c)


def with_ratios(df: DataFrame, column: str, output: str, threshold: float = 0.6) -> DataFrame:
    """``df`` with a struct (language, confidence, englishRatio, chineseRatio) by classes of characters.

    In three steps, as each is used more than once by the next: the optimizer then keeps them apart.
    """
    counted = df.withColumn("__text", text_content(F.col(column)))
    count = lambda kept: F.length(F.regexp_replace("__text", kept, ""))
    counted = counted.withColumn("__n", F.struct(count(r"[^A-Za-z0-9_\x{4e00}-\x{9fff}]+").alias("total"), count("[^A-Za-z]+").alias("en"), count(r"[^\x{4e00}-\x{9fff}]+").alias("zh")))
    enough = F.coalesce(F.col("__n.total") >= 10, F.lit(False))
    share = lambda part: F.when(enough, F.col(f"__n.{part}") / F.col("__n.total")).otherwise(0.0)
    shares = counted.withColumn("__r", F.struct(share("en").alias("en"), share("zh").alias("zh")))
    english, chinese = F.col("__r.en"), F.col("__r.zh")
    language = F.when(english >= threshold, "en").when(chinese >= threshold, "zh").when(english > chinese, "en").when(chinese > english, "zh").otherwise("unknown")
    confidence = F.when(english == chinese, 0.0).otherwise(F.when(english >= threshold, english).when(chinese >= threshold, chinese).otherwise(F.greatest(english, chinese)))
    ratios = F.struct(language.alias("language"), confidence.alias("confidence"), english.alias("englishRatio"), chinese.alias("chineseRatio"))
    return shares.withColumn(output, ratios).drop("__text", "__n", "__r")


def should_translate(ratios: Column, threshold: float = 0.6) -> Column:
    return (ratios["language"] == "en") & (ratios["confidence"] >= threshold)


def strip_scripts(html: Column) -> Column:
    """HTML without script, style, noscript and template elements."""
    return F.regexp_replace(html, r"(?is)<(script|style|noscript|template)\b[^>]*>.*?</\1>", "")


def strip_callout(c: Column) -> Column:
    return F.regexp_replace(c, rf"^({CALLOUTS})\s+", "")


def trim_code(c: Column) -> Column:
    """Blank runs inside code collapsed, end trimmed."""
    return F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), r"\s+$", "")


def base64_text(c: Column) -> Column:
    return F.replace(F.base64(F.encode(c, "UTF-8")), F.lit("\r\n"), F.lit(""))


def unbase64_text(c: Column) -> Column:
    return F.decode(F.unbase64(c), "UTF-8")


def json_escape(c: Column) -> Column:
    """Backslash, quote, LF, CR and tab escaped."""
    pairs = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def duration_label(ms: Column) -> Column:
    """999ms, 1.23s or 1.50m; decimals are those of the binary value."""
    fixed = lambda x: F.call_function("format_number", x, F.lit("0.00"))
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(ms < 60000, F.concat(fixed(ms / F.lit(1000.0)), F.lit("s"))).otherwise(F.concat(fixed(ms / F.lit(60000.0)), F.lit("m")))


def to_boolean(c: Column) -> Column:
    """Yes and no words to booleans, anything else to null."""
    word = F.lower(js_trim(c))
    return F.when(word.isin("1", "true", "yes", "y", "on"), True).when(word.isin("0", "false", "no", "n", "off"), False)


def truncate_with_hash(c: Column, limit: int = 200) -> Column:
    """Long values cut, with a hash of the whole: a 31-polynomial over the characters in 32 bits."""
    size = F.lit(1 << 32)
    wrapped = lambda x: F.pmod(x + F.lit(1 << 31), size) - F.lit(1 << 31)
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    code = F.aggregate(codes, F.lit(0).cast("long"), lambda h, x: wrapped(h * 31 + x))
    label = F.substring(F.lower(F.hex(F.abs(code))), 1, 8)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, limit), F.lit("... [truncated, hash: "), label, F.lit("]")))


def front_matter_end(c: Column) -> Column:
    """Offset of the body: behind a leading ``---`` block, else 0."""
    # The search starts at the third character, so an empty block closes too.
    at = F.locate("\n---", c, 4)
    return F.when(c.startswith("---") & (at > 0), at + 3).otherwise(0)


def split_front_matter(c: Column) -> Column:
    """Struct (frontmatter, body)."""
    end = front_matter_end(c)
    return F.struct(F.when(end > 0, F.substr(c, F.lit(1), end)).otherwise("").alias("frontmatter"), F.when(end > 0, F.substr(c, end + 1)).otherwise(c).alias("body"))


def caption(c: Column) -> Column:
    """Whether a paragraph is a caption: short, no Markdown syntax in front, and numbered like one."""
    patterns = r"(?i)^(figure\s+\d+|fig\.\s*\d+|table\s+\d+|image\s+\d+|图\s*\d+|表\s*\d+|\d+[:.：]\s*)"
    return F.coalesce((F.length(c) <= 120) & ~c.rlike(r"^[#\-*>`]") & ~blank(c) & js_trim(c).rlike(patterns), F.lit(False))


def math_problem(c: Column) -> Column:
    """First reason why a formula is no valid replacement, or null."""
    bare = F.regexp_replace(c, r"\\.", "")
    balance = lambda a, b: F.regexp_count(bare, F.lit(a)) - F.regexp_count(bare, F.lit(b))
    braces, squares, rounds = balance(r"\{", r"\}"), balance(r"\[", r"\]"), balance(r"\(", r"\)")
    return (
        F.when(c.contains("$$"), "Contains $$ delimiter")
        .when(c.contains("$"), "Contains $ delimiter")
        .when(c.contains("\\[") | c.contains("\\]"), "Contains \\[ or \\] delimiter")
        .when(c.rlike("<[^>]+>"), "Contains HTML tags")
        .when(braces != 0, F.concat(F.lit("Unbalanced braces: "), braces.cast("string")))
        .when(squares != 0, F.concat(F.lit("Unbalanced square brackets: "), squares.cast("string")))
        .when(rounds != 0, F.concat(F.lit("Unbalanced parentheses: "), rounds.cast("string")))
    )
