"""Slugs, hashes and names derived from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import js_trim

# Accented letters and their plain ones, and what stands for more than one letter.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOOUUUUYaaaaaaceeeeiiiinoooooouuuuyy"
SPELLED = (("ß", "ss"), ("œ", "oe"), ("Œ", "OE"), ("æ", "ae"), ("Æ", "AE"), ("$", "dollar"), ("%", "percent"), ("&", "and"), ("-", " "))
# Extensions by image type.
MIME_EXTENSIONS = {"image/jpeg": ".jpg", "image/jpg": ".jpg", "image/png": ".png", "image/webp": ".webp", "image/gif": ".gif", "image/bmp": ".bmp", "image/avif": ".avif", "image/svg+xml": ".svg"}


def normalise_slug(c: Column) -> Column:
    """Lower-case ASCII slug: accents dropped, currency and percent signs spelled out, other signs deleted."""
    plain = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), SPELLED, F.translate(c, ACCENTED, PLAIN))
    kept = F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^A-Za-z0-9\s]", ""), r"\s+", " "))
    return F.lower(F.replace(kept, F.lit(" "), F.lit("-")))


def encode_component(c: Column) -> Column:
    """Percent-encoding that leaves letters, digits and ``-_.!~*'()`` alone."""
    marks = (("+", "%20"), ("%7E", "~"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%2A", "*"))
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), marks, F.url_encode(c))


def slugify_tag(c: Column) -> Column:
    """Slug of a tag; one without ASCII letters is percent-encoded."""
    name = F.regexp_replace(js_trim(c), r"(?U)\s+", " ")
    slug = normalise_slug(name)
    return F.when(slug != "", slug).otherwise(encode_component(F.replace(F.lower(name), F.lit(" "), F.lit("-"))))


def slug_from_title(explicit: Column, title: Column, fallback: Column) -> Column:
    """First non-blank slug; the fallback is taken raw where its slug is blank."""
    some = lambda x: F.nullif(normalise_slug(x), F.lit(""))
    return F.coalesce(some(explicit), some(title), some(fallback), fallback)


def short_hash(c: Column, length: int = 6) -> Column:
    return F.substring(F.sha2(c, 256), 1, length)


def image_name(index: Column, url: Column) -> Column:
    """``NNN-`` and the start of the address's MD5."""
    return F.concat(F.lpad((index + 1).cast("string"), 3, "0"), F.lit("-"), F.substring(F.md5(url), 1, 8))


def url_extension(url: Column) -> Column:
    """Lower-case image extension of an address, or null."""
    return F.nullif(F.lower(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"(?i)(\.(?:jpe?g|png|webp|gif|bmp|avif|svg))$", 1)), F.lit(""))


def mime_extension(mime: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in MIME_EXTENSIONS.items() for x in pair))
    return names[F.lower(F.trim(F.split(mime, ";")[0]))]


def image_extension(mime: Column, url: Column) -> Column:
    """Type first, then the address, then .jpg."""
    return F.coalesce(mime_extension(mime), url_extension(url), F.lit(".jpg"))


def image_extension_by_url(mime: Column, url: Column) -> Column:
    """The address first, then the type, then .png."""
    return F.coalesce(url_extension(url), mime_extension(mime), F.lit(".png"))


def safe_image_id(c: Column) -> Column:
    kept = F.regexp_replace(c, "[^a-zA-Z0-9_-]", "")
    return F.when(kept != "", kept).otherwise(F.substring(F.md5(c), 1, 12))


def latin_slug(c: Column, romanised: dict[str, str] | None = None) -> Column:
    """Slug, or for a text without Latin letters the slug of its romanisation.

    ``romanised`` maps single characters to their reading; which language's is the caller's choice.
    """
    own = normalise_slug(c)
    if not romanised:
        return own
    readings = F.create_map(*(F.lit(x) for pair in romanised.items() for x in pair))
    spelled = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.concat(F.lit(" "), F.try_element_at(readings, x), F.lit(" ")), x)), "")
    return F.when(own != "", own).otherwise(normalise_slug(spelled))
