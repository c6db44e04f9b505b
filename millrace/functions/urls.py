"""Addresses: canonical forms, base paths, routing by host."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import js_trim

# Query parameters that only track or share.
TRACKING = ("share_code", "utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "utm_psn", "utm_id", "utm_oi")


def part(url: Column, name: str, key: str | None = None) -> Column:
    """Part of an address; null where it is none, never an error."""
    args = [url, F.lit(name)] + ([F.lit(key)] if key else [])
    return F.try_parse_url(*args)


def host(url: Column) -> Column:
    return F.lower(part(url, "HOST"))


def on_host(url: Column, name: str) -> Column:
    """Whether the address is on ``name`` or below it."""
    h = host(url)
    return F.coalesce((h == name) | h.endswith(f".{name}"), F.lit(False))


def is_zhihu(url: Column) -> Column:
    return on_host(url, "zhihu.com") & F.coalesce(url.contains("zhuanlan.zhihu.com/p/"), F.lit(False))


def is_medium(url: Column) -> Column:
    return on_host(url, "medium.com")


def is_wechat(url: Column) -> Column:
    return on_host(url, "mp.weixin.qq.com")


#: Adapters in order; the last takes what the others leave.
ADAPTERS = [("zhihu", is_zhihu), ("medium", is_medium), ("wechat", is_wechat), ("others", lambda url: F.lit(True))]


def register_adapter(name: str, predicate) -> None:
    """Add an adapter, or replace the one of that name; "others" stays last."""
    kept = [a for a in ADAPTERS if a[0] not in (name, "others")]
    last = (name, predicate) if name == "others" else next(a for a in ADAPTERS if a[0] == "others")
    ADAPTERS[:] = [*kept, *([(name, predicate)] if name != "others" else []), last]


def provider(url: Column) -> Column:
    """Name of the first adapter that takes the address."""
    out = F
    for name, predicate in ADAPTERS:
        out = out.when(predicate(url), F.lit(name))
    return out


def is_arxiv(url: Column) -> Column:
    path = F.coalesce(part(url, "PATH"), F.lit(""))
    return (on_host(url, "arxiv.org") & path.rlike("(?i)/(pdf|abs|src|html|e-print)/")) | F.coalesce(host(url) == "ar5iv.labs.arxiv.org", F.lit(False))


def is_pdf(url: Column) -> Column:
    return F.coalesce(part(url, "PATH").rlike(r"(?i)\.pdf/*$"), F.lit(False))


def is_entity_link(url: Column) -> Column:
    """Search links that a site puts on words of its texts."""
    search = (host(url) == "zhida.zhihu.com") & (part(url, "PATH") == "/search")
    return F.coalesce(search & (part(url, "QUERY", "zd_token").isNotNull() | (part(url, "QUERY", "zhida_source") == "entity")), F.lit(False))


def _rebuilt(url: Column, kept: Column) -> Column:
    """The address with the query parameters ``kept``, an array; empty ones leave no question mark."""
    bare = F.regexp_extract(url, r"^([^?#]*)", 1)
    fragment = F.regexp_extract(url, r"(#.*)$", 1)
    return F.concat(bare, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""), fragment)


def _parameters(url: Column) -> Column:
    return F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: p != "")


def sanitise_url(url: Column) -> Column:
    """Tracking parameters of exactly these names dropped."""
    kept = F.filter(_parameters(url), lambda p: ~F.split(p, "=")[0].isin(*TRACKING))
    return F.when(url.contains("?"), _rebuilt(url, kept)).otherwise(url)


def import_url(url: Column) -> Column:
    """Trimmed, without tracking parameters in any case, the rest sorted by name (stable)."""
    trimmed = js_trim(url)
    name = lambda p: F.split(p, "=")[0]
    kept = F.filter(_parameters(trimmed), lambda p: ~(F.lower(name(p)).startswith("utm_") | F.lower(name(p)).isin(*TRACKING)))
    keyed = F.array_sort(F.transform(kept, lambda p, i: F.struct(name(p).alias("k"), i.alias("i"), p.alias("p"))))
    return F.when(trimmed.contains("?"), _rebuilt(trimmed, F.transform(keyed, lambda s: s["p"]))).otherwise(trimmed)


def import_owner(source: Column, url: Column) -> Column:
    return F.concat(F.lit("import:"), F.lower(js_trim(source)), F.lit(":"), import_url(url))


def normalise_url(url: Column, base: Column | None = None) -> Column:
    """``//`` gets https, absolute ones stay, root-relative ones go onto ``base``; anything else is empty."""
    out = F.when(F.coalesce(url, F.lit("")) == "", "").when(url.startswith("//"), F.concat(F.lit("https:"), url)).when(url.rlike("(?i)^https?://"), url)
    if base is not None:
        origin = F.regexp_extract(base, r"(?i)^(https?://[^/?#]+)", 1)
        folder = F.regexp_extract(base, r"(?i)^(https?://[^/?#]+(?:/[^?#]*/|/))", 1)
        folder = F.when(folder == "", F.concat(origin, F.lit("/"))).otherwise(folder)
        out = out.when((origin != "") & url.startswith("/"), F.concat(origin, url)).when(origin != "", F.concat(folder, url))
    return out.otherwise("")


def normalise_base(base: Column) -> Column:
    """With a trailing slash."""
    return F.when(base.endswith("/"), base).otherwise(F.concat(base, F.lit("/")))


def normalise_site_base(base: Column) -> Column:
    """With a leading and a trailing slash."""
    led = F.when(base.startswith("/"), base).otherwise(F.concat(F.lit("/"), base))
    return normalise_base(led)


def with_base(path: Column, base: Column) -> Column:
    """Root-relative paths below ``base``, once; others unchanged."""
    b = normalise_site_base(base)
    inside = path.startswith("/") & ~path.startswith("//")
    return F.when(~inside, path).when(b == "/", path).when(path.startswith(b) | (F.concat(path, F.lit("/")) == b), path).otherwise(F.concat(b, F.substr(path, F.lit(2))))


def post_url(slug: Column, base: Column) -> Column:
    return F.concat(normalise_base(base), slug, F.lit("/"))


def prefix_images(markdown: Column, base: str) -> Column:
    """Root-relative image addresses below ``base``."""
    return F.regexp_replace(markdown, r"(!\[[^\]]*\]\()/(?!/)", "$1" + base.rstrip("/") + "/")


def is_external(href: Column, base: str = "/") -> Column:
    inside = rf"^(#|/|\./|\.\./{'|' + base if base != '/' else ''})"
    return F.coalesce(~href.rlike(inside), F.lit(False))
