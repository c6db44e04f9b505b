"""Fields, main element and Markdown of HTML pages, as one pass of Arrow batches over the pages."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.dom import AnyOf, Element, matcher, parse, select
from millrace.plans.parallel import spread
from millrace.sources import read_table

LEAST_TEXT = 100
# What may be a page's article, and what is noise inside it.
MAIN = ("article", "main article", "main", "[data-article]", ".article", ".article-body", ".post", ".post-content", ".blog-post", ".markdown", ".mdx", ".prose", ".content", ".entry-content")
NOISE = (
    "nav footer aside .toc #toc .table-of-contents .TableOfContents .toc-container .TableOfContents__root .breadcrumb .breadcrumbs .comment .comments #comments "
    '[data-component="comments"] .related .related-posts .post-navigation .next-post .prev-post .subscribe .newsletter .cookie .cookie-banner .share .social .ad .ads .advert .promo'
).split()
ZHIHU = (".Post-RichText", ".RichText", "article", ".ztext", '[data-za-detail-view-element_name="Article"]', ".Post-Main .RichContent")
WECHAT = ("#js_content", ".rich_media_content")
ZHIHU_TITLE, ZHIHU_AUTHOR = ("h1.Post-Title", "h1.RichText-Title", ".Post-Title", "article h1"), (".AuthorInfo-name", ".ContentItem-author .UserLink-link", ".UserLink-link", '[rel="author"]')
META_TITLE, META_AUTHOR = ('meta[property="og:title"]', 'meta[name="title"]'), ('meta[name="author"]', 'meta[property="article:author"]')
META_DATE = ('meta[property="article:published_time"]', 'meta[name="publish_date"]', 'meta[name="date"]')
META_UPDATED, TIME_UPDATED = ('meta[property="article:modified_time"]', 'meta[name="lastmod"]'), ('time[datetime][itemprop="dateModified"]',)
PAGE_TITLE, PAGE_AUTHOR = ("main h1", "article h1", "h1"), ('[rel="author"]', ".author", ".post-author", ".byline")
UNSEEN = ("script", "style", "noscript", "template")
LAZY = ("data-src", "data-original", "data-backup-src", "data-actualsrc", "src", "data-actual-url")
#: An article below main is an article, so it needs no test of its own.
_SIMPLE = tuple(x for x in MAIN if " " not in x)
_IS_MAIN, _IS_DIV, _MATCHERS = AnyOf(_SIMPLE), AnyOf(("div",)), tuple(map(matcher, _SIMPLE))
FIELDS = ("title", "author", "published", "updated", "html", "base_url", "source_title")


def drop(root: Element, selectors: tuple[str, ...] | list[str]) -> None:
    test = AnyOf(selectors)
    for e in [e for e in root.walk() if test(e)]:
        e.remove()


def first_text(root: Element, selectors: tuple[str, ...]) -> str | None:
    """Trimmed text of the first selector that finds any."""
    for s in selectors:
        for e in select(root, s):
            if t := e.text().strip():
                return t
            break
    return None


def first_attribute(root: Element, selectors: tuple[str, ...], name: str) -> str | None:
    for s in selectors:
        for e in select(root, s):
            if v := e.attrs.get(name, "").strip():
                return v
            break
    return None


def main_element(root: Element) -> Element | None:
    """The longest text of the usual places, at least LEAST_TEXT long; else of any div.

    Places are tried in their order, and the first of equals is kept.
    """
    for test, places in ((_IS_MAIN, _MATCHERS), (_IS_DIV, ())):
        found = [e for e in root.walk() if test(e)]
        # The order of places first, that of the document second; sorting keeps the latter.
        found.sort(key=lambda e: next((i for i, m in enumerate(places) if m(e)), 0))
        best, most = None, 0
        for e in found:
            n = len(e.text().strip())
            if n >= LEAST_TEXT and n > most:
                best, most = e, n
        if best is not None:
            return best
    return None


def generic(html: str, url: str) -> tuple:
    root = parse(html)
    drop(root, UNSEEN)
    parts = urlsplit(url)
    title = first_text(root, PAGE_TITLE) or first_attribute(root, META_TITLE, "content") or first_text(root, ("title",)) or parts.hostname
    author = first_attribute(root, META_AUTHOR, "content") or first_text(root, PAGE_AUTHOR)
    published = first_attribute(root, META_DATE, "content") or first_attribute(root, ("time[datetime]",), "datetime")
    updated = first_attribute(root, META_UPDATED, "content") or first_attribute(root, TIME_UPDATED, "datetime")
    main = main_element(root) or next(select(root, "body"), root)
    drop(main, NOISE)
    return title, author, published, updated, main.inner(), f"{parts.scheme}://{parts.netloc}", parts.hostname


def clean_zhihu(html: str) -> str:
    """Scripts dropped, links on entities unwrapped, headings raised so that the top one is h2."""
    root = parse(html)
    drop(root, UNSEEN)
    for a in list(select(root, "a[href]")):
        parts = urlsplit(a.attrs["href"])
        if parts.hostname == "zhida.zhihu.com" and parts.path == "/search" and re.search(r"(?:^|&)(?:zd_token=|zhida_source=entity(?:&|$))", parts.query):
            a.replace(*a.children)
    found = [e for e in root.walk() if re.fullmatch("h[1-6]", e.name)]
    top = min((int(e.name[1]) for e in found), default=7)
    if 2 < top <= 6:
        for e in found:
            e.name = f"h{int(e.name[1]) - top + 2}"
    return root.inner()


def _by_selectors(html: str, selectors: tuple[str, ...]) -> str | None:
    root = parse(html)
    for s in selectors:
        for e in select(root, s):
            if inner := e.inner().strip():
                return inner
            break
    return None


def zhihu(html: str, url: str) -> tuple:
    """Title, author and date by the places of this site's pages, then by the page's own data; no article leaves all null."""
    inner = _by_selectors(html, ZHIHU)
    if not inner:
        return (None,) * len(FIELDS)
    root = parse(html)
    title = first_text(root, ZHIHU_TITLE) or first_attribute(root, META_TITLE, "content") or first_text(root, ("title",)) or "Zhihu Article"
    author = first_attribute(root, META_AUTHOR, "content") or first_text(root, ZHIHU_AUTHOR)
    published = first_attribute(root, ('meta[itemprop="datePublished"]', *META_DATE), "content") or first_attribute(root, ("time[datetime]",), "datetime")
    return title, author, published, None, clean_zhihu(inner), None, None


def keywords(html: str) -> list[str]:
    """Keywords of a page's own data, each once."""
    given = next((e.attrs["content"] for e in parse(html).walk() if e.name == "meta" and e.attrs.get("name", "").lower() == "keywords" and e.attrs.get("content")), "")
    return list(dict.fromkeys(filter(None, (w.strip() for w in re.split("[,，]", given)))))


def medium(html: str, url: str) -> tuple:
    root = parse(html)
    article = next(select(root, "article"), None)
    if article is None or not article.inner().strip():
        return (None,) * len(FIELDS)
    title = first_text(root, ("h1",)) or first_text(root, ("title",)) or "Medium Article"
    author = first_attribute(root, META_AUTHOR[:1], "content") or first_text(root, ('a[rel="author"]',))
    return title, author, first_attribute(root, META_DATE, "content"), None, article.inner(), None, None


def lazy_images(root: Element) -> None:
    """The first web address among an image's lazy attributes becomes its source."""
    for img in select(root, "img"):
        for name in LAZY:
            if img.attrs.get(name, "").startswith(("http://", "https://")):
                img.attrs["src"] = img.attrs[name]
                break


def wechat(html: str, url: str) -> tuple:
    root = parse(html)
    lazy_images(root)
    inner = next((e.inner() for s in WECHAT for e in select(root, s)), None)
    if not (inner or "").strip():
        return (None,) * len(FIELDS)
    title = first_text(root, ("#activity-name",)) or first_text(root, ("h1",)) or first_text(root, ("title",)) or "WeChat Article"
    author = first_text(root, ("#js_name",)) or first_text(root, (".profile_nickname",))
    return title, author, first_text(root, ("#publish_time",)), None, inner, None, None


def image_source(attrs: dict[str, str], base: str | None) -> str:
    """Address of an image: lazy attributes in order, then the largest of a srcset; data addresses count as none."""
    url = next((attrs[n].strip() for n in LAZY if attrs.get(n, "").strip()), "")
    for name in ("srcset", "data-srcset"):
        if not url and attrs.get(name):
            best = -2.0
            for part in attrs[name].split(","):
                address, _, size = part.strip().partition(" ")
                number = re.match(r"[\d.]+", size.strip())
                score = float(number[0]) * (1000 if size.strip().endswith("x") else 1) if number else -1.0
                if address and score > best:
                    url, best = address, score
    if not url or url.startswith("data:"):
        return ""
    if url.startswith("//"):
        return f"https:{url}"
    if re.match(r"https?://", url, re.IGNORECASE):
        return url
    return urljoin(base, url) if base else ""


def _math(e: Element) -> str | None:
    """TeX of an element that holds a formula, with its delimiters."""
    names = e.classes()
    if "ztext-math" in names:
        tex = (e.attrs.get("data-tex") or e.text()).strip()
        return f"$${tex}$$" if e.name == "div" else f"${tex}$"
    if "katex" in names or "katex-display" in names:
        for a in select(e, 'annotation[encoding="application/x-tex"]'):
            tex = a.text().strip()
            return f"$${tex}$$" if "katex-display" in names else f"${tex}$"
    return None


def _inline(e: Element | str, base: str | None, images: list[str]) -> str:
    if isinstance(e, str):
        return re.sub(r"\s+", " ", e)
    if (tex := _math(e)) is not None:
        return tex
    inner = "".join(_inline(c, base, images) for c in e.children)
    if e.name == "br":
        return "\n"
    if e.name == "img":
        src = image_source(e.attrs, base)
        if not src:
            return ""
        images.append(src)
        return f"![{e.attrs.get('alt', '')}]({src})"
    if e.name == "code":
        return f"`{e.text()}`" if e.text() else ""
    bare = inner.strip()
    if not bare:
        return inner
    mark = {"strong": "**", "b": "**", "em": "_", "i": "_", "del": "~~", "s": "~~"}.get(e.name)
    if mark:
        return inner.replace(bare, f"{mark}{bare}{mark}", 1)
    if e.name == "a" and e.attrs.get("href"):
        return inner.replace(bare, f"[{bare}]({urljoin(base, e.attrs['href']) if base else e.attrs['href']})", 1)
    return inner


_BLOCKS = frozenset("p div section article main header footer aside nav ul ol li blockquote pre table figure figcaption h1 h2 h3 h4 h5 h6 hr dl dt dd body html".split())


def _markdown(e: Element, base: str | None, images: list[str]) -> list[str]:
    """Markdown blocks of an element."""
    if (tex := _math(e)) is not None:
        return [tex]
    if re.fullmatch("h[1-6]", e.name):
        words = "".join(_inline(c, base, images) for c in e.children).strip()
        return [f"{'#' * int(e.name[1])} {words}"] if words else []
    if e.name == "pre":
        code = next(select(e, "code"), None)
        lang = next((c.partition("-")[2] for c in (code or e).classes() if c.startswith(("language-", "lang-"))), "")
        return [f"```{lang}\n{e.text().strip(chr(10))}\n```"]
    if e.name == "hr":
        return ["---"]
    if e.name in ("ul", "ol"):
        lines = []
        for n, item in enumerate((c for c in e.children if isinstance(c, Element) and c.name == "li"), 1):
            inner = "\n".join(_flow(item, base, images))
            mark = "- " if e.name == "ul" else f"{n}. "
            lines.append(mark + inner.replace("\n", "\n" + " " * len(mark)))
        return ["\n".join(lines)] if lines else []
    if e.name == "blockquote":
        inner = "\n\n".join(_flow(e, base, images))
        return ["\n".join(f"> {x}".rstrip() for x in inner.split("\n"))] if inner else []
    if e.name == "table":
        rows = [["".join(_inline(c, base, images) for c in cell.children).strip() for cell in row.walk() if cell.name in ("td", "th")] for row in select(e, "tr")]
        rows = [r for r in rows if r]
        if not rows:
            return []
        width = max(map(len, rows))
        line = lambda r: "| " + " | ".join(r + [""] * (width - len(r))) + " |"
        return ["\n".join((line(rows[0]), "| " + " | ".join(["---"] * width) + " |", *map(line, rows[1:])))]
    return _flow(e, base, images)


def _flow(e: Element, base: str | None, images: list[str]) -> list[str]:
    """Blocks among an element's children; what stands between them are paragraphs."""
    out, run = [], []

    def close() -> None:
        words = re.sub(r" *\n *", "\n", "".join(run)).strip()
        run.clear()
        if words:
            out.append(words)

    for c in e.children:
        if isinstance(c, Element) and c.name in _BLOCKS:
            close()
            out.extend(_markdown(c, base, images))
        elif not isinstance(c, Element) or c.name not in UNSEEN:
            run.append(_inline(c, base, images))
    close()
    return out


def to_markdown(html: str, base: str | None = None) -> tuple[str, list[str]]:
    """(Markdown, image addresses in order) of a page or fragment."""
    images: list[str] = []
    root = parse(html)
    drop(root, (*UNSEEN, "head", "title"))
    return "\n\n".join(_flow(root, base, images)), images


def extracted(df: DataFrame, id_column: str, html: str, url: str, how: Callable[[str, str], tuple] = generic) -> DataFrame:
    """Fields of each page: id, title, author, published, updated, html, base_url, source_title.

    Null and blank pages have null fields; a null address is an empty one. Repeated rows give repeated
    results; an empty table gives none. Other columns are never read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *(how(h, u if isinstance(u, str) else "") if isinstance(h, str) and h.strip() else (None,) * len(FIELDS))) for i, h, u in zip(pdf["id"], pdf["html"], pdf["url"], strict=True)]
            yield pd.DataFrame(rows, columns=["id", *FIELDS])

    narrow = df.select(F.col(id_column).cast("long").alias("id"), F.col(html).alias("html"), F.col(url).alias("url"))
    return spread(narrow).mapInPandas(run, "id long, " + ", ".join(f"{f} string" for f in FIELDS))


def converted(df: DataFrame, id_column: str, html: str, base: str) -> DataFrame:
    """(id, markdown, images) of each page; null pages give the empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [to_markdown(h, b if isinstance(b, str) else None) if isinstance(h, str) else ("", []) for h, b in zip(pdf["html"], pdf["base"], strict=True)]
            yield pd.DataFrame({"id": pdf["id"], "markdown": [m for m, _ in done], "images": [i for _, i in done]})

    narrow = df.select(F.col(id_column).cast("long").alias("id"), F.col(html).alias("html"), F.col(base).alias("base"))
    return spread(narrow).mapInPandas(run, "id long, markdown string, images array<string>")


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _snapshots(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """The pages as a site of that kind serves them: its own places in front, filled from the page's title and id."""
    name, number = F.concat(F.lit("T "), _escaped(F.coalesce("title", F.lit(""))), F.lit(".")), F.col("page_id").cast("string")
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    front = {
        "zhihu": text('<meta name="author" content="A ', number, '"><meta itemprop="datePublished" content="2024-', number, '"><h1 class="Post-Title"> ', name, '</h1><div class="Post-RichText"><h3>', name, '</h3><p><a href="https://zhida.zhihu.com/search?zhida_source=entity">x</a></p><script>y</script></div>'),
        "medium": text("<title>", name, '</title><meta name="publish_date" content="2024-', number, '"><article><p>', name, '</p></article><a rel="author"> A ', number, " </a>"),
        "wechat": text('<h1 id="activity-name">', name, '</h1><b class="profile_nickname">A ', number, '</b><i id="publish_time">2024-', number, '</i><div id="js_content"><img data-src="https://a.example/', number, '.png"><p>', name, "</p></div>"),
    }
    return read_table(spark, sf_dir, "extracted_article", "page_id", "title", "url", "html", "baseUrl").withColumn("html", F.concat(front[kind], F.coalesce("html", F.lit(""))))


def _extract_snapshot(how: Callable[[str, str], tuple], kind: str):
    return lambda s, d: extracted(_snapshots(s, d, kind), "page_id", "html", "url", how).select("id", "title", "author", "published", "html")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "extracted_article", "page_id", "url", "html", "baseUrl")


def _extract(how: Callable[[str, str], tuple], *columns: str):
    return lambda s, d: extracted(_pages(s, d), "page_id", "html", "url", how).select("id", *columns)


def _strings(f: Callable[[str], str | None], front: tuple[str, str] | None = None):
    """A query of one string per page; ``front`` is put in front of it, with the page's id between its parts."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame({"page_id": pdf["page_id"], "value": [f(h) if isinstance(h, str) else None for h in pdf["html"]]})

        html = F.col("html") if front is None else F.concat(F.lit(front[0]), F.col("page_id").cast("string"), F.lit(front[1]), "html")
        return spread(_pages(spark, sf_dir).select("page_id", html.alias("html"))).mapInPandas(run, "page_id long, value string")

    return query


def _main_html(html: str) -> str | None:
    root = parse(html)
    drop(root, UNSEEN)
    main = main_element(root)
    return main.inner() if main else None


def _without_noise(html: str) -> str:
    root = parse(html)
    drop(root, NOISE)
    return root.inner()


def _with_math(html: str) -> str:
    root = parse(html)
    return "\n".join(filter(None, map(_math, root.walk())))


QUERIES = {
    "extract_generic": _extract(generic, *FIELDS),
    "extract_zhihu": _extract_snapshot(zhihu, "zhihu"),
    "page_keywords": _strings(lambda h: "|".join(keywords(h)), ('<meta name="Keywords" content="caches, k', '，caches">')),
    "extract_medium": _extract_snapshot(medium, "medium"),
    "extract_wechat": _extract_snapshot(wechat, "wechat"),
    "extract_main": _strings(_main_html),
    "agg_max_text": _strings(lambda h: (lambda e: str(len(e.text().strip())) if e else None)(main_element(parse(h)))),
    "strip_noise": _strings(_without_noise),
    "pick_first_text": _strings(lambda h: first_text(parse(h), ("main h1", "article h1", "h1", "h2"))),
    "pick_first_attr": _strings(lambda h: first_attribute(parse(h), ('meta[name="author"]', 'meta[property="article:published_time"]'), "content")),
    "zhihu_clean_html": _strings(clean_zhihu),
    "wechat_lazy_img": _strings(lambda h: (lambda r: (lazy_images(r), "|".join(e.attrs.get("src", "") for e in select(r, "img")))[1])(parse(h)), ('<img src="data:image/svg+xml,x" data-src="https://a.example/', '.png">')),
    "html_to_md": lambda s, d: converted(_pages(s, d), "page_id", "html", "baseUrl").select("id", "markdown", F.size("images").cast("long").alias("n_images")),
    "html_math": _strings(_with_math, ('<div class="ztext-math" data-tex="x_', '"></div><span class="ztext-math"> y </span>')),
    "html_text": _strings(lambda h: parse(h).text()),
    "html_has_class": _strings(lambda h: str(sum("byline" in e.classes() for e in parse(h).walk()))),
    "html_img_src": _strings(lambda h: "|".join(image_source(e.attrs, "https://base.example/") for e in select(parse(h), "img"))),
}
_ESCAPED = "replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_UNESCAPED = "replace(replace(replace(replace(replace({x}, '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&')"
_TITLED = """(select page_id, 'T ' || coalesce(title, '') || '.' as t, trim(regexp_replace(regexp_extract(x, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')) as h, trim(regexp_extract(x, '<meta name="author" content="([^"]*)"', 1)) as a, trim(regexp_extract(x, '<meta property="article:published_time" content="([^"]*)"', 1)) as d
 from (select page_id, title, regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g') as x from extracted_article))"""
ORACLE = {
    "html_has_class": "select page_id, cast(len(regexp_extract_all(html, 'class=\"byline\"')) as varchar) as value from extracted_article",
    "html_img_src": "select page_id, array_to_string(list_transform(regexp_extract_all(html, '<img src=\"([^\"]*)\"', 1), lambda x: 'https://base.example' || x), '|') as value from extracted_article",
    "pick_first_attr": "select page_id, coalesce(nullif(trim(replace(regexp_extract(html, '<meta name=\"author\" content=\"([^\"]*)\"', 1), '&amp;', '&')), ''), nullif(trim(regexp_extract(html, '<meta property=\"article:published_time\" content=\"([^\"]*)\"', 1)), '')) as value from extracted_article",
    "extract_zhihu": f"select page_id as id, t as title, 'A ' || page_id as author, '2024-' || page_id as published, '<h2>' || {_ESCAPED} || '</h2><p>x</p>' as html from {_TITLED}",
    "extract_medium": f"select page_id as id, coalesce(nullif(trim(h), ''), t) as title, coalesce(nullif(a, ''), 'A ' || page_id) as author, coalesce(nullif(d, ''), '2024-' || page_id) as published, '<p>' || {_ESCAPED} || '</p>' as html from {_TITLED}",
    "extract_wechat": f"select page_id as id, t as title, 'A ' || page_id as author, '2024-' || page_id as published, '<img data-src=\"https://a.example/' || page_id || '.png\" src=\"https://a.example/' || page_id || '.png\"><p>' || {_ESCAPED} || '</p>' as html from {_TITLED}",
    "page_keywords": "select page_id, 'caches|k' || page_id as value from extracted_article where html is not null",
    "html_math": "select page_id, '$$x_' || page_id || '$$' || chr(10) || '$y$' as value from extracted_article where html is not null",
    "wechat_lazy_img": "select page_id, concat_ws('|', 'https://a.example/' || page_id || '.png', nullif(array_to_string(regexp_extract_all(html, '<img src=\"([^\"]*)\"', 1), '|'), '')) as value from extracted_article",
    "html_text": f"select page_id, {_UNESCAPED.format(x='v')} as value from (select page_id, regexp_replace(html, '(?s)<!--.*?-->|<[^>]*>', '', 'g') as v from extracted_article)",
    "pick_first_text": f"select page_id, nullif(trim({_UNESCAPED.format(x='v')}, ' ' || chr(10)), '') as value from (select page_id, regexp_replace(coalesce(nullif(regexp_extract(x, '(?is)<h1[^>]*>(.*?)</h1>', 1), ''), regexp_extract(x, '(?is)<h2[^>]*>(.*?)</h2>', 1)), '<[^>]*>', '', 'g') as v from (select page_id, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') as x from extracted_article))",
}
