import pytest
from test_boilerplate import sample

from millrace.llm import exclude
from millrace.llm.boilerplate import fit
from millrace.llm.residue import PATTERNS, expanded, is_notice, residue_kind, without_code

PROSE = "The cache keeps its rows for long articles, and the parser is measured twice on every page that we read. "


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("Welcome back, {{ post.title }}, here is your summary.", "placeholder"),
        ("摘要：【在此填写摘要】", "placeholder"),
        ("Posted by [Your Name] today.", "placeholder"),
        ("By %AUTHOR_NAME% and @@BYLINE@@", "placeholder"),
        ("$TITLE$", "placeholder"),
        ("Last changed on XXXX年XX月XX日", "placeholder"),
        ("本文由YOUR_TITLE_HERE整理发布。", "placeholder"),
        ("欢迎阅读{0}，以下是本期内容。作者$TITLE$和%AUTHOR_NAME%。", "placeholder"),
        ("欢迎阅读{0}，以下是本期内容。", "placeholder"),
        ("[object Object]", "placeholder"),
        ("{0}", "placeholder"),
        ("404 Not Found. The page you asked for does not exist or has moved.", "error"),
        ("# A long and unrelated title about caches and parsers\n\n404 Not Found. The page you asked for does not exist or has moved.", "error"),
        ("该内容因违规已无法查看。\n\n归档 · 书单 · 活动 · 下载客户端", "error"),
        ("Your session has expired. Sign in again to go on reading.", "barrier"),
        ("You need to enable JavaScript to run this app.", "script"),
        ("Ｙｏｕ need to en​able JavaScript to run this app.", "script"),
        ("Your text goes here. Replace this paragraph with your own words.", "filler"),
        ("Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor.", "filler"),
        (PROSE, None),
        (PROSE * 3 + "The old theme shipped with lorem ipsum in the footer until somebody noticed.", None),
        (PROSE * 3 + "以前遇到“页面不存在”时读者会直接离开。", None),
        ("We log every 404 answer and compare it with the not found ones of last week in detail.", None),
        ("`{{ title }}` is replaced when the site is built. " + PROSE, None),
        ("```\n{{ title }}\n[Your Name]\n```\n" + PROSE, None),
        ("A link [text](url) and a set {a} and [[wiki]] and 5% of 10%.", None),
        ("$$\n\\frac{x}{2}\n$$\n" + PROSE, None),
        ("", None),
        (None, None),
    ],
)
def test_kinds(text, kind):
    assert residue_kind(without_code(text) if text else text) == kind


def test_notice():
    assert is_notice("访问过于频繁，请完成安全验证后继续。")
    assert not is_notice("Your text goes here.")


def test_markdown_rows(spark):
    rows = [(1, "{{a}}", "x"), (1, "{{a}}", "x"), (2, None, None), (3, "", "y"), (4, PROSE * 3000 + "{{a}}", None), (5, PROSE, "z")]
    df = spark.createDataFrame(rows, "article_id long, markdown string, kind string")
    got = sorted((r["id"], r["kind"]) for r in exclude.residue_in_markdown(df, "article_id", "markdown").collect())
    assert got == [(1, "placeholder"), (1, "placeholder"), (4, "placeholder")]
    assert exclude.residue_in_markdown(df.limit(0), "article_id", "markdown").count() == 0


def test_page_rows(spark):
    model = fit([sample(i) for i in range(60)])
    shell = '<body><div class="m"><div><a href="/">Home</a></div></div><div class="x2">{}</div><div class="x4"><h3>Comments (3)</h3><div>user3</div><p>' + PROSE + "</p></div></body>"
    pages = [shell.format("<h1>Oops! We could not find that page. Try the search box or go back home.</h1>"), sample(2), sample(2).replace("rows for", "{{pag<b>e.name</b>}} for", 1), shell.format("<p>ok</p><pre>{{ x }}</pre>"), None, "", "<noscript>You need to enable JavaScript to run this app.</noscript>"]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    got = {r["id"]: r["kind"] for r in exclude.residue_in_pages(df, "page_id", "html", model).collect()}
    assert got == {0: "error", 2: "placeholder"}


def test_query(spark, data):
    assert exclude.p7_found(spark, data).columns == ["tbl", "row_id"]
    assert exclude.p7_kinds(spark, data).count() > 0


# Notices that the patterns were written with.
WORDED = """
Oops! That page can't be found. It looks like nothing was found at this location. Maybe try a search?
The resource you are looking for has been removed, had its name changed, or is temporarily unavailable.
Sorry, the page you were looking for doesn't exist. You may have mistyped the address or the page may have moved.
We're sorry, but something went wrong. If you are the application owner check the logs for more information.
503 Service Unavailable. No server is available to handle this request.
Attention Required! Please complete the security check to access this site.
Please turn JavaScript on and reload the page.
Your browser does not support JavaScript or it is disabled. Please enable it to use this site.
You must be logged in to view this content.
HTTP Error 403. You are not authorized to view this page.
Access to this page has been denied because we believe you are using automation tools to browse the website.
Désolé, la page que vous recherchez n'existe pas ou a été déplacée.
Une erreur est survenue. Veuillez réessayer dans quelques instants.
JavaScript est désactivé dans votre navigateur. Activez-le pour continuer.
Connectez-vous pour lire la suite de cet article.
Die angeforderte Seite konnte nicht gefunden werden.
Leider ist ein Fehler aufgetreten. Bitte versuchen Sie es später erneut.
Für diese Seite muss JavaScript aktiviert sein.
Sie müssen sich anmelden, um diesen Inhalt zu sehen.
Lo sentimos, la página que buscas no existe o ha sido eliminada.
Se ha producido un error. Por favor, inténtalo de nuevo más tarde.
Debes habilitar JavaScript para usar esta página.
Debes iniciar sesión para ver este contenido.
对不起，您要找的页面不存在或已被移除。
网络出错了，请稍后重试。
您的浏览器不支持JavaScript，请启用后再试。
该文章已被删除，无法访问。
指定されたページが見つかりません。削除されたか、URLが変更された可能性があります。
エラーが発生しました。時間をおいて再度お試しください。
この内容を閲覧するにはログインが必要です。
JavaScriptが無効になっています。有効にしてください。
"""


def test_notices_of_the_patterns():
    lines = [x for x in WORDED.split("\n") if x]
    assert [x for x in lines if residue_kind(x) is None] == []


@pytest.mark.parametrize("pattern", [p for lines in PATTERNS.values() for p in lines.split("\n") if p])
def test_patterns_are_bounded(pattern):
    """A pattern's choices give tidy phrases, and not too many of them."""
    found = list(expanded(pattern))
    assert 1 <= len(found) <= 80_000
    assert all(x == x.lower().strip() and "  " not in x and "(" not in x and "|" not in x for x in found)


@pytest.mark.parametrize(
    "prose",
    [
        "We measured how often the page could not be found. When a link was stale, the crawler waited and then asked the next mirror for its copy.",
        "Our error page says that something went wrong, and most readers close it at once. This post explains how we made such pages rarer.",
        "Die Meldung, dass die Seite nicht gefunden wurde, kam bei alten Adressen. Seit dem Umbau leiten wir sie auf die neuen Adressen um.",
        "我们统计了页面不存在的次数。旧链接失效以后，爬虫会等待一段时间，再向下一个镜像索取副本。",
    ],
)
def test_prose_about_notices(prose):
    assert residue_kind(prose) is None
