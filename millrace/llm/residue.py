"""Template residue, filler, error pages, barriers and script-required notices.

A multi-pattern automaton holds the known phrases of all languages, and those that the sentence patterns
of each language give: subjects, verbs and manners of speech in all their combinations and is run once over a text in
its one form (look-alikes folded, lower case); placeholders are recognised by their notation. A text
is residue when it holds a placeholder outside code, or when the phrases cover most of it. Coverage
is measured against what is left after code, comments and lines of bare navigation, so prose that
quotes or mentions such a phrase stays. A text that is no known phrase but is made of the phrases' words for
the most part is a notice too. Filler vocabulary counts as covered where it comes in runs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.lookalikes import transducer
from millrace.sources import read_table

#: Share of a text that phrases must cover.
COVERAGE = 0.5
#: Share of a text in words of notices from which it is one in words of its own.
WORDED = 0.6
#: Letters of a word that isn't only a link between others.
LONG = 5

# Phrases by kind, lower case, in the form that the transducer gives; # is a run of digits.
PHRASES = {
    "error": """
# not found
page not found
the page you asked for does not exist or has moved
the page you requested could not be found
the page you are looking for does not exist
the requested url was not found on this server
we could not find that page
we can't find the page you're looking for
this page does not exist
this page could not be found
oops! we could not find that page
oops
try the search box or go back home
return to the home page
# internal server error
internal server error
# service temporarily unavailable
# service unavailable
the server cannot handle the request right now
the server is temporarily unable to service your request
# bad gateway
the upstream server closed the connection
# gateway timeout
# too many requests
slow down and try again in a few minutes
# forbidden
you do not have permission to view this resource
you don't have permission to access this page
access denied
error establishing a database connection
something went wrong on our side
something went wrong
please try again later
reference number #
this content has been removed by its author
this content is no longer available
this page has been removed
抱歉,您访问的内容找不到了
您访问的页面不存在
返回首页看看吧
返回首页
页面不存在
可能已被作者删除
该内容因违规已无法查看
该内容已被发布者删除
内容已被删除
服务器内部错误
错误编号#
系统繁忙
请稍后再试
页面找不到了
seite nicht gefunden
bitte prüfen sie die adresse
die seite existiert nicht
interner serverfehler
versuchen sie es später noch einmal
page introuvable
l'adresse est peut-être erronée
cette page n'existe pas
erreur interne du serveur
réessayez plus tard
veuillez réessayer plus tard
página no encontrada
revisa la dirección
esta página no existe
error interno del servidor
inténtalo más tarde
サーバーエラーが発生しました
しばらくしてからもう一度お試しください
お探しのページは見つかりませんでした
ページが見つかりません
""",
    "barrier": """
sign in to view the full text
sign in to continue
log in to continue reading
please log in
your session has expired
sign in again to go on reading
please verify that you are human by ticking the box below
please verify that you are human
verify you are human
checking your browser before you continue
this may take a few seconds
subscribe to continue reading
complete the captcha
访问过于频繁
请完成安全验证后继续
请完成安全验证
登录已过期
请重新登录后继续阅读
请登录后查看
ihre sitzung ist abgelaufen
bitte melden sie sich an
votre session a expiré
veuillez vous connecter
tu sesión ha caducado
inicia sesión para continuar
セッションの有効期限が切れました
ログインしてください
""",
    "script": """
you need to enable javascript to run this app
this page needs javascript
please switch it on in your browser and reload
please enable javascript
please enable javascript to continue
enable javascript and cookies to continue
javascript is required
javascript is disabled in your browser
this site requires javascript
loading
if nothing appears, scripts may be blocked by an extension
您的浏览器禁用了脚本
无法显示正文
请开启浏览器脚本功能后刷新页面
请启用javascript
正在加载
请稍候
bitte aktivieren sie javascript, um diese seite zu sehen
bitte aktivieren sie javascript
veuillez activer javascript pour afficher cette page
veuillez activer javascript
activa javascript en tu navegador para ver esta página
activa javascript
このページを表示するにはスクリプトを有効にしてください
javascriptを有効にしてください
""",
    "filler": """
your text goes here
replace this paragraph with your own words
this is placeholder copy for the first section
this is placeholder copy
this is placeholder text
sample heading
sample text
type something about your project in this block
click here to edit this text
add your text here
insert your text here
此处填写正文
默认段落文本
请编辑
这里是示例文字
请替换为您的内容
在此处输入文字
hier steht ihr text
dies ist ein beispieltext
dies ist ein platzhaltertext
ersetzen sie diesen text
votre texte ici
ceci est un texte d'exemple
texte d'exemple
remplacez ce texte
escriba su texto aquí
su texto va aquí
este es un texto de ejemplo
texto de ejemplo
reemplace este texto
ここにテキストを入力してください
ここに本文を入力
これはサンプルテキストです
ダミーテキスト
サンプルテキスト
""",
}
#: Sentence patterns by kind and language: (a|b|) is a choice, the empty one leaves the part out; ~ divides
#: a sentence into phrases that are found each by itself.
PATTERNS = {
    "error": """
(sorry, but|we're sorry, but|we are sorry, but|oops! sorry) ~ (the|this|that) (page|site|article|post|content|document|file|resource|address|url|link|item) (you requested|you are looking for|you're looking for|you were looking for|you asked for|you tried to open|requested|) ~ (could not be found|couldn't be found|cannot be found|can't be found|was not found|is not found|does not exist|doesn't exist|no longer exists|does not exist anymore|is not available|isn't available|is no longer available|is unavailable|is temporarily unavailable|is currently unavailable|has been removed|has been deleted|has been moved|has moved|may have been removed|may have been deleted|may have been moved|may have moved|might have been removed|might have been deleted|might have been moved)
(page|file|document|article|resource) (not found|unavailable|no longer available|does not exist)
(has been|was|may have been|might have been|had its name|is) (removed|deleted|moved|renamed|changed|temporarily unavailable|no longer available)
(it looks like |) nothing (was found|could be found) (at this location|here)
(maybe|please|you can|) (try|use) (a|the|our) (search|search box|search form)
you may have (mistyped|followed a broken link to|typed) the (address|page|url) (incorrectly|)
(please |) (check|verify) the (address|url|link|spelling) (and try again|)
(we're sorry, |sorry, |oops! |) (but |) (something went wrong|an error occurred|an error has occurred|an unexpected error occurred|there was an error|there was a problem|we have encountered an error|we encountered an error|we ran into a problem)
(if you are the application owner |) check the logs for more information
(no server is|the server is|the service is) (available|unable|not able|temporarily unable|currently unable|unavailable|overloaded|down) (to handle|to complete|to process|to service|) (this request|your request|the request|)
(please |) (try again|come back|check back|reload the page|refresh the page) (later|soon|in a few minutes|in a moment|shortly|)
(http |) (error #|# error|status #)
(you are not authorized|you are not allowed|you are not permitted|you do not have permission|you don't have permission) to (view|access|see|open) (this|the) (page|content|resource|site)
access to this (page|site|resource) (has been |is |was |) (denied|forbidden|blocked)
(we believe |) you are using automation tools to browse (the|this) (website|site)
(return|go back|back) to (the|our|) (home page|homepage|start page|front page)
(die|diese) (angeforderte |gesuchte |aufgerufene |gewünschte |) (seite|datei|adresse|url) (konnte nicht gefunden werden|wurde nicht gefunden|existiert nicht|existiert nicht mehr|ist nicht verfügbar|ist nicht mehr verfügbar|wurde gelöscht|wurde entfernt|wurde verschoben|ist nicht erreichbar)
(leider |) (ist|ist leider) ein (unerwarteter |) fehler aufgetreten
(leider |) (wurde|konnte) (diese|die) seite nicht (gefunden|gefunden werden)
(bitte |) (versuchen sie es|versuche es|probieren sie es) (später|in einigen minuten|in kürze|) (erneut|noch einmal|wieder|)
(zurück |) zur startseite
(der |dieser |) (inhalt|artikel|beitrag) (ist nicht mehr verfügbar|wurde gelöscht|wurde entfernt|existiert nicht mehr)
(désolé, |oups ! |) (la|cette) page (que vous recherchez|que vous cherchez|que vous avez demandée|demandée|) (n'existe pas|n'existe plus|est introuvable|n'a pas été trouvée|n'est pas disponible|n'est plus disponible|a été supprimée|a été déplacée)
(ou |) a été (déplacée|supprimée|retirée|supprimé|retiré|déplacé)
une erreur (inattendue |) (est survenue|s'est produite)
(veuillez |merci de |) (réessayer|réessayez) (plus tard|dans quelques instants|dans quelques minutes|ultérieurement|)
(retour|retourner|revenir) à (l'accueil|la page d'accueil)
(ce|cet|le) (contenu|article) (n'est plus disponible|n'existe plus|a été supprimé|a été retiré)
(lo sentimos, |vaya, |) (la|esta) página (que buscas|que busca|que está buscando|que estás buscando|solicitada|que ha solicitado|) (no existe|ya no existe|no se encuentra|no se ha encontrado|no fue encontrada|no está disponible|ya no está disponible|ha sido eliminada|ha sido movida)
(o |) (ha sido|fue) (eliminada|movida|borrada|retirada|eliminado|borrado)
(se ha producido|se produjo|ha ocurrido|ocurrió) un error (inesperado|)
(por favor, |) (inténtalo|inténtelo|intente|intenta|vuelve a intentarlo|vuelva a intentarlo) (de nuevo |otra vez |) (más tarde|en unos minutos|)
volver (al inicio|a la página de inicio|a la portada)
(este|el) (contenido|artículo) (ya no está disponible|ya no existe|ha sido eliminado|fue eliminado)
(对不起,|抱歉,|很抱歉,|) (您|你|) (要找的|访问的|请求的|查看的|要访问的|所访问的|) (页面|网页|内容|文章|链接) ~ (不存在|找不到了|找不到|无法找到|已被删除|已被移除|已删除|已失效|已不存在|无法访问) (或已被移除|或已被删除|或已移动|)
(该|此|本) (内容|文章|页面|帖子|网页) ~ (已被|已经被|已|) (作者|发布者|管理员|) (删除|移除|下架|屏蔽|隐藏)
(网络|服务器|系统|页面|) (出错了|发生错误|出现错误|开小差了|异常|繁忙)
(请|) (稍后|稍候) (重试|再试|再试一次|访问)
(返回|回到) (首页|主页|上一页)
(お探しの|指定された|ご指定の|要求された|アクセスしようとした) (ページ|記事|コンテンツ|url) (は|が) (見つかりません|見つかりませんでした|存在しません|削除されました|移動しました)
(削除された|移動した|urlが変更された) (か、|) (可能性があります|おそれがあります)
(削除されたか、|) (urlが変更された|移動した|名前が変更された) 可能性があります
(予期しない|予期せぬ|) エラーが発生しました
(時間をおいて|しばらく経ってから|しばらくしてから|後ほど|) (再度|もう一度) (お試しください|アクセスしてください)
(この|) (ページ|記事|コンテンツ) は (存在しません|削除されました|公開を終了しました|現在ご利用いただけません)
(トップページ|ホーム) (へ|に) 戻る
(sorry, |whoops, |) (looks like |) something went wrong
(this|your) (account|site|domain|page) (has been|is) (suspended|disabled|blocked|deactivated|parked)
(contact|please contact) (your|the) (hosting provider|administrator|site owner|system administrator|webmaster|support team) (for more information|for assistance|for help|if this persists|)
(sorry, |) (you have|you've) been blocked
you (are unable|are not able|do not have permission|don't have permission|are not allowed) to (access|view|open) (this|the|that) (website|site|page|resource)
(this|that) (site|page|website) (can't|cannot|could not) be (reached|opened|displayed|loaded)
the connection (was|has been) (reset|refused|closed|interrupted|timed out)
(the page|this page|it) isn't redirecting properly
(bad request|invalid url|invalid request|gateway timeout|request timeout|method not allowed)
(that's|this is) an error
that's all we know
(down for maintenance|under maintenance|scheduled maintenance|under construction|maintenance mode|performing maintenance|undergoing maintenance)
(we are|we're|the site is|this site is) (currently |) (down for maintenance|under maintenance|performing maintenance|undergoing maintenance|performing scheduled maintenance)
(we'll|we will) be back (soon|shortly|online soon|)
(zugriff|zugang) (verweigert|gesperrt|nicht erlaubt)
sie haben keine (berechtigung|rechte), (diese seite|diesen inhalt) (aufzurufen|anzuzeigen|zu sehen)
der (server|dienst) ist (derzeit |zurzeit |momentan |) (nicht erreichbar|nicht verfügbar|überlastet)
(bitte |) (später|in kürze) (nochmals|noch einmal|erneut|wieder) (versuchen|probieren)
(wartungsarbeiten|wartungsmodus)
(wir sind|die seite ist) (bald|gleich|in kürze) (wieder da|wieder erreichbar|wieder online)
accès (refusé|interdit)
vous n'avez pas (l'autorisation|la permission|le droit) d'accéder à (cette page|ce contenu|ce site)
(la page demandée|la page|cette page) est introuvable
vérifiez l'adresse (saisie|)
le (serveur|service) est (temporairement |actuellement |) (indisponible|inaccessible|surchargé)
(site en maintenance|maintenance en cours|en cours de maintenance)
(acceso denegado|acceso restringido|acceso prohibido)
no (tienes|tiene) (permiso|permisos|autorización) para (ver|acceder a) (esta página|este contenido|este sitio)
no (encontramos|hemos encontrado|pudimos encontrar|se ha podido encontrar) la página (que buscas|que busca|solicitada|)
el (servidor|servicio) no está disponible
(sitio en mantenimiento|en mantenimiento|estamos en mantenimiento)
(页面|网页|文件|内容) (未找到|不存在|无法显示|加载失败)
(请|) (检查|确认|核对) (网址|地址|链接|网络) (是否正确|是否有误|连接|设置|)
(系统|网站|服务器) (维护中|正在维护|升级中|暂停服务)
(暂时|目前|当前) (无法访问|无法使用|不可用)
(没有|无) (权限|权限访问|权限查看)
(拒绝访问|访问被拒绝|禁止访问)
ページ (が|を) (表示できません|表示できませんでした|開けません)
url (を|が) (ご確認ください|間違っている可能性があります|確認してください)
(現在|ただいま) (メンテナンス中です|工事中です|アクセスできません|混み合っています)
(しばらく|少々) お待ちください
(アクセスが拒否されました|アクセス権限がありません|閲覧権限がありません)
""",
    "barrier": """
(you must|you need to|you have to|please) (be logged in|be signed in|log in|login|sign in|subscribe|register) to (view|read|see|access|continue|continue reading|go on reading) ~ (this|the|) (content|article|page|full article|full text|)
(please |) (complete|pass|solve) the (security check|captcha|verification) to (continue|proceed|access this site|access this page)
(attention required|security check|just a moment)
(please |) (confirm|prove|verify) (that |) you are (a human|human|not a robot)
(sie müssen sich|bitte) (anmelden|einloggen|registrieren) (, um diesen inhalt zu sehen|, um fortzufahren|, um weiterzulesen|, um diesen artikel zu lesen|)
(melden sie sich an|loggen sie sich ein) (, um weiterzulesen|, um fortzufahren|)
(bitte |) (bestätigen sie|beweisen sie) (, |)dass sie (kein roboter|ein mensch) sind
(connectez-vous|abonnez-vous|inscrivez-vous|identifiez-vous) pour (lire|voir|continuer|accéder à) (la suite|cet article|ce contenu|cette page|) (de cet article|)
(vous devez|veuillez) (être connecté|vous connecter|vous abonner|vous identifier) (pour continuer|pour voir ce contenu|pour lire la suite|pour accéder à cette page|)
(debes|debe|necesitas|tienes que|por favor,) (iniciar sesión|inicia sesión|registrarte|registrarse|suscribirte) para (ver|leer|continuar|acceder a) (este contenido|este artículo|esta página|leyendo|)
(请先|请|您需要|需要) (登录|登陆|注册|登录账号) (后|) (查看|阅读|继续阅读|访问|继续) (全文|内容|更多|)
(请|) (完成|通过) (安全|人机|) 验证 (后继续|后访问|)
(この|) (内容|記事|ページ|コンテンツ|続き) を (閲覧|見る|読む|表示する|閲覧する) (には|ためには|に) (ログイン|会員登録|登録) (が必要です|してください)
ロボットではないことを確認してください
(your |the |) session (has |) (timed out|expired|ended|is no longer valid)
(please |) (log in|login|sign in) again (to continue|)
are you a (robot|human|bot)
(click|tick|check) the box (below |) to (let us know|confirm|prove|show) (that |) you (are|'re) not a (robot|bot)
(this|the rest of this) (article|content|story|page) is (for|only for|available to|only available to|reserved for) (subscribers|members|registered users|paying subscribers) (only|)
(already a subscriber|already have an account|not a member yet)
(nur für abonnenten|nur für mitglieder|nur für registrierte nutzer)
(réservé aux abonnés|réservé aux membres)
(solo para suscriptores|solo para miembros|exclusivo para suscriptores)
(会员专享|仅限会员|仅会员可见|付费内容|登录可见)
(会員限定|有料会員限定|会員専用)
""",
    "script": """
(please |) (turn|switch) (javascript|scripts) on (in your browser|) (and|, then) (reload|refresh) (the page|this page|)
(please |) (enable|activate|allow|turn on|switch on) (javascript|scripts|it|javascript and cookies) (in your browser|in your browser settings|) ~ (to use this site|to view this page|to view this site|to continue|to proceed|to use this app|and reload the page|and reload|and try again|)
(your browser does not support|your browser doesn't support|this browser does not support) (javascript|scripts) (or it is disabled|or it has been disabled|)
(this page|this site|this website|this app|this application|our site) (requires|needs|works best with|relies on|depends on) (javascript|scripts) (to work|to function|to run|to be enabled|enabled|)
(javascript|scripting) (is|has been|must be|needs to be|seems to be|appears to be) (disabled|enabled|turned off|switched off|turned on|required|blocked) (in your browser|to view this page|to use this site|)
(für diese seite|für diese website|für diesen inhalt) muss javascript (aktiviert|eingeschaltet) (sein|werden)
(diese seite|diese website|diese anwendung) (benötigt|braucht|erfordert) javascript
(bitte |) (aktivieren sie|schalten sie|aktiviere|erlauben sie) javascript (ein |) (in ihrem browser|) (und laden sie die seite neu|, um fortzufahren|)
javascript ist (in ihrem browser |) (deaktiviert|ausgeschaltet|nicht aktiviert)
javascript (est désactivé|n'est pas activé|doit être activé|est nécessaire|est requis) (dans votre navigateur|pour afficher cette page|pour continuer|)
(veuillez |) (activez|activer|autorisez) (-le|javascript) (dans votre navigateur|) (pour continuer|pour afficher cette page|et rechargez la page|)
(ce site|cette page|cette application) (nécessite|requiert|a besoin de) javascript
(debes|debe|necesitas|es necesario|por favor,) (habilitar|activar|habilita|activa) javascript (en tu navegador|en su navegador|) (para usar esta página|para ver esta página|para continuar|)
javascript está (desactivado|deshabilitado) (en tu navegador|en su navegador|)
(esta página|este sitio) (requiere|necesita) javascript
(您的|你的|) 浏览器 (不支持|未启用|禁用了|已禁用|没有启用) (javascript|脚本)
(请|) (启用|开启|打开|允许) (浏览器的|) (javascript|脚本|它) (功能|) (后重试|后刷新|后再试|并刷新页面|后刷新页面|后继续|)
(请|) 启用后 (再试|重试|刷新)
(本|此|该) (页面|网站|应用) 需要 (启用|) (javascript|脚本)
javascript (が|を) (無効になっています|有効にしてください|オンにしてください|必要です)
(このページ|このサイト|本サイト) (は|の表示には|の利用には|をご利用になるには) javascript (が必要です|を有効にしてください|を使用しています)
(有効にして|オンにして) (ください|から再度お試しください)
you need javascript (enabled|turned on|) to (see|view|use|read) (the|this) (page|site|content)
(we use cookies|cookies must be enabled|cookies are required)
""",
    "filler": """
(this is|here is|here goes) (a|some|an|) (sample|example|dummy|placeholder|demo|filler) (text|copy|paragraph|heading|content|page|post)
(your|the) (text|content|title|heading|headline|copy|description|summary) (goes|comes|will go|will appear) here
(replace|edit|change|delete|update) this (text|paragraph|copy|content|block|section|sentence) (with your own (words|text|content)|and start writing|)
(click|tap|double-click) (here|) to (edit|add|change|replace) (this|your|) (text|content|title|paragraph)
(add|insert|enter|type|write|put) your (own |) (text|content|title|description|copy|story) here
(hier|an dieser stelle) (steht|folgt|kommt|erscheint) (ihr|der|dein) (text|inhalt|titel)
(das ist|dies ist) (ein|nur ein) (beispieltext|platzhaltertext|blindtext|mustertext|platzhalter)
(ersetzen|bearbeiten|ändern) sie diesen (text|absatz|inhalt)
(ceci|ce texte) est (un|du) (texte d'exemple|texte fictif|faux texte|texte de remplissage|exemple)
(saisissez|insérez|écrivez|ajoutez) votre (texte|contenu|titre) ici
(este|esto) es un (texto de ejemplo|texto de prueba|texto de relleno|ejemplo)
(escribe|escriba|inserta|inserte|añade|añada) (tu|su) (texto|contenido|título) aquí
(在此|在这里|此处|请在此) (输入|填写|编辑|添加|插入) (您的|你的|) (文字|内容|正文|标题|文本)
(这是|这里是) (一段|) (示例|占位|测试|样例) (文字|文本|内容|段落)
(ここに|こちらに) (本文|テキスト|文章|内容|タイトル) (を入力|を入力します|を入力してください|が入ります)
(これは|この文章は) (サンプル|ダミー|仮の|テスト) (テキスト|文章) です
""",
}
_CHOICE = re.compile(r"\(([^()]*)\)")
_BESIDE_WIDE = re.compile(r" *([぀-ヿ㐀-鿿]) *")
#: The vocabulary of the common Latin filler text.
FILLER_WORDS = frozenset(
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua "
    "enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate "
    "velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
#: Latin filler words of several letters, of which a run must hold some: short ones are words of other languages too.
FILLER_LONG = frozenset(w for w in FILLER_WORDS if len(w) > 4) | {"amet", "elit", "nisi"}

_INNER = r"[^{}<>\n]{1,60}?"
#: Notations of unfilled placeholders.
PLACEHOLDER = re.compile(
    "|".join(
        (
            rf"\{{\{{[#/^&>!]?\s*{_INNER}\}}\}}",  # {{ name }}
            r"\{%-?\s*[^%{}\n]{1,80}?-?%\}",  # {% tag %}
            rf"\$\{{{_INNER}\}}",  # ${name}
            rf"#\{{{_INNER}\}}",  # #{name}
            r"<%[=-]?\s*[^%<>\n]{1,60}?%>",  # <%= name %>
            r"%%[A-Z][A-Z0-9_]{1,40}%%",  # %%NAME%%
            r"(?<![A-Za-z0-9_%])%[A-Z][A-Z0-9_]{3,40}%(?![A-Za-z0-9_%])",  # %NAME%
            r"@@[A-Z][A-Z0-9_]{1,40}@@",  # @@NAME@@
            r"(?<![A-Za-z0-9_$])\$[A-Z][A-Z0-9_]{2,40}\$(?![A-Za-z0-9_$])",  # $NAME$
            r"\[\[[A-Z][A-Z0-9_]{1,40}\]\](?!\()",  # [[NAME]]
            r"(?<![A-Za-z0-9])__[A-Z][A-Z0-9_]{1,40}?__(?![A-Za-z0-9])",  # __NAME__
            r"(?<![A-Za-z0-9_])(?:YOUR|INSERT|ADD|ENTER)_[A-Z0-9_]{2,40}(?![A-Za-z0-9])",  # YOUR_NAME_HERE
            r"\[(?:Your|Insert|Enter|Add|Ihr|Ihre|Votre|Su|Tu|TODO|TBD|FIXME|Hier|Ici|Aquí)\b[^\[\]\n]{0,60}\](?!\()",  # [Your Name]
            r"[【\[](?:在此|此处|请在此|请输入|待填写|ここに)[^】\]\n]{0,40}[】\]]",  # 【在此填写摘要】
            r"[<‹][a-z][a-z ]{2,60} (?:goes )?here[>›]",  # <lead paragraph goes here>
            r"X{4}年X{1,2}月X{1,2}日",
            r"\[object Object\]",
            r"(?<![A-Za-z0-9_{}\\^])\{\d\}(?![A-Za-z0-9_{}])",  # {0}
        )
    )
)
_FENCE = re.compile(r"^[ \t]{0,3}(```+|~~~+)[^\n]*\n.*?(?:^[ \t]{0,3}\1[`~]*[ \t]*$|\Z)", re.DOTALL | re.MULTILINE)
_MATH = re.compile(r"\$\$.*?\$\$", re.DOTALL)
_INLINE_CODE = re.compile(r"(`+)(?!`)(?:(?!\n\n).)+?(?<!`)\1(?!`)", re.DOTALL)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.DOTALL)
_HIDDEN = re.compile(r"<(pre|code|noscript|script|style|template)\b[^>]*>.*?</\1\s*>", re.DOTALL | re.IGNORECASE)
_FRONT = re.compile(r"\A---\n.*?\n---[ \t]*(?:\n|\Z)", re.DOTALL)
_DIGITS = re.compile(r"\d+")
_NAVIGATION = re.compile(r"^[^\n.。!?！？]{1,40}(?:[ \t]*[·|•›»][ \t]*[^\n.。!?！？·|•›»]{1,40}){2,}$", re.MULTILINE)
_HEADING = re.compile(r"^[ \t]{0,3}#{1,6}(?=[ \t]).*$", re.MULTILINE)
_PLACEHOLDER_SIGNS = ("{", "%", "[", "【", "$", "@@", "_", "<", "XXXX")
_SIGNS = re.compile(r"[\W_]+")
_WORDS = re.compile(r"[^\W\d_]+|\d+")


def expanded(pattern: str) -> Iterator[str]:
    """All sentences of a pattern; scripts without spaces have none beside their letters."""
    m = _CHOICE.search(pattern)
    if m is None:
        yield _BESIDE_WIDE.sub(r"\1", " ".join(pattern.split())).replace(" ,", ",").replace(" -", "-")
        return
    for choice in m[1].split("|"):
        yield from expanded(f"{pattern[: m.start()]}{choice}{pattern[m.end() :]}")


def phrases() -> Iterator[tuple[str, str]]:
    """(kind, phrase) of the listed phrases and of those that the patterns give."""
    for kind, lines in PHRASES.items():
        for phrase in filter(None, lines.split("\n")):
            yield kind, phrase
    for kind, lines in PATTERNS.items():
        for pattern in filter(None, lines.split("\n")):
            for phrase in chain.from_iterable(map(expanded, pattern.split("~"))):
                if len(phrase) >= (4 if _BESIDE_WIDE.search(phrase) else 9):  # shorter ones are words of any text
                    yield kind, phrase


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Compiled phrases; the value of each is (length, kind)."""
    a = ahocorasick.Automaton()
    form = transducer().apply
    for kind, phrase in phrases():
        folded = form(phrase).replace("#", "0")
        if folded not in a:
            a.add_word(folded, (len(folded), kind))
    a.make_automaton()
    return a


class Vocabulary:
    """The words of all notices: a text that is made of them for the most part is one, however it is worded."""

    def __init__(self) -> None:
        self.words, self.pairs = set(), set()
        for kind, phrase in phrases():
            if kind != "filler":
                for w in _WORDS.findall(phrase):
                    if w[0] > "぀":
                        self.pairs.update(map("".join, zip(w, w[1:], strict=False)))
                    else:
                        self.words.add(w)
        self.signs = frozenset("".join(self.pairs))
        self.tokens = frozenset(w + end for w in self.words for end in ("", ".", ",", "!", "?", ":", ";"))

    def mostly(self, folded: str) -> bool:
        """A quick test that no text of notice words fails: half of its words, or of its letters where there are no spaces."""
        words = folded.split()
        if 2 * sum(map(self.tokens.__contains__, words)) >= len(words) > 0:
            return True
        return not folded.isascii() and 2 * sum(map(self.signs.__contains__, folded)) >= len(folded)

    def share(self, folded: str) -> float:
        """Share of the text's letters in known words, one of them a longer one; of letters without spaces, in known pairs."""
        known = total = longest = 0
        for w in _WORDS.findall(folded):
            if w[0] > "぀":
                total += len(w) - 1
                found = sum(pair in self.pairs for pair in map("".join, zip(w, w[1:], strict=False)))
                known, longest = known + found, max(longest, LONG if found else 0)
            else:
                total += len(w)
                if w in self.words:
                    known, longest = known + len(w), max(longest, len(w))
        return known / total if longest >= LONG else 0.0


@lru_cache(maxsize=1)
def vocabulary() -> Vocabulary:
    return Vocabulary()


def without_code(markdown: str) -> str:
    """``markdown`` without fenced and inline code, formulas, comments, hidden elements and front matter."""
    text = markdown
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    if "$$" in text:
        text = _MATH.sub(" ", text)
    if "`" in text:
        text = _INLINE_CODE.sub(" ", text)
    if "<" in text:
        text = _HIDDEN.sub(" ", _COMMENT.sub(" ", text))
    return _FRONT.sub("", text, count=1) if text.startswith("---") else text


def _hits(folded: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the phrases in ``folded``; a phrase ends at word ends, where its script has such."""
    spans, last = [], len(folded)
    for end, (length, kind) in automaton().iter(folded):
        start, after = end - length + 1, end + 1
        cut_before = start and folded[start - 1].isalnum() and folded[start - 1].isascii() and folded[start].isascii() and folded[start].isalnum()
        cut_after = after < last and folded[after].isalnum() and folded[after].isascii() and folded[end].isascii() and folded[end].isalnum()
        if not cut_before and not cut_after:
            spans.append((start, after, kind))
    return spans


def _letters(text: str) -> int:
    return len(_SIGNS.sub("", text))


def _latin_filler(folded: str) -> int:
    """Letters in runs of at least six filler words, one in three of them long."""
    covered = run = letters = long = 0
    for w in _WORDS.findall(folded):
        if w in FILLER_WORDS:
            run, letters, long = run + 1, letters + len(w), long + (w in FILLER_LONG)
        else:
            if run >= 6 and 3 * long >= run:
                covered += letters
            run = letters = long = 0
    return covered + (letters if run >= 6 and 3 * long >= run else 0)


def coverage(form: str) -> dict[str, float]:
    """Share of letters and digits that each kind of phrase covers; {} where nothing is covered.

    ``form`` is in the one form. Headings and lines of navigation are left out, unless nothing else is there.
    """
    folded = _DIGITS.sub("0", form.lower())
    spans = _hits(folded)
    latin = any(w in folded for w in ("ipsum", "lorem", "dolor", "pariatur", "consectetur", "adipiscing"))
    worded = vocabulary().mostly(folded)
    if not spans and not latin and not worded:
        return {}
    bare = folded
    if "\n" in folded or "·" in folded:
        bare = _HEADING.sub("", _NAVIGATION.sub("", folded))
        if bare != folded:
            if _letters(bare):
                folded, spans = bare, _hits(bare)
    size = _letters(folded)
    if not size:
        return {}
    out: dict[str, float] = {}
    until = 0
    for start, end, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        start = max(start, until)
        if start < end:
            out[kind] = out.get(kind, 0.0) + _letters(folded[start:end]) / size
            until = end
    if latin:
        out["filler"] = out.get("filler", 0.0) + _latin_filler(folded) / size
    if worded and sum(out.values()) < COVERAGE and (share := vocabulary().share(folded)) >= WORDED:
        kind = "script" if "javascript" in folded else max(out, key=out.get, default="error")
        out[kind] = out.get(kind, 0.0) + share
    return out


def is_notice(text: str) -> bool:
    """Error page, barrier or script-required notice in place of content."""
    shares = coverage(transducer().form(text))
    return sum(shares.get(k, 0.0) for k in ("error", "barrier", "script")) >= COVERAGE


def has_placeholder(form: str) -> bool:
    """``form`` (in the one form, without code) holds an unfilled placeholder."""
    return any(sign in form for sign in _PLACEHOLDER_SIGNS) and PLACEHOLDER.search(form) is not None


def residue_kind(text: str | None) -> str | None:
    """placeholder, error, barrier, script or filler, or None; ``text`` holds no code any more."""
    if not text:
        return None
    form = transducer().form(text)
    if has_placeholder(form):
        return "placeholder"
    shares = coverage(form)
    return max(shares, key=shares.get) if sum(shares.values()) >= COVERAGE else None
