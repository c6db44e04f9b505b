"""Code blocks: languages, fence attributes, redaction of secrets in values."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import js_trim

# Signs of each language, in order of priority; ties go to the first.
LANGUAGE_SIGNS = {
    "python": (r"\bdef\s+\w+\s*\(", r"\bclass\s+\w+", r"\bimport\s+\w+", r"\bfrom\s+\w+\s+import", r"\b(elif|async|await)\b", r"__init__"),
    "bash": (r"\b(echo|cd|ls|mkdir|rm|cp|mv|grep|sed|awk|cat|chmod|chown)\s", r"\$\{?\w+\}?", r"\bif\s+\[\[", r"\bthen\b", r"\bfi\b", r"\bdo\b.*\bdone\b"),
    "yaml": (r"(?m)^name:\s*.+$", r"(?m)^on:\s*$", r"(?m)^\s{2,}(runs?-on|steps|uses|with|env|if):", r"(?m)^\w+:\s*$", r"(?m)^\s{2,}-\s+\w+:", r"(?m)^\s{2,}\w+:\s+[^#\n]+$"),
    "dockerfile": (r"(?m)^FROM\s+", r"(?m)^RUN\s+", r"(?m)^COPY\s+", r"(?m)^ADD\s+", r"(?m)^WORKDIR\s+", r"(?m)^ENV\s+", r"(?m)^EXPOSE\s+", r"(?m)^CMD\s+", r"(?m)^ENTRYPOINT\s+"),
    "json": (r"^\s*\{", r"^\s*\[", r'"\w+":\s*[{\["]'),
    "cpp": (r'(?m)^#include\s*[<"]', r"\bstd::", r"\b(namespace|template|typename|class|public|private|protected)\b", r"\b(vector|string|map|set|unique_ptr|shared_ptr)<\w+>", r"\bcout\s*<<|cin\s*>>", r"::\w+"),
    "c": (r'(?m)^#include\s*[<"]', r"\b(int|char|float|double|void|long|short|unsigned)\s+\w+\s*[=;(]", r"\bprintf\s*\(", r"\bscanf\s*\(", r"\bmalloc\s*\(", r"\bfree\s*\("),
}
# Short names of languages.
ALIASES = {"js": "javascript", "ts": "typescript", "tsx": "tsx", "jsx": "jsx", "py": "python", "sh": "bash", "shell": "bash", "md": "markdown", "yml": "yaml", "cplusplus": "cpp"}
# Names of languages that a highlighter knows.
KNOWN = tuple(
    """
    ada apex applescript asm astro awk bash bat bicep c clojure cmake cobol coffee common-lisp cpp crystal csharp css csv cypher d dart diff docker dockerfile
    elixir elm erb erlang fish fsharp gherkin gleam glsl go graphql groovy haml handlebars haskell hcl html http ini java javascript jinja json json5 jsonc
    jsx julia kotlin latex less liquid log lua make markdown matlab mdx mermaid nginx nim nix objective-c ocaml pascal perl php powershell prisma prolog proto
    pug puppet purescript python r racket raku ruby rust sas sass scala scheme scss shellscript smalltalk solidity sparql sql stylus svelte swift
    system-verilog terraform tex toml tsx turtle twig typescript v vb verilog vhdl viml vue wasm wgsl xml xsl yaml zig
    """.split()
)
# Words that mark a field as sensitive.
SENSITIVE = ("token", "secret", "cookie", "authorization", "password", "passwd", "pwd", "apikey", "api_key", "access_token", "refresh_token", "session", "auth")
REDACTED = "[REDACTED]"
# Interpreters of a block's first line; what makes a CI workflow; a fence's attributes; secrets inside values.
SHEBANGS = {"python": r"(?i)^#!\s*/.*python[23]?", "bash": r"(?i)^#!\s*/(bin/)?(ba)?sh"}
WORKFLOW_HEAD = (r"^name:\s*.+$", r"^on:\s*$", r"^on:\s+\[")
WORKFLOW_BODY = (r"^jobs:\s*$", r"^\s+steps:\s*$")
META_TITLE, META_LINES, META_OFF = r"(?i)(?:title|file|filename)=(\"[^\"]+\"|'[^']+'|\S+)", r"\{([^}]+)\}", r"(?i)(?:no-?line-?numbers|line-?numbers\s*=\s*false|nolines)"
SECRET_PARAMETER = r"(?i)([?&])(token|secret|password|auth|apikey|api_key|key)=([^&\s]+)"
SECRET_BEARER = r"(?i)Bearer\s+([\w\-.~+/=]{6})[\w\-.~+/=]+([\w\-.~+/=]{4})"
SECRET_PAIR = r"([a-zA-Z0-9_-]+)=([^;,\s&=]{6})[^;,\s&=]+([^;,\s&=]{4})"


def code_scores(code: Column) -> dict[str, Column]:
    """Number of signs of each language."""
    return {lang: sum((code.rlike(sign).cast("int") for sign in signs), F.lit(0)) for lang, signs in LANGUAGE_SIGNS.items()}


def is_workflow(code: Column) -> Column:
    """Whether a block is a CI workflow: a name or trigger, and jobs or steps."""
    any_of = lambda patterns: reduce(or_, (code.rlike("(?m)" + p) for p in patterns))
    return any_of(WORKFLOW_HEAD) & any_of(WORKFLOW_BODY)


def code_language(code: Column) -> Column:
    """text for blank code, then the first line's interpreter, a workflow, the best score, text."""
    first = F.split(js_trim(code), "\n")[0]
    scores = code_scores(code)
    ranked = F.array(*(F.struct(s.alias("score"), F.lit(-i).alias("rank"), F.lit(lang).alias("lang")) for i, (lang, s) in enumerate(scores.items())))
    best = F.array_max(ranked)
    return (
        F.when(js_trim(code) == "", "text")
        .when(first.rlike(SHEBANGS["python"]), "python")
        .when(first.rlike(SHEBANGS["bash"]), "bash")
        .when(is_workflow(code), "yaml")
        .when(best["score"] > 0, best["lang"])
        .otherwise("text")
    )


def code_alias(lang: Column) -> Column:
    """Full name of a language; unknown and missing ones are text."""
    name = F.lower(F.coalesce(lang, F.lit("")))
    names = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    full = F.coalesce(names[name], name)
    return F.when(full.isin(*KNOWN), full).otherwise("text")


def highlight_set(value: Column) -> Column:
    """Positive line numbers of a comma list, each once."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda v: F.regexp_extract(F.trim(v), r"^([+-]?\d+)", 1).try_cast("int")), lambda n: n > 0))


def code_meta(meta: Column) -> Column:
    """Struct (title, showLineNumbers, highlights, meta) of what follows a fence's language."""
    given = F.coalesce(meta, F.lit(""))
    title = F.regexp_replace(F.trim(F.regexp_extract(given, META_TITLE, 1)), r"^['\"]|['\"]$", "")
    parts = F.filter(F.transform(F.split(F.regexp_extract(given, META_LINES, 1), ","), F.trim), lambda p: p != "")

    def lines(p: Column) -> Column:
        a, b = F.split(p, "-")[0].try_cast("int"), F.get(F.split(p, "-"), F.lit(1)).try_cast("int")
        span = F.when(a.isNotNull() & b.isNotNull(), F.sequence(F.least(a, b), F.greatest(a, b)))
        one = p.try_cast("int")
        return F.coalesce(F.when(p.contains("-"), span).when(one.isNotNull(), F.array(one)), F.array().cast("array<int>"))

    rest = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(given, META_LINES, ""), META_TITLE, ""), META_OFF, ""))
    return F.struct(F.nullif(title, F.lit("")).alias("title"), (~given.rlike(META_OFF)).alias("showLineNumbers"), F.flatten(F.transform(parts, lines)).alias("highlights"), rest.alias("meta"))


def is_sensitive(key: Column, extra: tuple[str, ...] = ()) -> Column:
    return key.rlike("(?i)" + "|".join((*SENSITIVE, *extra)))


def redact_value(c: Column) -> Column:
    """Sensitive query parameters, then bearer tokens, then long ``name=value`` pairs, in this order."""
    parameters = F.regexp_replace(c, SECRET_PARAMETER, "$1$2=[REDACTED]")
    return F.regexp_replace(F.regexp_replace(parameters, SECRET_BEARER, "Bearer $1...$2"), SECRET_PAIR, "$1=$2...$3")


def redact_fields(fields: Column, extra: tuple[str, ...] = ()) -> Column:
    """Map values redacted: those of sensitive keys whole, others by what they hold."""
    return F.transform_values(fields, lambda k, v: F.when(is_sensitive(k, extra), F.lit(REDACTED)).otherwise(redact_value(v)))


def fields_pretty(fields: Column) -> Column:
    """`` key=value`` for each entry, in the map's order."""
    return F.array_join(F.transform(F.map_entries(fields), lambda e: F.concat(F.lit(" "), e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), "")
