"""The front matter of Markdown files: the common part of YAML, without a library.

Mappings by indentation, lists by dashes or in brackets, quoted and plain scalars, comments, and blocks
behind ``|`` and ``>``. Plain scalars become booleans, numbers and null as in YAML 1.2's core schema; dates
stay text. Anchors, tags and flow mappings inside others are kept as text.
"""

from __future__ import annotations

import json
import re

_KEY = re.compile(r"^(?P<key>\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[^\s#:\-\[\]{},&*!|>'\"%@`][^:#]*?)\s*:(?:\s+(?P<rest>.*))?$")
_COMMENT = re.compile(r"(?:^|\s)#.*$")
_PARTS = re.compile(r"\s*(\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[^,]*?)\s*(?:,|$)")
_WORDS = {"": None, "null": None, "~": None, "true": True, "false": False}


def scalar(text: str) -> object:
    """Value of a scalar or of a list in brackets."""
    text = text.strip()
    if len(text) > 1 and text[0] == '"' == text[-1]:
        try:
            return json.loads(text)
        except ValueError:
            return text[1:-1]
    if len(text) > 1 and text[0] == "'" == text[-1]:
        return text[1:-1].replace("''", "'")
    if text.startswith("[") and text.endswith("]"):
        inner = text[1:-1].strip()
        return [scalar(m[1]) for m in _PARTS.finditer(inner) if m[0]] if inner else []
    text = _COMMENT.sub("", text).strip()
    if text.lower() in _WORDS:
        return _WORDS[text.lower()]
    if re.fullmatch(r"[-+]?\d+", text):
        return int(text)
    if re.fullmatch(r"[-+]?(?:\d+\.\d*|\.\d+|\d+(?=e))(?:e[-+]?\d+)?", text, re.IGNORECASE):
        return float(text)
    return text


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def _block(lines: list[str], at: int, depth: int, folded: bool) -> tuple[str, int]:
    """Text of a block of lines deeper than ``depth``."""
    own, inner = [], None
    while at < len(lines) and (not lines[at].strip() or _indent(lines[at]) > depth):
        if inner is None and lines[at].strip():
            inner = _indent(lines[at])
        own.append(lines[at][inner or 0 :] if lines[at].strip() else "")
        at += 1
    text = "\n".join(own).rstrip("\n")
    return (re.sub(r"(?<!\n)\n(?!\n)", " ", text) if folded else text) + "\n", at


def _value(rest: str | None, lines: list[str], at: int, depth: int) -> tuple[object, int]:
    """Value behind a key or a dash whose own line is read; deeper lines belong to it."""
    rest = (rest or "").strip()
    if rest[:1] in ("|", ">"):
        return _block(lines, at, depth, rest[0] == ">")
    if rest and not rest.startswith("#"):
        return scalar(rest), at
    while at < len(lines) and (not lines[at].strip() or lines[at].lstrip().startswith("#")):
        at += 1
    if at < len(lines) and (_indent(lines[at]) > depth or (_indent(lines[at]) == depth and lines[at].lstrip().startswith("- "))):
        return _node(lines, at, _indent(lines[at]))
    return None, at


def _node(lines: list[str], at: int, depth: int) -> tuple[object, int]:
    """The mapping or list that starts at line ``at``."""
    out: dict | list | None = None
    while at < len(lines):
        line = lines[at]
        bare = line.strip()
        if not bare or bare.startswith("#"):
            at += 1
            continue
        if _indent(line) != depth:
            break
        if bare == "-" or bare.startswith("- "):
            if isinstance(out, dict):
                break
            out = out if out is not None else []
            inner = bare[1:].strip()
            if _KEY.match(inner):  # a mapping that starts behind the dash
                lines[at] = " " * (depth + 2) + inner
                value, at = _node(lines, at, depth + 2)
            else:
                value, at = _value(inner, lines, at + 1, depth)
            out.append(value)
            continue
        m = _KEY.match(bare)
        if not m or isinstance(out, list):
            at += 1 if not m else 0
            if m:
                break
            continue
        out = out if out is not None else {}
        value, at = _value(m["rest"], lines, at + 1, depth)
        out[str(scalar(m["key"]))] = value
    return ({} if out is None else out), at


def parse(head: str) -> dict:
    """The mapping of a front matter, with or without its ``---`` lines; no mapping gives {}."""
    lines = [x.rstrip().replace("\t", "  ") for x in head.split("\n") if x.strip() != "---"]
    first = next((x for x in lines if x.strip() and not x.lstrip().startswith("#")), "")
    found, _ = _node(lines, 0, _indent(first))
    return found if isinstance(found, dict) else {}


def flattened(value: object, path: str = "") -> list[tuple[str, str]]:
    """(path, JSON) of every leaf: ``source.url``, ``tags[0]``; empty containers are leaves."""
    if isinstance(value, dict) and value:
        return [x for k, v in value.items() for x in flattened(v, f"{path}.{k}" if path else k)]
    if isinstance(value, list) and value:
        return [x for i, v in enumerate(value) for x in flattened(v, f"{path}[{i}]")]
    return [(path, json.dumps(value, ensure_ascii=False))] if path else []
