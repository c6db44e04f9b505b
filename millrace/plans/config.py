"""Settings with defaults, bounds and environment overrides; read once per process."""

from __future__ import annotations

import json
import os
import secrets
from dataclasses import dataclass, fields
from functools import lru_cache
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

YES, NO = ("1", "true", "yes", "y", "on"), ("0", "false", "no", "n", "off")


@dataclass(frozen=True)
class Settings:
    """``page_size`` and ``window`` of listings, ``related`` posts, ``batch_chars`` of a translation batch."""

    page_size: int = 6
    window: int = 2
    related: int = 4
    batch_chars: int = 6000
    comments: bool = True

    BOUNDS: ClassVar[dict[str, tuple[int, int]]] = {"page_size": (1, 100), "window": (1, 20), "related": (0, 20), "batch_chars": (1, 1_000_000)}


def boolean(value: str | None, fallback: bool) -> bool:
    word = (value or "").strip().lower()
    return True if word in YES else False if word in NO else fallback


def number(value: str | None, fallback: int) -> int:
    try:
        return int((value or "").strip())
    except ValueError:
        return fallback


def checked(raw: dict) -> Settings:
    """Settings of a mapping; every problem is listed in one ValueError. Unknown keys are dropped."""
    known = {f.name: f.type for f in fields(Settings)}
    values, problems = {}, []
    for k, v in raw.items():
        if k not in known:
            continue
        low, high = Settings.BOUNDS.get(k, (None, None))
        wanted = bool if k == "comments" else int
        if not isinstance(v, wanted) or (wanted is int and isinstance(v, bool)):
            problems.append(f"  - {k}: not of type {wanted.__name__}")
        elif low is not None and not low <= v <= high:
            problems.append(f"  - {k}: not within {low} and {high}")
        else:
            values[k] = v
    if problems:
        raise ValueError("settings:\n" + "\n".join(problems))
    return Settings(**values)


@lru_cache(maxsize=8)
def load(path: str | None = None) -> Settings:
    """Settings of a JSON file, if given, overridden by MILLRACE_PAGE_SIZE and the like."""
    raw = json.load(open(path, encoding="utf-8")) if path else {}
    base = checked(raw)
    out = {}
    for f in fields(Settings):
        value, given = getattr(base, f.name), os.environ.get(f"MILLRACE_{f.name.upper()}")
        out[f.name] = boolean(given, value) if isinstance(value, bool) else number(given, value)
    return checked(out)


def css_variables(colours: dict, prefix: str = "--color") -> list[str]:
    """``--color-a-b: value;`` lines of nested names."""
    out = []
    for k, v in colours.items():
        name = f"{prefix}-{k}"
        out += css_variables(v, name) if isinstance(v, dict) else [f"{name}: {v};"]
    return out


def variable_lines(colours: Column, prefix: str = "--color") -> Column:
    """``--color-a: value;`` lines of a map column of flattened names, in its order."""
    return F.transform(F.map_entries(colours), lambda e: F.concat(F.lit(f"{prefix}-"), e["key"], F.lit(": "), e["value"], F.lit(";")))


def settings_of(sites: DataFrame) -> DataFrame:
    """Settings that are rows of a table, with ``valid``: whether each field is one of those allowed."""
    return sites.withColumn("valid", F.col("date_order").isin("mdy", "dmy", "ymd") & F.col("source").isNotNull())


def run_id_column() -> Column:
    """``run_id`` for each row."""
    return F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 8)


def run_id() -> str:
    """Eight random hex digits that name a run."""
    return secrets.token_hex(4)
