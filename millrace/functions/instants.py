"""Parsing one timestamp string, whatever its notation, into an instant.

``parse_instant(raw, tz, date_order)`` gives microseconds since 1970 in UTC, or None where the
string denotes no moment. Rules:

* blanks around the value, full-width digits and repeated spaces don't matter;
* a value without a zone is local time of ``tz``; a day is its local midnight;
* a local time that occurs twice is the earlier instant, one that is skipped is read with the
  offset before the change (both are what ``fold=0`` means to ``zoneinfo``);
* UTC, GMT and Z are UTC; any other zone abbreviation is looked up in ``tz`` itself;
* all-number dates with the year last follow ``date_order``;
* bare integers count from 1970 in seconds, milli-, micro- or nanoseconds by their magnitude;
* impossible dates and times, words such as "yesterday", and unknown zones give None.
"""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
MICROSECOND = timedelta(microseconds=1)

# Month names of the languages in the data, by month.
MONTHS = (
    "january jan januar jänner janvier janv enero ene",
    "february feb februar février févr fév fevrier febrero",
    "march mar märz mär mrz maerz mars marzo",
    "april apr avril avr abril abr",
    "may mai mayo",
    "june jun juni juin junio",
    "july jul juli juillet juil julio",
    "august aug août aout agosto ago",
    "september sep sept septembre septiembre setiembre",
    "october oct oktober okt octobre octubre",
    "november nov novembre noviembre",
    "december dec dezember dez décembre déc decembre diciembre dic",
)
MONTH_NUMBER = {name: i + 1 for i, names in enumerate(MONTHS) for name in names.split()}
DAY_HALVES = {"am": 0, "a.m.": 0, "上午": 0, "午前": 0, "凌晨": 0, "早上": 0, "pm": 12, "p.m.": 12, "下午": 12, "午後": 12, "晚上": 12, "中午": 12}
WEEKDAY = r"(?:[^\W\d_]{2,10}\.?,?\s+)?"

_TIME = (
    r"(?P<half1>上午|下午|午前|午後|凌晨|早上|晚上|中午)?\s*"
    r"(?P<h>\d{1,2})(?:[:時时点](?P<mi>\d{1,2})(?:[:分](?P<s>\d{1,2})(?:[.,](?P<f>\d{1,9}))?)?分?秒?)"
    r"(?:\s*(?P<half2>[AaPp]\.?[Mm]\.?))?"
)
_ZONE = r"(?:\s*(?P<zone>Z|z|(?:UTC|GMT)?[+\-−]\d{1,2}(?::?\d{2})?|[A-Za-z]{1,5})(?:\s*\([^)]*\))?)?"
_END = rf"(?:(?:\s*,\s*|\s+|[Tt])(?:um|at|à|a las)?\s*{_TIME}{_ZONE})?"

_FORMS = tuple(
    re.compile(p, re.IGNORECASE)
    for p in (
        rf"(?P<y>\d{{4}})(?P<sep>[-/.])(?P<mo>\d{{1,2}})(?P=sep)(?P<d>\d{{1,2}}){_END}",
        rf"(?P<y>\d{{4}})\s*年\s*(?P<mo>\d{{1,2}})\s*月\s*(?P<d>\d{{1,2}})\s*日(?:\s*{_TIME}{_ZONE})?",
        rf"(?P<a>\d{{1,2}})(?P<sep>[-/.])(?P<b>\d{{1,2}})(?P=sep)(?P<y>\d{{4}}){_END}",
        rf"{WEEKDAY}(?P<d>\d{{1,2}})(?:\.|º|er)?[\s-]+(?:de\s+)?(?P<name>[^\W\d_]+)\.?,?[\s-]+(?:de\s+|del\s+)?(?P<y>\d{{4}}){_END}",
        rf"{WEEKDAY}(?P<name>[^\W\d_]+)\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}}){_END}",
        r"(?P<y>\d{4})(?P<mo>\d{2})(?P<d>\d{2})[Tt](?P<h>\d{2})(?P<mi>\d{2})(?:(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?(?P<zone>Z|z|[+\-]\d{2}:?(?:\d{2})?)?",
    )
)
_INTEGER = re.compile(r"[+-]?\d{1,19}")
_OFFSET = re.compile(r"(?:UTC|GMT)?([+\-−])(\d{1,2})(?::?(\d{2}))?", re.IGNORECASE)
#: Largest absolute value read as seconds, milliseconds, microseconds and nanoseconds.
_MAGNITUDES = ((10**11, 1_000_000, 1), (10**14, 1_000, 1), (10**17, 1, 1), (10**20, 1, 1_000))


@lru_cache(maxsize=1024)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:  # unknown or malformed names alike
        return None


@lru_cache(maxsize=4096)
def _abbreviation_offset(tz: str, year: int, abbreviation: str) -> timedelta | None:
    """Offset that ``abbreviation`` stands for in ``tz``: in ``year`` if it is used then, else in its neighbours."""
    zone = _zone(tz)
    if zone is None:
        return None
    for y in (year, year - 1, year + 1):
        if not 1 <= y <= 9998:
            continue
        for month in range(1, 13):
            at = datetime(y, month, 15, 12, tzinfo=zone)
            if (at.tzname() or "").upper() == abbreviation:
                return at.utcoffset()
    return None


def _offset(zone: str, tz: str | None, year: int) -> timedelta | None:
    upper = zone.upper()
    if upper in ("Z", "UTC", "GMT"):
        return timedelta(0)
    if m := _OFFSET.fullmatch(zone):
        hours, minutes = int(m[2]), int(m[3] or 0)
        if hours > 18 or minutes > 59:
            return None
        return (-1 if m[1] != "+" else 1) * timedelta(hours=hours, minutes=minutes)
    return _abbreviation_offset(tz, year, upper) if tz else None


def _micros(at: datetime) -> int:
    return (at - EPOCH) // MICROSECOND


def parse_instant(raw: str | None, tz: str | None, date_order: str | None) -> int | None:
    if raw is None:
        return None
    text = " ".join(raw.translate(_WIDTH).split())
    if not text or not any(c.isdigit() for c in text):
        return None
    if _INTEGER.fullmatch(text):
        n = int(text)
        for limit, times, over in _MAGNITUDES:
            if abs(n) < limit:
                micros = n * times // over
                return micros if -62_135_596_800_000_000 <= micros <= 253_402_300_799_999_999 else None
        return None
    for form in _FORMS:
        m = form.fullmatch(text)
        if m:
            return _moment(m.groupdict(), tz, date_order)
    return None


_WIDTH = {0xFF01 + i: 0x21 + i for i in range(94)} | {0x3000: 0x20, 0xFEFF: None, 0x200B: None}


def _moment(g: dict[str, str | None], tz: str | None, date_order: str | None) -> int | None:
    if g.get("a"):
        if date_order not in ("mdy", "dmy", "ymd"):
            return None
        month, day = (g["a"], g["b"]) if date_order == "mdy" else (g["b"], g["a"])
    else:
        month, day = g.get("mo"), g["d"]
    if g.get("name"):
        month = MONTH_NUMBER.get(g["name"].lower())
        if month is None:
            return None
    hour, minute, second = int(g.get("h") or 0), int(g.get("mi") or 0), int(g.get("s") or 0)
    half = g.get("half1") or g.get("half2")
    if half:
        if not 1 <= hour <= 12:
            return None
        if half == "中午":
            hour = hour if hour in (11, 12) else hour + 12
        else:
            hour = hour % 12 + DAY_HALVES[half.lower()]
    fraction = int(((g.get("f") or "") + "000000")[:6])
    extra = timedelta(0)
    if (hour, minute, second, fraction) == (24, 0, 0, 0):  # ISO 8601: the end of the day
        hour, extra = 0, timedelta(days=1)
    try:
        local = datetime(int(g["y"]), int(month), int(day), hour, minute, second, fraction) + extra
        zone = g.get("zone")
        if zone:
            offset = _offset(zone, tz, local.year)
            return None if offset is None else _micros(local.replace(tzinfo=UTC)) - offset // MICROSECOND
        site = _zone(tz) if tz else None
        return None if site is None else _micros(local.replace(tzinfo=site, fold=0))
    except (ValueError, OverflowError):
        return None
