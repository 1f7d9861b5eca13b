"""Dates and instants written in many formats and zones, brought to one unambiguous form.

Each text is reduced to its shape: digits become 9 and letters a. All texts of one shape have the same length and the
same places, so a shape is given a parser once, and all its texts are converted together with NumPy. Local times are
turned into instants by binary search in tables of each zone's changes of offset, which are built once on the driver
from the time zone database, carry its version, and travel to the executors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from pathlib import Path
from zoneinfo import TZPATH, ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Month names by their first three letters, Spanish and English; Set and Sep are one month. Fixed values.
MONTHS = {
    "ene": 1, "jan": 1, "feb": 2, "mar": 3, "abr": 4, "apr": 4, "may": 5, "jun": 6, "jul": 7,
    "ago": 8, "aug": 8, "set": 9, "sep": 9, "oct": 10, "nov": 11, "dic": 12, "dec": 12,
}
#: Minutes east of UTC of zone abbreviations. Fixed values.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "EST": -300, "EDT": -240,
    "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "PET": -300, "COT": -300,
}
#: Two-digit years from here on are of the 20th century.
PIVOT = 90
FIRST_YEAR, LAST_YEAR = 1900, 2100
#: More letters than the longest layout takes, after blanks are collapsed; longer texts are unreadable, never cut.
LONGEST = 128
NAT = np.iinfo(np.int64).min
SECOND, MICROS_DAY = 1_000_000, 86_400_000_000

_TIME = r"(?:[ a](?P<h>9{1,2}):(?P<m>99)(?::(?P<s>99)(?:[.,](?P<f>9{1,9}))?)?(?P<ap> ?a\.? ?a\.?(?!a))?)?"
_ZONE = r"(?: ?(?P<z>a{1,5}(?:[+-]9{1,2}(?::?99)?)?|[+-]99:?99|[+-]9{1,2}))?"
#: Families of shapes, tried in this order.
LAYOUTS = [
    ("ymd", re.compile(rf"(?P<Y>9999)[-/.](?P<M>9{{1,2}})[-/.](?P<D>9{{1,2}}){_TIME}{_ZONE}")),
    ("num", re.compile(rf"(?P<p>9{{1,2}})[-/.](?P<q>9{{1,2}})[-/.](?P<Y>9999|99),?{_TIME}{_ZONE}")),
    ("ymd", re.compile(r"(?P<Y>9999)(?P<M>99)(?P<D>99)(?:[ a]?(?P<h>99):?(?P<m>99):?(?P<s>99)(?:\.?(?P<f>9{3,6}))?)?(?P<z>a|[+-]99:?99)?")),
    ("epoch", re.compile(r"(?P<e>9{9,10}|9{12,13}|9{15,16})")),
    ("epoch", re.compile(r"/aaaa\((?P<e>9{9,10}|9{12,13}|9{15,16})(?:[+-]9999)?\)/")),
    ("dmy", re.compile(rf"(?:a{{2,9}}\.?, ?)?(?P<D>9{{1,2}})[-/. ]?(?:aa )?(?P<N>a{{3,10}})[-/. ]{{0,2}}(?:aa )?(?P<Y>9999|99),?{_TIME}{_ZONE}")),
    ("dmy", re.compile(rf"(?:a{{3,9}} )?(?P<N>a{{3,10}})\.? (?P<D>9{{1,2}}),? (?P<Y>9999){_TIME}{_ZONE}")),
]


@dataclass(frozen=True)
class Parser:
    """Where each part of a date stands in the texts of one shape. kind: ymd, num, dmy or epoch; empty: unreadable."""

    kind: str = ""
    at: dict[str, tuple[int, int]] = field(default_factory=dict)


@lru_cache(maxsize=4096)
def parser_of(shape: str) -> Parser:
    for kind, layout in LAYOUTS:
        if m := layout.fullmatch(shape):
            return Parser(kind, {k: m.span(k) for k, v in m.groupdict().items() if v is not None})
    return Parser()


_SHAPE = str.maketrans({chr(c): "9" for c in range(48, 58)} | {chr(c): "a" for c in range(0x250) if chr(c).isalpha()})


def shape_of(text: str) -> str:
    return text.translate(_SHAPE)


@dataclass(frozen=True)
class ZoneTable:
    """A zone's changes: local times before which the old offset still holds, and the offsets (microseconds).

    wall[i] is the i-th change's instant in the later of the two local times around it, so a time that occurs twice
    is the first and one that is skipped takes the offset from before the change. utc[i] is its instant.
    """

    wall: np.ndarray
    utc: np.ndarray
    offsets: np.ndarray


def database_version() -> str:
    for folder in TZPATH:
        for name in ("+VERSION", "tzdata.zi", "version"):
            if (p := Path(folder, name)).is_file():
                return p.open(errors="replace").readline().strip(" #\n").removeprefix("version ")
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


@lru_cache(maxsize=256)
def zone_table(name: str) -> ZoneTable:
    """Built by looking for days on which the offset changes and bisecting to the second. Unknown names raise."""
    zone = ZoneInfo(name)
    offset = lambda s: int(zone.utcoffset(datetime.fromtimestamp(s, timezone.utc).astimezone(zone)).total_seconds())
    start, end = (int(datetime(y, 1, 1, tzinfo=timezone.utc).timestamp()) for y in (FIRST_YEAR, LAST_YEAR))
    wall, utc, offsets = [], [], [offset(start)]
    for lo in range(start, end, 86_400 * 7):
        hi = lo + 86_400 * 7
        while (old := offset(lo)) != offset(hi):
            a, b = lo, hi
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (mid, b) if offset(mid) == old else (a, mid)
            new = offset(b)
            utc.append(b * SECOND)
            wall.append((b + max(old, new)) * SECOND)
            offsets.append(new)
            lo = b
    return ZoneTable(np.array(wall, dtype=np.int64), np.array(utc, dtype=np.int64), np.array(offsets, dtype=np.int64) * SECOND)


@lru_cache(maxsize=4096)
def _zone_offset(text: str) -> int | None:
    """Microseconds east of UTC of a written zone; None if it is unknown."""
    t = text.upper()
    if t in ABBREVIATIONS:
        return ABBREVIATIONS[t] * 60 * SECOND
    m = re.fullmatch(r"(?:UTC|GMT)?([+-])(\d{1,2}):?(\d\d)?", t)
    if not m or int(m[2]) > 15 or int(m[3] or 0) > 59:
        return None
    return (1 if m[1] == "+" else -1) * (int(m[2]) * 60 + int(m[3] or 0)) * 60 * SECOND


def _number(codes: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    n = np.zeros(len(codes), dtype=np.int64)
    for i in range(*span):
        n = n * 10 + (codes[:, i] - 48)
    return n


def _words(texts: np.ndarray, span: tuple[int, int], value) -> np.ndarray:
    """value of each text's part, looked up once per distinct part; -1 where it is None."""
    parts, where = np.unique(np.array([t[slice(*span)] for t in texts]), return_inverse=True)
    return np.array([NAT if (v := value(p)) is None else v for p in parts], dtype=np.int64)[where]


def convert(texts: np.ndarray, month_first: np.ndarray, kind_epoch: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(microseconds since 1970 as written, offset written) of texts without blanks at their ends.

    NAT in the first: unreadable or impossible; in the second: no zone is written. month_first holds, per text,
    whether numeric dates put the month before the day.
    """
    when = np.full(len(texts), NAT, dtype=np.int64)
    off = np.full(len(texts), NAT, dtype=np.int64)
    shapes, which = np.unique(np.array([shape_of(t) for t in texts], dtype=object).astype(str), return_inverse=True)
    for i, shape in enumerate(shapes):
        p = parser_of(str(shape))
        if not p.kind or p.kind == "epoch" and not kind_epoch:
            continue
        rows = np.flatnonzero(which == i)
        own = texts[rows]
        codes = np.array(own, dtype=f"U{len(shape)}").view(np.uint32).reshape(len(rows), len(shape)).astype(np.int64)
        get = lambda k, default=0: _number(codes, p.at[k]) if k in p.at else np.full(len(rows), default, dtype=np.int64)  # noqa: B023, E731
        if p.kind == "epoch":
            n = get("e")
            digits = p.at["e"][1] - p.at["e"][0]
            when[rows] = n * {9: SECOND, 10: SECOND, 12: 1000, 13: 1000, 15: 1, 16: 1}[digits]
            off[rows] = 0
            continue
        year = get("Y")
        if p.at["Y"][1] - p.at["Y"][0] == 2:
            year = np.where(year >= PIVOT, 1900 + year, 2000 + year)
        ok = (year >= FIRST_YEAR) & (year < LAST_YEAR)
        if p.kind == "num":
            first, second = get("p"), get("q")
            mf = month_first[rows]
            month, day = np.where(mf, first, second), np.where(mf, second, first)
        elif "N" in p.at:
            month, day = _words(own, p.at["N"], lambda w: MONTHS.get(w.lower()[:3])), get("D")
        else:
            month, day = get("M"), get("D")
        ok &= (month >= 1) & (month <= 12) & (day >= 1)
        months = (np.where(ok, year, 1970) - 1970) * 12 + np.where(ok, month, 1) - 1
        start = months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
        ok &= day <= (months + 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) - start
        hour, minute, second = get("h"), get("m"), get("s")
        if "ap" in p.at:
            half = _words(own, p.at["ap"], lambda w: {"am": 0, "pm": 12}.get(re.sub(r"[^a-z]", "", w.lower())))
            ok &= (half != NAT) & (hour >= 1) & (hour <= 12)
            hour = hour % 12 + np.where(half == 12, 12, 0)
        ok &= (hour < 24) & (minute < 60) & (second < 60)
        micros = np.zeros(len(rows), dtype=np.int64)
        if "f" in p.at:
            a, b = p.at["f"]
            micros = _number(codes, (a, min(b, a + 6))) * 10 ** max(0, 6 - (b - a))
        value = (start + day - 1) * MICROS_DAY + ((hour * 60 + minute) * 60 + second) * SECOND + micros
        if "z" in p.at:
            z = _words(own, p.at["z"], _zone_offset)
            ok &= z != NAT
            off[rows] = np.where(ok, z, NAT)
        when[rows] = np.where(ok, value, NAT)
    return when, off


def to_utc(local: np.ndarray, zones: np.ndarray, tables: dict[str, ZoneTable]) -> np.ndarray:
    """UTC of local times; NAT where the zone has no table."""
    out = np.full(len(local), NAT, dtype=np.int64)
    for z in {x for x in zones if x in tables}:
        rows, t = np.flatnonzero(zones == z), tables[z]
        v = local[rows]
        out[rows] = np.where(v == NAT, NAT, v - t.offsets[np.searchsorted(t.wall, v, side="right")])
    return out


def to_local(utc: np.ndarray, zones: np.ndarray, tables: dict[str, ZoneTable]) -> np.ndarray:
    out = np.full(len(utc), NAT, dtype=np.int64)
    for z in {x for x in zones if x in tables}:
        rows, t = np.flatnonzero(zones == z), tables[z]
        v = utc[rows]
        out[rows] = np.where(v == NAT, NAT, v + t.offsets[np.searchsorted(t.utc, v, side="right")])
    return out


def normalise(df: DataFrame, text: Column, zone: Column, month_first: Column, zones: list[str], keep: list[Column]) -> DataFrame:
    """``keep`` and three columns: ``instante`` and ``local`` (microseconds since 1970 in UTC and in the row's zone)
    and ``version_zonas`` (of the zone database).

    ``zone`` names the zone of a text that states none, and the zone ``local`` is given in; ``zones`` lists the names
    that may occur (those of a reference table); a name the zone database does not know counts as no zone. ``month_first``: whether numeric dates put the month first (NULL: no).
    A date without time is midnight. NULL, blank, unreadable and impossible texts give NULLs, as do texts that state no
    zone where the row has none; texts of any length do no harm. A local time that occurs twice is the first of the
    two; a skipped one takes the offset from before the change.
    """
    tables = {}
    for z in zones:
        try:
            tables[z] = zone_table(z)
        except (KeyError, ValueError, OSError):  # a name the database does not know
            continue
    version = database_version()
    src = df.select(*keep, text.cast("string").alias("__t"), zone.cast("string").alias("__z"), F.coalesce(month_first, F.lit(False)).alias("__m"))
    names = [f.name for f in src.schema.fields[:-3]]
    schema = T.StructType([*src.schema.fields[:-3], T.StructField("instante", T.LongType()), T.StructField("local", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            t = pdf["__t"].fillna("").str.strip().str.replace(r"\s+", " ", regex=True)
            t = t.where(t.str.len() <= LONGEST, "")
            texts = t.to_numpy(dtype=object)
            zone_of = pdf["__z"].to_numpy(dtype=object)
            when, off = convert(texts, pdf["__m"].to_numpy(dtype=bool))
            utc = np.where(off == NAT, to_utc(when, zone_of, tables), when - np.where(off == NAT, 0, off))
            utc = np.where(when == NAT, NAT, utc)
            local = np.where(off == NAT, when, to_local(utc, zone_of, tables))
            out = pdf[names].copy()
            for c, v in (("instante", utc), ("local", local)):
                out[c] = pd.array(v, dtype="Int64")
                out.loc[v == NAT, c] = pd.NA
            yield out

    return src.mapInPandas(run, schema).withColumn("version_zonas", F.lit(version))


def instant_text(micros: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss.SSSSSS`` of microseconds since 1970, whatever the session's zone."""
    rest = F.pmod(micros, F.lit(MICROS_DAY))
    part = lambda unit, size, digits: F.lpad(F.pmod(F.floor(rest / F.lit(unit)), F.lit(size)).cast("string"), digits, "0")
    return F.concat(day_of(micros).cast("string"), F.lit(" "), part(3600 * SECOND, 24, 2), F.lit(":"), part(60 * SECOND, 60, 2), F.lit(":"), part(SECOND, 60, 2), F.lit("."), part(1, SECOND, 6))


def day_of(micros: Column) -> Column:
    """The date of microseconds since 1970."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(micros / F.lit(MICROS_DAY)).cast("int"))
