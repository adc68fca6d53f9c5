"""Time texts of many forms and zones brought to one UTC instant.

A text is reduced to a shape mask of character classes (9 a digit, a a letter), as long as the text. Each distinct mask
is mapped to a parser once, which is where its parts lie; all values of that mask are then sliced and converted as
arrays. Local times go through zone transition tables, which are built on the driver from the JVM's rules under their
version and shipped with the job.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_ZONE = "Europe/Copenhagen"
FIRST_YEAR = 2000
# Zone tables end here; later years take the offsets of the year among these 28 that has the same calendar, as the last rules recur.
LAST_YEARS = range(2101, 2129)

# Month names in Danish, Swedish and English with their abbreviations.
MONTHS = {
    "januar": 1, "januari": 1, "january": 1, "jan": 1,
    "februar": 2, "februari": 2, "february": 2, "feb": 2, "febr": 2,
    "marts": 3, "mars": 3, "march": 3, "mar": 3,
    "april": 4, "apr": 4,
    "maj": 5, "may": 5, "mai": 5,
    "juni": 6, "june": 6, "jun": 6,
    "juli": 7, "july": 7, "jul": 7,
    "august": 8, "augusti": 8, "aug": 8,
    "september": 9, "sep": 9, "sept": 9,
    "oktober": 10, "october": 10, "okt": 10, "oct": 10,
    "november": 11, "nov": 11,
    "december": 12, "dec": 12,
}
# Zone names that are read, in minutes east of Greenwich.
ZONES = {"z": 0, "gmt": 0, "utc": 0, "bst": 60, "cet": 60, "cest": 120, "eet": 120, "est": -300}
# Words that may stand around a date or time.
FILLERS = {
    "mandag", "tirsdag", "onsdag", "torsdag", "fredag", "lørdag", "søndag", "man", "tir", "tirs", "ons", "tor", "tors", "fre", "lør", "søn",
    "måndag", "tisdag", "lördag", "söndag", "mån", "tis", "lör", "sön",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "mon", "tue", "tues", "wed", "thu", "thur", "thurs", "fri", "sat", "sun",
    "den", "d", "the", "of", "kl", "klokken", "klockan", "at", "t", "w", "st", "nd", "rd", "th", "date",
}

# Forms of dates, times and zones over mask characters: 9 is a digit, a stands for a run of letters.
_DAY_NAME = r"(?:(?P<F1>a)\.?,? )?(?:(?P<F2>a)\.? )?"
_DATES = [
    r"(?P<Y>9999)-(?P<M>99?)-(?P<D>99?)",
    r"(?P<Y>9999)/(?P<M>99?)/(?P<D>99?)",
    r"(?P<Y>9999)\.(?P<M>99?)\.(?P<D>99?)\.?",
    r"(?P<Y>9999)-?(?P<W>a)(?P<K>99)-?(?P<N>9)",
    _DAY_NAME + r"(?P<D>99?)\. ?(?P<M>99?)\. ?(?P<Y>9999)",
    _DAY_NAME + r"(?P<D>99?)/(?P<M>99?)[-/ ](?P<Y>9999)",
    _DAY_NAME + r"(?P<D>99?)-(?P<M>99?)-(?P<Y>9999)",
    _DAY_NAME + r"(?P<D>99?)(?P<F3>a)?\.?[ -](?P<B>a)\.?,?[ -](?P<Y>9999)",
    r"(?:(?P<F1>a)\.?,? )?(?P<B>a)\.? (?P<D>99?)(?P<F3>a)?,? (?P<Y>9999)",
    r"(?P<Y>9999),? (?P<B>a)\.? (?P<D>99?)",
]
_ZONE = r"(?: ?(?P<Z>a)| ?(?P<S>[-+−])(?P<O>99):?(?P<P>99)?)?"
_CLOCK = r"(?P<H>99?)[:.](?P<I>99)(?:[:.](?P<C>99)(?:[.,](?P<X>9+))?)?(?: ?(?P<A>a(?:\.a\.?)?))??"
_TIME = r"(?:(?:,? (?:(?P<F4>a)\.?:? )?|,|(?P<F5>a))" + _CLOCK + _ZONE + r")?"
_FORMS = [d + _TIME for d in _DATES] + [
    r"(?P<Y>9999)(?P<M>99)(?P<D>99)(?:[ -]?(?P<F5>a)?(?P<H>99):?(?P<I>99)(?::?(?P<C>99)(?:[.,](?P<X>9+))?)?" + _ZONE + r")?",
    _CLOCK + r",? " + _DATES[7],
]
_EPOCH = r"(?:/?(?P<F1>a)\()?(?P<E>9{13}|9{10})(?:[-+]99:?99)?\)?/?"


_PARSERS = [re.compile(re.sub(r"(?<![?<\w])a(?!\w)", "a+", f)) for f in [_EPOCH, *_FORMS]]


@functools.lru_cache(maxsize=100_000)
def parser_of(mask: str) -> dict[str, tuple[int, int]] | None:
    """Where the parts of a text of this shape lie, or None if such texts denote nothing."""
    for form in _PARSERS:
        if m := form.fullmatch(mask):
            return {name: m.span(name) for name, found in m.groupdict().items() if found is not None}
    return None


def shape_mask(text: Column) -> Column:
    """Mask of a folded text: digits become 9, letters a, everything else stays."""
    return F.regexp_replace(F.regexp_replace(text, r"\p{L}", "a"), "[0-9]", "9")


def _new_year(year: np.ndarray) -> np.ndarray:
    """Days from 1970 to the first of January."""
    return (year - 1970).astype("datetime64[Y]").astype("datetime64[D]").astype("int64")


def _calendar(year: np.ndarray) -> np.ndarray:
    """One of 14 calendars: the weekday of the first of January, and whether it is a leap year."""
    return _new_year(year) % 7 * 2 + (_new_year(year + 1) - _new_year(year) == 366)


_SAME_CALENDAR = np.zeros(14, "int64")
_SAME_CALENDAR[_calendar(np.array(LAST_YEARS))] = np.array(LAST_YEARS)


def _within_tables(local_us: np.ndarray) -> np.ndarray:
    """Local times past the tables moved to the year of the same calendar within them."""
    year = local_us.astype("datetime64[us]").astype("datetime64[Y]").astype("int64") + 1970
    inside = np.where(year > LAST_YEARS[-1], _SAME_CALENDAR[_calendar(year)], year)
    return local_us - (_new_year(year) - _new_year(inside)) * 86_400_000_000


@dataclass(frozen=True)
class ZoneTable:
    """Transitions of a zone in local microseconds, each valid from its threshold on, under a rules version."""

    version: str
    thresholds: np.ndarray
    offsets: np.ndarray

    def offset_us(self, local_us: np.ndarray) -> np.ndarray:
        """Offsets for local times: the first of two readings, and the earlier offset inside a gap."""
        local_us = _within_tables(local_us)
        return self.offsets[np.searchsorted(self.thresholds, local_us, side="right")]


def zone_tables(spark: SparkSession, names: list[str]) -> dict[str, ZoneTable]:
    """Tables of the named zones from the JVM's rules; names it doesn't know are left out."""
    jvm, out = spark.sparkContext._jvm, {}
    zone_id, instant, provider = jvm.java.time.ZoneId, jvm.java.time.Instant, jvm.java.time.zone.ZoneRulesProvider
    known = set(zone_id.getAvailableZoneIds())
    for name in sorted({DEFAULT_ZONE, "UTC", *names} & known):
        rules = zone_id.of(name).getRules()
        at = instant.parse("1999-12-01T00:00:00Z")
        thresholds, offsets = [], [rules.getOffset(at).getTotalSeconds()]
        while (t := rules.nextTransition(at)) is not None and t.toEpochSecond() < (LAST_YEARS[-1] + 2 - 1970) * 31_556_952:
            before, after = t.getOffsetBefore().getTotalSeconds(), t.getOffsetAfter().getTotalSeconds()
            thresholds.append(t.toEpochSecond() + max(before, after))
            offsets.append(after)
            at = t.getInstant()
        version = provider.getVersions(name).lastEntry().getKey()
        out[name] = ZoneTable(str(version), np.array(thresholds, "int64") * 1_000_000, np.array(offsets, "int64") * 1_000_000)
    return out


_FILL = dict.fromkeys(FILLERS, 0)
_AMPM = {"am": 0, "pm": 1, "a.m": 0, "p.m": 1, "a.m.": 0, "p.m.": 1}
_BAD = -(10**9)
_NOTHING = np.iinfo("int64").min


class _Shape:
    """Texts of one mask as a matrix of characters, with the places of their parts."""

    def __init__(self, texts: list[str], parts: dict[str, tuple[int, int]]) -> None:
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(texts), -1)
        self.parts = parts

    def __contains__(self, name: str) -> bool:
        return name in self.parts

    def number(self, name: str) -> np.ndarray:
        """Values of a part that is all digits; 0 where the shape has none."""
        if name not in self.parts:
            return np.zeros(len(self.codes), "int64")
        low, high = self.parts[name]
        return (self.codes[:, low:high].astype("int64") - 48) @ 10 ** np.arange(high - low - 1, -1, -1, dtype="int64")

    def words(self, name: str, known: dict[str, int], missing: int, unknown: int) -> np.ndarray:
        """Codes of the words of a part: `missing` where the shape has none, `unknown` for others."""
        if name not in self.parts:
            return np.full(len(self.codes), missing, "int64")
        low, high = self.parts[name]
        each, at = np.unique(np.ascontiguousarray(self.codes[:, low:high]).view(f"<U{high - low}").ravel(), return_inverse=True)
        return np.array([known.get(str(w).lower(), unknown) for w in each], "int64")[at]


def _convert(texts: list[str], zones: np.ndarray, parts: dict[str, tuple[int, int]], tables: dict[str, ZoneTable]) -> np.ndarray:
    """UTC microseconds of texts of one mask, the least integer where they denote nothing."""
    found = _Shape(texts, parts)
    ok = np.ones(len(texts), bool)
    for f in ("F1", "F2", "F3", "F4", "F5"):
        ok &= found.words(f, _FILL, 0, _BAD) != _BAD
    low = np.int64((FIRST_YEAR - 1970) * 365 + 7) * 86_400_000_000
    if "E" in found:
        digits = parts["E"][1] - parts["E"][0]
        us = found.number("E") * (1000 if digits == 13 else 1_000_000)
        return np.where(ok & (us >= low), us, _NOTHING)
    year = found.number("Y")
    if "K" in found:
        ok &= found.words("W", {"w": 0}, 0, _BAD) != _BAD
        jan4 = (year - 1970).astype("datetime64[Y]").astype("datetime64[D]") + 3
        monday = jan4 - (jan4.astype("int64") + 3) % 7
        week, weekday = found.number("K"), found.number("N")
        days = monday + (week - 1) * 7 + (weekday - 1)
        thursday = monday + (week - 1) * 7 + 3
        ok &= (week >= 1) & (weekday >= 1) & (weekday <= 7) & (thursday.astype("datetime64[Y]").astype("int64") + 1970 == year)
    else:
        month = found.words("B", MONTHS, 0, 0) if "B" in found else found.number("M")
        day = found.number("D")
        ok &= (month >= 1) & (month <= 12) & (day >= 1) & (day <= 31)
        months = ((year - 1970) * 12 + np.where(ok, month, 1) - 1).astype("datetime64[M]")
        days = months.astype("datetime64[D]") + (np.where(ok, day, 1) - 1)
        ok &= days.astype("datetime64[M]") == months
    ok &= year >= FIRST_YEAR
    hour, minute, second = found.number("H"), found.number("I"), found.number("C")
    half = found.words("A", _AMPM, -1, _BAD)
    zone = found.words("Z", ZONES, -9999, _BAD)
    if "A" in found and "Z" not in found:  # one word after the clock may be either
        as_zone = found.words("A", ZONES, -9999, _BAD)
        there = (half == _BAD) & (as_zone != _BAD)
        zone, half = np.where(there, as_zone, zone), np.where(there, -1, half)
    if "Z" in found and "A" not in found:
        as_half = found.words("Z", _AMPM, -1, _BAD)
        there = (zone == _BAD) & (as_half != _BAD)
        half, zone = np.where(there, as_half, half), np.where(there, -9999, zone)
    ok &= (half != _BAD) & (zone != _BAD) & (minute < 60) & (second < 60)
    ok &= np.where(half >= 0, (hour >= 1) & (hour <= 12), hour < 24)
    hour = np.where(half >= 0, hour % 12 + 12 * (half == 1), hour)
    micro = found.number("X") * 10 ** (6 - (parts["X"][1] - parts["X"][0])) if "X" in found else np.zeros(len(texts), "int64")
    local = days.astype("int64") * 86_400_000_000 + (hour * 3600 + minute * 60 + second) * 1_000_000 + micro
    signed = "S" in found
    west = found.codes[:, parts["S"][0]] != ord("+") if signed else False
    east = (found.number("O") * 60 + found.number("P")) * np.where(west, -1, 1)
    ok &= (np.abs(east) < 24 * 60) & (found.number("P") < 60)
    fixed = np.full(len(texts), signed) | (zone != -9999)
    offset = np.where(signed, east, zone) * 60_000_000
    for name in np.unique(zones[~fixed]).tolist():
        here = ~fixed & (zones == name)
        if name in tables:
            offset[here] = tables[name].offset_us(local[here])
        else:
            ok &= ~here
    return np.where(ok, local - offset, _NOTHING)


def _to_utc(tables: dict[str, ZoneTable]):
    @F.pandas_udf("bigint")
    def convert(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, mask, zone in batches:
            out = np.full(len(text), _NOTHING)
            texts, zones = text.tolist(), zone.fillna(DEFAULT_ZONE).to_numpy().astype("U")
            codes, masks = pd.factorize(mask)
            order = np.argsort(codes, kind="stable")
            bounds = np.searchsorted(codes[order], np.arange(len(masks) + 1))
            for k, m in enumerate(masks):
                if (parts := parser_of(m)) is not None:
                    rows = order[bounds[k] : bounds[k + 1]]
                    out[rows] = _convert([texts[r] for r in rows.tolist()], zones[rows], parts, tables)
            yield pd.Series(out, dtype="Int64").mask(out == _NOTHING)

    return convert


def utc_micros(spark: SparkSession, zone_names: list[str]):
    """A function (text, zone name) -> bigint microseconds since 1970 UTC, null where the text denotes no instant.

    Null, empty and very long texts denote nothing; a null zone is Europe/Copenhagen; a zone name unknown to the
    rules denotes nothing unless the text states its own. Years from 2000 on are read.
    """
    convert = _to_utc(zone_tables(spark, zone_names))

    def apply(text: Column, zone: Column) -> Column:
        bare = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
        bare = F.regexp_replace(bare, "([.,][0-9]{6})[0-9]+", "$1")  # digits beyond microseconds are dropped
        short = F.when(F.length(bare) <= 200, bare)  # no form is longer
        return convert(short, shape_mask(short), zone)

    return apply


CANONICAL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"


def normalise_times(df: DataFrame, key: Column, text: Column, zone: Column, zone_names: list[str]) -> DataFrame:
    """Rows (record_key, utc_us) of df whose text denotes an instant and isn't canonical already, each once."""
    to_utc = utc_micros(df.sparkSession, zone_names)
    rows = df.select(key.cast("string").alias("record_key"), text.alias("text"), zone.alias("zone")).filter(F.col("text").isNotNull() & ~F.col("text").rlike(CANONICAL))
    return rows.select("record_key", to_utc(F.col("text"), F.col("zone")).alias("utc_us")).filter("utc_us is not null").distinct()
