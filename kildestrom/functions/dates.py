"""Calendar functions in local time, Copenhagen by default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Europe/Copenhagen"


def local(ts: Column, zone: str = ZONE) -> Column:
    """Wall-clock time of an instant."""
    return F.from_utc_timestamp(ts, zone)


def local_day(ts: Column, zone: str = ZONE) -> Column:
    """Calendar day of an instant."""
    return F.to_date(local(ts, zone))


def day_start(day: Column, zone: str = ZONE) -> Column:
    """Instant at which a calendar day begins."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def iso_week(day: Column) -> Column:
    """Week label such as 2026-W07."""
    thursday = F.date_add(F.date_trunc("week", day).cast("date"), 3)
    return F.format_string("%04d-W%02d", F.year(thursday), F.weekofyear(day))


def month_bounds(day: Column) -> Column:
    """struct<first, last> day of the month."""
    return F.struct(F.trunc(day, "month").alias("first"), F.last_day(day).alias("last"))


def sort_key(published: Column, first_seen: Column, quality: Column, zone: str = ZONE) -> Column:
    """Local time by which items are shown: a date without clock counts from day start, or from its finding that day."""
    day, seen = local_day(published, zone), local(first_seen, zone)
    dated = quality.isin("url", "liste")
    return F.when(dated & (F.to_date(seen) == day), seen).when(dated, day.cast("timestamp")).otherwise(local(published, zone))


def relative_day(day: Column, today: Column) -> Column:
    """'i dag', 'i går', a weekday number within the last week, else the date."""
    ago = F.date_diff(today, day)
    return F.when(ago == 0, "i dag").when(ago == 1, "i går").when((ago > 1) & (ago < 7), F.concat(F.lit("ugedag "), F.weekday(day).cast("string"))).otherwise(F.date_format(day, "yyyy-MM-dd"))


# Month names that stand within texts, in Danish, Swedish and English.
MONTH_WORDS = [
    ("januar", 1), ("januari", 1), ("january", 1), ("februar", 2), ("februari", 2), ("february", 2), ("marts", 3), ("mars", 3), ("march", 3), ("april", 4), ("maj", 5), ("may", 5), ("juni", 6), ("june", 6), ("juli", 7), ("july", 7),
    ("august", 8), ("augusti", 8), ("september", 9), ("oktober", 10), ("october", 10), ("november", 11), ("december", 12),
]
_ISO = r"(?<![0-9])([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})(?![0-9])"
_NUMERIC = r"(?<![0-9])([0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4})(?![0-9])"
_NAMED = r"(?i)(?<![0-9])([0-9]{1,2}\.? (?:" + "|".join(w for w, _ in MONTH_WORDS) + r") [0-9]{4})(?![0-9])"
_LABEL = r"(?i)(?:publiceret|offentliggjort|udgivet|published|publicerad)[:]? *"


def _day_of(text: Column) -> Column:
    """The date of a text in one of the three forms; null if there is no such day."""
    parts = F.split(F.regexp_replace(F.lower(text), r"\.? +|[./-]", " "), " ")
    month = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MONTH_WORDS for x in kv]), parts[1]), parts[1].try_cast("int"))
    first, last = parts[0].try_cast("int"), parts[2].try_cast("int")
    return F.when(F.length(parts[0]) == 4, F.try_make_date(first, month, last)).otherwise(F.try_make_date(last, month, first)) if hasattr(F, "try_make_date") else F.when(
        F.length(parts[0]) == 4, F.to_date(F.try_to_timestamp(F.concat_ws("-", first, F.lpad(month.cast("string"), 2, "0"), F.lpad(last.cast("string"), 2, "0")), F.lit("yyyy-MM-dd")))
    ).otherwise(F.to_date(F.try_to_timestamp(F.concat_ws("-", last, F.lpad(month.cast("string"), 2, "0"), F.lpad(first.cast("string"), 2, "0")), F.lit("yyyy-MM-dd"))))


def plausible(day: Column, today: Column) -> Column:
    """Whether a day lies between 2000 and today."""
    return day.between(F.lit("2000-01-01").cast("date"), today)


def text_date(text: Column, today: Column) -> Column:
    """The day that a text tells: the first plausible one behind a label, else the latest plausible one; null if there is none."""
    any_form = lambda label: F.concat(*[F.regexp_extract_all(text, F.lit(label + p.replace("(?i)", "")) if not p.startswith("(?i)") else F.lit("(?i)" + label.replace("(?i)", "") + p[4:]), 1) for p in (_ISO, _NUMERIC, _NAMED)])
    days = lambda found: F.filter(F.transform(found, _day_of), lambda d: plausible(d, today))
    return F.coalesce(F.get(days(any_form(_LABEL)), F.lit(0)), F.array_max(days(any_form(""))))


def date_quality(day: Column, listed: Column) -> Column:
    """kilde for a day of the page itself, liste for one beside its link, fundet for none."""
    return F.when(day.isNotNull(), "kilde").when(listed.isNotNull(), "liste").otherwise("fundet")
