"""Taking entries in: admission, age and future gates, sitemap windows and quotas, due sources and their order, kept state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kildestrom.functions.urls import address_key, host_of
from kildestrom.operators.ranking import top_per
from kildestrom.operators.times import DEFAULT_ZONE, utc_micros

#: Slack for clocks that are ahead.
SLACK = "2 hours"


def admitted(url: Column, title: Column) -> Column:
    """Whether an entry may come in: a web address and a title with a character that isn't blank; nulls are refused."""
    return F.coalesce(F.trim(url).rlike(r"^(?i:https?)://[^/?#\s]") & (F.trim(title) != ""), F.lit(False))


def entry_time(spark: SparkSession, texts: list[Column], zone: Column | None = None, zone_names: list[str] | None = None) -> Column:
    """The instant of the first text that denotes one, of published, updated and created; null if none does."""
    to_utc = utc_micros(spark, zone_names or [])
    return F.timestamp_micros(F.coalesce(*[to_utc(t, F.lit(DEFAULT_ZONE) if zone is None else zone) for t in texts]))


def dated(published: Column, found: Column, max_age_days: int, first_run: Column) -> Column:
    """struct<at, quality, gate>: the time an entry counts from, and whether it is taken, too old or undated on a first run.

    A time more than SLACK ahead of the finding is none. Entries without a time count from their finding, but are left
    out on a first run, when everything old is found at once.
    """
    real = F.when(published <= found + F.expr(f"interval {SLACK}"), published)
    old = real < found - F.expr(f"interval {max_age_days} days")
    gate = F.when(real.isNull() & first_run, "undated").when(F.coalesce(old, F.lit(False)), "old").otherwise("taken")
    return F.struct(F.coalesce(real, found).alias("at"), F.when(real.isNull(), "fundet").otherwise("kilde").alias("quality"), gate.alias("gate"))


def lookback_days(last_ok: Column, today: Column, least: int = 3, most: int = 14, first: int = 14) -> Column:
    """Days to look back: since the last success and one more, within bounds; `first` on a first run."""
    return F.coalesce(F.greatest(F.lit(least), F.least(F.lit(most), F.date_diff(today, last_ok) + 1)), F.lit(first))


def own_host(host: Column, hosts: Column) -> Column:
    """Whether a host is one of an array of hosts or lies below one."""
    return F.exists(hosts, lambda h: (host == h) | host.endswith(F.concat(F.lit("."), h)))


def sitemap_targets(places: DataFrame, sources: DataFrame, seen: DataFrame, match: str, quota: int) -> DataFrame:
    """Rows (source, address, loc, lastmod, rank) of a sitemap's places that are to be fetched, at most `quota` a source.

    places has source, loc and lastmod; sources has source, hosts and since; seen has address. A place must lie on its
    source's hosts, match the pattern, be changed since `since` (or say nothing) and not be seen; one address counts
    once, newest first.
    """
    rows = places.join(sources, "source").filter(own_host(host_of(F.col("loc")), F.col("hosts")) & F.col("loc").rlike(match))
    rows = rows.filter(F.col("lastmod").isNull() | (F.col("lastmod") >= F.col("since"))).withColumn("address", address_key(F.col("loc")))
    one = rows.groupBy("source", "address").agg(F.max("lastmod").alias("lastmod"), F.min("loc").alias("loc"))
    new = one.join(seen.select("address").distinct(), "address", "left_anti")
    return top_per(new, ["source"], [F.col("lastmod").desc_nulls_last(), F.col("address")], quota).select("source", "address", "loc", "lastmod", "rank")


def traversed(maps: DataFrame, urls: DataFrame, own: DataFrame, newest: int) -> DataFrame:
    """Rows (source, loc) behind a sitemap index: of every source's maps on its own hosts the newest are read.

    maps has source, map, lastmod and position; urls has map and loc; own has source and hosts.
    """
    mine = maps.join(own, "source").filter(own_host(host_of(F.col("map")), F.col("hosts")))
    kept = top_per(mine, ["source"], [F.col("lastmod").desc_nulls_last(), F.col("position").desc()], newest)
    return urls.join(kept.select("source", "map"), "map").select("source", "loc").distinct()


# Hours between two visits by method, and of a source in trouble.
EVERY_HOURS = {"rss": 1, "search": 2, "oda": 3, "sitemap": 6, "html": 6}
TROUBLE_HOURS = 24


def due(method: Column, last: Column, now: Column, trouble: Column) -> Column:
    """Whether a source's visit is due, half an hour early at most; one never visited is."""
    every = F.coalesce(F.create_map(*[F.lit(x) for kv in EVERY_HOURS.items() for x in kv])[method], F.lit(TROUBLE_HOURS))
    hours = F.when(trouble, TROUBLE_HOURS).otherwise(every)
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(last) >= hours * 3600 - 1800, F.lit(True))


def keep_referenced(cache: DataFrame, key: str, valid: DataFrame, valid_key: str) -> DataFrame:
    """Rows of a cache that something still refers to."""
    return cache.join(valid.select(F.col(valid_key).alias(key)).distinct(), key, "left_semi")


def keep_recent(cache: DataFrame, at: Column, since: Column) -> DataFrame:
    """Rows of a cache not older than `since`; those whose time can't be read go."""
    return cache.filter(at.isNotNull() & (at >= since))
