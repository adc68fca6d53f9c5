"""Queries of the general training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kildestrom.operators.changes import apply_changes, live_images
from kildestrom.operators.times import CANONICAL, DEFAULT_ZONE, utc_micros
from kildestrom.session import collect_small, small_side, table

#: Zone names that are looked up on the driver.
MOST_ZONES = 1_000


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timeline events alive after all lines, with the line that holds."""
    return live_images(table(spark, sf_dir, "timeline_line")).select(F.col("key").alias("id"), "seq")


def p1_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rebuilt timeline: the valid line of each event alive, whole."""
    rows = apply_changes(table(spark, sf_dir, "timeline_line"))
    return rows.select("id", "seq", F.col("day").cast("string").alias("day"), "level", "title", F.size("items").alias("n_items"), "updated")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTC microseconds of every time text that denotes an instant and isn't in canonical form."""
    sources = table(spark, sf_dir, "feed_source").select(F.col("id").alias("sid"), "zone_name")
    names = [r.zone_name for r in collect_small(sources.select("zone_name").filter("zone_name is not null").distinct(), MOST_ZONES, "zone names")]
    to_utc = utc_micros(spark, names)
    quality = F.coalesce(F.lower(F.trim(F.regexp_replace("date_quality", r"(?U)\s+", " "))), F.lit("")) != "fundet"

    def feed(name: str, key: str, source: str) -> DataFrame:
        rows = table(spark, sf_dir, name).filter(quality).filter(F.col("published").isNotNull() & ~F.col("published").rlike(CANONICAL))
        rows = rows.select(F.col(key).cast("string").alias("record_key"), F.col("published").alias("text"), F.col(source).alias("sid"))
        return rows.join(small_side(sources), "sid", "left").select(F.lit(name).alias("record_table"), "record_key", "text", "zone_name", F.lit(None).cast("string").alias("instead"))

    oda = table(spark, sf_dir, "oda_document").select(
        F.lit("oda_document").alias("record_table"), F.col("id").cast("string").alias("record_key"), F.col("frigivelsesdato").alias("text"), F.lit(DEFAULT_ZONE).alias("zone_name"), F.col("dato").alias("instead")
    )
    first = feed("candidate", "id", "source").unionByName(feed("raw_entry", "ord", "source_id")).unionByName(oda)
    # one conversion for both texts of a parliament document: the second stands in where the first denotes nothing
    texts = first.select("record_table", "record_key", "zone_name", F.posexplode(F.when(F.col("instead").isNull(), F.array("text")).otherwise(F.array("text", "instead"))).alias("nth", "text"))
    read = texts.withColumn("utc_us", to_utc(F.col("text"), F.col("zone_name"))).filter("utc_us is not null")
    best = read.groupBy("record_table", "record_key").agg(F.min_by(F.struct("text", "utc_us"), F.struct("nth", "utc_us")).alias("b"))
    return best.filter(~F.col("b.text").rlike(CANONICAL)).select("record_table", "record_key", "b.utc_us")


QUERIES = {"p1_found": p1_found, "p1_rebuilt": p1_rebuilt, "p4_found": p4_found}

_LIVE = """
with changes as (select * exclude (arrived, seq), min(seq) as seq from timeline_line where id is not null group by all),
last as (select *, row_number() over (partition by id order by updated desc nulls last, seq desc nulls last) as rn from changes)
"""
ORACLE = {
    "p1_found": _LIVE + "select id, seq from last where rn = 1 and not coalesce(deleted, false)",
    "p1_rebuilt": _LIVE + "select id, seq, cast(day as varchar) as day, level, title, cast(coalesce(len(items), -1) as int) as n_items, updated from last where rn = 1 and not coalesce(deleted, false)",
}
