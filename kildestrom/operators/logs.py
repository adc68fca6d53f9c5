"""Append-only logs and keyed tables: latest line per key, merges of versions, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key by `order`; pre-aggregated before the shuffle, so a hot key costs one row a task.

    Rows with a null key are void; ties leave one of the rows that are equal in order.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    best = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(whole, F.struct(*order)).alias("__row"))
    return best.select("__row.*")


def first(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key by `order`."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    best = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(whole, F.struct(*order)).alias("__row"))
    return best.select("__row.*")


def newest_value(sides: list[DataFrame], key: str, value: str, at: str) -> DataFrame:
    """Rows (key, value) with the newest value over several logs; at equal times the later side wins, nulls don't count."""
    union = None
    for rank, df in enumerate(sides):
        part = df.filter(F.col(value).isNotNull()).select(key, value, at, F.lit(rank).alias("__rank"))
        union = part if union is None else union.unionByName(part)
    return union.groupBy(key).agg(F.max_by(value, F.struct(at, "__rank", value)).alias(value))


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of both tables, those of `rows` replacing equal keys."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows.dropDuplicates([key]))


def merge_keeping_first(table: DataFrame, rows: DataFrame, key: str, kept: list[str], at: str, cutoff: Column) -> DataFrame:
    """Full outer merge: columns `kept` stay as first stored, the others are refreshed; rows before the cutoff go."""
    a, b = table.alias("a"), rows.alias("b")
    other = [c for c in table.columns if c != key]
    merged = a.join(b, key, "full").select(key, *[(F.coalesce(f"a.{c}", f"b.{c}") if c in kept else F.coalesce(f"b.{c}", f"a.{c}")).alias(c) for c in other])
    return merged.filter(F.col(at) >= cutoff)
