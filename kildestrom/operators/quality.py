"""Validation: rules as columns, their failures as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def failures(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """Rows (key, rule) for every rule that a row breaks; a rule that is null holds."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(test, F.lit(True)), F.lit(name)) for name, test in rules.items()]))
    return df.select(key, F.explode(broken).alias("rule"))


def missing(df: DataFrame, key: str, ref: str, known: DataFrame, known_key: str, rule: str) -> DataFrame:
    """Rows (key, rule) whose reference is not among the known."""
    ids = known.select(F.col(known_key).alias(ref)).distinct()
    return df.filter(F.col(ref).isNotNull()).join(ids, ref, "left_anti").select(key, F.lit(rule).alias("rule"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Rows (key, n) of keys that come more than once."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
