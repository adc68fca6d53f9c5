"""Health of sources from their outcomes in order, as runs of failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def failures_in_row(df: DataFrame, key: str, order: Column, failed: Column, red_after: int = 5) -> DataFrame:
    """Rows (key, fails, health): failures since the last success; red from `red_after`, yellow from one, else green.

    Two pre-aggregated steps instead of a window: the last success of a key, then the failures after it.
    """
    rows = df.select(key, F.struct(order).alias("at"), failed.alias("failed"))
    ok = rows.groupBy(key).agg(F.max(F.when(~F.col("failed"), F.col("at"))).alias("ok"))
    after = rows.join(ok, key).filter("failed and (ok is null or at > ok)").groupBy(key).agg(F.count("*").alias("fails"))
    all_ = ok.select(key).join(after, key, "left").fillna(0, ["fails"])
    return all_.withColumn("health", F.when(F.col("fails") >= red_after, "roed").when(F.col("fails") > 0, "gul").otherwise("groen"))
