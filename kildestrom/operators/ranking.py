"""Rankings, round robin, sampling and unique names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows; Spark keeps n rows a task."""
    return df.orderBy(*order).limit(n)


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of every key; the limit is applied before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def round_robin(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """n rows taken in turns from the keys: all first rows, then all second ones."""
    return top_per(df, keys, order, n).orderBy("rank", *order).limit(n)


def evenly(df: DataFrame, order: list[Column], n: int, total: int) -> DataFrame:
    """n of `total` rows at even distances in order (range-partitioned ranks, no single task)."""
    ranked = with_position(df, order)
    step = F.floor(F.col("position") * n / F.lit(max(total, 1)))
    before = F.floor((F.col("position") - 1) * n / F.lit(max(total, 1)))
    return ranked.filter((F.col("position") == 0) | (step > before)).filter(step < n)


def with_position(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with its zero-based position in the whole order, without a window over one partition."""
    from kildestrom.session import cut

    spread = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = spread.groupBy("__part").agg(F.count("*").alias("n"))
    offsets = counts.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row a partition
    local = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return spread.withColumn("__local", local).join(F.broadcast(offsets), "__part").withColumn("position", F.col("__before") + F.col("__local")).drop("__part", "__local", "__before")


def unique_names(df: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """Names made unique by -2, -3, ... in order."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return df.withColumn(name, F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("-"), n.cast("string"))))
