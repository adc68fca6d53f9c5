"""Streaming variants: deduplication, sessions, day counts with late rows, keyed health, change feeds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kildestrom.session import fresh_path


def stream_of(spark: SparkSession, path: str, glob: str | None = None, files: int | None = None) -> DataFrame:
    """A stream of parquet files with the schema of those that are there, at most `files` in a micro-batch.

    `glob` names a file of the folder, or a folder of files in it.
    """
    if glob:
        inner = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{glob}")
        system = inner.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if system.exists(inner) and system.getFileStatus(inner).isDirectory():
            path, glob = f"{path}/{glob}", None
    schema = spark.read.option("pathGlobFilter", glob or "*.parquet").parquet(path).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob or "*.parquet")
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def drain(df: DataFrame, name: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what is available, into a written table, and read it.

    In update mode a later micro-batch's rows replace those of equal `keys` and leave the others; in complete mode the
    last batch holds all.
    """
    spark = df.sparkSession
    path, log = fresh_path(spark, name), fresh_path(spark, name + "-log")
    if mode == "append":
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(df.schema).parquet(path)

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("__batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/batch={n}")  # written again, a batch replaces itself

    df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("__batch", T.IntegerType())])).parquet(path)
    if mode == "complete":
        last = rows.agg(F.max("__batch").alias("n")).first().n
        return rows.filter(F.col("__batch") == F.lit(last)).select(*df.columns)
    if not keys:
        raise ValueError("update mode needs the keys of its rows")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), "__batch").alias("__row")).select("__row.*")


def first_per_key(df: DataFrame, key: str, at: str, late: str = "14 days") -> DataFrame:
    """Each key once within the watermark; state is bounded by it."""
    return df.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def session_counts(df: DataFrame, keys: list[str], at: str, gap: str, late: str) -> DataFrame:
    """Rows (keys, start, end, n) of sessions."""
    grouped = df.withWatermark(at, late).groupBy(*keys, F.session_window(at, gap).alias("s")).agg(F.count("*").alias("n"))
    return grouped.select(*keys, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def window_counts(df: DataFrame, keys: list[str], at: str, size: str, late: str) -> DataFrame:
    """Rows (keys, start, n) of fixed windows."""
    grouped = df.withWatermark(at, late).groupBy(*keys, F.window(at, size).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select(*keys, F.col("w.start").alias("start"), "n")


def health_states(df: DataFrame, key: str, order: str, failed: str) -> DataFrame:
    """Rows (key, fails) as they change: failures in a row per key, kept as state."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fails = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(order)
        for bad in rows[failed]:
            fails = fails + 1 if bad else 0
        state.update((fails,))
        yield pd.DataFrame({key: [k[0]], "fails": [fails]})

    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, fails long", "fails long", "update", GroupStateTimeout.NoTimeout)


def split_late(df: DataFrame, at: str, late: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a stream in time, and those more than `late` behind the newest time of earlier micro-batches, as written tables.

    The newest time is kept beside the stream's log, so that a batch that is run again is judged alike.
    """
    spark = df.sparkSession
    path, log = fresh_path(spark, name), fresh_path(spark, name + "-log")

    def newest(before: int) -> object:
        if before == 0:
            return None
        return spark.read.schema("newest timestamp, n int").parquet(*[f"{path}/newest/batch={k}" for k in range(before)]).agg(F.max("newest").alias("m")).first().m

    def keep(batch: DataFrame, n: int) -> None:
        mark = newest(n)
        behind = F.lit(False) if mark is None else F.coalesce(F.col(at) < F.lit(mark) - F.expr(f"interval {late}"), F.lit(False))
        batch.withColumn("__late", behind).write.mode("overwrite").parquet(f"{path}/rows/batch={n}")
        batch.agg(F.max(at).cast("timestamp").alias("newest")).withColumn("n", F.lit(n)).write.mode("overwrite").parquet(f"{path}/newest/batch={n}")

    df.writeStream.foreachBatch(keep).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("__late", T.BooleanType())])).parquet(f"{path}/rows")
    return rows.filter("not __late").select(*df.columns), rows.filter("__late").select(*df.columns)
