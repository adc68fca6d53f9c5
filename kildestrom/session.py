"""Session helpers: tables, the shared folder, cutting lineage and size-checked broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it has at most this many rows.
BROADCAST_ROWS = 20_000


def get_spark(cores: str | int = "*", **conf: str) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("kildestrom")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, or a temporary one in local mode where none is set (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        had = sc._jsc.sc().getCheckpointDir()
        if had.isDefined():
            named = had.get()
        else:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = "file://" + tempfile.mkdtemp(prefix="kildestrom-")
            sc.setCheckpointDir(named)
    return named.rstrip("/")


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, whichever it is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path in the shared folder, removed when the driver ends unless kept."""
    path = f"{shared_dir(spark)}/kildestrom/{name}-{uuid.uuid4().hex[:12]}"
    if not keep:
        @atexit.register
        def _drop() -> None:
            with contextlib.suppress(Exception):
                remove_path(spark, path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df once as a table of the shared folder and read it back: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def collect_small(df: DataFrame, most: int, what: str) -> list[Row]:
    """The rows of a parameter table of at most `most` rows; a larger one is an error, nothing is left out."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most:,} {what}")
    return rows


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when df has at most max_rows rows; else leave the join to Spark."""
    return F.broadcast(df) if len(df.limit(max_rows + 1).select(F.lit(1)).take(max_rows + 1)) <= max_rows else df
