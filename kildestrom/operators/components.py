"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kildestrom.session import cut

MAX_ROUNDS = 60


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; both keep the components and shorten paths to the least node."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = down.groupBy("u").agg(F.min("v").alias("m"))
    hooks = down.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return hooks.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, component) of every node that has an edge to another one; the component is its least node.

    Edges are undirected; repeats, loops and edges with a null end change nothing. Each round's table is written to
    the shared folder, so the plan doesn't grow and nothing is gathered on the driver but a count and a checksum.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    e = cut(e.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    last = _fingerprint(e)
    for _ in range(MAX_ROUNDS):
        if last[0] == 0:
            break
        e = cut(_stars(e), "edges")
        now = _fingerprint(e)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select("v", "v").toDF("node", "component")).distinct()
