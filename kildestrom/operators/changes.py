"""Applying a stream of inserts, updates and deletes as a signed multiset of row images.

Every distinct change contributes its after-image with multiplicity +1 and the image it replaces, its before-image,
with -1. Summed with the base table's own rows (+1 each), all images but the valid one of each key cancel out. The sum
is associative, so it is formed twice: first inside shards of each key, which spreads a key that holds any share of all
lines, then over the at most `shards` images that each key has left. A deletion is an image as well (a tombstone), so
that it survives the first sum; tombstones leave at the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def _net(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sum the signed images of rows (keys, version, seq, alive) in version order within keys; keep positive ones."""
    image = F.struct("version", "seq", "alive")
    order = [F.col("version").asc_nulls_first(), F.col("seq").asc_nulls_first()]
    before = F.lag(image).over(Window.partitionBy(*keys).orderBy(*order))
    signed = F.explode(F.array(F.struct(image.alias("image"), F.lit(1).alias("m")), F.struct(F.col("before").alias("image"), F.lit(-1).alias("m"))))
    return (
        rows.withColumn("before", before)
        .select(*keys, signed.alias("s"))
        .filter("s.image is not null")
        .groupBy(*keys, "s.image")
        .agg(F.sum("s.m").alias("m"))
        .filter("m > 0")
        .select(*keys, "image.*")
    )


def _changes(lines: DataFrame, key: str, version: str, seq: str, deleted: Column, ignore: Sequence[str]) -> DataFrame:
    content = [F.col(f"`{c}`") for c in lines.columns if c not in {seq, *ignore}]
    return lines.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("key"),
        F.col(version).alias("version"),
        F.col(seq).alias("seq"),
        (~F.coalesce(deleted, F.lit(False))).alias("alive"),
        F.md5(F.to_json(F.struct(*content), {"ignoreNullFields": "false"})).alias("content"),
    )


def live_images(lines: DataFrame, key: str = "id", version: str = "updated", seq: str = "seq", deleted: str = "deleted", ignore: Sequence[str] = ("arrived",), base: DataFrame | None = None, shards: int | None = None) -> DataFrame:
    """Keys alive after all lines, with the seq of the line that holds: columns (key, seq).

    Lines equal in all columns but `seq` and `ignore` are one change with the lowest seq. Changes of a key are ordered
    by (version, seq), nulls first, whatever the order of arrival. `base` has the columns of `lines` and holds rows of
    the table as it was. Lines without a key are void; a null `deleted` writes; an empty table yields no rows; an image
    for an unknown key inserts it and deleting an unknown key does nothing. A key's changes are summed in `shards` parts
    first, as many as the session has shuffle partitions, so a hot key has a whole cluster's tasks.
    """
    shards = shards or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _changes(lines, key, version, seq, F.col(deleted), ignore)
    if base is not None:
        rows = rows.unionByName(_changes(base, key, version, seq, F.lit(False), ignore))
    shard = F.pmod(F.xxhash64("content"), F.lit(shards)).cast("int")
    distinct = (
        rows.withColumn("shard", shard)
        .repartition("key", "shard")  # one exchange serves the distinct, the window and the sum
        .groupBy("key", "shard", "content", "version", "alive")
        .agg(F.min("seq").alias("seq"))
    )
    partial = _net(distinct, ["key", "shard"])
    return _net(partial.drop("shard"), ["key"]).filter("alive").select("key", "seq")


def apply_changes(lines: DataFrame, key: str = "id", seq: str = "seq", base: DataFrame | None = None, **options: object) -> DataFrame:
    """The table rebuilt: whole rows of `lines` (and `base`) that `live_images` retains; `seq` identifies a line."""
    live = live_images(lines, key=key, seq=seq, base=base, **options).select(F.col("key").alias("__key"), F.col("seq").alias("__seq"))
    rows = lines if base is None else base.unionByName(lines, allowMissingColumns=True)
    return rows.join(live, (rows[key] == live["__key"]) & rows[seq].eqNullSafe(live["__seq"]), "left_semi").dropDuplicates([key])
