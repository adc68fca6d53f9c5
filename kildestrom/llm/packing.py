"""Laying texts into containers of fixed capacity by minimum bin slack.

Per container, subset sums over the lengths at hand are formed as a bitset, starting from the longest item, until the
capacity is reached exactly or no length is left; the fullest combination is taken out. Items are spread over shards of
bounded size, which are filled on their own; what lies in containers with room left is gathered into fewer shards and
filled again, so that shards cost next to nothing.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kildestrom.session import collect_small, cut

#: Items of a shard on average, and how many shards are gathered into one for the second filling.
SHARD_ITEMS, GATHER = 4_000, 16
#: Specs that are filled in one call; a spec table holds a few.
MOST_SPECS = 1_000
#: Containers that are fuller stay as they are in the second filling.
FULL = 0.995


def fill(sizes: Iterable[int], capacity: int) -> list[list[int]]:
    """Containers as lists of item indices, each filled as far as the remaining lengths allow; no item exceeds the capacity."""
    by_length: dict[int, list[int]] = {}
    for k, s in enumerate(sizes):
        by_length.setdefault(int(s), []).append(k)
    lengths = sorted(by_length, reverse=True)
    bins = []
    while lengths:
        taken, room = [lengths[0]], capacity - lengths[0]
        reached, steps = 1, []
        target = 1 << room
        mask = (target << 1) - 1
        for length in lengths:
            if length > room:
                continue
            copies = len(by_length[length]) - (length == taken[0])
            for _ in range(min(copies, room // length if length else copies)):
                more = (reached | (reached << length)) & mask
                if more == reached and length:
                    break
                steps.append((length, reached))
                reached = more
            if reached & target:
                break
        best = reached.bit_length() - 1
        for length, before in reversed(steps):
            if length == 0 or not (before >> best) & 1:
                taken.append(length)
                best -= length
        content = []
        for length in taken:
            content.append(by_length[length].pop())
            if not by_length[length]:
                del by_length[length]
        bins.append(content)
        if any(length not in by_length for length in taken):
            lengths = [x for x in lengths if x in by_length]
    return bins


def _fill_group(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
    bins = fill(group["n_tokens"].to_numpy(), int(group["capacity"].iloc[0]))
    number, load = np.zeros(len(group), "int64"), np.zeros(len(group), "int64")
    sizes = group["n_tokens"].to_numpy()
    for k, content in enumerate(bins):
        number[content] = k
        load[content] = sizes[content].sum()
    prefix = f"{group['level'].iloc[0]}-{group['shard'].iloc[0]}-"
    return group.assign(container=[prefix + str(k) for k in number], load=load)


_PACKED = "spec_id int, capacity bigint, level int, shard bigint, doc_id bigint, piece bigint, n_tokens bigint, container string, load bigint"


def pack(items: DataFrame, specs: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Rows (spec_id, container, doc_id, piece, n_tokens, load): every item (doc_id, n_tokens) in a container of every spec.

    An item longer than the capacity is divided into full containers and a rest; no other is divided. Items without
    tokens take no room and lie in some container; null sizes count as 0. An empty table needs no container.
    """
    size = F.coalesce(F.col("n_tokens"), F.lit(0))
    n = items.count()
    shards = max(1, round(n / shard_items))
    wanted = [F.struct(F.lit(r.spec_id).cast("int").alias("spec_id"), F.lit(r.capacity_tokens).cast("bigint").alias("capacity")) for r in collect_small(specs.filter("capacity_tokens > 0").select("spec_id", "capacity_tokens").distinct(), MOST_SPECS, "container specs")]
    if not wanted:
        wanted = [F.lit(None).cast("struct<spec_id:int,capacity:bigint>")]
    spread = items.select("doc_id", size.alias("n_tokens"), F.explode(F.array(*wanted)).alias("spec")).filter("spec is not null").select("doc_id", "n_tokens", "spec.*")
    pieces = F.greatest(F.ceil(F.col("n_tokens") / F.col("capacity")), F.lit(1)).cast("bigint")
    each = spread.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), pieces - 1)))
    each = each.withColumn("n_tokens", F.least(F.col("capacity"), F.col("n_tokens") - F.col("piece") * F.col("capacity")))
    whole = each.filter("n_tokens = capacity").select(  # a full container needs no search
        "spec_id", "capacity", F.lit(0).alias("level"), F.lit(-1).cast("bigint").alias("shard"), "doc_id", "piece", "n_tokens", F.concat_ws("-", F.lit("whole"), "doc_id", "piece").alias("container"), F.col("n_tokens").alias("load")
    )
    rest = each.filter("n_tokens < capacity").select("spec_id", "capacity", F.lit(1).alias("level"), F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).alias("shard"), "doc_id", "piece", "n_tokens")
    first = cut(rest.groupBy("spec_id", "shard").applyInPandas(_fill_group, _PACKED), "packed")
    loose = first.filter(F.col("load") < FULL * F.col("capacity")).select("spec_id", "capacity", F.lit(2).alias("level"), F.pmod("shard", F.lit(max(1, shards // GATHER))).alias("shard"), "doc_id", "piece", "n_tokens")
    second = loose.groupBy("spec_id", "shard").applyInPandas(_fill_group, _PACKED)
    kept = first.filter(F.col("load") >= FULL * F.col("capacity"))
    return whole.unionByName(kept).unionByName(second).select("spec_id", "capacity", "container", "doc_id", "piece", "n_tokens", "load")


def packing_report(packed: DataFrame) -> DataFrame:
    """Per spec: containers, tokens, the share of room used and the fewest containers that could do."""
    bins = packed.groupBy("spec_id", "capacity", "container").agg(F.sum("n_tokens").alias("tokens"))
    sums = bins.groupBy("spec_id", "capacity").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    return sums.withColumn("filled", F.col("tokens") / (F.col("containers") * F.col("capacity"))).withColumn("at_least", F.ceil(F.col("tokens") / F.col("capacity")))
