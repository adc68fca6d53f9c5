"""Mixing sources to target shares by Sainte-Laguë apportionment of equal-token blocks.

A mixture is as large as its scarcest source allows within its repeats. It is divided into blocks of equal tokens, which
go to the sources by highest quotients, and each source's blocks to its shards likewise. A shard's documents are laid
out in a seeded order and divided into blocks; its quota is taken as whole passes over all blocks and the first blocks
of one more. A document isn't divided: it belongs to the block that its middle lies in.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kildestrom.session import collect_small, cut

#: Tokens of a block, at most, and blocks of a mixture, at least.
BLOCK_TOKENS, LEAST_BLOCKS = 128, 1_000
#: Tokens of a shard of a source on average.
SHARD_TOKENS = 4_000_000
MIX_ROWS = 100_000


def sainte_lague(weights: list[float], seats: int, most: list[int] | None = None) -> list[int]:
    """Seats by highest quotients weight / (2 k + 1); ties go to the earlier one; nobody gets more than `most`."""
    total = sum(weights)
    if total <= 0 or seats <= 0:
        return [0] * len(weights)
    most = most or [seats] * len(weights)

    def quotients(least: float) -> list[int]:
        """How many quotients of each weight are at least as large."""
        out = []
        for w, m in zip(weights, most, strict=True):
            k = min(m, int((w / least + 1) / 2) + 1) if w > 0 else 0
            while k > 0 and w / (2 * k - 1) < least:
                k -= 1
            out.append(k)
        return out

    # the least quotient that wins, by bisection; what ties there is settled one by one
    low, high = 0.0, 2 * max(weights)
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        if sum(quotients(middle)) > seats:
            low = middle
        else:
            high = middle
    got = quotients(high)
    heap = [(-w / (2 * g + 1), k) for k, (w, g, m) in enumerate(zip(weights, got, most, strict=True)) if w > 0 and g < m]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        if not heap:
            break
        _, k = heapq.heappop(heap)
        got[k] += 1
        if got[k] < most[k]:
            heapq.heappush(heap, (-weights[k] / (2 * got[k] + 1), k))
    return got


def plan(targets: pd.DataFrame, have: dict[str, int]) -> pd.DataFrame:
    """Per mixture and source its quota in tokens; targets has mix_id, source, target_share and max_repeats.

    Sources without text get nothing and the others keep their proportions.
    """
    out = []
    for mix_id, rows in targets.groupby("mix_id", sort=True):
        rows = rows.sort_values("source")
        weights = [float(w) if have.get(s, 0) > 0 and m > 0 else 0.0 for s, w, m in zip(rows["source"], rows["target_share"], rows["max_repeats"], strict=True)]
        total = sum(weights)
        room = [have.get(s, 0) * int(m) for s, m in zip(rows["source"], rows["max_repeats"], strict=True)]
        size = int(min((r * total / w for r, w in zip(room, weights, strict=True) if w > 0), default=0))
        block = max(1, min(BLOCK_TOKENS, size // LEAST_BLOCKS))
        blocks = sainte_lague(weights, size // block, [r // block for r in room])
        for (_, row), n in zip(rows.iterrows(), blocks, strict=True):
            out.append((int(mix_id), row["source"], float(row["target_share"]), int(row["max_repeats"]), block, n))
    return pd.DataFrame(out, columns=["mix_id", "source", "target_share", "max_repeats", "block", "blocks"])


def _by_shard(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("shard")
    block = int(group["block"].iloc[0])
    most = [int(t) * int(m) // block for t, m in zip(group["tokens"], group["max_repeats"], strict=True)]
    seats = sainte_lague([float(t) for t in group["tokens"]], int(group["blocks"].iloc[0]), most)
    return group.assign(quota=[s * block for s in seats])


def mixture(items: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """Rows (mix_id, source, doc_id, n_tokens, copies): the documents of every mixture and how often each comes.

    items has doc_id, source and n_tokens; documents without tokens or source take no part. targets is a small table
    (at most MIX_ROWS rows). No document comes more than max_repeats times.
    """
    sized = items.filter("n_tokens > 0 and source is not null")
    collect_small(targets.select(F.lit(1)), MIX_ROWS, "mix targets")
    wanted = targets.toPandas()
    names = F.broadcast(targets.select("source").distinct())
    sized = cut(sized.join(names, "source", "left_semi").select("doc_id", "source", "n_tokens"), "sized")
    totals = {r.source: r.tokens for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).collect()}  # sources of targets only
    spark = sized.sparkSession
    quotas = plan(wanted, totals)
    quotas["shards"] = [max(1, round(totals.get(s, 0) / SHARD_TOKENS)) for s in quotas["source"]]
    schema = "mix_id int, source string, target_share double, max_repeats int, block bigint, blocks bigint, shards int"
    quota = spark.createDataFrame(quotas, schema) if len(quotas) else spark.createDataFrame([], schema)
    draw = F.xxhash64(F.lit(seed), F.col("mix_id"), F.col("doc_id"))
    rows = sized.join(F.broadcast(quota.filter("blocks > 0")), "source").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.col("shards")))
    shard_sums = rows.groupBy("mix_id", "source", "shard", "max_repeats", "block", "blocks").agg(F.sum("n_tokens").alias("tokens"))
    by_shard = shard_sums.groupBy("mix_id", "source").applyInPandas(_by_shard, "mix_id int, source string, shard bigint, max_repeats int, block bigint, blocks bigint, tokens bigint, quota bigint")
    drawn = rows.join(by_shard.select("mix_id", "source", "shard", "tokens", "quota"), ["mix_id", "source", "shard"])
    order = Window.partitionBy("mix_id", "source", "shard").orderBy(draw, "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passes, part = F.floor(F.col("quota") / F.col("tokens")), F.col("quota") % F.col("tokens")
    inside = F.sum("n_tokens").over(order) - F.col("n_tokens") / 2 <= part  # the half that lies inside decides
    copies = F.least(passes + F.when(inside & (part > 0), 1).otherwise(0), F.col("max_repeats")).cast("int")
    return drawn.withColumn("copies", copies).filter("copies > 0").select("mix_id", "source", "doc_id", "n_tokens", "copies")


def mixture_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mixture and source: target and reached share of tokens, tokens, documents and the most copies of one."""
    sums = mixed.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("n_docs"), F.max("copies").alias("most_copies"))
    whole = sums.groupBy("mix_id").agg(F.sum("tokens").alias("mix_tokens"))
    rows = targets.join(sums, ["mix_id", "source"], "left").join(whole, "mix_id", "left").fillna(0, ["tokens", "n_docs", "most_copies"])
    return rows.select("mix_id", "source", "target_share", F.coalesce(F.col("tokens") / F.col("mix_tokens"), F.lit(0.0)).alias("reached_share"), "tokens", "n_docs", "max_repeats", "most_copies")
