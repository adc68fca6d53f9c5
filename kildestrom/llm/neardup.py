"""Groups of records whose word sets are nearly the same, by BK-trees over word-parity sketches.

A set's sketch has 128 bits; each word flips one of them, so the Hamming distance of two sketches is at most the number
of words that are in one set only. Sets A and B with a similarity of at least s differ in at most (|A| + |B|) (1 - s) /
(1 + s) words, which makes that number a radius that loses nothing. The trees are sharded: similar sets share one of
their rarest words (prefix filtering), so each such word has a tree of its own, and a hot word several of bounded size.
Trees are built and searched where their shard lies instead of being broadcast, as together they hold the whole
collection. Hits are checked exactly, links closed to groups. How often words come is told by a hashed count table of
fixed size, which never counts a word too low: whatever is hot is split.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kildestrom.llm.lookalikes import Canoniser
from kildestrom.llm.words import chunks, count_table, mix, place_of, spread, word_sets
from kildestrom.operators.components import components
from kildestrom.session import cut

SIMILARITY = Fraction(3, 4)
#: Sets in one tree, and queries of one task, on average at most: a hot word gets a grid of trees and blocks of queries.
TREE_SETS = 20_000
#: Rows that are searched together, and pairs of a query and a node that are visited at once.
CHUNK_ROWS, FRONTIER = 50_000, 1_000_000
#: Members of a group that are joined in one task when its pairs are listed.
PAIR_BLOCK = 2_000
BITS = 128


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of rows of sketches."""
    return np.bitwise_count(a[:, 0] ^ b[:, 0]).astype("int64") + np.bitwise_count(a[:, 1] ^ b[:, 1])


class Forest:
    """BK-trees over sketches, one for each shard code, built and searched level by level for all at once."""

    def __init__(self, shard: np.ndarray, sketch: np.ndarray) -> None:
        n = len(shard)
        self.sketch, self.visited = sketch, 0
        parent, edge = np.full(n, -1), np.zeros(n, "int64")
        rest, cell = np.arange(n), shard.astype("int64")
        level_parent, level_edge = np.full(n, -1), np.zeros(n, "int64")
        while len(rest):
            order = np.argsort(cell, kind="stable")
            rest, cell, level_parent, level_edge = rest[order], cell[order], level_parent[order], level_edge[order]
            first = np.r_[True, cell[1:] != cell[:-1]]
            roots = rest[first]
            parent[roots], edge[roots] = level_parent[first], level_edge[first]
            above = roots[np.cumsum(first) - 1][~first]
            rest = rest[~first]
            d = _distance(sketch[rest], sketch[above])
            cell, level_parent, level_edge = above * (BITS + 1) + d, above, d
        roots = np.flatnonzero(parent < 0)
        self.root_of = dict(zip(shard[roots].tolist(), roots.tolist(), strict=True))
        children = np.flatnonzero(parent >= 0)
        inner, number = np.unique(parent[children], return_inverse=True)
        self.inner = np.full(n, -1)  # only nodes with children have a row of edges
        self.inner[inner] = np.arange(len(inner)) * (BITS + 2)
        slot = number * (BITS + 2) + edge[children]
        self.child = children[np.argsort(slot, kind="stable")]
        self.start = np.zeros(len(inner) * (BITS + 2) + 1, "int32")
        np.cumsum(np.bincount(slot, minlength=len(inner) * (BITS + 2)), out=self.start[1:])

    def search(self, root: np.ndarray, sketch: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node, distance) within each query's radius, following only edges that can lead there."""
        queries, nodes, distances = [], [], []
        stack = [(np.arange(len(root)), root)]
        while stack:
            q, at = stack.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                stack += [(q[:half], at[:half]), (q[half:], at[half:])]
                continue
            self.visited += len(q)
            d, r = _distance(sketch[q], self.sketch[at]), radius[q]
            hit = d <= r
            queries.append(q[hit])
            nodes.append(at[hit])
            distances.append(d[hit])
            row = self.inner[at]
            go = row >= 0
            q, d, r, row = q[go], d[go], r[go], row[go]
            low = self.start[row + np.maximum(d - r, 0)]
            count = self.start[row + np.minimum(d + r, BITS) + 1] - low
            go = count > 0
            q, low, count = q[go], low[go], count[go]
            if len(q):
                ends = np.cumsum(count)
                step = np.arange(ends[-1]) - np.repeat(ends - count, count)
                stack.append((np.repeat(q, count), self.child[np.repeat(low, count) + step]))
        none = np.zeros(0, "int64")
        return np.concatenate([*queries, none]), np.concatenate([*nodes, none]), np.concatenate([*distances, none])


def _ceil(x: Fraction, n: np.ndarray) -> np.ndarray:
    return -(-(n * x.numerator) // x.denominator)


_CELLS = "shard bigint, h bigint, s0 bigint, s1 bigint, meta int"


def _prefix_rows(counts: np.ndarray, similarity: Fraction):
    """Arrow batches (h, s0, s1, wh) -> rows (shard, h, s0, s1, meta): each set under each word of its prefix.

    meta holds the set's size times four, plus one if it is a node there, plus two if it is a query. A word with t
    trees has t times t cells: a set is a node of one tree, in the cells of all blocks of queries, and a query of one
    block, in the cells of all trees.
    """
    index = 2 * similarity / (1 + similarity)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # copies in one partition leave once
        for b in batches:
            h, s0 = b["h"].to_numpy(zero_copy_only=False), b["s0"].to_numpy(zero_copy_only=False)
            new = np.zeros(len(h), bool)
            for i, pair in enumerate(zip(h.tolist(), s0.tolist(), strict=True)):
                if pair not in seen:
                    seen.add(pair)
                    new[i] = True
            if len(seen) > 500_000:
                seen.clear()
            b = b.filter(pa.array(new))
            h, s0, s1, lists = h[new], s0[new], b["s1"].to_numpy(zero_copy_only=False), b["wh"]
            size = np.diff(lists.offsets.to_numpy()).astype("int64")
            if not size.sum():
                continue
            w = lists.flatten().to_numpy(zero_copy_only=False)
            of, token, often = np.repeat(np.arange(len(size)), size), spread(w), counts[place_of(w)]
            order = np.lexsort((token, often, of))
            place = np.arange(len(w)) - np.repeat(np.cumsum(size) - size, size)
            probe, node = size - _ceil(similarity, size) + 1, size - _ceil(index, size) + 1
            keep = place < probe[of]
            row, pick, place = of[keep], order[keep], place[keep]
            is_node = (place < node[row]).astype("int64")
            trees = np.maximum(-(-often[pick] // TREE_SETS), 1)
            own = np.abs(h[row] % trees)
            many = np.repeat(np.arange(len(row)), trees)
            other = np.arange(len(many)) - np.repeat(np.cumsum(trees) - trees, trees)
            mine, is_node, word = own[many], is_node[many], token[pick][many]
            cell = lambda tree, block: mix(word + mix(tree.astype("uint64") << np.uint64(32) | block.astype("uint64"))).view("int64")
            apart = (is_node == 1) & (other != mine)
            shard = np.concatenate([cell(other, mine), cell(mine, other)[apart]])  # as a query, as a node
            meta = np.concatenate([size[row][many] * 4 + 2 + (is_node & (other == mine)), size[row][many][apart] * 4 + 1])
            to = row[np.concatenate([many, many[apart]])]
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(h[to]), pa.array(s0[to]), pa.array(s1[to]), pa.array(meta.astype("int32"))], ["shard", "h", "s0", "s1", "meta"])

    return rows


def _size_classes(most: int) -> np.ndarray:
    """Least sizes of classes, each about an eighth wider than the one before, up to `most`."""
    bounds = [1]
    while bounds[-1] <= most:
        bounds.append(max(bounds[-1] + 1, bounds[-1] * 9 // 8))
    return np.array(bounds)


def find_pairs(shard: np.ndarray, h: np.ndarray, s0: np.ndarray, s1: np.ndarray, meta: np.ndarray, similarity: Fraction) -> tuple[tuple[np.ndarray, ...], int, int]:
    """Pairs (ha, sa, hb, sb) of one chunk of cells within the radius, the smaller (size, h, s0) as b; pairs visited and possible."""
    order = np.lexsort((s0, h, shard))
    fresh = np.ones(len(order), bool)
    s, hh, kk = shard[order], h[order], s0[order]
    fresh[1:] = (s[1:] != s[:-1]) | (hh[1:] != hh[:-1]) | (kk[1:] != kk[:-1])  # copies from other partitions
    roles = np.bitwise_or.reduceat(meta[order], np.flatnonzero(fresh))
    keep = order[fresh]
    shard, h, s0, size = shard[keep], h[keep], s0[keep], (roles >> 2).astype("int64")
    bits = np.stack([s0, s1[keep]], axis=1).view("uint64")
    bounds = _size_classes(int(size.max(initial=1)))
    kind = np.searchsorted(bounds, size, side="right")
    code = np.unique(shard, return_inverse=True)[1]
    nodes = np.flatnonzero(roles & 1)
    forest = Forest(code[nodes] * len(bounds) + kind[nodes] - 1, bits[nodes])
    root = np.full((code.max(initial=0) + 1) * len(bounds), -1)
    root[list(forest.root_of)] = list(forest.root_of.values())
    asking = np.flatnonzero(roles & 2)
    least = np.searchsorted(bounds, _ceil(similarity, size[asking]), side="right")
    # a query enters the trees of every size class that may hold a partner of at most its size
    times = kind[asking] - least + 1
    queries = np.repeat(asking, times)
    into = np.repeat(least, times) + np.arange(len(queries)) - np.repeat(np.cumsum(times) - times, times)
    enters = root[code[queries] * len(bounds) + into - 1]
    queries, into, enters = queries[enters >= 0], into[enters >= 0], enters[enters >= 0]
    apart = (1 - similarity) / (1 + similarity)
    largest = np.minimum(np.r_[bounds, bounds[-1] + size.max(initial=1) + 1][into] - 1, size[queries])
    radius = (size[queries] + largest) * apart.numerator // apart.denominator
    q, at, d = forest.search(enters, bits[queries], radius)
    a, b = queries[q], nodes[at]
    ok = (
        (size[b] * similarity.denominator >= size[a] * similarity.numerator)
        & (d * apart.denominator <= (size[a] + size[b]) * apart.numerator)
        & ((size[b] < size[a]) | ((size[b] == size[a]) & ((h[b] < h[a]) | ((h[b] == h[a]) & (s0[b] < s0[a])))))
    )
    a, b = a[ok], b[ok]
    possible = int((np.bincount(code[asking], minlength=len(root)) * np.bincount(code[nodes], minlength=len(root))).sum())
    return (h[a], s0[a], h[b], s0[b]), forest.visited, possible


def _search_rows(similarity: Fraction):
    """Arrow batches of cells sorted by shard -> pairs of different sets within the radius."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        have = 0

        def take(upto: int | None) -> Iterator[pa.RecordBatch]:
            nonlocal held, have
            whole = [np.concatenate([x[k] for x in held]) for k in range(5)]
            n = len(whole[0]) if upto is None else int(np.searchsorted(whole[0], whole[0][-1], side="left"))
            if n:
                found = find_pairs(*[x[:n] for x in whole], similarity)[0]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["ha", "sa", "hb", "sb"])
            held = [[x[n:] for x in whole]]
            have = len(whole[0]) - n

        for b in batches:
            if b.num_rows:
                held.append([b[c].to_numpy(zero_copy_only=False) for c in ("shard", "h", "s0", "s1", "meta")])
                have += b.num_rows
                if have >= CHUNK_ROWS:
                    yield from take(-1)
        if have:
            yield from take(None)

    return rows


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches (key, text) -> (key, h, s0, s1, wh) of the texts that have a word; h sums the words' mixed hashes."""
    canon = Canoniser()
    for b in batches:
        texts = b["text"].to_pylist()
        for start, end in chunks(texts):
            w, size = word_sets(texts[start:end], canon)
            filled = size > 0
            keys, size = b["key"][start:end].filter(pa.array(filled)), size[filled]
            if not len(size):
                continue
            starts = np.cumsum(size) - size
            x = spread(w)
            bit, high = np.left_shift(np.uint64(1), x & np.uint64(63)), (x >> np.uint64(6)) & np.uint64(1) == 1
            s0 = np.bitwise_xor.reduceat(np.where(high, np.uint64(0), bit), starts)
            s1 = np.bitwise_xor.reduceat(np.where(high, bit, np.uint64(0)), starts)
            h = np.add.reduceat(mix(x), starts)
            wh = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype("int32")), pa.array(w))
            yield pa.RecordBatch.from_arrays([keys, *[pa.array(v.view("int64")) for v in (h, s0, s1)], wh], ["key", "h", "s0", "s1", "wh"])


def word_set_table(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The written table (key, h, s0, s1, wh) of the records' word sets: one pass over the texts."""
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.concat_ws(" ", *[F.col(f) for f in fields]).alias("text"))
    sets = rows.mapInArrow(_sketched, f"key {df.schema[key].dataType.simpleString()}, h bigint, s0 bigint, s1 bigint, wh array<int>")
    return cut(sets, "sets")


def near_links(sets: DataFrame, similarity: Fraction = SIMILARITY) -> DataFrame:
    """Links (ha, sa, hb, sb) between different word sets of a written table (key, h, s0, s1, wh), each once."""
    rows = sets.select("h", "s0", "s1", "wh").mapInArrow(_prefix_rows(count_table(sets.select("wh")), similarity), _CELLS)
    near = rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(_search_rows(similarity), "ha bigint, sa bigint, hb bigint, sb bigint").distinct()
    texts = sets.groupBy("h", "s0").agg(F.first("wh").alias("wh"))
    one = texts.select(F.col("h").alias("ha"), F.col("s0").alias("sa"), F.col("wh").alias("wa"))
    two = texts.select(F.col("h").alias("hb"), F.col("s0").alias("sb"), F.col("wh").alias("wb"))
    shared = F.size(F.array_intersect("wa", "wb"))
    pairs = near.join(one, ["ha", "sa"]).join(two, ["hb", "sb"]).withColumn("shared", shared)
    union = F.size("wa") + F.size("wb") - F.col("shared")
    return pairs.filter(F.col("shared") * similarity.denominator >= union * similarity.numerator).select("ha", "sa", "hb", "sb")


def near_groups(df: DataFrame, key: str, fields: list[str], similarity: Fraction = SIMILARITY) -> DataFrame:
    """Rows (key, group): every key with the group of records it belongs to, closed over links; alone it is its own.

    Records are linked if the distinct words of their fields that they share are at least `similarity` of all in
    either. Words are compared by a 32-bit hash within a pair; texts are identified by 128 bits. Null fields count as
    empty; records without a word and records with a null key are left out; exact repeats of a row count once.
    """
    sets = word_set_table(df, key, fields)
    name = lambda h, s: F.concat(F.lpad(F.hex(h), 16, "0"), F.lpad(F.hex(s), 16, "0"))
    links = near_links(sets, similarity).select(name(F.col("ha"), F.col("sa")).alias("a"), name(F.col("hb"), F.col("sb")).alias("b"))
    found = components(links, "a", "b")
    own = sets.select("key", name(F.col("h"), F.col("s0")).alias("node")).distinct()
    return own.join(found, "node", "left").select("key", F.coalesce("component", "node").alias("group"))


def group_pairs(groups: DataFrame) -> DataFrame:
    """Pairs (id_a, id_b) of different keys of one group, the smaller first; a large group is joined block by block."""
    members = groups.distinct()
    sizes = members.groupBy("group").agg(F.count("*").alias("n")).filter("n > 1")
    rows = members.join(sizes, "group").withColumn("blocks", F.ceil(F.col("n") / PAIR_BLOCK).cast("int"))
    a = rows.select("group", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"), F.col("key").alias("id_a"))
    b = rows.select("group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("key").alias("id_b"))
    return a.join(b, ["group", "block"]).filter("id_a < id_b").select("id_a", "id_b").distinct()
