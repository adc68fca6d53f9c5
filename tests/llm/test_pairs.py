import collections
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kildestrom.llm.history import RunStore, entries, take_in_order, word_distance
from kildestrom.llm.lookalikes import Canoniser
from kildestrom.llm.neardup import Forest, group_pairs, near_groups
from kildestrom.llm.words import word_sets
from kildestrom.session import cut, table

DATA = "/root/testdata/sf0.001"
W = re.compile(r"[^\W_]+")


def _words(text):
    return W.findall(Canoniser()(text)[0].lower())


def _groups(rows):
    parent = {k: k for k, s in rows if s}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    live = [(k, s) for k, s in rows if s]
    for i, (a, s) in enumerate(live):
        for b, t in live[:i]:
            if 4 * len(s & t) >= 3 * len(s | t):
                parent[find(a)] = find(b)
    out = collections.defaultdict(set)
    for k, _ in live:
        out[find(k)].add(k)
    return {frozenset(v) for v in out.values()}


def test_forest_equals_all_distances():
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, (40, 2), dtype="uint64")
    sketch = np.concatenate([base ^ np.stack([np.uint64(1) << r.integers(0, 63, 40).astype("uint64"), np.zeros(40, "uint64")], axis=1) for _ in range(8)])
    shard = r.integers(0, 3, len(sketch))
    forest = Forest(shard, sketch)
    root = np.array([forest.root_of[s] for s in shard.tolist()])
    q, at, d = forest.search(root, sketch, np.full(len(sketch), 4))
    far = lambda i, j: sum(int(x).bit_count() for x in sketch[i] ^ sketch[j])
    assert {(i, j): x for i, j, x in zip(q.tolist(), at.tolist(), d.tolist(), strict=True)} == {(i, j): far(i, j) for i in range(len(sketch)) for j in range(len(sketch)) if shard[i] == shard[j] and far(i, j) <= 4}
    assert forest.visited < sum(int(n) ** 2 for n in np.bincount(shard))  # edges are left out


def test_word_sets_equal_regular_expressions():
    texts = ["Én to, TO\u200b tre_fire", "", "ＡＢ x\u0301y 7½", "İstanbul ΣΑΣ", "a" * 5000 + " b"]
    hashes, size = word_sets(list(texts), Canoniser())
    assert size.tolist() == [len(set(_words(t))) for t in texts]
    again, _ = word_sets([" ".join(sorted(set(_words(t)))) for t in texts], Canoniser())
    assert hashes.tolist() == again.tolist()


def test_near_groups_equal_brute_force(spark):
    r = random.Random(3)
    vocabulary = [f"ord{k}" for k in range(60)]
    rows = [("e1", None, None), ("e2", "", "!!")]
    for k in range(160):
        words = r.sample(vocabulary, r.randrange(1, 24))
        for m in range(r.choice([1, 1, 2, 4])):
            own = list(words)
            for _ in range(m):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            rows.append((f"i{k:03}{m}", " ".join(own[:3]), " ".join(own[3:]) or None))
    rows += [(f"h{k}", "samme tekst igen", "og igen") for k in range(120)] + rows[5:20]  # a hot group and repeated rows
    df = spark.createDataFrame(rows, "id string, title string, teaser string").withColumn("key", F.lit("clash")).withColumn("h", F.lit(0))
    got = collections.defaultdict(set)
    for x in near_groups(df, "id", ["title", "teaser"]).collect():
        got[x.group].add(x.key)
    sets = {k: frozenset(_words(f"{a or ''} {b or ''}")) for k, a, b in rows}
    assert {frozenset(v) for v in got.values()} == _groups(list(sets.items()))
    assert near_groups(df.filter("false"), "id", ["title", "teaser"]).count() == 0


def test_hot_words_are_spread_over_trees(spark, monkeypatch):
    import kildestrom.llm.neardup as m

    monkeypatch.setattr(m, "TREE_SETS", 20)
    rows = [(f"k{i:03}", f"alle deler disse fire ord {i % 50} {i % 7}") for i in range(200)]
    df = spark.createDataFrame(rows, "id string, t string")
    got = collections.defaultdict(set)
    for x in near_groups(df, "id", ["t"]).collect():
        got[x.group].add(x.key)
    assert {frozenset(v) for v in got.values()} == _groups([(k, frozenset(_words(t))) for k, t in rows])


def test_pairs_of_a_large_group_come_block_by_block(spark, monkeypatch):
    import kildestrom.llm.neardup as m

    monkeypatch.setattr(m, "PAIR_BLOCK", 7)
    rows = [(f"k{i:02}", "g") for i in range(40)] + [("x", "h"), ("y", "h"), ("y", "h"), ("z", "alone")]
    got = [(r.id_a, r.id_b) for r in group_pairs(spark.createDataFrame(rows, "key string, group string")).collect()]
    assert len(got) == len(set(got)) == 40 * 39 // 2 + 1 and ("x", "y") in got


def _lev(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        e = [i]
        for j, y in enumerate(b, 1):
            e.append(min(d[j] + 1, e[-1] + 1, d[j - 1] + (x != y)))
        d = e
    return d[-1]


def test_word_distance(spark):
    r = random.Random(5)
    rows = [([r.randrange(6) for _ in range(r.randrange(0, 9))], [r.randrange(6) for _ in range(r.randrange(0, 9))]) for _ in range(200)]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>")
    for x in df.select("a", "b", word_distance(F.col("a"), F.col("b")).alias("d")).collect():
        assert x.d == _lev(x.a, x.b)


def _titles(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{c}{k}" for c in "abc" for k in "xyz"] + ["og", "i", "på", "til", "fra"]
    rows = []
    for k in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randrange(3, 9))] + r.choice([[], ["7"], ["12"]])
        rows.append((k, f"https://a.example/{r.randrange(4 * n)}", " ".join(words)))
        if r.random() < 0.4:
            for _ in range(r.randrange(0, 3)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            rows.append((n + k, f"http://www.a.example/{r.randrange(4 * n)}/?utm_x=1", " ".join(words).upper() + " | A Kilde"))
    return rows + [(3 * n, None, None), (3 * n + 1, "", "")]


def _found(rows):
    read = []
    for ord_, url, title in sorted(rows, key=lambda x: x[0]):
        words = tuple(W.findall(re.sub(r" \| a kilde$", "", (title or "").lower())))
        read.append((ord_, re.sub(r"^https?://(www\.)?|/?\?.*$", "", url or ""), words, sorted(re.findall(r"\d+", " ".join(words)))))
    out = set()
    for k, (o, u, w, n) in enumerate(read):
        for o2, u2, w2, n2 in read[:k]:
            if o2 < o and (u and u == u2 or w and w2 and (w == w2 or n == n2 and _lev(w, w2) <= 2)):
                out.add(o)
                break
    return out


@pytest.mark.parametrize("hot", [10_000, 1])
def test_batches_equal_brute_force_at_once_and_one_by_one(spark, hot):
    rows = _titles(4, 120)
    names = spark.createDataFrame([("A Kilde",), (None,)], "name string")
    df = spark.createDataFrame(rows, "ord bigint, url string, title string").withColumn("t1", F.lit("clash"))
    want = _found(rows)
    store = RunStore(spark, 4, hot_key=hot)
    assert {r.ord for r in take_in_order(store, df, [(0, 10**6)], names).collect()} == want
    store.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("kildestrom_run_")]
    store = RunStore(spark, 4, max_runs=2, hot_key=hot)
    assert {r.ord for r in take_in_order(store, df, [(0, 59), (60, 129), (130, 180), (181, 10**6)], names).collect()} == want
    assert len(store.runs) <= 2  # runs were compacted on the way
    assert take_in_order(store, df.filter("false"), [(0, 9)], names).count() == 0
    store.close()


def test_history_is_not_shuffled_for_a_batch(spark, monkeypatch):
    import kildestrom.llm.history as m

    names = spark.createDataFrame([("A Kilde",)], "name string")
    df = spark.createDataFrame(_titles(6, 60), "ord bigint, url string, title string")
    read = lambda part: cut(entries(part, F.col("ord"), F.col("url"), F.col("title"), names), "e")
    store, plans = RunStore(spark, 4), []
    store.add(read(df.filter("ord < 40")))
    old = store.runs[0]
    monkeypatch.setattr(m, "cut", lambda d, name: plans.append(d._jdf.queryExecution().executedPlan().toString()) or cut(d, name))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # a batch too large to be broadcast
    try:
        store.take(read(df.filter("ord >= 40")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    met = [p for p in plans if old.keys in p]
    assert met and all("SortMergeJoin" in p and p.count("Exchange hashpartitioning(key") == 0 for p in met)
    store.close()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_registered_query_equals_brute_force(spark):
    from kildestrom.llm.queries import p2_found

    rows = {r.id: frozenset(_words(f"{r.title or ''} {r.teaser or ''}")) for r in table(spark, DATA, "candidate").select("id", "title", "teaser").collect()}
    want = {(a, b) for g in _groups(list(rows.items())) for a in g for b in g if a < b}
    assert {(r.id_a, r.id_b) for r in p2_found(spark, DATA).collect()} == want
