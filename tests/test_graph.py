import random

import pytest
from pyspark.sql import functions as F

from kildestrom.operators.components import components
from kildestrom.operators.stories import chain_edges, sessions, star_edges, stories


def _union(pairs):
    p = {}

    def find(x):
        while p.setdefault(x, x) != x:
            x = p[x]
        return x

    for a, b in pairs:
        p[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in p}


def test_components(spark):
    r = random.Random(1)
    pairs = [(f"n{r.randrange(300):03}", f"n{r.randrange(300):03}") for _ in range(220)]
    pairs += [(f"p{k:03}", f"p{k + 1:03}") for k in range(60)] + [("hub", f"h{k:03}") for k in range(100)] + [(None, "x"), ("y", "y")]
    got = {x.node: x.component for x in components(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()}
    roots = _union([(a, b) for a, b in pairs if a and b and a != b])
    least = {}
    for n, c in roots.items():
        least[c] = min(n, least.get(c, n))
    assert got == {n: least[c] for n, c in roots.items()}
    assert components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def test_stories_peel_by_age(spark):
    rows = [("a", "k", 0, 0), ("b", "k", 1, 2), ("c", "k", 1, 4), ("d", "k", 0, 6), ("e", "k", 1, 9), ("f", "x", 1, 1)]
    df = spark.createDataFrame(rows, "id string, key string, rank int, d int").withColumn("at", F.timestamp_seconds(F.col("d") * 86400))
    edges = chain_edges(df, ["key"], "id", "at", "3 days")
    assert {(x.a, x.b) for x in edges.collect()} == {("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")}
    got = {x.node: x.story for x in stories(df, edges, "id", F.col("rank"), "at").collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "f"}
    assert {x.id: x.session for x in sessions(df, ["key"], "at", "2 days").collect()} == {"a": 0, "b": 0, "c": 0, "d": 0, "e": 1, "f": 0}
    assert {(x.a, x.b) for x in star_edges(df, ["key"], "id").collect()} == {("a", x) for x in "bcde"}


def _slow_stories(items, pairs, max_age):
    """Stories by the definition: pairwise edges, components of what is left, peeled around the least item."""
    left, out = dict(items), {}
    while left:
        part = {n: n for n in left}

        def root(n, part=part):
            while part[n] != n:
                n = part[n]
            return n

        for a, b in pairs:
            if a in left and b in left:
                part[root(a)] = root(b)
        groups = {}
        for n in left:
            groups.setdefault(root(n), []).append(n)
        for nodes in groups.values():
            main = min(nodes, key=lambda n: (left[n][0], left[n][1], n))
            inside = {n for n in nodes if abs(left[n][1] - left[main][1]) <= max_age}
            found, stack = {main}, [main]
            while stack:
                x = stack.pop()
                for a, b in pairs:
                    for u, v in ((a, b), (b, a)):
                        if u == x and v in inside and v not in found:
                            found.add(v)
                            stack.append(v)
            out |= dict.fromkeys(found, main)
        left = {n: v for n, v in left.items() if n not in out}
    return out


@pytest.mark.parametrize("task_rows", [1_000_000, 0])
def test_stories_equal_pairwise_definition(spark, task_rows):
    r = random.Random(9)
    day = 86_400
    rows = [(f"n{k:02}", f"t{r.randrange(4)}", r.randrange(3), r.randrange(0, 40 * day)) for k in range(60)]
    hints = [(f"n{r.randrange(60):02}", f"n{r.randrange(60):02}") for _ in range(6)]
    pairs = [(a[0], b[0]) for i, a in enumerate(rows) for b in rows[:i] if a[1] == b[1] and abs(a[3] - b[3]) <= 3 * day] + [(a, b) for a, b in hints if a != b]
    want = _slow_stories({n: (rank, at) for n, _, rank, at in rows}, pairs, 7 * day)
    df = spark.createDataFrame(rows, "id string, key string, rank int, s long").withColumn("at", F.timestamp_seconds("s"))
    edges = chain_edges(df, ["key"], "id", "at", "3 days").unionByName(spark.createDataFrame(hints, "a string, b string"))
    got = {x.node: x.story for x in stories(df, edges, "id", F.col("rank"), "at", task_rows=task_rows).collect()}
    assert got == want
