"""Stories: items with one title within a few days, or tied by hints, held together by age around a main item."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kildestrom.operators.components import components
from kildestrom.session import cut


def sessions(df: DataFrame, keys: list[str], at: str, gap: str) -> DataFrame:
    """df with `session`, numbered per keys: a row more than `gap` after the one before starts a new one."""
    w = Window.partitionBy(*keys).orderBy(F.col(at))
    fresh = (F.col(at) > F.lag(at).over(w) + F.expr(f"interval {gap}")).cast("int")
    return df.withColumn("session", F.sum(F.coalesce(fresh, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def chain_edges(df: DataFrame, keys: list[str], node: str, at: str, gap: str) -> DataFrame:
    """Edges (a, b) that connect the rows of equal keys whose neighbours in time are at most `gap` apart.

    Time is divided into stretches of `gap`: all rows of one are near enough and tied to its first and its last row, and
    the last row of a stretch to the first of the next one if they are near. Cut off at any two times, what remains is
    still connected if the neighbours are. Stretches are aggregated before the shuffle, so a hot key costs no task all its rows.
    """
    rows = df.filter(F.col(at).isNotNull()).select(*keys, F.col(node).alias("b"), F.unix_micros(F.col(at)).alias("__at"))
    length = F.unix_micros(F.lit("1970-01-01").cast("timestamp") + F.expr(f"interval {gap}"))
    rows = rows.withColumn("__stretch", F.floor(F.col("__at") / length))
    ends = rows.groupBy(*keys, "__stretch").agg(F.min(F.struct("__at", "b")).alias("__first"), F.max(F.struct("__at", "b")).alias("__last"), F.count("*").alias("__n"))
    tied = rows.join(ends.filter("__n > 1"), [*keys, "__stretch"]).select(F.explode(F.array("__first.b", "__last.b")).alias("a"), "b")
    before = F.lag("__last").over(Window.partitionBy(*keys).orderBy("__stretch"))  # a row a stretch
    across = ends.select("__first", before.alias("__before")).filter(F.col("__first.__at") - F.col("__before.__at") <= length).select(F.col("__before.b").alias("a"), F.col("__first.b").alias("b"))
    return tied.unionByName(across).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def star_edges(df: DataFrame, keys: list[str], node: str) -> DataFrame:
    """Edges (a, b) from the least node of equal keys to the others."""
    least = df.groupBy(*keys).agg(F.min(node).alias("a"), F.count("*").alias("n")).filter("n > 1")
    return df.join(least, keys).filter(F.col("a") != F.col(node)).select("a", F.col(node).alias("b"))


def hint_edges(df: DataFrame, node: str, hint: str) -> DataFrame:
    """Edges (a, b) from rows to the row that they name, if there is one."""
    ids = df.select(F.col(node).alias("a")).distinct()
    return df.filter(F.col(hint).isNotNull()).select(F.col(node).alias("b"), F.col(hint).alias("a")).join(ids, "a", "left_semi").filter("a <> b").select("a", "b")


def _peel(max_age_us: int):
    def split(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.drop_duplicates("node").sort_values(["rank", "at", "node"])
        at = dict(zip(rows["node"], rows["at"], strict=True))
        near: dict[str, list[str]] = {n: [] for n in at}
        for n, other in zip(group["node"], group["other"], strict=True):
            if other in near and other != n:
                near[n].append(other)
                near[other].append(n)
        story: dict[str, str] = {}
        for main in rows["node"]:  # each is the least of what is left of its component
            if main in story:
                continue
            story[main], stack = main, [main]
            while stack:
                for n in near[stack.pop()]:
                    if n not in story and abs(at[n] - at[main]) <= max_age_us:
                        story[n] = main
                        stack.append(n)
        return pd.DataFrame(list(story.items()), columns=["node", "story"])

    return split


#: Nodes and edges of a component that is peeled in one task; larger ones are peeled by joins, story after story at once.
TASK_ROWS = 1_000_000


def _peel_by_joins(nodes: DataFrame, edges: DataFrame, max_age_us: int) -> DataFrame:
    """The same for components of any size: in each round every component of what is left gives its main item's story."""
    out, left, ties = None, nodes, edges
    while left.take(1):
        found = components(ties, "a", "b").withColumnRenamed("component", "c")
        named = left.join(found, "node", "left").withColumn("c", F.coalesce("c", "node"))
        mains = named.groupBy("c").agg(F.min(F.struct("rank", "at", "node")).alias("m"))
        inside = cut(named.join(mains, "c").filter(F.abs(F.col("at") - F.col("m.at")) <= max_age_us).select("node", F.col("m.node").alias("story")), "inside")
        one, two = inside.select(F.col("node").alias("a"), F.col("story").alias("sa")), inside.select(F.col("node").alias("b"), F.col("story").alias("sb"))
        close = components(ties.join(one, "a").join(two, "b").filter("sa = sb").select("a", "b"), "a", "b")
        placed = inside.join(close, "node", "left").withColumn("component", F.coalesce("component", "node"))
        own = placed.filter("node = story").select("story", F.col("component").alias("of"))
        done = cut(placed.join(own, "story").filter("component = of").select("node", "story"), "stories")
        out = done if out is None else out.unionByName(done)
        left = cut(left.join(done, "node", "left_anti"), "left")
        gone = done.select("node")
        ties = cut(ties.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti"), "ties")
    return out if out is not None else nodes.select("node", F.col("node").alias("story"))


def stories(items: DataFrame, edges: DataFrame, node: str, rank: Column, at: str, max_age_days: int = 7, task_rows: int = TASK_ROWS) -> DataFrame:
    """Rows (node, story): every item with the main item of its story.

    The main item of a component is the least by (rank, time, node); items beyond max_age of it, or tied to it only
    through such, form stories of their own in the same way. Edges between items further apart than twice max_age can
    be in no story and go first. Items without a time are alone.
    """
    age = max_age_days * 86_400_000_000
    facts = items.select(F.col(node).alias("node"), rank.alias("rank"), F.unix_micros(F.col(at)).alias("at")).dropDuplicates(["node"])
    when = facts.filter("at is not null").select("node", "at")
    near = edges.join(when.select(F.col("node").alias("a"), F.col("at").alias("at_a")), "a").join(when.select(F.col("node").alias("b"), F.col("at").alias("at_b")), "b")
    near = cut(near.filter((F.col("a") != F.col("b")) & (F.abs(F.col("at_a") - F.col("at_b")) <= 2 * age)).select("a", "b").distinct(), "near")
    found = components(near, "a", "b")
    rows = cut(found.join(facts, "node").join(near.select(F.col("a").alias("node"), F.col("b").alias("other")), "node", "left").select("component", "node", "rank", "at", "other"), "tied")
    large = cut(rows.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > task_rows).select("component"), "large")
    kept = rows.join(large, "component", "left_anti").groupBy("component").applyInPandas(_peel(age), "node string, story string")
    if large.take(1):
        nodes = rows.join(large, "component", "left_semi")
        ties = nodes.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
        kept = kept.unionByName(_peel_by_joins(cut(nodes.select("node", "rank", "at").distinct(), "nodes"), cut(ties, "ties"), age))
    alone = facts.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("story"))
    return kept.unionByName(alone)
