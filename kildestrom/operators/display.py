"""What readers see: overrides, story members, reference lines, relaxed queries, labels and filled-down headings."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kildestrom.functions.urls import normalise_url
from kildestrom.operators.facets import FacetQuery, matching
from kildestrom.session import cut


@dataclass(frozen=True)
class Override:
    """A rule that applies to one id, to addresses of a pattern, or to both; `values` are what it sets."""

    values: dict[str, object]
    id: str | None = None
    url_regex: str | None = None


def overridden(df: DataFrame, rules: list[Override], id_: str = "id", url: str = "url") -> DataFrame:
    """df with the columns that rules name replaced where they apply, in order: a later rule beats an earlier one.

    A pattern may match the address as collected or in normal form. The rules are a list of bounded length that becomes
    literal conditions: no join, no shuffle.
    """
    meets = []
    for r in rules:
        tests = [F.col(id_) == r.id] if r.id else []
        if r.url_regex:
            tests.append(F.col(url).rlike(r.url_regex) | normalise_url(F.col(url)).rlike(r.url_regex))
        meets.append(F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False)) if tests else F.lit(False))
    out = {}
    for c in dict.fromkeys(k for r in rules for k in r.values):
        hit = [F.when(m, F.lit(r.values[c])) for r, m in zip(rules, meets, strict=True) if c in r.values]
        out[c] = F.coalesce(*reversed(hit), F.col(c))
    return df.withColumns(out) if out else df


def members(heads: DataFrame, others: DataFrame, unit: str, inherited: list[str], fixed: dict[str, Column]) -> DataFrame:
    """Heads and their other items as rows: an item without a value of its own has the head's; `fixed` columns are set.

    heads and others share their columns; others' units without a head are left out.
    """
    top = heads.select(unit, *[F.col(c).alias(f"__{c}") for c in inherited])
    empty = lambda c: F.col(c).isNull() | (F.size(c) == 0) if dict(others.dtypes)[c].startswith("array") else F.col(c).isNull()
    rows = others.join(top, unit).withColumns({c: F.when(empty(c), F.col(f"__{c}")).otherwise(F.col(c)) for c in inherited} | fixed)
    return heads.withColumn("is_head", F.lit(True)).unionByName(rows.select(*heads.columns).withColumn("is_head", F.lit(False)))


def reference_line(items: Column, shown: int = 2) -> Column:
    """The first ids of an array of items and how many more there are."""
    ids = F.array_distinct(F.transform(items, lambda i: i["id"]))
    return F.struct(F.slice(ids, 1, shown).alias("links"), F.greatest(F.size(ids) - shown, F.lit(0)).alias("rest"))


def relaxations(df: DataFrame, query: FacetQuery, facets: dict[str, Column], day: Column, text: Column) -> DataFrame:
    """Rows (dropped, n): how many rows match when one filter is left out, most helpful first; a single pass over df."""
    options = {f: (f,) for f in facets if query.include.get(f) or query.exclude.get(f)}
    variants = {f: (query, skip) for f, skip in options.items()}
    if query.since or query.until:
        variants["dage"] = (replace(query, since=None, until=None), ())
    if query.words:
        variants["ord"] = (replace(query, words=""), ())
    flags = [F.count_if(_test(df, q, facets, day, text, skip)).alias(name) for name, (q, skip) in variants.items()]
    if not flags:
        return df.sparkSession.createDataFrame([], "dropped string, n bigint")
    counts = df.agg(*flags)
    pairs = F.array(*[F.struct(F.lit(n).alias("dropped"), F.col(n).alias("n")) for n in variants])
    return counts.select(F.explode(pairs).alias("p")).select("p.*").orderBy(F.desc("n"), "dropped")


def _test(df: DataFrame, query: FacetQuery, facets: dict[str, Column], day: Column, text: Column, skip: tuple[str, ...]) -> Column:
    from kildestrom.operators.facets import predicate

    return F.coalesce(predicate(query, facets, day, text, skip), F.lit(False))


def labels(df: DataFrame, name: str, parent: str) -> DataFrame:
    """df with `label`: the name, with the parent in parentheses where several rows have it."""
    often = df.groupBy(name).agg((F.count("*") > 1).alias("__often"))
    label = F.when(F.col("__often"), F.concat(name, F.lit(" ("), parent, F.lit(")"))).otherwise(F.col(name))
    return df.join(often, name).withColumn("label", label).drop("__often")


def range_label(since: Column, until: Column) -> Column:
    """A compact label of a range of days, of which either may be null."""
    both = (
        F.when(since == until, F.date_format(since, "d.M.yyyy"))
        .when(F.date_trunc("month", since) == F.date_trunc("month", until), F.concat(F.date_format(since, "d."), F.lit("–"), F.date_format(until, "d.M.yyyy")))
        .when(F.year(since) == F.year(until), F.concat(F.date_format(since, "d.M."), F.lit("–"), F.date_format(until, "d.M.yyyy")))
        .otherwise(F.concat(F.date_format(since, "d.M.yyyy"), F.lit("–"), F.date_format(until, "d.M.yyyy")))
    )
    return F.when(since.isNull() & until.isNull(), "").when(until.isNull(), F.concat(F.lit("fra "), F.date_format(since, "d.M.yyyy"))).when(since.isNull(), F.concat(F.lit("til "), F.date_format(until, "d.M.yyyy"))).otherwise(both)


def filled_down(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """df with `out`: the last value at or before a row in the whole ascending order of columns, nulls passed over.

    Ranges of the order are filled on their own and take over the last value of the ranges before them, of which there
    is one row each; no task sees the whole.
    """
    spread = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    local = spread.withColumn(out, F.last(value, ignorenulls=True).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    ends = spread.filter(F.col(value).isNotNull()).groupBy("__part").agg(F.max_by(value, F.struct(*order)).alias("__end"))
    parts = spread.select("__part").distinct().join(ends, "__part", "left")
    before = parts.select("__part", F.last("__end", ignorenulls=True).over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))  # a row a range
    return local.join(F.broadcast(before), "__part").withColumn(out, F.coalesce(out, "__before")).drop("__part", "__before")


def winner(df: DataFrame, name: str, weight: str, id_: str, times: float) -> DataFrame:
    """Rows (name, id) of names that one row bears `times` as heavily as the next: the two heaviest decide, pre-aggregated."""
    pair = F.struct(F.col(weight).alias("w"), F.col(id_).alias("id"))
    best = df.groupBy(name).agg(F.max(pair).alias("best"))
    rest = df.join(best, name).filter(pair != F.col("best")).groupBy(name).agg(F.max(weight).alias("second"))
    joined = best.join(rest, name, "left")
    return joined.filter(F.col("second").isNull() | (F.col("best.w") >= times * F.col("second"))).select(name, F.col("best.id").alias(id_))


__all__ = ["Override", "filled_down", "labels", "matching", "members", "overridden", "range_label", "reference_line", "relaxations", "winner"]
