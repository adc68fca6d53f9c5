"""Faceted queries over items: predicates, counts without the own facet, day histogram, search, pages and query strings."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from urllib.parse import parse_qsl, quote, urlencode

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kildestrom.functions.text import LONG_FOLD, SHORT_FOLD, fold

NONE = "uden"


@dataclass(frozen=True)
class FacetQuery:
    """Included and excluded keys per facet, a day range with open ends, and words to search for."""

    include: dict[str, tuple[str, ...]] = field(default_factory=dict)
    exclude: dict[str, tuple[str, ...]] = field(default_factory=dict)
    since: str | None = None
    until: str | None = None
    words: str = ""

    @classmethod
    def parse(cls, text: str) -> FacetQuery:
        """From a query string; a reversed day range is turned."""
        include: dict[str, tuple[str, ...]] = {}
        exclude: dict[str, tuple[str, ...]] = {}
        plain: dict[str, str] = {}
        for k, v in parse_qsl(text.lstrip("?")):
            keys = tuple(sorted({x for x in v.split(",") if x}))
            if k.startswith("-"):
                exclude[k[1:]] = keys
            elif k in ("fra", "til", "q"):
                plain[k] = v
            else:
                include[k] = keys
        since, until = plain.get("fra"), plain.get("til")
        if since and until and since > until:
            since, until = until, since
        return cls(include, exclude, since, until, plain.get("q", ""))

    def serialise(self) -> str:
        """To a query string in canonical order."""
        parts = [(k, ",".join(sorted(v))) for k, v in sorted(self.include.items()) if v] + [("-" + k, ",".join(sorted(v))) for k, v in sorted(self.exclude.items()) if v]
        parts += [(k, v) for k, v in (("fra", self.since), ("til", self.until), ("q", self.words)) if v]
        return urlencode(parts, quote_via=quote, safe=",:")

    def toggle(self, facet: str, key: str) -> FacetQuery:
        """With the key included, or no longer so."""
        keys = set(self.include.get(facet, ()))
        return replace(self, include=self.include | {facet: tuple(sorted(keys ^ {key}))})

    def without(self, facet: str, key: str) -> FacetQuery:
        """With a chip taken away: the key is neither included nor excluded any more."""
        gone = lambda lists: {f: tuple(k for k in ks if f != facet or k != key) for f, ks in lists.items()}
        return replace(self, include={f: ks for f, ks in gone(self.include).items() if ks}, exclude={f: ks for f, ks in gone(self.exclude).items() if ks})

    def toggle_all(self, facet: str, group: set[str], universe: set[str]) -> FacetQuery:
        """With all keys of a group shown, or none if all were."""
        shown = (set(self.include.get(facet) or universe) - set(self.exclude.get(facet, ()))) & universe
        now = shown - group if group <= shown else shown | group
        cleared = replace(self, include={f: k for f, k in self.include.items() if f != facet}, exclude={f: k for f, k in self.exclude.items() if f != facet})
        if now == universe:
            return cleared
        if not now:
            return replace(cleared, exclude=cleared.exclude | {facet: tuple(sorted(universe))})
        return replace(cleared, include=cleared.include | {facet: tuple(sorted(now))}).shortest(facet, universe)

    def chips(self) -> list[tuple[str, str, bool]]:
        """What is set, as (facet, key, shown), in canonical order."""
        return [(f, k, True) for f, ks in sorted(self.include.items()) for k in sorted(ks)] + [(f, k, False) for f, ks in sorted(self.exclude.items()) for k in sorted(ks)]

    def pick_place(self, place: str, facet: str = "place") -> FacetQuery:
        """With a place added; the first one of a finer kind replaces whole regions."""
        have = set(self.include.get(facet, ()))
        kept = have if not have or place.startswith("r:") or not all(p.startswith("r:") for p in have) else set()
        return replace(self, include=self.include | {facet: tuple(sorted(kept | {place}))})

    def shortest(self, facet: str, universe: set[str]) -> FacetQuery:
        """The same selection as included or excluded keys, whichever list is shorter."""
        shown = (set(self.include.get(facet) or universe) - set(self.exclude.get(facet, ()))) & universe
        hidden = universe - shown
        inc, exc = dict(self.include), dict(self.exclude)
        inc.pop(facet, None)
        exc.pop(facet, None)
        if hidden and len(hidden) < len(shown):
            exc[facet] = tuple(sorted(hidden))
        elif hidden:
            inc[facet] = tuple(sorted(shown))
        return replace(self, include=inc, exclude=exc)


def facet_keys(values: Column) -> Column:
    """Keys of an item in a facet: its values, or one that says it has none."""
    return F.when(F.size(F.coalesce(values, F.array().cast("array<string>"))) > 0, values).otherwise(F.array(F.lit(NONE)))


def facet_predicate(keys: Column, query: FacetQuery, facet: str) -> Column:
    """Whether any key is shown: included (all if none is named) and not excluded."""
    inc, exc = query.include.get(facet), query.exclude.get(facet, ())
    shown = F.filter(keys, lambda k: (k.isin(*inc) if inc else F.lit(True)) & (~k.isin(*exc) if exc else F.lit(True)))
    return F.size(shown) > 0


def search(text: Column, wanted: str) -> Column:
    """Whether every word is in the text, as written or folded in either spelling."""
    both = [F.lower(text), fold(text, LONG_FOLD), fold(text, SHORT_FOLD)]
    tests = [reduce(lambda a, b: a | b, [t.contains(w) for t in both]) for w in wanted.lower().split()]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _tests(query: FacetQuery, facets: dict[str, Column], day: Column, text: Column) -> dict[str, Column]:
    """A test for every facet, and one for day range and search under ''."""
    rest = []
    if query.since:
        rest.append(day >= F.lit(query.since).cast("date"))
    if query.until:
        rest.append(day <= F.lit(query.until).cast("date"))
    if query.words:
        rest.append(search(text, query.words))
    return {f: facet_predicate(facet_keys(c), query, f) for f, c in facets.items()} | {"": reduce(lambda a, b: a & b, rest, F.lit(True))}


def predicate(query: FacetQuery, facets: dict[str, Column], day: Column, text: Column, skip: tuple[str, ...] = ()) -> Column:
    """Whether a row passes the day range, the search and every facet but those skipped."""
    return reduce(lambda a, b: a & b, [t for f, t in _tests(query, facets, day, text).items() if f not in skip])


def matching(df: DataFrame, query: FacetQuery, facets: dict[str, Column], day: Column, text: Column, skip: tuple[str, ...] = ()) -> DataFrame:
    """Rows that pass the day range, the search and every facet but those skipped."""
    return df.filter(predicate(query, facets, day, text, skip))


def facet_counts(df: DataFrame, query: FacetQuery, facets: dict[str, Column], day: Column, text: Column, unit: str) -> DataFrame:
    """Rows (facet, key, n): distinct units of every key under all predicates but the facet's own.

    One pass: a row counts for every facet if it passes all, for one if it fails only that one's own predicate.
    """
    tests = _tests(query, facets, day, text)
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(t, F.lit(False)), F.lit(f)) for f, t in tests.items()]))
    keys = F.array(*[F.struct(F.lit(f).alias("facet"), facet_keys(c).alias("keys")) for f, c in facets.items()])
    rows = df.select(F.col(unit).alias("unit"), failed.alias("failed"), F.explode(keys).alias("k")).filter((F.size("failed") == 0) | ((F.size("failed") == 1) & (F.col("failed")[0] == F.col("k.facet"))))
    return rows.select("unit", F.col("k.facet").alias("facet"), F.explode("k.keys").alias("key")).groupBy("facet", "key").agg(F.countDistinct("unit").alias("n"))


def day_histogram(df: DataFrame, day: Column, unit: str) -> DataFrame:
    """Distinct units per day."""
    return df.groupBy(day.alias("day")).agg(F.countDistinct(unit).alias("n"))


def pages(df: DataFrame, order: list[Column], size: int, page: int) -> DataFrame:
    """One page of the ordered rows."""
    return df.orderBy(*order).offset(size * page).limit(size)


def suggestions(names: DataFrame, name: str, query: str, n: int = 8) -> DataFrame:
    """The n best names for what was typed: those that start with it, then those with a word that does."""
    k, q = fold(F.col(name)), query.lower()
    rank = F.when(k.startswith(q), 1).when(k.contains(" " + q), 2)
    return names.withColumn("rank", rank).filter("rank is not null").orderBy("rank", name).limit(n)


def tri_state(df: DataFrame, group: str, shown: Column) -> DataFrame:
    """Rows (group, state): all, some or none shown."""
    counts = df.groupBy(group).agg(F.count_if(shown).alias("s"), F.count("*").alias("n"))
    return counts.select(group, F.when(F.col("s") == 0, "none").when(F.col("s") == F.col("n"), "all").otherwise("some").alias("state"))


def cards(df: DataFrame, unit: str, matches: Column, order: list[Column], head: Column) -> DataFrame:
    """One row a unit: its head if that matches, else its first matching row."""
    w = Window.partitionBy(unit).orderBy(head.desc(), *order)
    return df.filter(matches).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
