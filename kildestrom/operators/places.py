"""Places: a hierarchy with ancestors, and matching of place names in texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 8


def sort_places(places: Column, most: int = MOST) -> Column:
    """Distinct, regions before municipalities before towns, then by id, at most `most`."""
    rank = lambda p: F.when(p.startswith("r:"), 0).when(p.startswith("k:"), 1).otherwise(2)
    keyed = F.array_sort(F.transform(F.array_distinct(places), lambda p: F.struct(rank(p).alias("r"), p.alias("p"))))
    return F.slice(F.transform(keyed, lambda x: x["p"]), 1, most)


def place_names(places: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Rows (id, name) of every spelling of places (id, name): plain and with the word of its kind, each also in the genitive.

    `kinds` maps the start of an id to a form such as '{0} Kommune'. Names that end in s have no other genitive.
    """
    full = F.lit(None).cast("string")
    for start, form in kinds.items():
        before, after = form.split("{0}")
        full = F.when(F.col("id").startswith(start), F.concat(F.lit(before), "name", F.lit(after))).otherwise(full)
    both = places.select("id", F.explode(F.array_compact(F.array("name", full))).alias("name"))
    return both.unionByName(both.filter(~F.col("name").endswith("s")).select("id", F.concat("name", F.lit("s")).alias("name")))


def ancestors(places: DataFrame) -> DataFrame:
    """Rows (id, ancestor), each place among its own; places has id and parent, three levels deep."""
    own = places.select("id", F.col("id").alias("ancestor"))
    one = places.filter("parent is not null").select("id", F.col("parent").alias("ancestor"))
    two = one.join(places.select(F.col("id").alias("ancestor"), "parent"), "ancestor").filter("parent is not null").select("id", F.col("parent").alias("ancestor"))
    return own.unionByName(one).unionByName(two).distinct()


def expand(tags: DataFrame, node: str, place: str, places: DataFrame) -> DataFrame:
    """Rows (node, place) with every place's ancestors."""
    return tags.join(ancestors(places).withColumnRenamed("id", place), place).select(node, F.col("ancestor").alias(place)).distinct()


def most_precise(tags: DataFrame, node: str, place: str, places: DataFrame) -> DataFrame:
    """Tags without those that a finer tag of the same node implies."""
    above = ancestors(places).filter("id <> ancestor").withColumnRenamed("id", place)
    implied = tags.join(above, place).select(node, F.col("ancestor").alias(place)).distinct()
    return tags.join(implied, [node, place], "left_anti")


def place_finder(names: dict[str, str], institutions: list[str], towns: set[str]):
    """A function text -> place ids: longest name first, without overlaps, not before an institution's name.

    Names of towns only are no places after a capitalised word, which makes them surnames. names is a bounded
    dictionary of a geography, matched in one alternation.
    """
    ordered = sorted(names, key=lambda n: (-len(n), n))
    pattern = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, ordered)) + r")(?!\w)") if ordered else None
    after = re.compile(r"[ -](?:" + "|".join(map(re.escape, institutions)) + ")", re.I) if institutions else None
    surname = re.compile(r"(?:^|[\s(])[A-ZÆØÅ][a-zæøåé]+(?: [A-ZÆØÅ]\.)* $")

    def find(text: str | None) -> list[str]:
        found = set()
        for m in pattern.finditer(text or "") if pattern else ():
            if after and after.match(text, m.end()) or m[0] in towns and surname.search(text[: m.start()]):
                continue
            found.add(names[m[0]])
        return sorted(found, key=lambda p: ("rkb".find(p[0]), p))[:MOST]

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(find)

    return run
