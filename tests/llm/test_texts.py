import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kildestrom.llm.mixing import mixture, plan, sainte_lague
from kildestrom.llm.packing import fill, pack
from kildestrom.llm.quality import jensen_shannon, structural_kinds, text_statistics
from kildestrom.llm.tokens import VOCABULARY, token_count
from kildestrom.llm.truncation import MARKS, censored_fit, judged

WHOLE = ["Der er sat nye skilte op ved havnen.", "Kommunen vil bruge 84 kroner pr. husstand på en ny bro.", "Naboerne frygter, at en ny vej vil samle trafikken.", "Tallene viser, at mange stadig blander glas med andet.", "Et flertal vil flytte pladsen til byen."]


def _teasers(n, seed):
    r = random.Random(seed)
    rows, cut = [], set()
    for k in range(n):
        text = " ".join(r.sample(WHOLE, 3))
        source = "bar" if k % 4 == 0 else "stop"
        if k % 5 == 1:
            end = r.randrange(len(text) - 30, len(text) - 8)
            text = (text[:end].rsplit(" ", 1)[0] + "…") if k % 2 else text[:end]
            cut.add(str(k))
        elif source == "bar":
            text = text[:-1]
        rows.append((str(k), source, text))
    return rows, cut


def test_truncation(spark):
    rows, cut = _teasers(800, 2)
    extra = [("n1", "stop", None), ("n2", None, ""), ("n3", None, " "), ("n4", None, WHOLE[0]), ("n4", None, WHOLE[0]), ("n5", "stop", "Kommunen vil bruge 84 kroner pr."), ("n6", "stop", "Der er sat nye sk&oslas")]
    df = spark.createDataFrame(rows + extra, "id string, source string, teaser string").withColumn("length", F.lit("clash")).withColumn("cut", F.lit("clash"))
    out = judged(df, "id", "source", "teaser").collect()
    got = {r.key for r in out if r.cut}
    ids = {r.key for r in out}
    assert not {"n1", "n2", "n3"} & ids and len(out) == len(ids)
    assert {"n5", "n6"} <= got and "n4" not in got
    found = got - {"n5", "n6"}
    assert len(found & cut) >= 0.9 * len(cut) and len(found - cut) <= 0.05 * len(rows)
    assert judged(df.filter("false"), "id", "source", "teaser").count() == 0


def test_censored_fit_recovers_the_distribution():
    r = np.random.default_rng(3)
    x = np.minimum(r.normal(200, 40, 20_000).round(), 220)
    length, n = np.unique(x, return_counts=True)
    mu, sigma = censored_fit(length, n, 220)
    assert abs(mu - 200) < 2 and abs(sigma - 40) < 2
    assert MARKS.search("som […]") and MARKS.search("for (fortsættes)") and MARKS.search("af... Læs mere »") and not MARKS.search("alt.")


def test_fill_is_full_and_whole():
    r = random.Random(1)
    for capacity in (10, 64, 500):
        sizes = [r.randrange(0, capacity + 1) for _ in range(300)]
        bins = fill(sizes, capacity)
        assert sorted(k for b in bins for k in b) == list(range(300))
        assert all(sum(sizes[k] for k in b) <= capacity for b in bins)
        first_fit: list[int] = []
        for s in sorted(sizes, reverse=True):
            k = next((k for k, room in enumerate(first_fit) if room >= s), None)
            if k is None:
                first_fit.append(capacity - s)
            else:
                first_fit[k] -= s
        assert len(bins) <= len(first_fit)
    assert fill([], 5) == [] and fill([5, 3, 2], 5) == [[0], [1, 2]]


def test_pack(spark):
    r = random.Random(2)
    rows = [(k, r.choice([0, 3, 40, 99, 100, 101, 250, 1000]) if k % 7 else None) for k in range(500)]
    items = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint").withColumn("capacity", F.lit("clash"))
    specs = spark.createDataFrame([(1, 100), (2, 256)], "spec_id int, capacity_tokens int")
    out = pack(items, specs, shard_items=100).toPandas()
    for spec, capacity in ((1, 100), (2, 256)):
        own = out[out.spec_id == spec]
        assert own.groupby("doc_id").n_tokens.sum().to_dict() == {k: n or 0 for k, n in rows}
        assert own.groupby("container").n_tokens.sum().max() <= capacity
        pieces = own.groupby("doc_id").size()
        assert all(pieces[k] == max(1, -(-(n or 0) // capacity)) for k, n in rows)
    assert pack(items.filter("false"), specs).count() == 0 and pack(items, specs.filter("false")).count() == 0


def test_sainte_lague():
    assert sainte_lague([53, 24, 23], 7) == [3, 2, 2]
    r = random.Random(4)
    for _ in range(50):
        weights, seats = [r.random() for _ in range(r.randrange(1, 9))], r.randrange(0, 60)
        slow = [0] * len(weights)
        for _ in range(seats):
            best = max(range(len(weights)), key=lambda k: (weights[k] / (2 * slow[k] + 1), -k))
            slow[best] += 1
        assert sainte_lague(weights, seats) == slow
    assert sainte_lague([1, 1], 10, [2, 20]) == [2, 8] and sainte_lague([], 3) == [] and sainte_lague([0.0], 3) == [0]


def test_mixture(spark):
    r = random.Random(5)
    rows = [(k, "big" if k % 3 else "small" if k % 2 else None, r.randrange(0, 400)) for k in range(3000)]
    items = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint").withColumn("quota", F.lit("clash"))
    targets = spark.createDataFrame([(1, "big", 0.6, 1), (1, "small", 0.4, 3), (2, "big", 0.5, 2), (2, "nobody", 0.5, 2)], "mix_id int, source string, target_share double, max_repeats int")
    out = mixture(items, targets).toPandas()
    assert out.groupby(["mix_id", "doc_id"]).size().max() == 1
    one = out[out.mix_id == 1]
    tokens = (one.n_tokens * one.copies).groupby(one.source).sum()
    assert abs(tokens["big"] / tokens.sum() - 0.6) < 0.005 and one[one.source == "small"].copies.max() <= 3
    assert set(out[out.mix_id == 2].source) == {"big"}
    assert mixture(items.filter("false"), targets).count() == 0 and mixture(items, targets.filter("false")).count() == 0
    assert plan(pd.DataFrame([(1, "a", 1.0, 2)], columns=["mix_id", "source", "target_share", "max_repeats"]), {"a": 10}).blocks.tolist() == [20]


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
def test_tokens(spark):
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("æ" * 20_000,)], "t string")
    got = [r.n for r in df.select(token_count(F.col("t")).alias("n")).collect()]
    assert got[:3] == [2, 0, 0] and got[3] > 1000


DOCS = {
    "prose": "Det er uklart, hvem der skal betale for broen, hvis planen falder. Et flertal vil flytte den til byen.\n\nDer er sat nye skilte op ved havnen, og det er godt.",
    "wrapped": "Det er uklart, hvem der skal\nbetale for broen, hvis planen\nfalder. Et flertal vil flytte\nden til byen nu.",
    "list": "\n".join(f"- minimetalgebyr {c}, dyr" for c in "abcdefgh"),
    "table": "\n".join(["| navn | antal | pris |", "| --- | --- | --- |"] + [f"| skovby | {k} | {k},50 |" for k in range(8)]),
    "junk": "dRsaTcaXuxW7qA3D5U5SjEz866VhCF5UF1nRfZll1amcVxHDwSMw+hz5kIHZLFUKdnYjVtN3K2vJ",
    "menu": "\n".join(["Forrige", "Menu", "Luk", "Menu", "Søg", "Forrige", "Menu", "Luk"] * 3),
    "dialogue": "– Kan det være rigtigt, at broen lukker?\n– Det er den, der skal betale for det.\n– Så må vi se på det igen til foråret.",
}


def test_structural_kinds(spark):
    common = frozenset("det er hvem der skal betale for hvis et vil den til sat op ved og at kan så må vi se på igen".split())
    df = spark.createDataFrame([(k, t, "da") for k, t in DOCS.items()] + [("null", None, None), ("empty", "", "da"), ("long", (DOCS["prose"] + " Det er minimetalgebyr, og det er en dyr en. ") * 500, "da")], "doc_id string, text string, lang string")
    got = {r.key: r.kind for r in structural_kinds(df, "doc_id", "text", "lang", common).collect()}
    assert got == {"prose": "prose", "wrapped": "prose", "list": "list", "table": "table", "junk": "junk", "menu": "junk", "dialogue": "prose", "null": "prose", "empty": "prose", "long": "prose"}
    assert structural_kinds(df.filter("false"), "doc_id", "text", "lang", common).count() == 0


def test_statistics_and_divergence(spark):
    df = spark.createDataFrame([("og en to!\n\nx",), (None,), ("",)], "t string")
    rows = [tuple(r) for r in df.select(*text_statistics(F.col("t"), F.array(F.lit("og"), F.lit("en")))).collect()]
    assert rows[0] == (4, 1.75, round(1 / 12, 6), 2, 0.5, 0.5) and rows[1] == rows[2] == (0, 0.0, 0.0, 0, 0.0, 0.0)
    p = np.array([[1.0, 0.0], [0.5, 0.5]])
    d = jensen_shannon(p, p)
    assert d[0, 0] < 1e-6 and abs(jensen_shannon(p[:1], np.array([[0.0, 1.0]]))[0, 0] - 1) < 1e-6
