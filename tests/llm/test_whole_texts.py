"""The operators do the whole job on inputs that the data lack: very short titles and very long fields."""

import random
import re

import pytest
from pyspark.sql import functions as F

from kildestrom.llm.history import RunStore, entries
from kildestrom.llm.truncation import length_limits
from kildestrom.session import cut

SHORT = [(1, "Nyt"), (2, "Affald 7"), (3, "Byen holder rent"), (4, "Havne budget"), (5, "Genbrug 7"), (6, "7"), (7, "Nyt"), (8, "Ren by 12"), (9, "Pose"), (10, "Nyt anlæg åbner"), (11, "Vand 12"), (12, None)]


def _lev(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        e = [i]
        for j, y in enumerate(b, 1):
            e.append(min(d[j] + 1, e[-1] + 1, d[j - 1] + (x != y)))
        d = e
    return d[-1]


@pytest.mark.parametrize("bounds", [[(0, 99)], [(0, 4), (5, 8), (9, 99)]])
def test_short_titles_need_no_common_word(spark, bounds):
    read = [(o, (t or "").lower().split(), re.findall(r"\d+", t or "")) for o, t in SHORT]
    want = {o for o, w, n in read if any(p < o and w and v and n == m and _lev(v, w) <= 2 for p, v, m in read)}
    assert {4, 5, 6, 9} <= want
    df = spark.createDataFrame(SHORT, "ord bigint, title string")
    names = spark.createDataFrame([("A Kilde",)], "name string")
    store, got = RunStore(spark, 4), set()
    for low, high in bounds:
        batch = cut(entries(df.filter(F.col("ord").between(low, high)), F.col("ord"), F.lit(None).cast("string"), F.col("title"), names), "e")
        got |= {r.ord for r in store.take(batch).collect()}
    assert got == want


def test_field_limits_are_found_at_any_length(spark):
    free = [("s", 3000 + 37 * k) for k in range(60)]
    rows = [(s, "x" * n) for s, n in free + [("s", 5000)] * 40]
    found = {r.length: r.posterior for r in length_limits(spark.createDataFrame(rows, "source string, text string").select("source", F.length("text").alias("length"))).collect()}
    assert set(found) == {5000} and found[5000] > 0.5


def test_parameter_tables_beyond_their_bounds_are_errors(spark, tmp_path, monkeypatch):
    from kildestrom.llm import mixing, packing, quality, queries
    from kildestrom.plans import problems

    items = spark.createDataFrame([(k, "s", 5) for k in range(3)], "doc_id bigint, source string, n_tokens bigint")
    specs = spark.createDataFrame([(1, 8), (2, 16), (3, 0)], "spec_id int, capacity_tokens int")
    targets = spark.createDataFrame([(1, "s", 0.5, 1), (1, "t", 0.5, 1)], "mix_id int, source string, target_share double, max_repeats int")
    one = [0.0] * (len(quality.CLASSES) - 1) + [1.0]
    measured = spark.createDataFrame([(lang, [1], [4.0], one) for lang in ("da", "sv")], "lang string, sort array<tinyint>, size array<float>, dist array<float>")
    spark.createDataFrame([("da", "og"), ("da", "i")], "lang string, word string").write.parquet(f"{tmp_path}/common_word.parquet")
    spark.createDataFrame([("a", "Europe/Copenhagen"), ("b", "UTC")], "id string, zone_name string").write.parquet(f"{tmp_path}/feed_source.parquet")
    cases = [
        (packing, "MOST_SPECS", lambda: packing.pack(items, specs)),
        (mixing, "MIX_ROWS", lambda: mixing.mixture(items, targets)),
        (queries, "MOST_WORDS", lambda: queries._common_words(spark, str(tmp_path))),
        (quality, "MOST_LANGUAGES", lambda: quality.prose_profiles(measured)),
    ]
    for module, bound, run in cases:
        monkeypatch.setattr(module, bound, 2)
        run()
        monkeypatch.setattr(module, bound, 1)
        with pytest.raises(ValueError, match="more than 1 "):
            run()
    monkeypatch.setattr(problems, "MOST_ZONES", 1)
    with pytest.raises(ValueError, match="zone names"):
        problems.p4_found(spark, str(tmp_path))


def _cut_at_blanks(seed=11):
    """Texts of a source that writes no stops, every one of more than 90 characters cut at its last blank; another source with stops."""
    r = random.Random(seed)
    words = ["havn", "by", "skole", "vej", "pulje", "plan", "strand", "møde", "affald", "gård", "bro", "kanal"]
    rows, cut = [], set()
    for k in range(800):
        text, wanted = "", r.gauss(75, 20)
        while len(text) < wanted:
            text += (" " if text else "") + r.choice(words)
        if len(text) > 90:
            cut.add(f"a{k}")
            text = text[: text[:91].rfind(" ")]
        rows.append((f"a{k}", "uden", text))
    for k in range(200):
        sentences = [" ".join(r.choice(words) for _ in range(r.randrange(3, 12))).capitalize() + "." for _ in range(4)]
        rows.append((f"b{k}", "med", " ".join(sentences)))
    return rows, cut


def test_the_censoring_posterior_decides_at_limits(spark, monkeypatch):
    import kildestrom.llm.truncation as m

    rows, cut = _cut_at_blanks()
    df = spark.createDataFrame(rows, "id string, source string, teaser string")
    found = lambda: {r.key for r in m.judged(df, "id", "source", "teaser").filter("cut").collect()}
    with_it = found()
    assert len(with_it & cut) > 0.8 * len(cut) and not any(k.startswith("b") for k in with_it)
    limits = m.length_limits
    monkeypatch.setattr(m, "length_limits", lambda lengths: limits(lengths).filter("false"))
    assert len(found() & cut) < 0.7 * len(with_it & cut)


def test_endings_do_not_depend_on_partitions(spark):
    import kildestrom.llm.truncation as m

    rows, _ = _cut_at_blanks(12)
    df = spark.createDataFrame(rows, "id string, source string, teaser string")
    one, many = (m.learn_endings(df.repartition(n).select("teaser")) for n in (1, 16))
    assert (one.ended == many.ended).all() and (one.seen == many.seen).all()


def _highest_quotients(weights, seats, most):
    from fractions import Fraction

    quotients = sorted(((-Fraction(w) / (2 * k + 1), i) for i, w in enumerate(weights) for k in range(min(most[i], seats))))
    out = [0] * len(weights)
    for _, i in quotients[:seats]:
        out[i] += 1
    return out


def test_sainte_lague_equals_highest_quotients():
    from kildestrom.llm.mixing import sainte_lague

    assert sainte_lague([949.0] + [0.51] * 100, 1000)[0] == 930
    r = random.Random(3)
    for _ in range(200):
        n = r.randrange(1, 60)
        weights = [r.choice([0.0, r.random(), r.random() * 1000, 1.0, 3.0]) for _ in range(n)]
        seats = r.randrange(0, 300)
        most = [r.randrange(0, 200) for _ in range(n)]
        if sum(weights) > 0:
            assert sainte_lague(weights, seats, most) == _highest_quotients(weights, seats, [m if w > 0 else 0 for w, m in zip(weights, most)])


def test_a_heading_does_not_make_a_list_prose(spark):
    from kildestrom.llm.quality import structural_kinds

    common = frozenset(["og", "i", "på", "for", "der", "er", "en", "et", "at", "til", "med", "det", "vil", "har"])
    r = random.Random(2)
    things = [a + b for a in ("mini", "båd", "tæppe", "folie", "metal", "dør") for b in ("lager", "genbrug", "anlæg", "strøm", "depot", "ordning")]
    prose = "Kommunen vil bygge en ny plads ved havnen, og det er der mange grunde til. "
    rows = [(k, "da", "Borgere i byen beder om en ny plads til det\n" + " · ".join(r.sample(things, 20))) for k in range(30)]
    rows += [(100 + k, "da", (prose * 6).strip()) for k in range(60)] + [(900, "da", None), (901, None, "")]
    kinds = {x.key: x.kind for x in structural_kinds(spark.createDataFrame(rows, "doc_id bigint, lang string, text string"), "doc_id", "text", "lang", common).collect()}
    assert {kinds[k] for k in range(30)} == {"list"} and {v for k, v in kinds.items() if k >= 100} == {"prose"}
