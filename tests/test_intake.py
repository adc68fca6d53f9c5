"""Intake, registry, display and streaming operators on small inputs with nulls, ties, empty tables and clashing columns."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kildestrom.functions import registry
from kildestrom.operators import display, facets, intake, places
from kildestrom.operators.display import Override
from kildestrom.sources import records
from kildestrom.streaming import streams


def _one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def test_admission_gates_and_windows(spark):
    lit = F.lit
    assert tuple(_one(spark, *[intake.admitted(lit(u), lit(t)) for u, t in (("https://a.example/x", "t"), ("ftp://a.example", "t"), (None, "t"), ("http://a.example", "  "), ("https://", "t"), ("https://a.example", None))])) == (True, False, False, False, False, False)
    at = lambda s: lit(s).cast("timestamp")
    now = at("2026-03-01 12:00:00")
    rows = _one(spark, intake.dated(at("2026-02-28 00:00:00"), now, 14, lit(False)), intake.dated(at("2026-01-01 00:00:00"), now, 14, lit(False)), intake.dated(at("2026-03-01 15:00:00"), now, 14, lit(False)), intake.dated(lit(None).cast("timestamp"), now, 14, lit(True)))
    assert [(r.gate, r.quality) for r in rows] == [("taken", "kilde"), ("old", "kilde"), ("taken", "fundet"), ("undated", "fundet")]
    day = lambda s: lit(s).cast("date")
    assert tuple(_one(spark, *[intake.lookback_days(day(x), day("2026-03-01")) for x in ("2026-03-01", "2026-02-22", "2025-01-01", None)])) == (3, 8, 14, 14)
    assert tuple(_one(spark, intake.due(lit("rss"), at("2026-03-01 11:35:00"), now, lit(False)), intake.due(lit("rss"), at("2026-03-01 11:20:00"), now, lit(False)), intake.due(lit("rss"), at("2026-03-01 11:20:00"), now, lit(True)), intake.due(lit("html"), lit(None).cast("timestamp"), now, lit(False)))) == (False, True, False, True)
    when = intake.entry_time(spark, [lit("nonsense"), lit("1. marts 2026 kl. 12.00"), lit("2020-01-01")])
    assert _one(spark, F.date_format(when, "yyyy-MM-dd HH:mm")).c0 == "2026-03-01 11:00"


def test_sitemap_targets(spark):
    places_ = spark.createDataFrame([("s", "https://a.example/n/1", 5, "x"), ("s", "https://www.a.example/n/1/", 9, "x"), ("s", "https://b.example/n/2", 9, "x"), ("s", "https://a.example/om", 9, "x"), ("s", "https://a.example/n/3", None, "x"), ("s", "https://a.example/n/4", 1, "x"), ("s", None, 9, "x"), ("s", "https://a.example/n/5", 7, "x")], "source string, loc string, lastmod int, rank string").drop("rank")
    sources = spark.createDataFrame([("s", ["a.example"], 3)], "source string, hosts array<string>, since int")
    seen = spark.createDataFrame([("a.example/n/5",)], "address string")
    got = [(r.address, r.lastmod, r["rank"]) for r in intake.sitemap_targets(places_, sources, seen, "/n/", 5).orderBy("rank").collect()]
    assert got == [("a.example/n/1", 9, 1), ("a.example/n/3", None, 2)]
    assert intake.sitemap_targets(places_.filter("false"), sources, seen, "/n/", 5).count() == 0


def test_registry_functions(spark):
    lit = F.lit
    r = _one(spark, registry.source_hosts(lit("https://www.a.example/"), F.array(lit("a.example"), lit("B.example"))), registry.source_hosts(lit(None).cast("string"), lit(None).cast("array<string>")), registry.other_domains(lit("https://a.example"), F.array(lit("x.a.example"), lit("b.example"))), registry.site_names(lit("Det Råd (DR)"), F.array(lit("a.example"))), registry.slug_text(lit("https://a.example/n%C3%A6r-ved_8?x=1")), registry.population(lit("1.234.567,8")), registry.population(lit("ukendt")), registry.category_of(lit("Lokal Kommunal avis"), ["kommunal", "avis"]), F.round(registry.contrast(lit("#000000"), lit("#ffffff")), 2), registry.image_kind(F.unhex(lit("89504E470D0A1A0A"))), registry.image_kind(lit(None).cast("binary")))
    assert tuple(r) == (["a.example", "b.example"], [], ["b.example"], ["Det Råd (DR)", "Det Råd", "DR", "a.example"], "nær ved 8", 1234567, None, "kommunal", 21.0, "png", None)


def test_overrides_apply_in_order(spark):
    df = spark.createDataFrame([("1", "http://www.a.example/x/", "n"), ("2", "https://b.example", None), ("3", None, "n")], "id string, url string, genre string")
    rules = [Override({"genre": "a"}, url_regex="a.example"), Override({"genre": "b"}, id="1"), Override({"genre": "c"}, id="2", url_regex="nowhere"), Override({"genre": "d"}, url_regex="^https://a.example/x$"), Override({"genre": "e"})]
    assert {r.id: r.genre for r in display.overridden(df, rules).collect()} == {"1": "d", "2": None, "3": "n"}
    assert display.overridden(df, []).count() == 3


def test_members_labels_ranges_and_filling(spark):
    heads = spark.createDataFrame([("u", "h", ["t"], "g")], "unit string, id string, topics array<string>, genre string")
    others = spark.createDataFrame([("u", "m", None, "x"), ("u", "k", ["own"], "y"), ("v", "lost", None, "z")], heads.schema)
    got = {r.id: (r.topics, r.genre, r.is_head) for r in display.members(heads, others, "unit", ["topics"], {"genre": F.lit("fast")}).collect()}
    assert got == {"h": (["t"], "g", True), "m": (["t"], "fast", False), "k": (["own"], "fast", False)}
    named = spark.createDataFrame([("a", "By", "A"), ("b", "By", "B"), ("c", "Ø", "A")], "id string, name string, parent string")
    assert {r.id: r.label for r in display.labels(named, "name", "parent").collect()} == {"a": "By (A)", "b": "By (B)", "c": "Ø"}
    day = lambda s: F.lit(s).cast("date")
    assert tuple(_one(spark, *[display.range_label(day(a), day(b)) for a, b in (("2026-01-02", "2026-01-02"), ("2026-01-02", "2026-01-09"), ("2026-01-02", "2026-02-01"), ("2025-12-31", "2026-01-01"), (None, "2026-01-01"), (None, None))])) == ("2.1.2026", "2.–9.1.2026", "2.1.–1.2.2026", "31.12.2025–1.1.2026", "til 1.1.2026", "")
    r = random.Random(1)
    rows = [(k, r.choice([None, None, f"v{k}"])) for k in range(200)]
    want, last = {}, None
    for k, v in rows:
        last = v or last
        want[k] = last
    df = spark.createDataFrame(rows, "k int, v string").repartition(7)
    assert {x.k: x.out for x in display.filled_down(df, ["k"], "v", "out").collect()} == want


def test_winner_needs_a_lead(spark):
    rows = [("a", 10, "x"), ("a", 1, "y"), ("b", 5, "x"), ("b", 4, "y"), ("c", 1, "x"), ("d", 3, "x"), ("d", 3, "y")]
    df = spark.createDataFrame(rows, "name string, n int, id string")
    assert {(r.name, r.id) for r in display.winner(df, "name", "n", "id", 5).collect()} == {("a", "x"), ("c", "x")}


def test_place_names_and_picks(spark):
    df = spark.createDataFrame([("k:a", "Aby"), ("r:b", "Øs"), ("b:c", "Cby")], "id string, name string")
    got = {(r.id, r.name) for r in places.place_names(df, {"k:": "{0} Kommune", "r:": "Region {0}"}).collect()}
    assert got == {("k:a", "Aby"), ("k:a", "Abys"), ("k:a", "Aby Kommune"), ("k:a", "Aby Kommunes"), ("r:b", "Øs"), ("r:b", "Region Øs"), ("b:c", "Cby"), ("b:c", "Cbys")}
    q = facets.FacetQuery(include={"place": ("r:x", "r:y")})
    assert q.pick_place("k:a").include["place"] == ("k:a",) and q.pick_place("k:a").pick_place("b:c").include["place"] == ("b:c", "k:a")


def test_relaxations_count_each_query_without_one_filter(spark):
    df = spark.createDataFrame([("n", "x", "ord"), ("d", "x", "ord"), ("n", "y", "ord"), (None, "x", None)], "genre string, source string, title string")
    q = facets.FacetQuery(include={"genre": ("n",)}, exclude={"source": ("y",)}, words="ord")
    got = [(r.dropped, r.n) for r in display.relaxations(df, q, {"genre": F.array("genre"), "source": F.array("source")}, F.lit("2026-01-01").cast("date"), F.col("title")).collect()]
    assert got == [("genre", 2), ("source", 2), ("ord", 1)]
    assert display.relaxations(df, facets.FacetQuery(), {}, F.lit(None).cast("date"), F.col("title")).count() == 0


def test_streams_over_several_batches(spark, tmp_path):
    rows = [(k, f"u{k % 3}", bool(k % 4), dt.datetime(2026, 1, 1) + dt.timedelta(hours=k)) for k in range(12)]
    for k in range(4):
        spark.createDataFrame(rows[3 * k : 3 * k + 3], "k long, u string, failed boolean, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    read = lambda: streams.stream_of(spark, f"{tmp_path}/in", files=1)
    got = {r.u: r.fails for r in streams.drain(streams.health_states(read(), "u", "k", "failed"), "h", "update", ["u"]).collect()}
    want = {}
    for _, u, failed, _ in rows:
        want[u] = want.get(u, 0) + 1 if failed else 0
    assert got == want
    n = {(r.u, r.start): r.n for r in streams.drain(streams.window_counts(read(), ["u"], "ts", "6 hours", "1 day"), "w", "update", ["u", "start"]).collect()}
    assert sum(n.values()) == 12 and len(n) == 6
    with pytest.raises(ValueError):
        streams.drain(streams.window_counts(read(), ["u"], "ts", "6 hours", "1 day"), "x", "update")


def test_registry_and_tables_from_files(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"id": "a", "name": "A"}, {"id": "a", "name": "B"}, {"id": "b"}, {"id": "c", "name": "C", "odd": 1}, 7]')
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType())])
    rows, errors = records.registry(spark, str(tmp_path / "r.json"), schema, ["id", "name"])
    assert [tuple(r) for r in rows.collect()] == [("a", "A")]
    assert {(r.id, r.problem) for r in errors.collect()} >= {("a", "repeated"), ("b", "no name"), ("c", "unknown field odd")}
    late = "navn;Vært\n" + "a;b\n" * 20_000 + "grøn;x\n"
    (tmp_path / "t.csv").write_bytes(late.encode("cp1252"))
    df = records.sniffed_csv(spark, str(tmp_path / "t.csv"), {"VÆRT": "host", "navn ": "name"})
    assert df.columns == ["name", "host"] and df.filter("name = 'grøn'").count() == 1


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from kildestrom import session

    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"
        _jsc = spark.sparkContext._jsc

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        pytest.skip("a folder was set before")
    with pytest.raises(ValueError):
        session.shared_dir(Session())


def test_text_dates(spark):
    from kildestrom.functions import dates

    cases = [
        ("Set 3. maj 2024, opdateret 2024-06-01", "2024-06-01"), ("Publiceret: 3. maj 2024. Se også 2025-01-01", "2024-05-03"), ("31/2-2024", None), ("1/3-2024 og 5.4.2023", "2024-03-01"), ("2031-01-01", None), ("1999-01-01", None), ("12024-01-011", None),
        ("Published 7 March 2025", "2025-03-07"), ("", None), (None, None), ("publiceret 99.99.2024, 2.2.2022", "2022-02-02"),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string")
    got = {r.k: r.d for r in df.select("k", dates.text_date(F.col("t"), F.lit("2026-11-01").cast("date")).cast("string").alias("d")).collect()}
    assert [got[k] for k in range(len(cases))] == [w for _, w in cases]


def test_titles_without_sites(spark):
    from kildestrom.functions import text

    names = F.array(F.lit("Byens Avis"), F.lit("by.example"))
    cases = [
        ("Ny bro åbner | Byens Avis", "Ny bro åbner"), ("Ny bro åbner - by.example | Byens Avis", "Ny bro åbner"), ("Ny bro - og en vej til havnen", "Ny bro - og en vej til havnen"), ("Bro | Byens Avis", "Bro | Byens Avis"),
        ("Ny bro åbner – Fyns Amt", "Ny bro åbner"), ("Ny bro åbner | en længere forklaring af det hele", "Ny bro åbner | en længere forklaring af det hele"), (None, None), ("", ""),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string")
    got = {r.k: r.d for r in df.select("k", text.strip_site_tail(F.col("t"), names).alias("d")).collect()}
    assert [got[k] for k in range(len(cases))] == [w for _, w in cases]
    pairs = [("ＮＹ bro: Åbner! | Byens Avis", "ny bro åbner"), ("Straße & vej", "strasse vej"), (None, ""), ("  ", "")]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(pairs)], "k int, t string")
    got = {r.k: r.d for r in df.select("k", text.normal_title(F.col("t"), names).alias("d")).collect()}
    assert [got[k] for k in range(len(pairs))] == [w for _, w in pairs]
    assert tuple(_one(spark, text.strip_publisher(F.lit("En sag -  BYENS   avis "), F.lit("Byens Avis")), text.strip_publisher(F.lit("En sag - X"), F.lit(None).cast("string")))) == ("En sag", "En sag - X")


def test_selection_editing():
    q = facets.FacetQuery(include={"genre": ("a", "b")}, exclude={"source": ("x",)})
    assert q.chips() == [("genre", "a", True), ("genre", "b", True), ("source", "x", False)]
    assert q.without("genre", "a").include == {"genre": ("b",)} and q.without("source", "x").exclude == {}
    every = {"a", "b", "c", "d"}
    assert facets.FacetQuery().toggle_all("g", {"a", "b"}, every).include == {"g": ("c", "d")}
    assert facets.FacetQuery(include={"g": ("a",)}).toggle_all("g", {"b", "c", "d"}, every) == facets.FacetQuery()
    assert facets.FacetQuery().toggle_all("g", every, every).exclude == {"g": ("a", "b", "c", "d")}


def test_late_rows_come_apart(spark, tmp_path):
    day = lambda k: dt.datetime(2026, 1, 1) + dt.timedelta(days=k)
    for rows in ([(1, day(0)), (2, day(20))], [(3, day(3)), (4, day(10)), (5, None)], [(6, day(5)), (7, day(30))]):
        spark.createDataFrame(rows, "k int, at timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    fine, late = streams.split_late(streams.stream_of(spark, f"{tmp_path}/in", files=1), "at", "14 days", "late")
    seen = {r.k for r in fine.collect()}, {r.k for r in late.collect()}
    assert seen[0] | seen[1] == set(range(1, 8)) and not seen[0] & seen[1] and {2, 4, 5, 7} <= seen[0]


def test_list_pages(spark):
    from kildestrom.sources import pages

    html = """<nav><a href="/om">Om</a></nav><ul class="news x"><li><time datetime="2026-02-03"></time><a class="t" href="/a">A</a><a href="/a">Længere A</a></li>
        <li><a class="t" href="/b">B</a> 3. marts 2026</li></ul><article id="top"><a href="https://c.example/c">C</a></article>"""
    assert pages.read_links(html, "https://s.example/", selector="ul.news a") == [("https://s.example/a", "Længere A", "2026-02-03"), ("https://s.example/b", "B", "3. marts 2026")]
    assert [u for u, _, _ in pages.read_links(html, "https://s.example/", selector="a.t, #top a")] == ["https://s.example/a", "https://s.example/b", "https://c.example/c"]
    assert pages.read_links(html, "https://s.example/", "c\\.example") == [("https://c.example/c", "C", None)] and pages.read_links(None, "") == []
