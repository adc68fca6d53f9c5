import pytest
import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from kildestrom.operators import health, logs, places, quality, ranking
from kildestrom.operators.facets import FacetQuery, facet_counts
from kildestrom.sources import feeds, pages, records


def test_logs(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), (None, 9, "z"), ("b", 2, None)], "id string, seq int, v string")
    assert {(r.id, r.v) for r in logs.latest(df, "id", [F.col("seq")]).collect()} == {("a", "y"), ("b", None)}
    assert {(r.id, r.seq) for r in logs.upsert(df.filter("seq < 3"), df.filter("id = 'a' and seq = 3"), "id").filter("id is not null").collect()} == {("a", 3), ("b", 2)}
    t = lambda d: dt.datetime(2026, 1, d)
    old = spark.createDataFrame([("a", t(5), "old"), ("b", t(1), "gone")], "k string, at timestamp, v string")
    new = spark.createDataFrame([("a", t(9), "new"), ("c", t(9), "c")], "k string, at timestamp, v string")
    got = {(r.k, r.at.day, r.v) for r in logs.merge_keeping_first(old, new, "k", ["at"], "at", F.lit("2026-01-03").cast("timestamp")).collect()}
    assert got == {("a", 5, "new"), ("c", 9, "c")}


def test_ranking(spark):
    df = spark.createDataFrame([(k, k % 3) for k in range(20)], "n int, g int")
    assert [r.n for r in ranking.round_robin(df, ["g"], [F.asc("n")], 5).collect()] == [0, 1, 2, 3, 4]
    assert sorted(r.position for r in ranking.with_position(df, [F.desc("n")]).collect()) == list(range(20))
    assert ranking.evenly(df, [F.asc("n")], 5, 20).count() == 5
    names = ranking.unique_names(spark.createDataFrame([("a", 1), ("a", 2)], "name string, n int"), "name", [F.asc("n")])
    assert {r.name for r in names.collect()} == {"a", "a-2"}


def test_facets(spark):
    q = FacetQuery.parse("?genre=b,a&-source=x&fra=2026-02-01&til=2026-01-01")
    assert (q.since, q.until) == ("2026-01-01", "2026-02-01") and FacetQuery.parse(q.serialise()) == q
    assert q.toggle("genre", "a").include["genre"] == ("b",)
    assert FacetQuery(include={"g": ("a", "b", "c")}).shortest("g", set("abcd")).exclude == {"g": ("d",)}
    df = spark.createDataFrame([(1, "a", ["t"], "x"), (2, "b", [], "x"), (3, "a", None, "y")], "id int, genre string, topics array<string>, title string")
    got = facet_counts(df, FacetQuery(include={"genre": ("a",)}), {"genre": F.array("genre"), "topic": F.col("topics")}, F.lit(None).cast("date"), F.col("title"), "id")
    assert {tuple(r) for r in got.collect()} == {("genre", "a", 2), ("genre", "b", 1), ("topic", "t", 1), ("topic", "uden", 1)}


def test_places(spark):
    tree = spark.createDataFrame([("r:n", None), ("k:a", "r:n"), ("b:x", "k:a")], "id string, parent string")
    tags = spark.createDataFrame([(1, "b:x"), (2, "k:a"), (1, "r:n")], "n int, place string")
    assert {tuple(r) for r in places.expand(tags, "n", "place", tree).collect()} == {(1, "b:x"), (1, "k:a"), (1, "r:n"), (2, "k:a"), (2, "r:n")}
    assert {tuple(r) for r in places.most_precise(tags, "n", "place", tree).collect()} == {(1, "b:x"), (2, "k:a")}
    find = places.place_finder({"Aby": "b:aby", "Aby Mark": "b:abymark", "Byrum Kommune": "k:byrum"}, ["skole"], {"Aby"})
    df = spark.createDataFrame([("I Aby Mark og Byrum Kommune",), ("Jens Aby og Aby skole",), (None,), ("fra Aby",)], "t string")
    assert [r.p for r in df.select(find("t").alias("p")).collect()] == [["k:byrum", "b:abymark"], [], [], ["b:aby"]]


def test_quality_and_health(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "bb", 5), (2, "c", 1)], "id int, v string, n int")
    got = quality.failures(df, "id", {"short": F.length("v") < 2, "n": F.col("n") < 3})
    assert {tuple(r) for r in got.collect()} == {(2, "short"), (2, "n")}
    assert [tuple(r) for r in quality.duplicates(df, "id").collect()] == [(2, 2)]
    ev = spark.createDataFrame([("s", 1, True), ("s", 2, False), ("s", 3, True), ("t", 1, False), ("u", 1, True), ("u", 2, True)], "k string, o int, bad boolean")
    assert {tuple(r) for r in health.failures_in_row(ev, "k", F.col("o"), F.col("bad"), 2).collect()} == {("s", 1, "gul"), ("t", 0, "groen"), ("u", 2, "roed")}


RSS = b"<rss><channel><item><title>A &amp; B</title><link>https://a.example/1</link><description>t</description><pubDate>Mon, 02 Feb 2026 10:00:00 GMT</pubDate><category>x</category><category>x</category></item></channel></rss>"
ATOM = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>Å</title><link rel='alternate' href='https://a.example/2'/><published>2026-02-02T10:00:00Z</published><summary>s</summary></entry></feed>".encode()


def test_feeds(spark):
    assert feeds.read_feed(RSS) == (True, [("https://a.example/1", "A & B", "t", "Mon, 02 Feb 2026 10:00:00 GMT", ["x"])], None)
    assert feeds.read_feed(feeds.gzipped(ATOM))[1][0][:2] == ("https://a.example/2", "Å")
    for bad in (b"<html></html>", b"", b"<rss", b"<!DOCTYPE x [<!ENTITY a 'b'>]><rss><channel/></rss>"):
        assert feeds.read_feed(bad)[:2] == (False, []) and feeds.read_feed(bad)[2]
    with pytest.raises(feeds.Refused, match="too large"):
        feeds.unpack(feeds.gzipped(b"0" * 3_000_000), 1000)
    padded = b"<?xml version='1.0'?><!--" + b"<a>" * 5000 + b"--><!DOCTYPE rss [<!ENTITY x 'y'>]><rss><channel><item><title>&x;</title></item></channel></rss>"
    assert feeds.read_feed(padded) == (False, [], "document type")
    assert feeds.read_feed(b"<rss><channel><item><title><![CDATA[<!DOCTYPE html>]]></title></item></channel></rss>")[0]
    assert feeds.read_sitemap(b"<urlset><url><loc>https://a.example/</loc><lastmod>2026</lastmod></url></urlset>") == ("urlset", [("https://a.example/", "2026", None, None)], None)
    import base64

    url = b"https://a.example/langt/navn"
    token = base64.urlsafe_b64encode(b"\x08\x13\x22" + bytes([len(url)]) + url).decode().rstrip("=")
    df = spark.createDataFrame([(f"https://news.example/articles/{token}?x=1",), ("https://news.example/articles/zz",), (None,)], "u string")
    assert [r.x for r in df.select(feeds.encoded_target("u").alias("x")).collect()] == [url.decode(), None, None]
    df = spark.createDataFrame([("https://b.example/click?url=https%3A%2F%2Fa.example%2F1",), ("https://c.example/2026/02/03/x",)], "u string")
    assert [r.x for r in df.select(feeds.bing_target(F.col("u")).alias("x")).collect()] == ["https://a.example/1", "https://c.example/2026/02/03/x"]
    assert [str(r.x) for r in df.select(feeds.url_date(F.col("u")).alias("x")).collect()] == ["None", "2026-02-03"]
    doc = '{"value":[{"id":1,"titel":" T ","dato":"2026-02-02","offentlighedskode":"O","Dokumenttype":{"type":"a"},"Fil":[{"filurl":"x.html","variantkode":"H"},{"filurl":"x.pdf","variantkode":"P"}]},{"id":2,"offentlighedskode":"F"}]}'
    got = feeds.odata(spark.createDataFrame([(doc,), ("nonsense",)], "j string"), F.col("j"), ["b"]).collect()
    assert [(r.id, r.url, r.skipped) for r in got] == [(1, "x.pdf", None), (2, None, "not public")]
    days = spark.sql("select 'https://a.example/{dato}' as t, date '2026-02-01' as a, date '2026-02-03' as b").select(feeds.expand_days(F.col("t"), F.col("a"), F.col("b")).alias("x")).first().x
    assert days == [f"https://a.example/2026-02-0{k}" for k in (3, 2, 1)]


def test_pages(spark):
    html = """<html><head><meta property="og:title" content="Stor &amp; lille"><script type="application/ld+json">{"@graph":[{"datePublished":"2026-02-02"}]}</script></head>
    <body><nav><a href="/n">n</a></nav><main><h1>H</h1><p>Kort.</p><p>Et afsnit som er langt nok til at være indledning på siden.</p><a href="/a?x=1#y">Artikel om noget</a></main></body></html>"""
    assert pages.read_page(html)[:3] == ("Stor & lille", "2026-02-02", "Et afsnit som er langt nok til at være indledning på siden.")
    assert pages.read_page(None, "https://a.example/2026/03/04/x")[:3] == (None, "2026-03-04", None)
    assert pages.read_links(html, "https://a.example/", "example/a") == [("https://a.example/a?x=1", "Artikel om noget", None)]
    assert pages.decode_page("æ".encode("cp1252")) == "æ" and pages.decode_page("æ".encode(), "text/html; charset=utf-8") == "æ"


def test_records(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType())])
    (tmp_path / "a.json").write_text('{"id":"a","n":1}\nnot json\n{"id":"b","n":2}\n')
    good, bad = records.json_lines(spark, str(tmp_path / "a.json"), schema)
    assert {r.id for r in good.collect()} == {"a", "b"} and bad.count() == 1
    df = spark.createDataFrame([("a", 1, dt.datetime(2026, 1, 5)), ("b", 2, dt.datetime(2026, 3, 5))], "id string, n int, t timestamp")
    records.write_months(df, str(tmp_path / "m"), F.col("t"))
    assert {r.id for r in records.read_months(spark, str(tmp_path / "m"), schema, "2026-02-10").collect()} == {"b"}
    (tmp_path / "c.csv").write_bytes("navn;by\nÆrø;Å\n".encode("cp1252"))
    assert records.sniffed_csv(spark, str(tmp_path / "c.csv")).first().navn == "Ærø"
    records.feed_document(df.select("id", "n"), [F.asc("id")], str(tmp_path / "f"))
    assert spark.read.text(str(tmp_path / "f")).count() == 2
