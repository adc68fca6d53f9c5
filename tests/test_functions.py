import re

from pyspark.sql import functions as F

from kildestrom.functions import dates, patterns, text, urls


def _one(spark, values, fn):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r.x for r in df.select("k", fn(F.col("v")).alias("x")).orderBy("k").collect()]


def test_urls(spark):
    cases = {
        "HTTP://www.Eksempel.DK:80/Sti/?b=2&a=1&utm_source=x#top": "https://eksempel.dk/Sti?a=1&b=2",
        "//a.example/": "https://a.example/",
        "a.example/x?q=a+b&empty=": "https://a.example/x?empty=&q=a%20b",
        "ftp://a.example/x": "ftp://a.example/x",
        "https://a.example/x?FBCLID=1&ref=2": "https://a.example/x",
        "": "",
        None: None,
    }
    assert _one(spark, cases, urls.normalise_url) == list(cases.values())
    same = ["http://www.a.example:80/x/?b=1&a=2&gclid=3#f", "https://A.example/x?a=2&b=1", "https://a.example/X?a=2&b=1"]
    keys = _one(spark, same, urls.address_key)
    assert keys[0] == keys[1] != keys[2]
    assert _one(spark, ["https://www.A.example:8080/x", "nothing", None], urls.host_of) == ["a.example", "nothing", None]


def test_texts(spark):
    assert _one(spark, ["<p>En &amp; <b>to</b></p>", "a<script>x</script>b", None, "ord " * 50], lambda c: text.clean_text(c, 20)) == ["En & to", "a b", None, "ord ord ord ord ord…"]
    assert _one(spark, ["Rødgrød – med FLØDE!", None, ""], text.title_key) == ["rødgrød med fløde", "", ""]
    assert _one(spark, ["Ærø Å-sti", "Café"], text.slug) == ["aeroe-aa-sti", "cafe"]
    assert _one(spark, ["Ærø Århus", "Café"], text.fold) == ["aero arhus", "cafe"]
    assert _one(spark, ["Det Lange Navn (DLN)", "Kort (ikke et akronym)"], text.short_name) == ["DLN", "Kort"]
    assert _one(spark, ["", None, " a  b "], text.word_count) == [0, 0, 2]
    df = spark.createDataFrame([("a b c d e f g", "x a b c d e f y"), ("a b c", "c b a")], "a string, b string")
    got = df.select(text.copied(F.col("a"), F.col("b")), text.longest_shared_run(text.words(F.col("a")), text.words(F.col("b")))).collect()
    assert [tuple(r) for r in got] == [(True, 6), (False, 1)]


def test_patterns(spark):
    for pattern, yes, no in [("glas*", "Nyt glasværk her", "husglas"), ("*glas*", "husglasset", "hus"), ("Fur", "på Fur i dag", "en fur gren"), ("a b", "x A  b y", "ab"), ("ø*", "den Østre", "bøn")]:
        rx = patterns.compile_pattern(pattern)
        assert _one(spark, [yes, no], lambda c, rx=rx: c.rlike(rx)) == [True, False], pattern
    df = spark.createDataFrame([("glas og papir", "glas glas"), (None, None), ("", "affald")], "t string, z string")
    got = df.select(patterns.score(F.col("t"), F.col("z"), ["glas"], ["papir", "affald"]).alias("s")).select("s.score").collect()
    assert [r.score for r in got] == [7, 0, 0]


def test_dates(spark):
    df = spark.sql("select timestamp '2026-03-29 00:30:00' as t union all select timestamp '2026-12-31 23:30:00'")
    rows = df.select(dates.local_day(F.col("t")).cast("string").alias("d"), dates.iso_week(dates.local_day(F.col("t"))).alias("w")).collect()
    assert {(r.d, r.w) for r in rows} == {("2026-03-29", "2026-W13"), ("2027-01-01", "2026-W53")}
    assert re.fullmatch(r"\d{4}-W\d\d", rows[0].w)
