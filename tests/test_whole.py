"""Queries do the whole job on made-up tables that hold what small data lack."""

import datetime as dt

from kildestrom.plans import text_queries


def _table(df, folder, name):
    df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_sitemap_newest_keeps_addresses_with_signs(spark, tmp_path):
    urls = ["https://a.example/?a=1&b=2", "https://a.example/?q=<x>&amp;y", "https://a.example/new", "https://a.example/old"]
    rows = [(f"i{k}", "s", u, dt.datetime(2026, 1, 9 - k)) for k, u in enumerate(urls)]
    d = _table(spark.createDataFrame(rows, "id string, source string, url string, first_seen timestamp"), tmp_path, "candidate")
    got = {(r.rank, r.loc) for r in text_queries.sitemap_newest(spark, d).collect()}
    assert got == {(k + 1, u) for k, u in enumerate(urls[:3])}


def test_title_keys_slug_the_whole_title(spark, tmp_path):
    start = "Kommunen henter affald i alle byens gader og stræder hver eneste "
    rows = [(1, start + "mandag\nTekst"), (2, start + "fredag\nTekst"), (3, "")]
    d = _table(spark.createDataFrame(rows, "doc_id bigint, text string"), tmp_path, "documents")
    got = {r.doc_id: r.slug for r in text_queries.title_keys(spark, d).collect()}
    whole = "kommunen-henter-affald-i-alle-byens-gader-og-straeder-hver-eneste-"
    assert got == {1: whole + "mandag", 2: whole + "fredag", 3: ""}


def test_clean_teasers_keep_what_intake_keeps(spark, tmp_path):
    whole = " ".join(f"ord{k:04}" for k in range(37))  # 295 characters
    rows = [("a", f"<p>{whole}</p>", dt.datetime(2026, 1, 1)), ("b", whole + " " + whole, dt.datetime(2026, 1, 1)), ("c", None, dt.datetime(2026, 1, 1))]
    d = _table(spark.createDataFrame(rows, "id string, teaser string, first_seen timestamp"), tmp_path, "candidate")
    got = {r.id: r.teaser for r in text_queries.clean_teasers(spark, d).collect()}
    assert got == {"a": whole, "b": whole + "…", "c": None}


def test_far_years_padded_texts_and_long_fractions_denote_instants(spark):
    from pyspark.sql import functions as F

    from kildestrom.operators.times import utc_micros

    cases = {
        "9999-12-31": "9999-12-30T23:00:00",
        "2100-07-01 12:00": "2100-07-01T10:00:00",
        "3000-03-30 03:30": "3000-03-30T01:30:00",  # the last Sunday of March
        "3000-03-29 03:30": "3000-03-29T02:30:00",
        "2400-02-29T12:00:00Z": "2400-02-29T12:00:00",
        " " * 150 + "2026-10-25" + " " * 150: "2026-10-24T22:00:00",
        "2024-09-12T12:00:00." + "1234567" * 40 + "Z": "2024-09-12T12:00:00.123456",
    }
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    got = {r.t: r.us for r in df.select("t", utc_micros(spark, [])(F.col("t"), F.lit(None).cast("string")).alias("us")).collect()}
    assert got == {t: (dt.datetime.fromisoformat(w) - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1) for t, w in cases.items()}


def test_years_past_the_zone_tables_follow_the_last_rules(spark):
    import numpy as np

    from kildestrom.operators.times import zone_tables

    zones = spark.sparkContext._jvm.java.time
    for name in ("Europe/Copenhagen", "America/St_Johns", "Africa/Casablanca", "Australia/Sydney"):
        table, rules = zone_tables(spark, [name])[name], zones.ZoneId.of(name).getRules()
        for year in (2099, 2128, 2129, 2200, 2400, 2777, 9999):
            for month in range(1, 13):
                local = zones.LocalDateTime.of(year, month, 27, 12, 0)
                us = (dt.datetime(year, month, 27, 12) - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
                assert table.offset_us(np.array([us]))[0] == rules.getOffset(local).getTotalSeconds() * 1_000_000, (name, year, month)
