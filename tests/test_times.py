import datetime as dt

import pytest
from pyspark.sql import functions as F

from kildestrom.operators.times import parser_of, utc_micros

CASES = {
    "2026-03-29T02:30:00": "2026-03-29T01:30:00",  # skipped: the offset before the change
    "2026-10-25 02:30": "2026-10-25T00:30:00",  # twice: the first
    "2026-10-25": "2026-10-24T22:00:00",
    "1. januar 2026 kl. 00.30": "2025-12-31T23:30:00",
    "fredag den 13. september 2024, 14:15": "2024-09-13T12:15:00",
    "13/9-2024 kl. 15:55": "2024-09-13T13:55:00",
    "Sep 12, 2024 at 12:25 am": "2024-09-11T22:25:00",
    "September 10, 2024 12:48 PM": "2024-09-10T10:48:00",
    "Wed, 04 Sep 2024 05:30:06 EET": "2024-09-04T03:30:06",
    "17 Sep 2024 08:43:34 EST": "2024-09-17T13:43:34",
    "2024-09-12T12:00:00.1234567+05:45": "2024-09-12T06:15:00.123456",
    "20240904044945": "2024-09-04T02:49:45",
    "20240903T163519Z": "2024-09-03T16:35:19",
    "2024-W36-2": "2024-09-02T22:00:00",
    "2020-W53-7": "2021-01-02T23:00:00",
    "/Date(1725164025564+0200)/": "2024-09-01T04:13:45.564000",
    "1725523806": "2024-09-05T08:10:06",
    "den 16 oktober 2026 klockan 17:52": "2026-10-16T15:52:00",
    " 14.11.2026 kl. 00.23 ": "2026-11-13T23:23:00",
    "29.02.2024": "2024-02-28T23:00:00",
    "2021-W53-1": None,
    "29.02.2023": None,
    "31.02.2026 10:15": None,
    "2026-13-41": None,
    "1999-12-31T23:59:59": None,
    "2024-09-23 12:13 ZQT": None,
    "13:02": None,
    "23. september": None,
    "i dag": None,
    "": None,
    "x" * 5000: None,
    "2024-09-12 25:00": None,
    None: None,
}


def test_texts(spark):
    to_utc = utc_micros(spark, ["Europe/Copenhagen"])
    df = spark.createDataFrame([(k, v) for k, v in CASES.items()], "t string, want string")
    for r in df.select("t", "want", to_utc(F.col("t"), F.lit(None).cast("string")).alias("us")).collect():
        want = None if r.want is None else int((dt.datetime.fromisoformat(r.want) - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
        assert r.us == want, r.t


@pytest.mark.parametrize("zone", ["Europe/London", "Atlantic/Reykjavik", "America/St_Johns", "Europe/Stockholm"])
def test_zones_equal_the_standard_library(spark, zone):
    from zoneinfo import ZoneInfo

    try:
        info = ZoneInfo(zone)
    except Exception:
        pytest.skip("no zone data here")
    to_utc = utc_micros(spark, [zone])
    t, rows = dt.datetime(2024, 1, 1), []
    while t.year < 2028:
        rows.append((t.isoformat(), int((t.replace(tzinfo=info) - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) / dt.timedelta(microseconds=1))))
        t += dt.timedelta(hours=7, minutes=30)
    df = spark.createDataFrame(rows, "t string, want bigint")
    bad = df.select("t", "want", to_utc(F.col("t"), F.lit(zone)).alias("us")).filter("us is null or us <> want").collect()
    assert not bad


def test_unknown_zone_and_masks(spark):
    to_utc = utc_micros(spark, [])
    df = spark.createDataFrame([("2026-01-01", "Nowhere/Land"), ("2026-01-01T00:00:00Z", "Nowhere/Land")], "t string, z string")
    assert [r.us for r in df.select(to_utc(F.col("t"), F.col("z")).alias("us")).collect()] == [None, 1767225600000000]
    assert parser_of("9999-99-99") is parser_of("9999-99-99") and parser_of("9" * 70) is None


def test_other_zone_names_and_padding(spark):
    rows = [("2024-03-01 10:00 UT", None), ("2024-03-01 10:00 GMT", 1709287200_000_000), ("  2024-03-01\t10:00 " + " " * 300 + "GMT ", 1709287200_000_000), ("2024-03-01 10:00 pm", 1709330400_000_000), ("2024-03-01 10:00 \U0001d7d9", None)]
    to_utc = utc_micros(spark, ["UTC"])
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "k int, t string")
    got = {r.k: r.us for r in df.select("k", to_utc(F.col("t"), F.lit("UTC")).alias("us")).collect()}
    assert [got[k] for k in range(len(rows))] == [w for _, w in rows]
