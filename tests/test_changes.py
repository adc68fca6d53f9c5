import random

from kildestrom.operators.changes import apply_changes, live_images

SCHEMA = "seq bigint, id string, deleted boolean, title string, items array<string>, updated timestamp, arrived timestamp"


def _brute(lines):
    changes = {}
    for seq, key, deleted, title, items, updated, _ in lines:
        if key is not None:
            k = (key, deleted, title, tuple(items) if items is not None else None, updated)
            changes[k] = min(seq, changes.get(k, seq))
    last = {}
    for (key, deleted, _, _, updated), seq in changes.items():
        rank = (updated is not None, updated or 0, seq)
        if key not in last or rank > last[key][0]:
            last[key] = (rank, deleted, seq)
    return {(k, seq) for k, (_, deleted, seq) in last.items() if not deleted}


def _lines(n, seed):
    import datetime

    r = random.Random(seed)
    t0 = datetime.datetime(2026, 1, 1)
    rows = []
    for seq in r.sample(range(10 * n), n):
        key = "hot" if r.random() < 0.35 else r.choice([None, *map(str, range(30))])
        t = None if r.random() < 0.03 else t0 + datetime.timedelta(hours=r.randrange(40))
        gone = r.choice([True, False, None, False])
        rows.append((seq, key, gone, None if gone else r.choice(["a", "b", None]), None if gone else r.choice([["x"], [], None, ["x", None]]), t, t0))
    return rows


def test_signed_multiset_equals_last_change(spark):
    for seed in range(4):
        rows = _lines(600, seed)
        got = {tuple(r) for r in live_images(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert got == _brute(rows)


def test_empty_repeated_and_base(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert live_images(none).count() == 0
    rows = _lines(200, 9)
    df = spark.createDataFrame(rows + [(r[0] + 10**6, *r[1:6], None) for r in rows], SCHEMA)  # every line again, later
    assert {tuple(r) for r in live_images(df).collect()} == _brute(rows)
    base = spark.createDataFrame([(-1, "base", False, "old", None, None, None), (-2, "hot", False, "old", None, None, None)], SCHEMA)
    got = {r.id: r.seq for r in apply_changes(df, base=base).collect()}
    assert got["base"] == -1 and got.get("hot") != -2
    assert len(got) == len(_brute(rows)) + 1


def test_extra_columns_with_clashing_names(spark):
    rows = _lines(100, 3)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "id as key", "seq % 1 as version", "title as image")
    assert {tuple(r) for r in live_images(df).collect()} == _brute(rows)
