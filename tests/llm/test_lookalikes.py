from pyspark.sql import functions as F

from kildestrom.llm.lookalikes import LOOKALIKES, Canoniser, best_word, bigram_model, disguised_fields

CASES = {
    "Nу kаffe": ("Ny kaffe", True),
    "so­ft hy​phen": ("soft hyphen", True),
    "to ord": ("to ord", True),
    "ＡＢ１２，": ("AB12,", True),
    "𝐛𝐨𝐥𝐝": ("bold", True),
    "ﬁnd": ("find", True),
    "ångst": ("ångst", True),
    "Новатрик og Ρεκυτα": ("Новатрик og Ρεκυτα", False),
    "å é – » … 5 °C CO₂ m² ½ 3 €": ("å é – » … 5 °C CO₂ m² ½ 3 €", False),
    "": ("", False),
}


def test_cases():
    for raw, want in CASES.items():
        assert Canoniser()(raw) == want, raw


def test_fields(spark):
    rows = [(str(k), raw, None) for k, raw in enumerate(CASES)] + [("x", None, "to ord"), ("x", None, "to ord"), (None, "ok", "")]
    df = spark.createDataFrame(rows, "id string, title string, teaser string").withColumn("text", F.lit("clash")).withColumn("found", F.lit(1))
    got = {(r.id, r.field): r.text for r in disguised_fields(df, "id", ["title", "teaser"], bigram_model(df, ["title", "teaser"])).collect()}
    want = {(str(k), "title"): w for k, (w, found) in enumerate(CASES.values()) if found} | {("x", "teaser"): "to ord"}
    assert got == want
    none = df.filter("false")
    assert disguised_fields(none, "id", ["title", "teaser"], bigram_model(none, ["title", "teaser"])).count() == 0


def test_model_chooses_between_readings(spark):
    df = spark.createDataFrame([("hund hus hav nu nyt " * 50,)], "t string")
    model = bigram_model(df, ["t"])
    assert best_word("нus", model) == "hus" and best_word("nуt", model) == "nyt"
    assert all(len(x) >= 1 for x in LOOKALIKES.values())


def test_long_text():
    assert Canoniser()("а" + "b" * 100_000)[0] == "a" + "b" * 100_000
