"""Queries of what readers see: overrides, cards, timelines, exports, places, labels, validation of documents and time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kildestrom.functions import dates, patterns, registry, text
from kildestrom.operators import display, facets, logs, places, quality, ranking
from kildestrom.operators.display import Override
from kildestrom.plans.table_queries import GENRE_RANK, QUERY
from kildestrom.session import small_side, table
from kildestrom.streaming import streams

NOW = "2026-11-01 12:00:00"
RULES = [Override({"genre": "debat"}, url_regex=r"/artikel/"), Override({"genre": "nyhed", "lang": "xx"}, url_regex=r"kategori=udbud"), Override({"genre": "analyse"}, url_regex=r"^https://[^/]*e\.example/2026/"), Override({"lang": "yy"}, id="8ed88d60882e")]
STRONG = ["gebyr*", "genbrug*", "*container*", "udbud"]


def _now() -> object:
    return F.lit(NOW).cast("timestamp")


def _c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.first(table(spark, sf_dir, "candidate"), "id", [F.col("first_seen")])


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.latest(table(spark, sf_dir, "judgment"), "id", [F.col("seq")])


def _alive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.latest(table(spark, sf_dir, "timeline_line"), "id", [F.col("updated"), F.col("seq")]).filter("not coalesce(deleted, false)")


def _rank() -> object:
    return F.coalesce(F.array_position(F.array(*[F.lit(g) for g in GENRE_RANK]), F.col("genre")), F.lit(9))


def overridden_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with genre and language after the rules, the later ones winning."""
    return display.overridden(_c(spark, sf_dir).select("id", "url", "genre", "lang"), RULES).select("id", "genre", "lang")


def approved_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items judged relevant within a year of sources that may be read in full."""
    full = table(spark, sf_dir, "feed_source").filter("paywall <> 'ja'").select(F.col("id").alias("source"))
    rows = _c(spark, sf_dir).filter(F.col("first_seen").between(_now() - F.expr("interval 365 days"), _now())).join(small_side(full), "source", "left_semi")
    return rows.join(_judged(spark, sf_dir).filter("relevant").select("id"), "id", "left_semi").select("id", "source")


def rewrite_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 newest approved items with a teaser of 40 characters and no summary yet, and how many there are in all."""
    rows = approved_items(spark, sf_dir).join(_c(spark, sf_dir).filter(F.length("teaser") >= 40).select("id", "first_seen"), "id")
    rows = rows.join(table(spark, sf_dir, "judgment").filter("summary_da is not null").select("id").distinct(), "id", "left_anti")
    return ranking.top(rows, [F.desc("first_seen"), F.asc("id")], 200).select("id").withColumn("total", F.lit(rows.count()).cast("bigint"))


def story_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day bundles as head and members, which have the head's topics and places where they have none."""
    rows = _c(spark, sf_dir).select("id", "source", "genre", "topics", "places", "first_seen", F.concat_ws("/", "source", dates.local_day(F.col("first_seen")).cast("string")).alias("unit"))
    main = rows.groupBy("unit").agg(F.min_by("id", F.struct(_rank(), "first_seen", "id")).alias("main"))
    both = rows.join(main, "unit")
    out = display.members(both.filter("id = main"), both.filter("id <> main"), "unit", ["topics", "places"], {"genre": F.lit("andet")})
    return out.select("unit", "id", "is_head", "genre", F.array_join("topics", ",").alias("topics"), F.array_join("places", ",").alias("places"))


def story_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day bundle the head if it matches, else the first that does."""
    rows = _c(spark, sf_dir).withColumn("unit", F.concat_ws("/", "source", dates.local_day(F.col("first_seen")).cast("string")))
    rows = rows.join(rows.groupBy("unit").agg(F.min_by("id", F.struct(_rank(), "first_seen", "id")).alias("main")), "unit")
    return facets.cards(rows, "unit", F.col("genre").isin("nyhed", "debat"), [F.col("first_seen"), F.col("id")], F.col("id") == F.col("main")).select("unit", "id")


def relaxed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many candidates match when one filter is left out, most helpful first."""
    rows = _c(spark, sf_dir)
    keys = {"genre": F.array("genre"), "source": F.array("source"), "topic": F.col("topics")}
    return display.relaxations(rows, QUERY, keys, dates.local_day(F.col("first_seen")), F.col("title"))


def timeline_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alive events newest first with page (12 months each), first item and known places; items oldest first."""
    known = table(spark, sf_dir, "candidate").select(F.explode("places").alias("place")).distinct()
    rows = _alive(spark, sf_dir).withColumn("ordered", F.array_sort(F.transform("items", lambda i: F.struct(i["published"].alias("at"), i["id"].alias("id")))))
    kept = rows.select("id", F.explode("places").alias("place")).join(known, "place", "left_semi").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("place")), ",").alias("places"))
    months = rows.select(F.date_format("day", "yyyy-MM").alias("month")).distinct()
    number = ranking.with_position(months, [F.desc("month")]).select("month", F.floor(F.col("position") / 12).cast("bigint").alias("page"))
    first = F.get("ordered", F.lit(0))["id"]
    stories = _c(spark, sf_dir).select(F.col("id").alias("first_item"), F.col("source").alias("story"))
    out = rows.select("id", F.col("day").cast("string").alias("day"), F.date_format("day", "yyyy-MM").alias("month"), first.alias("first_item"), F.size("items").alias("n")).join(number, "month").join(kept, "id", "left").join(stories, "first_item", "left")
    return out.select("id", "day", "page", "first_item", "n", F.coalesce("places", F.lit("")).alias("places"), "story")


def feed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published feed, one compact JSON record a line."""
    rows = _c(spark, sf_dir).join(_judged(spark, sf_dir).filter("relevant").select("id"), "id", "left_semi")
    return rows.select("id", F.to_json(F.struct("id", "source", "genre", F.date_format("first_seen", "yyyy-MM-dd HH:mm").alias("at"), F.coalesce("topics", F.array().cast("array<string>")).alias("topics"))).alias("line"))


def sender_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Senders with their state: active ones, those of searches only if used, and paused ones as waiting."""
    state = table(spark, sf_dir, "candidate").groupBy(F.col("source").alias("id")).agg(F.max("first_seen").alias("last"), F.countDistinct("id").alias("n"))
    rows = table(spark, sf_dir, "feed_source").join(small_side(state), "id", "left")
    shown = rows.filter("status = 'aktiv' and (method <> 'search' or n > 0)").select("id", F.lit("shown").alias("block"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.unix_timestamp("last"), F.lit(0)).alias("last"))
    return shown.unionByName(rows.filter("status = 'pause'").select("id", F.lit("waiting").alias("block"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("last")))


def status_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources with counts of the last 60 days, shown ones, and of turned-down ones of 30."""
    day = lambda n: F.col("first_seen") >= _now() - F.expr(f"interval {n} days")
    counts = _c(spark, sf_dir).groupBy(F.col("source").alias("id")).agg(F.count_if(day(60)).alias("found"), F.count_if(day(60) & (F.col("why.decision") == "vis")).alias("shown"), F.count_if(day(30) & (F.col("why.decision") != "vis")).alias("turned_down"))
    return table(spark, sf_dir, "feed_source").select("id", "status").join(counts, "id", "left").fillna(0, ["found", "shown", "turned_down"])


def fresh_overviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overview files by name: the newest of every kind and month, and whether its day is the last one."""
    name = F.concat(F.element_at(F.array(F.lit("dag"), F.lit("uge")), (F.pmod(F.dayofmonth("day"), F.lit(2)) + 1)), F.lit("-"), F.col("day").cast("string"), F.lit(".json"))
    names = _alive(spark, sf_dir).select(name.alias("file")).distinct()
    kind, day = F.regexp_extract("file", r"^([a-z]+)-(\d{4}-\d\d-\d\d)\.json$", 1), F.regexp_extract("file", r"^([a-z]+)-(\d{4}-\d\d-\d\d)\.json$", 2)
    rows = names.select(kind.alias("kind"), day.alias("day"), "file").filter("day <> ''")
    best = rows.groupBy("kind", F.substring("day", 1, 7).alias("month")).agg(F.max_by("file", "day").alias("file"), F.max("day").alias("day"))
    last = rows.agg(F.max("day").alias("d")).first().d
    return best.withColumn("fresh", F.col("day") == F.lit(last))


def prefetch_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of strict sources whose path or title has a strong word, before the page is fetched."""
    strict = table(spark, sf_dir, "feed_source").filter("filter_level = 'strict'").select(F.col("id").alias("source_id"))
    rows = table(spark, sf_dir, "raw_entry").join(small_side(strict), "source_id", "left_semi").select("ord", "url", "title").distinct()
    words = F.concat_ws(" ", registry.slug_text(F.col("url")), F.col("title"))
    return rows.select("ord", (F.size(patterns.hits(words, STRONG)) > 0).alias("wanted"))


def source_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose name contains what was typed in either spelling, by category; categories without a hit are hidden."""
    rows = table(spark, sf_dir, "feed_source")
    hit = rows.filter(text.fold(F.col("name")).contains("groen") | text.fold(F.col("name"), text.LONG_FOLD).contains("groen") | F.lower("name").contains("by"))
    counts = rows.join(hit.select("category").distinct(), "category", "left_semi").groupBy("category").agg(F.count("*").alias("of"))
    return hit.select("category", "id").join(counts, "category")


def shown_in_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that are shown by the list of sources and by that of categories, with items."""
    rows = table(spark, sf_dir, "feed_source").select(F.col("id").alias("source"), ((~F.col("category").isin("lokalmedie", "forskning")) & ~F.col("id").startswith("b")).alias("shown"))
    return _c(spark, sf_dir).join(small_side(rows.filter("shown")), "source", "left_semi").groupBy("source").agg(F.count("*").alias("n"))


def place_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling of the places' names with the place: plain, genitive, with its kind."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("k:"), F.lower("n_name")).alias("id"), F.initcap(F.lower("n_name")).alias("name"))
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r:"), F.lower("r_name")).alias("id"), F.initcap(F.lower("r_name")).alias("name"))
    return places.place_names(n.unionByName(r), {"k:": "{0} Kommune", "r:": "Region {0}"}).select("id", "name")


def place_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last words of the sources' names as labels, with the category where several have one."""
    rows = table(spark, sf_dir, "feed_source").select("id", F.element_at(F.split("name", " "), -1).alias("name"), "category")
    return display.labels(rows, "name", "category").select("id", "label")


def tagged_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Danish candidates whose places change when titles and teasers are read anew: fixed ones and names found, at most eight."""
    rows = _c(spark, sf_dir).select("id", "lang", "title", "teaser", "places")
    dims = rows.select(F.explode("places").alias("place")).distinct().select("place", F.substring_index("place", ":", -1).alias("slug"))
    danish = rows.filter("lang = 'da'")
    found = F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", "title", "teaser"), F.lit(r"(\p{Lu}[\p{L}]{3,})"), 1))
    named = danish.select("id", F.explode(found).alias("word")).select("id", text.slug(F.col("word")).alias("slug")).join(dims, "slug").groupBy("id").agg(F.collect_set("place").alias("named"))
    both = danish.select("id", F.coalesce("places", F.array().cast("array<string>")).alias("places")).join(named, "id")
    new = places.sort_places(F.array_union("places", "named"))
    return both.filter(~new.eqNullSafe(F.col("places"))).select("id", F.array_join(new, ",").alias("places"))


def geo_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All regions, and of the nations those with a supplier that has debts."""
    used = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_nationkey").alias("n_nationkey")).distinct()
    nations = table(spark, sf_dir, "nation").join(used, "n_nationkey", "left_semi").select(F.lit("k").alias("kind"), F.col("n_name").alias("name"))
    return table(spark, sf_dir, "region").select(F.lit("r").alias("kind"), F.col("r_name").alias("name")).unionByName(nations)


def part_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Towns summed over their parts, with the main part: segments over nations."""
    parts = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("town"), F.col("c_nationkey").alias("part")).agg(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).alias("s"))
    return parts.groupBy("town").agg(F.sum("s").cast("double").alias("total"), F.max_by("part", F.struct("s", "part")).alias("main"))


def name_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places that alone mean their name: a fifth heavier than the next of the name."""
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name"), F.col("p_size").alias("id")).agg(F.count("*").alias("n"))
    return display.winner(rows, "name", "n", "id", 1.2)


def region_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with another number of nations than five."""
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n")).withColumn("right", F.col("n") == 5)


def filled_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the user of the last purchase before them, as rows below a heading."""
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "purchase", F.col("user_id")).alias("head"))
    return display.filled_down(rows, ["event_id"], "head", "heading").select("event_id", F.coalesce("heading", F.lit(-1)).alias("heading"))


def day_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compact labels of the span of days of every topic and level."""
    rows = _alive(spark, sf_dir).select(F.explode("topics").alias("topic"), "level", "day", F.month("day").alias("month")).groupBy("topic", "level", "month").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    return rows.select("topic", "level", "month", display.range_label(F.col("a"), F.col("b")).alias("both"), display.range_label(F.col("a"), F.lit(None).cast("date")).alias("open"))


def shifted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of the items within events moved by a day and a half."""
    moved = F.transform("items", lambda i: F.date_format(i["published"] + F.expr("interval 36 hours"), "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf_dir, "timeline_line").select("seq", F.array_join(F.coalesce(moved, F.array().cast("array<string>")), ",").alias("times"))


def reference_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two items of every alive event and how many more it has."""
    r = display.reference_line(F.col("items"))
    return _alive(spark, sf_dir).select("id", F.array_join(r["links"], ",").alias("links"), r["rest"].alias("rest"))


def distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that several candidates have, and whether all come from different sources."""
    rows = _c(spark, sf_dir).select(text.title_key(F.col("title")).alias("key"), "source")
    return rows.groupBy("key").agg(F.count("*").alias("n"), (F.countDistinct("source") == F.count("*")).alias("apart")).filter("n > 1")


def day_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items per local day and per month, as headers."""
    day = dates.local_day(F.col("first_seen"))
    rows = _c(spark, sf_dir).select(F.explode(F.array(day.cast("string"), F.date_format(day, "yyyy-MM"))).alias("header"))
    return rows.groupBy("header").agg(F.count("*").alias("n"))


def new_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items new since a visit: no baseline, found after it, at most three days after their day; those of a facet and all."""
    at = F.try_to_timestamp("published", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    fresh = ~F.col("baseline") & (F.col("first_seen") > F.lit("2026-09-01").cast("timestamp")) & (F.col("first_seen") <= at + F.expr("interval 3 days"))
    rows = _c(spark, sf_dir).filter(F.col("published").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$")).filter(fresh)
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("genre") == "nyhed").alias("filtered"))


def quiet_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active sources followed for 30 days that brought nothing in the last 30."""
    counts = table(spark, sf_dir, "candidate").groupBy(F.col("source").alias("id")).agg(F.min("first_seen").alias("since"), F.count_if(F.col("first_seen") >= _now() - F.expr("interval 30 days")).alias("recent"))
    rows = table(spark, sf_dir, "feed_source").filter("status = 'aktiv'").join(small_side(counts), "id", "left")
    return rows.select("id", ((F.coalesce("recent", F.lit(0)) == 0) & (F.col("since") <= _now() - F.expr("interval 30 days"))).alias("silent"))


def recent_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw entries whose title their source already had among the candidates of the week before the entry's batch."""
    starts = F.date_add(F.lit("2026-01-01").cast("date"), (F.col("batch") * 7).cast("int")).cast("timestamp")
    rows = table(spark, sf_dir, "raw_entry").select("ord", F.col("source_id").alias("source"), text.title_key(F.col("title")).alias("key"), starts.alias("at")).distinct().filter(F.size(F.split("key", " ")) >= 4)
    had = _c(spark, sf_dir).select("source", text.title_key(F.col("title")).alias("key"), "first_seen").groupBy("source", "key").agg(F.collect_set(F.date_trunc("day", "first_seen")).alias("days"))  # days of one title
    return rows.join(had, ["source", "key"]).select("ord", F.exists("days", lambda d: (d < F.col("at")) & (d >= F.col("at") - F.expr("interval 7 days"))).alias("recent"))


def overview_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 best day bundles for an overview: by size, rank and time, and whether an event holds the main item."""
    rows = _c(spark, sf_dir).withColumn("day", dates.local_day(F.col("first_seen")).cast("string"))
    heads = rows.groupBy("source", "day").agg(F.min_by("id", F.struct(_rank(), "first_seen", "id")).alias("main"), F.count("*").alias("n"), F.min(_rank()).alias("rank"), F.max("first_seen").alias("at"))
    best = ranking.top(heads, [F.desc("n"), F.asc("rank"), F.desc("at"), F.asc("main")], 40)
    held = table(spark, sf_dir, "timeline_line").select(F.explode("items").alias("i")).select(F.col("i.id").alias("main"), F.lit(True).alias("highlight")).distinct()
    return best.join(held, "main", "left").select("main", "source", "day", "n", F.coalesce("highlight", F.lit(False)).alias("highlight"))


def ready_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months with their candidates that nobody has judged: a month without any is ready to be filled."""
    rows = _c(spark, sf_dir).select("id", F.date_format(dates.local_day(F.col("first_seen")), "yyyy-MM").alias("month"))
    open_ = rows.join(table(spark, sf_dir, "judgment").select("id").distinct(), "id", "left_anti").groupBy("month").agg(F.count("*").alias("open"))
    return rows.groupBy("month").agg(F.count("*").alias("n")).join(open_, "month", "left").fillna(0, ["open"]).withColumn("ready", F.col("open") == 0)


def pending_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document a source: pending and approved items by number, newest pending ones by id."""
    j = _judged(spark, sf_dir).select("id", "relevant")
    rows = _c(spark, sf_dir).select("id", "source", "first_seen").join(j, "id", "left")
    sums = rows.groupBy("source").agg(F.count_if(F.col("relevant").isNull()).alias("pending"), F.count_if("relevant").alias("approved"))
    last = ranking.top_per(rows.filter("relevant is null"), ["source"], [F.desc("first_seen"), F.asc("id")], 3)
    newest = last.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("newest"))  # three a source
    doc = F.to_json(F.struct("pending", "approved", F.coalesce("newest", F.array().cast("array<string>")).alias("newest")))
    return sums.join(newest, "source", "left").select("source", doc.alias("document"))


def item_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best suggestions for what was typed among topics, places and sources; the fuller ones first within a rank."""
    c = _c(spark, sf_dir)
    kinds = [("1 emne", c.select(F.explode("topics").alias("name"))), ("2 sted", c.select(F.explode("places").alias("name"))), ("3 kilde", c.select(F.col("source").alias("name")))]
    rows = None
    for kind, df in kinds:
        part = df.groupBy("name").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
        rows = part if rows is None else rows.unionByName(part)
    bare = F.regexp_replace("name", "^[rkb]:", "")
    ranked = rows.withColumn("rank", F.when(bare.startswith("b"), 1).when(bare.contains("_b"), 2)).filter("rank is not null")
    return ranking.top(ranked, [F.asc("rank"), F.asc("kind"), F.desc("n"), F.asc("name")], 8).select("kind", "name", "n", "rank")


def summary_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that judges' summaries break."""
    rows = table(spark, sf_dir, "judgment").filter("summary_da is not null").dropDuplicates(["seq"])
    rules = {"length": F.length("summary_da").between(20, 240), "stop": F.col("summary_da").rlike(r"[.?!]$"), "relevant": F.col("relevant"), "one line": ~F.col("summary_da").contains("\n")}
    return quality.failures(rows, "seq", rules).unionByName(quality.missing(rows, "seq", "id", table(spark, sf_dir, "candidate"), "id", "unknown id"))


def timeline_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that written timeline lines break."""
    rows = table(spark, sf_dir, "timeline_line").filter("not coalesce(deleted, false)")
    rules = {
        "title": text.word_count(F.col("title")) <= 12, "summary": text.word_count(F.col("summary")) <= 20, "items": F.size("items").between(1, 8), "id": F.length("id") <= 80, "filed": F.col("id").startswith(F.date_format("day", "yyyy-MM-dd")),
        "future": F.col("day") <= F.to_date("updated"), "repeated": F.size(F.array_distinct(F.transform("items", lambda i: i["id"]))) == F.size("items"),
    }
    known = table(spark, sf_dir, "candidate").select("id")
    refs = rows.select("seq", F.explode("items").alias("i")).select("seq", F.col("i.id").alias("ref")).distinct()
    return quality.failures(rows, "seq", rules).unionByName(quality.missing(refs, "seq", "ref", known, "id", "unknown item").distinct())


def overview_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that weekly overviews of the events break: number of events, citations approved, words."""
    ok = _judged(spark, sf_dir).filter("relevant").select("id")
    rows = _alive(spark, sf_dir).select("id", dates.iso_week(F.col("day")).alias("week"), "title", "items")
    weeks = rows.groupBy("week").agg(F.count("*").alias("n"), F.max(text.word_count(F.col("title"))).alias("words"))
    cited = rows.select("week", F.explode("items").alias("i")).select("week", F.col("i.id").alias("ref")).distinct()
    return quality.failures(weeks, "week", {"count": F.col("n").between(3, 12), "words": F.col("words") <= 16}).unionByName(quality.missing(cited, "week", "ref", ok, "id", "not approved").distinct())


def registry_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules across the registry: unique domains, homepage among the domains, topics that items have, items of known sources."""
    s = table(spark, sf_dir, "feed_source")
    hosts = s.select("id", F.explode("domains").alias("domain"))
    twice = hosts.join(quality.duplicates(hosts, "domain").select("domain"), "domain", "left_semi").select("id", F.lit("domain").alias("rule"))
    rules = {"homepage": F.array_contains("domains", F.regexp_replace("homepage", r"^https?://(?:www\.)?", "")), "checked": F.col("checked") >= F.lit("2026-10-10").cast("date"), "id": F.col("id").rlike("^[a-z0-9][a-z0-9-]*$")}
    used = table(spark, sf_dir, "candidate").select(F.explode("topics").alias("topic")).distinct()
    topics = s.select("id", F.explode("topics").alias("topic"))
    idle = s.select("id").join(table(spark, sf_dir, "candidate").select(F.col("source").alias("id")).distinct(), "id", "left_anti").select("id", F.lit("idle").alias("rule"))
    return quality.failures(s, "id", rules).unionByName(twice).unionByName(quality.missing(topics, "id", "topic", used, "topic", "topic")).unionByName(idle)


def geography_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the timeline that no candidate has, and nations without their region."""
    known = table(spark, sf_dir, "candidate").select(F.explode("places").alias("place"))
    tags = table(spark, sf_dir, "timeline_line").select(F.explode("places").alias("place")).distinct().withColumn("key", F.col("place"))
    lost = table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").alias("r"))
    return quality.missing(tags, "key", "place", known, "place", "place").unionByName(quality.missing(lost, "key", "r", table(spark, sf_dir, "region"), "r_regionkey", "parent"))


def lateness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timeline lines by how their arrival lies to their time: ahead of it by the clock's slack, ahead, on time, late by a day, by a week."""
    ago = F.unix_timestamp("arrived") - F.unix_timestamp("updated")
    kind = F.when(ago < -7200, "ahead").when(ago < 0, "skew").when(ago < 86_400, "on time").when(ago < 7 * 86_400, "late").otherwise("too late")
    return table(spark, sf_dir, "timeline_line").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def rolling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates per source of today, and of the last 7, 30 and 365 times 24 hours."""
    day = F.to_utc_timestamp(F.to_date(F.from_utc_timestamp(_now(), "Europe/Copenhagen")).cast("timestamp"), "Europe/Copenhagen")
    within = lambda since: F.count_if((F.col("first_seen") >= since) & (F.col("first_seen") <= _now()))
    ago = lambda n: _now() - F.expr(f"interval {n * 24} hours")
    return _c(spark, sf_dir).groupBy("source").agg(within(day).alias("dag"), within(ago(7)).alias("uge"), within(ago(30)).alias("maaned"), within(ago(365)).alias("aar"))


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per kind and fixed window of six hours, from a stream."""
    rows = streams.stream_of(spark, sf_dir, "events.parquet").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    out = streams.drain(streams.window_counts(rows, ["event_type"], "ts", "6 hours", "40 days"), "windows", "update", ["event_type", "start"])
    return out.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users and kinds with gaps below an hour, from a stream."""
    rows = streams.stream_of(spark, sf_dir, "events.parquet").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    out = streams.drain(streams.session_counts(rows, ["user_id", "event_type"], "ts", "1 hour", "40 days"), "sessions", "complete")
    return out.groupBy("user_id", "event_type").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


QUERIES = {
    f.__name__: f
    for f in (
        overridden_items, approved_items, rewrite_queue, story_members, story_cards, relaxed_queries, timeline_export, feed_lines, sender_block, status_block, fresh_overviews, prefetch_words, source_search, shown_in_both, place_names, place_labels,
        tagged_places, geo_block, part_sums, name_winners, region_counts, filled_headings, day_ranges, shifted_items, reference_lines, distinct_sources, day_headers, new_cards, quiet_sources, recent_titles, overview_input, ready_months, pending_document,
        item_suggestions, summary_errors, timeline_errors, overview_errors, registry_errors, geography_errors, lateness, rolling_windows, stream_windows, stream_sessions,
    )
}

_C = "c as (select * from candidate qualify row_number() over (partition by id order by first_seen) = 1)"
_J = "j as (select * from judgment qualify row_number() over (partition by id order by seq desc) = 1)"
_A = "t as (select * from timeline_line qualify row_number() over (partition by id order by updated desc, seq desc) = 1), a as (select * from t where not coalesce(deleted, false))"
_DAY = "cast(timezone('Europe/Copenhagen', first_seen) as date)"
_N = f"timestamptz '{NOW}+00'"
_RANK = "coalesce(nullif(list_position(['" + "', '".join(GENRE_RANK) + "'], genre), 0), case when genre is null then 9 else 0 end)"
_KEY = r"trim(regexp_replace(lower(coalesce(title, '')), '[^\p{L}\p{N}]+', ' ', 'g'))"
_SLUG = "regexp_replace(regexp_replace(translate(replace(replace(replace(replace(lower(word), 'å', 'aa'), 'ø', 'oe'), 'æ', 'ae'), 'ß', 'ss'), 'äöüéèàâêëïîôûçñ', 'aoueeaaeeiioucn'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
_UNIT = f"source || '/' || cast({_DAY} as varchar)"
_F = lambda c: f"(day({c}) || '.' || month({c}) || '.' || year({c}))"
_IN, _OUT = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
# the regular expressions that the patterns of STRONG stand for, written out
_STRONG = [rf"(?:^|{_OUT})[gG][eE][bB][yY][rR]{_IN}*(?:$|{_OUT})", rf"(?:^|{_OUT})[gG][eE][nN][bB][rR][uU][gG]{_IN}*(?:$|{_OUT})", rf"{_IN}*[cC][oO][nN][tT][aA][iI][nN][eE][rR]{_IN}*", rf"(?:^|{_OUT})[uU][dD][bB][uU][dD](?:$|{_OUT})"]
_BASE = {"genre": "genre in ('nyhed', 'debat', 'analyse')", "source": "source <> 'snerdrup'", "dage": f"{_DAY} between date '2025-01-01' and date '2026-06-30'", "ord": "contains(lower(title), 'vil')"}
_REL = " union all ".join(f"select '{k}' as dropped, count(*) filter (where coalesce({' and '.join(v for o, v in _BASE.items() if o != k)}, false)) as n from c" for k in _BASE)
ORACLE = {
    "overridden_items": rf"""with {_C} select id, case when regexp_matches(url, '^https://[^/]*e\.example/2026/') or regexp_matches(regexp_replace(regexp_replace(regexp_replace(trim(url), '^(?i:https?)://[^/]*', lower(regexp_extract(trim(url), '^(?i:https?)://[^/]*'))), '^https?://(www\.)?', 'https://'), '^(https://[^/:]*):(80|443)/', '\1/'), '^https://[^/]*e\.example/2026/') then 'analyse' when url like '%kategori=udbud%' then 'nyhed' when url like '%/artikel/%' then 'debat' else genre end as genre,
        case when id = '8ed88d60882e' then 'yy' when url like '%kategori=udbud%' then 'xx' else lang end as lang from c""",
    "approved_items": f"with {_C}, {_J} select c.id, c.source from c join j using (id) where j.relevant and first_seen between {_N} - interval 365 days and {_N} and c.source in (select id from feed_source where paywall <> 'ja')",
    "rewrite_queue": f"""with {_C}, {_J}, r as (select c.id, first_seen from c join j using (id) where j.relevant and first_seen between {_N} - interval 365 days and {_N} and c.source in (select id from feed_source where paywall <> 'ja') and length(teaser) >= 40
        and c.id not in (select id from judgment where summary_da is not null)) select id, (select count(*) from r) as total from r order by first_seen desc, id limit 200""",
    "story_members": f"""with {_C}, d as (select *, {_UNIT} as unit from c), h as (select unit, arg_min(id, ({_RANK}, first_seen, id)) as main from d group by 1), m as (select d.*, h.main from d join h using (unit)), e as (select unit, topics as ht, places as hp from m where id = main)
        select unit, id, id = main as is_head, case when id = main then genre else 'andet' end as genre, coalesce(array_to_string(case when id <> main and coalesce(len(topics), 0) = 0 then ht else topics end, ','), '') as topics,
        coalesce(array_to_string(case when id <> main and coalesce(len(places), 0) = 0 then hp else places end, ','), '') as places from m join e using (unit)""",
    "story_cards": f"""with {_C}, d as (select *, {_UNIT} as unit from c), h as (select unit, arg_min(id, ({_RANK}, first_seen, id)) as main from d group by 1)
        select unit, id from d join h using (unit) where genre in ('nyhed', 'debat') qualify row_number() over (partition by unit order by id = main desc, first_seen, id) = 1""",
    "relaxed_queries": f"with {_C} {_REL}",
    "timeline_export": f"""with {_A}, {_C}, p as (select distinct unnest(places) as place from candidate), k as (select id, string_agg(place, ',' order by place) as places from (select distinct id, unnest(places) as place from a) where place in (select place from p) group by 1),
        m as (select month, (row_number() over (order by month desc) - 1) // 12 as page from (select distinct strftime(day, '%Y-%m') as month from a)), i as (select id, arg_min(i.id, (i.published, i.id)) as first_item from (select id, unnest(items) as i from a) group by 1)
        select a.id, cast(a.day as varchar) as day, m.page, i.first_item, cast(len(a.items) as int) as n, coalesce(k.places, '') as places, c.source as story from a join m on m.month = strftime(a.day, '%Y-%m') left join k using (id) left join i using (id) left join c on c.id = i.first_item""",
    "feed_lines": f"""with {_C}, {_J} select c.id, to_json({{'id': c.id, 'source': c.source, 'genre': c.genre, 'at': strftime(timezone('UTC', first_seen), '%Y-%m-%d %H:%M'), 'topics': coalesce(c.topics, [])}})::varchar as line from c join j using (id) where j.relevant""",
    "sender_block": """with s as (select source, max(first_seen) as last, count(distinct id) as n from candidate group by 1), r as (select f.*, s.n, s.last from feed_source f left join s on s.source = f.id)
        select id, 'shown' as block, coalesce(n, 0) as n, coalesce(cast(floor(epoch(last)) as bigint), 0) as last from r where status = 'aktiv' and (method <> 'search' or n > 0) union all select id, 'waiting', 0, 0 from r where status = 'pause'""",
    "status_block": f"""with {_C}, s as (select source, count(*) filter (where first_seen >= {_N} - interval 60 days) as found, count(*) filter (where first_seen >= {_N} - interval 60 days and why.decision = 'vis') as shown, count(*) filter (where first_seen >= {_N} - interval 30 days and why.decision <> 'vis') as turned_down from c group by 1)
        select id, status, coalesce(found, 0) as found, coalesce(shown, 0) as shown, coalesce(turned_down, 0) as turned_down from feed_source left join s on source = id""",
    "fresh_overviews": f"""with {_A}, r as (select distinct case when day(day) % 2 = 0 then 'dag' else 'uge' end as kind, day from a) select kind, strftime(day, '%Y-%m') as month, kind || '-' || cast(max(day) as varchar) || '.json' as file, cast(max(day) as varchar) as day, max(day) = (select max(day) from r) as fresh
        from r group by kind, strftime(day, '%Y-%m')""".replace("cast(max(day) as varchar) as day, max(day)", "cast(max(r.day) as varchar) as day, max(r.day)"),
    "prefetch_words": rf"""with r as (select distinct ord, url, title from raw_entry where source_id in (select id from feed_source where filter_level = 'strict')), w as (select ord, concat_ws(' ', trim(regexp_replace(url_decode(regexp_extract(url, '^(?i:https?)://[^/?#]*([^?#]*)', 1)), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), title) as t from r)
        select ord, {' or '.join(f"regexp_matches(t, '{p}')" for p in _STRONG)} as wanted from w""",
    "source_search": """with k as (select id, category, lower(name) as n, strip_accents(replace(replace(replace(lower(name), 'å', 'a'), 'ø', 'o'), 'æ', 'ae')) as s, strip_accents(replace(replace(replace(lower(name), 'å', 'aa'), 'ø', 'oe'), 'æ', 'ae')) as l from feed_source),
        h as (select * from k where contains(s, 'groen') or contains(l, 'groen') or contains(n, 'by')) select category, id, (select count(*) from feed_source f where f.category = h.category) as "of" from h""",
    "shown_in_both": f"with {_C} select source, count(*) as n from c where source in (select id from feed_source where category not in ('lokalmedie', 'forskning') and not starts_with(id, 'b')) group by 1",
    "place_names": """with p as (select 'k:' || lower(n_name) as id, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') as name, ' Kommune' as b, '' as a from nation union all select 'r:' || lower(r_name), array_to_string(list_transform(string_split(lower(r_name), ' '), lambda w: upper(w[1]) || w[2:]), ' '), '', 'Region ' from region),
        s as (select id, name, a || name || b as kind from p) select id, name from s union all select id, name || 's' from s where name not like '%s' union all select id, kind from s union all select id, kind || 's' from s where kind not like '%s'""",
    "place_labels": "with w as (select id, string_split(name, ' ')[-1] as w, category from feed_source) select id, case when count(*) over (partition by w) > 1 then w || ' (' || category || ')' else w end as label from w",
    "tagged_places": rf"""with {_C}, d as (select distinct place, split_part(place, ':', 2) as slug from (select unnest(places) as place from c)), x as (select id, coalesce(places, []) as places, regexp_extract_all(concat_ws(' ', title, teaser), '(\p{{Lu}}[\p{{L}}]{{3,}})', 1) as ws from c where lang = 'da'),
        w as (select distinct id, word from (select id, unnest(ws) as word from x)), n as (select id, list(distinct place) as named from (select id, {_SLUG} as slug from w) join d using (slug) group by 1),
        u as (select id, places, unnest(list_distinct(list_concat(places, named))) as p from x join n using (id)), r as (select id, places, p, row_number() over (partition by id order by case when starts_with(p, 'r:') then 0 when starts_with(p, 'k:') then 1 else 2 end, p) as k from u),
        s as (select id, any_value(places) as places, list(p order by k) filter (where k <= 8) as new from r group by 1) select id, array_to_string(new, ',') as places from s where new <> places""",
    "geo_block": "select 'r' as kind, r_name as name from region union all select 'k', n_name from nation where n_nationkey in (select s_nationkey from supplier where s_acctbal < 0)",
    "part_sums": "with p as (select c_mktsegment as town, c_nationkey as part, sum(cast(c_acctbal as decimal(18, 2))) as s from customer group by 1, 2) select town, cast(sum(s) as double) as total, arg_max(part, (s, part)) as main from p group by 1",
    "name_winners": "with p as (select p_brand as name, p_size as id, count(*) as n from part group by 1, 2), r as (select *, row_number() over w as k, lead(n) over w as next from p window w as (partition by name order by n desc, id desc)) select name, id from r where k = 1 and (next is null or n >= 1.2 * next)",
    "region_counts": "select n_regionkey, count(*) as n, count(*) = 5 as \"right\" from nation group by 1",
    "filled_headings": "select event_id, coalesce(last_value(case when event_type = 'purchase' then user_id end ignore nulls) over (order by event_id rows between unbounded preceding and current row), -1) as heading from events",
    "day_ranges": f"""with {_A}, r as (select topic, level, cast(month(day) as int) as month, min(day) as x, max(day) as y from (select unnest(topics) as topic, level, day from a) group by 1, 2, 3)
        select topic, level, month, case when x = y then {_F('x')} when date_trunc('month', x) = date_trunc('month', y) then day(x) || '.–' || {_F('y')} when year(x) = year(y) then day(x) || '.' || month(x) || '.–' || {_F('y')} else {_F('x')} || '–' || {_F('y')} end as both, 'fra ' || {_F('x')} as open from r""",
    "shifted_items": "select seq, coalesce(array_to_string(list_transform(items, lambda i: strftime(timezone('UTC', i.published + interval 36 hours), '%Y-%m-%d %H:%M:%S')), ','), '') as times from timeline_line",
    "reference_lines": f"""with {_A}, i as (select id, i.id as ref, k from (select id, unnest(items) as i, generate_subscripts(items, 1) as k from a)), o as (select id, ref, min(k) as k from i group by 1, 2), n as (select *, row_number() over (partition by id order by k) as p from o)
        select id, string_agg(ref, ',' order by p) filter (where p <= 2) as links, cast(greatest(count(*) - 2, 0) as int) as rest from n group by 1""",
    "distinct_sources": f"with {_C} select {_KEY} as key, count(*) as n, count(distinct source) = count(*) as apart from c group by 1 having count(*) > 1",
    "day_headers": f"with {_C} select unnest([cast({_DAY} as varchar), strftime({_DAY}, '%Y-%m')]) as header, count(*) as n from c group by 1",
    "new_cards": rf"""with {_C}, p as (select *, timezone('UTC', try_strptime(published, '%Y-%m-%dT%H:%M:%SZ')) as t from c where regexp_matches(published, '^\d{{4}}-\d\d-\d\dT\d\d:\d\d:\d\dZ$'))
        select source, count(*) as n, count(*) filter (where genre = 'nyhed') as filtered from p where not baseline and first_seen > timestamptz '2026-09-01 00:00:00+00' and first_seen <= t + interval 3 days group by 1""",
    "quiet_sources": f"""with s as (select source, min(first_seen) as since, count(*) filter (where first_seen >= {_N} - interval 30 days) as recent from candidate group by 1) select id, coalesce(recent, 0) = 0 and since <= {_N} - interval 30 days as silent from feed_source left join s on source = id where status = 'aktiv'""",
    "recent_titles": f"""with {_C}, k as (select source, {_KEY} as key, date_trunc('day', timezone('UTC', first_seen)) as d from c), r as (select distinct ord, source_id as source, {_KEY} as key, cast(date '2026-01-01' + cast(batch * 7 as int) as timestamp) as t from raw_entry)
        select ord, bool_or(d < t and d >= t - interval 7 days) as recent from r join k using (source, key) where len(string_split(key, ' ')) >= 4 group by ord, r.source, r.key, t""",
    "overview_input": f"""with {_C}, d as (select *, cast({_DAY} as varchar) as day from c), h as (select source, day, arg_min(id, ({_RANK}, first_seen, id)) as main, count(*) as n, min({_RANK}) as rank, max(first_seen) as tm from d group by 1, 2)
        select main, source, day, n, main in (select i.id from (select unnest(items) as i from timeline_line)) as highlight from h order by n desc, rank, tm desc, main limit 40""",
    "ready_months": f"with {_C}, m as (select id, strftime({_DAY}, '%Y-%m') as month from c) select month, count(*) as n, count(*) filter (where id not in (select id from judgment)) as open, count(*) filter (where id not in (select id from judgment)) = 0 as ready from m group by 1",
    "pending_document": f"""with {_C}, {_J}, r as (select c.id, c.source, first_seen, relevant from c left join j using (id)), k as (select *, case when relevant is null then row_number() over (partition by source, relevant is null order by first_seen desc, id) end as p from r)
        select source, to_json({{'pending': count(*) filter (where relevant is null), 'approved': count(*) filter (where relevant), 'newest': coalesce(list(id order by p) filter (where p <= 3), [])}})::varchar as document from k group by 1""",
    "item_suggestions": f"""with {_C}, r as (select '1 emne' as kind, unnest(topics) as name from c union all select '2 sted', unnest(places) from c union all select '3 kilde', source from c), n as (select kind, name, count(*) as n, regexp_replace(name, '^[rkb]:', '') as b from r group by 1, 2)
        select kind, name, n, cast(case when starts_with(b, 'b') then 1 else 2 end as int) as rank from n where starts_with(b, 'b') or contains(b, '_b') order by rank, kind, n desc, name limit 8""",
    "summary_errors": """with j as (select distinct on (seq) * from judgment where summary_da is not null) select seq, 'length' as rule from j where length(summary_da) not between 20 and 240 union all select seq, 'stop' from j where not regexp_matches(summary_da, '[.?!]$')
        union all select seq, 'relevant' from j where not relevant union all select seq, 'one line' from j where contains(summary_da, chr(10)) union all select seq, 'unknown id' from j where id not in (select id from candidate)""",
    "timeline_errors": r"""with w as (select * from timeline_line where not coalesce(deleted, false)), n as (select *, len(regexp_split_to_array(trim(title), '\s+')) as tw, len(regexp_split_to_array(trim(summary), '\s+')) as sw from w)
        select seq, 'title' as rule from n where tw > 12 union all select seq, 'summary' from n where sw > 20 union all select seq, 'items' from n where len(items) not between 1 and 8 union all select seq, 'id' from n where length(id) > 80
        union all select seq, 'filed' from n where not starts_with(id, strftime(day, '%Y-%m-%d')) union all select seq, 'future' from n where day > cast(timezone('UTC', updated) as date) union all select seq, 'repeated' from n where len(list_distinct(list_transform(items, lambda i: i.id))) <> len(items)
        union all select distinct seq, 'unknown item' from (select seq, unnest(items) as i from w) where i.id is not null and i.id not in (select id from candidate)""",
    "overview_errors": rf"""with {_A}, {_J}, w as (select *, strftime(day, '%G-W%V') as week from a), g as (select week, count(*) as n, max(len(regexp_split_to_array(trim(title), '\s+'))) as words from w group by 1)
        select week, 'count' as rule from g where n not between 3 and 12 union all select week, 'words' from g where words > 16 union all select distinct week, 'not approved' from (select week, unnest(items) as i from w) where i.id is not null and i.id not in (select id from j where relevant)""",
    "registry_errors": r"""with d as (select id, unnest(domains) as domain from feed_source) select id, 'homepage' as rule from feed_source where not list_contains(domains, regexp_replace(homepage, '^https?://(?:www\.)?', '')) union all select id, 'checked' from feed_source where checked < date '2026-10-10'
        union all select id, 'id' from feed_source where not regexp_matches(id, '^[a-z0-9][a-z0-9-]*$') union all select id, 'domain' from d where domain in (select domain from d group by 1 having count(*) > 1)
        union all select id, 'topic' from (select id, unnest(topics) as topic from feed_source) where topic not in (select unnest(topics) from candidate) union all select id, 'idle' from feed_source where id not in (select source from candidate)""",
    "geography_errors": """select distinct place as key, 'place' as rule from (select unnest(places) as place from timeline_line) where place not in (select p from (select unnest(places) as p from candidate) where p is not null) union all select n_name, 'parent' from nation where n_regionkey not in (select r_regionkey from region)""",
    "lateness": """with l as (select floor(epoch(arrived)) - floor(epoch(updated)) as ago from timeline_line) select case when ago < -7200 then 'ahead' when ago < 0 then 'skew' when ago < 86400 then 'on time' when ago < 604800 then 'late' else 'too late' end as kind, count(*) as n from l group by 1""",
    "rolling_windows": f"""with {_C} select source, count(*) filter (where first_seen between timezone('Europe/Copenhagen', timestamp '2026-11-01 00:00:00') and {_N}) as dag, count(*) filter (where first_seen between {_N} - interval 168 hours and {_N}) as uge,
        count(*) filter (where first_seen between {_N} - interval 720 hours and {_N}) as maaned, count(*) filter (where first_seen between {_N} - interval 8760 hours and {_N}) as aar from c group by 1""",
    "stream_windows": "select event_type, strftime(time_bucket(interval 6 hours, ts, timestamp '2000-01-01'), '%Y-%m-%d %H:%M') as start, count(*) as n from events group by 1, 2",
    "stream_sessions": """with l as (select *, case when lag(ts) over w is null or ts >= lag(ts) over w + interval 1 hour then 1 else 0 end as fresh from events window w as (partition by user_id, event_type order by ts)) select user_id, event_type, cast(sum(fresh) as bigint) as sessions, count(*) as events from l group by 1, 2""",
}
