"""Queries of logs, joins, rankings, facets, stories, validation and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kildestrom.functions import dates, text
from kildestrom.operators import facets, health, logs, places, quality, ranking, stories
from kildestrom.operators.components import components
from kildestrom.session import cut, small_side, table
from kildestrom.streaming import streams

GENRE_RANK = ["folketing", "hoering", "analyse", "nyhed", "debat", "pressemeddelelse"]
QUERY = facets.FacetQuery(include={"genre": ("nyhed", "debat", "analyse")}, exclude={"source": ("snerdrup",)}, since="2025-01-01", until="2026-06-30", words="vil")


def _c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.first(table(spark, sf_dir, "candidate"), "id", [F.col("first_seen")])


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.latest(table(spark, sf_dir, "judgment"), "id", [F.col("seq")])


def latest_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid judgment of every id."""
    return _judged(spark, sf_dir).select("id", "seq", "relevant", "written_by", F.size(F.coalesce("topics", F.array())).alias("n_topics"))


def newest_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item the newest text of two logs: judges' summaries and timeline events."""
    sums = table(spark, sf_dir, "judgment").select("id", F.col("summary_da").alias("value"), F.col("judged_at").alias("at"))
    events = table(spark, sf_dir, "timeline_line").select(F.explode("items").alias("i"), "summary", "updated").select(F.col("i.id").alias("id"), F.col("summary").alias("value"), F.col("updated").alias("at"))
    return logs.newest_value([sums, events], "id", "value", "at")


def judged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with their valid judgment, which overrides topics and genre only where the line has them."""
    j = _judged(spark, sf_dir).select("id", "relevant", F.col("genre").alias("jg"), "has_genre", F.col("topics").alias("jt"), "has_topics", F.col("places").alias("jp"))
    rows = _c(spark, sf_dir).select("id", "genre", "topics", "places").join(j, "id", "left")
    return rows.select("id", "relevant", F.when(F.col("has_genre"), F.col("jg")).otherwise(F.col("genre")).alias("genre"), F.array_join(F.when(F.col("has_topics"), F.col("jt")).otherwise(F.col("topics")), ",").alias("topics"), F.array_join(F.coalesce("jp", "places"), ",").alias("places"))


def pending_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 newest candidates of active sources that nobody has judged."""
    active = table(spark, sf_dir, "feed_source").filter("status = 'aktiv'").select(F.col("id").alias("source"))
    rows = _c(spark, sf_dir).select("id", "source", "first_seen").join(table(spark, sf_dir, "judgment").select("id").distinct(), "id", "left_anti").join(small_side(active), "source", "left_semi")
    return ranking.top(rows, [F.desc("first_seen"), F.asc("id")], 200).select("id", "source", F.unix_timestamp("first_seen").alias("seen"))


def new_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that judges added and no candidate holds."""
    rows = _judged(spark, sf_dir).filter("new_item is not null").select("id", "new_item.title", "new_item.source")
    return rows.join(table(spark, sf_dir, "candidate").select("id").distinct(), "id", "left_anti")


def all_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items per source over candidates and added items, with the earliest time."""
    own = _c(spark, sf_dir).select("id", "source", F.col("first_seen").alias("at"))
    added = _judged(spark, sf_dir).filter("new_item is not null").select("id", F.col("new_item.source").alias("source"), F.col("judged_at").alias("at")).join(own.select("id"), "id", "left_anti")
    return own.unionByName(added).groupBy("source").agg(F.count("*").alias("n"), F.unix_timestamp(F.min("at")).alias("since"))


def title_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw entries left out as repeats of an accepted title of their source: the first accepted one counts; recent_titles has the window of a week."""
    rows = table(spark, sf_dir, "raw_entry").dropDuplicates(["ord"]).select("ord", F.col("source_id").alias("source"), text.title_key(F.col("title")).alias("key"), (F.coalesce(F.lower(F.trim("date_quality")), F.lit("")) != "fundet").alias("accepted"))
    first = F.min(F.when(F.col("accepted"), F.col("ord"))).alias("fa")
    found = rows.join(rows.groupBy("key", "source").agg(first), ["key", "source"])
    return found.filter((F.size(F.split("key", " ")) >= 4) & (F.col("ord") > F.col("fa"))).select("ord", "fa")


def upsert_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates after the judges' added items were merged in: counts per month."""
    own = _c(spark, sf_dir).select("id", "title", F.col("first_seen").alias("at"))
    added = _judged(spark, sf_dir).filter("new_item is not null").select("id", F.col("new_item.title").alias("title"), F.col("judged_at").alias("at"))
    rows = logs.upsert(own, added, "id")
    return rows.groupBy(F.date_format("at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def merged_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a keyed table merged: first time kept, the rest refreshed, old rows gone."""
    ev = table(spark, sf_dir, "events")
    old = ev.filter("event_type in ('view', 'click')").groupBy(F.col("user_id").alias("k")).agg(F.min("ts").alias("at"), F.max("value").alias("v"))
    new = ev.filter("event_type = 'purchase'").groupBy(F.col("user_id").alias("k")).agg(F.min("ts").alias("at"), F.min("value").alias("v"))
    rows = logs.merge_keeping_first(old, new, "k", ["at"], "at", F.lit("2024-01-01 06:00:00").cast("timestamp"))
    return rows.select("k", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "v")


def title_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one user and kind in sessions with gaps of an hour at most."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return stories.sessions(rows, ["user_id", "event_type"], "ts", "1 hour").select("event_id", F.col("session").cast("bigint").alias("session"))


def hint_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the story hints among judged ids."""
    rows = table(spark, sf_dir, "judgment").select("id", "story_hint").distinct()
    return components(cut(stories.hint_edges(rows, "id", "story_hint"), "edges"), "a", "b").select(F.col("node").alias("id"), "component")


def story_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories of candidates: equal titles of four words or more within three days and hints, seven days around the main item."""
    items = cut(_c(spark, sf_dir).select("id", text.title_key(F.col("title")).alias("key"), "genre", "first_seen"), "items")
    titles = stories.chain_edges(items.filter(F.size(F.split("key", " ")) >= 4), ["key"], "id", "first_seen", "3 days")
    hints = table(spark, sf_dir, "judgment").select(F.col("story_hint").alias("a"), F.col("id").alias("b")).filter("a is not null").distinct()
    ids = items.select("id")
    both = hints.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    edges = cut(titles.unionByName(both.select("a", "b")).filter("a <> b").distinct(), "edges")
    rank = F.coalesce(F.array_position(F.array(*[F.lit(g) for g in GENRE_RANK]), F.col("genre")), F.lit(9))
    return stories.stories(items, edges, "id", rank, "first_seen").withColumnRenamed("node", "id")


def story_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per local day and source: the main item, the number of items and all places."""
    rows = _c(spark, sf_dir).withColumn("day", dates.local_day(F.col("first_seen")).cast("string"))
    rank = F.array_position(F.array(*[F.lit(g) for g in GENRE_RANK]), F.col("genre"))
    grouped = rows.groupBy("source", "day").agg(F.min_by("id", F.struct(rank, "first_seen", "id")).alias("main"), F.count("*").alias("n"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("places")))), ",").alias("places"))
    return grouped.filter("n > 1")


def day_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that bundle a source's items of one local day."""
    rows = _c(spark, sf_dir).select("id", "source", dates.local_day(F.col("first_seen")).alias("day"))
    return stories.star_edges(rows, ["source", "day"], "id")


def _facets(rows: DataFrame) -> dict:
    return {"genre": F.array("genre"), "source": F.array("source"), "topic": F.col("topics"), "place": F.col("places")}


def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates per key of every facet, without the facet's own filter."""
    rows = cut(_c(spark, sf_dir).select("id", "genre", "source", "topics", "places", "title", "first_seen"), "items")
    return facets.facet_counts(rows, QUERY, _facets(rows), dates.local_day(F.col("first_seen")), F.col("title"), "id")


def facet_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of the candidates that match."""
    rows = _c(spark, sf_dir)
    found = facets.matching(rows, QUERY, _facets(rows), dates.local_day(F.col("first_seen")), F.col("title"))
    return facets.pages(found, [F.desc("first_seen"), F.asc("id")], 20, 1).select("id", "source")


def day_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with orders per day and region."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    dims = c.join(small_side(n), F.col("c_nationkey") == F.col("n_nationkey")).join(small_side(r), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "r_name")
    rows = o.join(dims, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("r_name", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.countDistinct("o_custkey").alias("n"))


def place_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers per place with its ancestors: a nation counts for its region."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), F.col("n_regionkey"))
    r = table(spark, sf_dir, "region")
    tree = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("id", F.col("r_name").alias("parent")).unionByName(r.select(F.col("r_name").alias("id"), F.lit(None).cast("string").alias("parent")))
    tags = table(spark, sf_dir, "customer").join(small_side(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("place"))
    return places.expand(tags, "c_custkey", "place", tree).groupBy("place").agg(F.count("*").alias("n"))


def sorted_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of candidates in their order."""
    return _c(spark, sf_dir).select("id", F.array_join(places.sort_places(F.coalesce("places", F.array())), ",").alias("places"))


def accent_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose title has a word typed without accents."""
    return _c(spark, sf_dir).filter(facets.search(F.coalesce("title", F.lit("")), "oestre foere")).select("id").unionByName(_c(spark, sf_dir).filter(facets.search(F.coalesce("title", F.lit("")), "omlaegge vil")).select("id"))


def name_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source names for what was typed."""
    return facets.suggestions(table(spark, sf_dir, "feed_source").select("id", "name"), "name", "b").select("id", "name", "rank")


def category_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all, some or none of a category's sources are followed."""
    return facets.tri_state(table(spark, sf_dir, "feed_source"), "category", F.col("status") == "aktiv")


def month_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred orders taken in turns from the months, dearest first."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return ranking.round_robin(rows, ["month"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 100).select("o_orderkey", "month", "rank")


def size_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 150 customers with most orders."""
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("newest"))
    return ranking.top(rows, [F.desc("n"), F.desc("newest"), F.asc("o_custkey")], 150)


def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven documents at even distances."""
    rows = table(spark, sf_dir, "documents").select("doc_id")
    return ranking.evenly(rows, [F.asc("doc_id")], 7, rows.count()).select("doc_id", F.col("position").cast("bigint").alias("position"))


def week_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks with more than two alive events of one topic."""
    alive = logs.latest(table(spark, sf_dir, "timeline_line"), "id", [F.col("updated"), F.col("seq")]).filter("not coalesce(deleted, false)")
    rows = alive.select("id", F.explode("topics").alias("topic"), dates.iso_week(F.col("day")).alias("week"))
    return rows.groupBy("topic", "week").agg(F.count("*").alias("n")).filter("n > 2")


def event_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of events that are candidates, with the events they stand in."""
    rows = table(spark, sf_dir, "timeline_line").select(F.col("id").alias("event"), F.explode("items").alias("i")).select("event", F.col("i.id").alias("id")).distinct()
    known = rows.join(table(spark, sf_dir, "candidate").select("id").distinct(), "id", "left_semi")
    return known.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("event")), ",").alias("events"), F.count("*").alias("n"))


def event_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of an event with what the line before it was."""
    w = Window.partitionBy("id").orderBy("seq")
    rows = table(spark, sf_dir, "timeline_line").select("seq", "id", "deleted", "updated")
    return rows.select("seq", F.coalesce(F.lag("seq").over(w), F.lit(-1)).alias("before"), F.lag("deleted").over(w).alias("was_deleted"), (F.col("updated") < F.lag("updated").over(w)).alias("late"))


def event_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alive events per month with the newest."""
    alive = logs.latest(table(spark, sf_dir, "timeline_line"), "id", [F.col("updated"), F.col("seq")]).filter("not coalesce(deleted, false)")
    return alive.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.max_by("id", F.struct("day", "id")).alias("newest"))


def item_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: items, of the last 30 days, decisions and baseline ones."""
    end = F.lit("2026-11-01").cast("timestamp")
    rows = _c(spark, sf_dir)
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("first_seen") >= end - F.expr("interval 30 days")).alias("recent"), F.count_if(F.col("why.decision") == "vis").alias("shown"), F.count_if("baseline").alias("baseline"), F.countDistinct("genre").alias("genres"))


def silent_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active sources without an item since a day; quiet_sources has the condition that they were followed before."""
    seen = table(spark, sf_dir, "candidate").filter(F.col("first_seen") >= F.lit("2026-09-20").cast("timestamp")).select(F.col("source").alias("id")).distinct()
    return table(spark, sf_dir, "feed_source").filter("status = 'aktiv'").join(seen, "id", "left_anti").select("id", "method")


def new_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items found after a visit that are no baseline; new_cards has the condition on their own day."""
    rows = _c(spark, sf_dir).filter(~F.col("baseline") & (F.col("first_seen") > F.lit("2026-10-01").cast("timestamp")))
    return rows.groupBy("source").agg(F.count("*").alias("n"))


def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health per user: errors in a row since the last other event."""
    return health.failures_in_row(table(spark, sf_dir, "events"), "user_id", F.struct("ts", "event_id"), F.col("event_type") == "error", 3)


def failure_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of errors per day, and whether it is above a fifth."""
    rows = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(F.avg((F.col("event_type") == "error").cast("int")), 6).alias("ratio"))
    return rows.withColumn("failed", F.col("ratio") > 0.2)


def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that more than one row holds."""
    return quality.duplicates(table(spark, sf_dir, "candidate"), "id")


def judgment_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that judgment lines break."""
    j = table(spark, sf_dir, "judgment").dropDuplicates(["seq"])
    known = table(spark, sf_dir, "candidate").select("id").unionByName(j.filter("new_item is not null").select("id"))
    rules = {
        "id": F.col("id").rlike("^[0-9a-f]{12}$"),
        "topics": F.size(F.coalesce("topics", F.array())) <= 1,
        "summary": F.length("summary_da").between(20, 90),
        "hint": F.col("story_hint") != F.col("id"),
        "places": F.forall(F.coalesce("places", F.array()), lambda p: p.rlike("^[rkb]:")),
    }
    return quality.failures(j, "seq", rules).unionByName(quality.missing(j, "seq", "story_hint", known, "id", "unknown hint"))


def policy_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates without those of paused sources, and without texts of paid ones."""
    s = table(spark, sf_dir, "feed_source").select(F.col("id").alias("source"), "status", "paywall")
    rows = _c(spark, sf_dir).join(small_side(s), "source").filter("status <> 'pause'")
    return rows.select("id", F.when(F.col("paywall") == "ja", "").otherwise(F.col("teaser")).alias("teaser"))


def retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of known sources of the last 400 days: how many stay per source."""
    s = table(spark, sf_dir, "feed_source").filter("status = 'aktiv'").select(F.col("id").alias("source"))
    rows = table(spark, sf_dir, "candidate").filter(F.col("first_seen") >= F.lit("2025-10-01").cast("timestamp")).join(small_side(s), "source", "left_semi")
    return rows.groupBy("source").agg(F.countDistinct("id").alias("n"))


def heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: ids judged and pending."""
    c, j = table(spark, sf_dir, "candidate").select("id").distinct(), table(spark, sf_dir, "judgment").select("id").distinct()
    both = c.withColumn("c", F.lit(1)).join(j.withColumn("j", F.lit(1)), "id", "full")
    return both.agg(F.count_if(F.col("j").isNotNull()).alias("judged"), F.count_if(F.col("j").isNull()).alias("pending"), F.count_if(F.col("c").isNull()).alias("foreign"))


def strictest_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stricter of the levels of collecting and publishing source."""
    level = lambda c: F.array_position(F.array(F.lit("none"), F.lit("normal"), F.lit("strict")), c)
    s = table(spark, sf_dir, "feed_source").select("id", "filter_level", F.explode("domains").alias("domain"))
    rows = table(spark, sf_dir, "raw_entry").select("ord", "source_id", "publisher_domain").distinct()
    a = small_side(s.select(F.col("id").alias("source_id"), F.col("filter_level").alias("own")).distinct())
    b = small_side(s.select(F.col("domain").alias("publisher_domain"), F.col("filter_level").alias("other")).distinct())
    joined = rows.join(a, "source_id", "left").join(b, "publisher_domain", "left")
    best = F.greatest(level(F.coalesce("own", F.lit("none"))), level(F.coalesce("other", F.lit("none"))))
    return joined.select("ord", F.element_at(F.array(F.lit("none"), F.lit("normal"), F.lit("strict")), best.cast("int")).alias("level"))


def stream_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users that a stream of events holds, each once."""
    rows = streams.stream_of(spark, sf_dir, "events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return streams.drain(streams.first_per_key(rows, "user_id", "ts", "40 days"), "stream").select("user_id")


def stream_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors in a row per user, kept as state of a stream."""
    rows = streams.stream_of(spark, sf_dir, "events.parquet").select("user_id", "event_id", (F.col("event_type") == "error").alias("failed"))
    return streams.drain(streams.health_states(rows, "user_id", "event_id", "failed"), "states", "update", ["user_id"])


QUERIES = {
    f.__name__: f
    for f in (
        latest_judgments, newest_texts, judged_candidates, pending_candidates, new_items, all_items, title_dedupe, upsert_candidates, merged_rejections, title_sessions, hint_components, story_groups, story_heads, day_stars,
        facet_counts, facet_cards, day_histogram, place_expansion, sorted_places, accent_search, name_suggestions, category_states, month_round_robin, size_ranking, even_sample, week_overflow, event_items, event_versions,
        event_months, item_counts, silent_sources, new_since, source_health, failure_ratio, duplicate_ids, judgment_errors, policy_scrub, retained, heartbeat, strictest_filter, stream_first, stream_health,
    )
}

_C = "c as (select * from candidate qualify row_number() over (partition by id order by first_seen) = 1)"
_J = "j as (select * from judgment qualify row_number() over (partition by id order by seq desc) = 1)"
_T = "t as (select * from timeline_line qualify row_number() over (partition by id order by updated desc, seq desc) = 1), a as (select * from t where not coalesce(deleted, false))"
_DAY = "cast(timezone('Europe/Copenhagen', first_seen) as date)"
_KEY = r"trim(regexp_replace(lower(coalesce(title, '')), '[^\p{L}\p{N}]+', ' ', 'g'))"
_RANK = "list_position(['" + "', '".join(GENRE_RANK) + "'], genre)"
_BASE = "contains(lower(title), 'vil') and d between date '2025-01-01' and date '2026-06-30'"
_GENRE, _SOURCE = "genre in ('nyhed', 'debat', 'analyse')", "source <> 'snerdrup'"
_SHORT = "replace(replace(replace(replace(lower(title), 'å', 'a'), 'ø', 'o'), 'æ', 'ae'), 'ß', 'ss')"
_LONG = "replace(replace(replace(replace(lower(title), 'å', 'aa'), 'ø', 'oe'), 'æ', 'ae'), 'ß', 'ss')"


def _found(word: str) -> str:
    return f"(contains(lower(title), '{word}') or contains(strip_accents({_SHORT}), '{word}') or contains(strip_accents({_LONG}), '{word}'))"


ORACLE = {
    "latest_judgments": f"with {_J} select id, seq, relevant, written_by, cast(coalesce(len(topics), 0) as int) as n_topics from j",
    "newest_texts": """with u as (select id, summary_da as value, judged_at as tm, 0 as r from judgment where summary_da is not null
        union all select i.id, summary, updated, 1 from (select unnest(items) as i, summary, updated from timeline_line) where summary is not null)
        select id, value from u qualify row_number() over (partition by id order by tm desc, r desc, value desc) = 1""",
    "judged_candidates": f"""with {_C}, {_J} select c.id, relevant, case when has_genre then j.genre else c.genre end as genre,
        coalesce(array_to_string(case when has_topics then j.topics else c.topics end, ','), '') as topics, coalesce(array_to_string(coalesce(j.places, c.places), ','), '') as places from c left join j using (id)""",
    "pending_candidates": f"""with {_C} select id, source, cast(epoch(first_seen) as bigint) as seen from c where not exists (select 1 from judgment j where j.id = c.id)
        and exists (select 1 from feed_source s where s.id = c.source and status = 'aktiv') order by first_seen desc, id limit 200""",
    "new_items": f"with {_J} select id, new_item.title as title, new_item.source as source from j where new_item is not null and id not in (select id from candidate)",
    "all_items": f"""with {_C}, {_J}, u as (select id, source, first_seen as tm from c union all select id, new_item.source, judged_at from j where new_item is not null and id not in (select id from candidate))
        select source, count(*) as n, cast(epoch(min(tm)) as bigint) as since from u group by 1""",
    "title_dedupe": f"""with r as (select distinct on (ord) ord, source_id, {_KEY} as key, coalesce(lower(trim(date_quality)), '') <> 'fundet' as accepted from raw_entry),
        f as (select key, source_id, min(ord) filter (where accepted) as fa from r group by 1, 2)
        select ord, fa from r join f using (key, source_id) where len(string_split(key, ' ')) >= 4 and ord > fa""",
    "upsert_candidates": f"""with {_C}, {_J}, n as (select id, judged_at as tm from j where new_item is not null), u as (select id, first_seen as tm from c where id not in (select id from n) union all select * from n)
        select strftime(timezone('UTC', tm), '%Y-%m') as month, count(*) as n from u group by 1""",
    "merged_rejections": """with o as (select user_id as k, min(ts) as tm, max(value) as v from events where event_type in ('view', 'click') group by 1), n as (select user_id as k, min(ts) as tm, min(value) as v from events where event_type = 'purchase' group by 1),
        m as (select coalesce(o.k, n.k) as k, coalesce(o.tm, n.tm) as tm, coalesce(n.v, o.v) as v from o full join n on o.k = n.k) select k, strftime(tm, '%Y-%m-%d %H:%M:%S') as "at", v from m where tm >= timestamp '2024-01-01 06:00:00'""",
    "title_sessions": """with l as (select *, case when ts > lag(ts) over w + interval 1 hour then 1 else 0 end as fresh from events window w as (partition by user_id, event_type order by ts))
        select event_id, cast(sum(fresh) over (partition by user_id, event_type order by ts rows unbounded preceding) as bigint) as session from l""",
    "hint_components": """with recursive i as (select distinct id from judgment), e0 as (select distinct story_hint as a, id as b from judgment where story_hint is not null and story_hint <> id and story_hint in (select id from i)),
        e as (select a, b from e0 union select b, a from e0), r as (select a as node, a as other from e union select r.node, e.b from r join e on e.a = r.other)
        select node as id, min(other) as component from r group by 1""",
    "story_heads": f"""with {_C}, d as (select *, cast({_DAY} as varchar) as day from c), p as (select source, day, coalesce(string_agg(distinct p, ',' order by p), '') as places from (select source, day, unnest(places) as p from d) group by 1, 2),
        g as (select source, day, arg_min(id, (coalesce({_RANK}, 0), first_seen, id)) as main, count(*) as n from d group by 1, 2) select g.*, coalesce(p.places, '') as places from g left join p using (source, day) where n > 1""",
    "day_stars": f"with {_C}, d as (select id, source, {_DAY} as day from c), g as (select source, day, min(id) as a from d group by 1, 2) select a, id as b from d join g using (source, day) where a <> id",
    "facet_counts": f"""with {_C}, d as (select *, {_DAY} as d from c), b as (select * from d where {_BASE})
        select 'genre' as facet, genre as key, count(distinct id) as n from b where {_SOURCE} group by 2
        union all select 'source', source, count(distinct id) from b where {_GENRE} group by 2
        union all select 'topic', k, count(distinct id) from (select id, unnest(case when len(topics) > 0 then topics else ['uden'] end) as k from b where {_GENRE} and {_SOURCE}) group by 2
        union all select 'place', k, count(distinct id) from (select id, unnest(case when len(places) > 0 then places else ['uden'] end) as k from b where {_GENRE} and {_SOURCE}) group by 2""",
    "facet_cards": f"with {_C}, d as (select *, {_DAY} as d from c) select id, source from d where {_BASE} and {_GENRE} and {_SOURCE} order by first_seen desc, id limit 20 offset 20",
    "day_histogram": """select r_name, strftime(o_orderdate, '%Y-%m-%d') as day, count(distinct o_custkey) as n from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2""",
    "place_expansion": """select n_name as place, count(*) as n from customer join nation on c_nationkey = n_nationkey group by 1 union all
        select r_name, count(*) from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1""",
    "sorted_places": f"""with {_C}, p as (select id, unnest(list_distinct(places)) as p from c) select c.id, coalesce((select string_agg(p, ',' order by case when starts_with(p, 'r:') then 0 when starts_with(p, 'k:') then 1 else 2 end, p) from p where p.id = c.id), '') as places from c""",
    "accent_search": f"with {_C} select id from c where {_found('oestre')} and {_found('foere')} union all select id from c where {_found('omlaegge')} and {_found('vil')}",
    "name_suggestions": f"""with f as (select id, name, {_SHORT.replace('title', 'name')} as k from feed_source), r as (select id, name, case when starts_with(k, 'b') then 1 when contains(k, ' b') then 2 end as rank from f)
        select id, name, cast(rank as int) as rank from r where rank is not null order by rank, name limit 8""",
    "category_states": "select category, case when count(*) filter (where status = 'aktiv') = 0 then 'none' when count(*) filter (where status = 'aktiv') = count(*) then 'all' else 'some' end as state from feed_source group by 1",
    "month_round_robin": """with r as (select o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m') as month, row_number() over (partition by strftime(o_orderdate, '%Y-%m') order by o_totalprice desc, o_orderkey) as rank from orders)
        select o_orderkey, month, cast(rank as int) as rank from r order by rank, o_totalprice desc, o_orderkey limit 100""",
    "size_ranking": "select o_custkey, count(*) as n, max(o_orderkey) as newest from orders group by 1 order by n desc, newest desc, o_custkey limit 150",
    "even_sample": """with r as (select doc_id, row_number() over (order by doc_id) - 1 as position, count(*) over () as total from documents)
        select doc_id, position from r where position = 0 or position * 7 // total > (position - 1) * 7 // total""",
    "week_overflow": f"with {_T} select topic, week, count(*) as n from (select unnest(topics) as topic, strftime(day, '%G-W%V') as week from a) group by 1, 2 having count(*) > 2",
    "event_items": """with r as (select distinct event, i.id as id from (select id as event, unnest(items) as i from timeline_line))
        select id, string_agg(event, ',' order by event) as events, count(*) as n from r where id in (select id from candidate) group by 1""",
    "event_versions": "select seq, coalesce(lag(seq) over w, -1) as before, lag(deleted) over w as was_deleted, updated < lag(updated) over w as late from timeline_line window w as (partition by id order by seq)",
    "event_months": f"with {_T} select strftime(day, '%Y-%m') as month, count(*) as n, arg_max(id, (day, id)) as newest from a group by 1",
    "item_counts": f"""with {_C} select source, count(*) as n, count(*) filter (where first_seen >= timestamptz '2026-10-02 00:00:00+00') as recent, count(*) filter (where why.decision = 'vis') as shown,
        count(*) filter (where baseline) as baseline, count(distinct genre) as genres from c group by 1""",
    "silent_sources": "select id, method from feed_source where status = 'aktiv' and id not in (select source from candidate where first_seen >= timestamptz '2026-09-20 00:00:00+00')",
    "new_since": f"with {_C} select source, count(*) as n from c where not baseline and first_seen > timestamptz '2026-10-01 00:00:00+00' group by 1",
    "source_health": """with o as (select user_id, max((ts, event_id)) filter (where event_type <> 'error') as ok from events group by 1),
        f as (select e.user_id, count(*) as n from events e join o using (user_id) where event_type = 'error' and (ok is null or (ts, event_id) > ok) group by 1)
        select o.user_id, coalesce(n, 0) as fails, case when coalesce(n, 0) >= 3 then 'roed' when coalesce(n, 0) > 0 then 'gul' else 'groen' end as health from o left join f using (user_id)""",
    "failure_ratio": "with r as (select strftime(ts, '%Y-%m-%d') as day, round(avg(case when event_type = 'error' then 1 else 0 end), 6) as ratio from events group by 1) select *, ratio > 0.2 as failed from r",
    "duplicate_ids": "select id, count(*) as n from candidate group by 1 having count(*) > 1",
    "judgment_errors": """with j as (select distinct on (seq) * from judgment), k as (select id from candidate union select id from j where new_item is not null)
        select seq, 'id' as rule from j where not regexp_matches(id, '^[0-9a-f]{12}$') union all select seq, 'topics' from j where coalesce(len(topics), 0) > 1
        union all select seq, 'summary' from j where length(summary_da) not between 20 and 90 union all select seq, 'hint' from j where story_hint = id
        union all select seq, 'places' from j where len(list_filter(places, lambda p: not regexp_matches(p, '^[rkb]:'))) > 0
        union all select seq, 'unknown hint' from j where story_hint is not null and story_hint not in (select id from k)""",
    "policy_scrub": f"with {_C} select c.id, case when s.paywall = 'ja' then '' else teaser end as teaser from c join feed_source s on s.id = c.source where s.status <> 'pause'",
    "retained": "select source, count(distinct id) as n from candidate where first_seen >= timestamptz '2025-10-01 00:00:00+00' and source in (select id from feed_source where status = 'aktiv') group by 1",
    "heartbeat": """select (select count(distinct id) from judgment) as judged, (select count(distinct id) from candidate where id not in (select id from judgment)) as pending,
        (select count(distinct id) from judgment where id not in (select id from candidate)) as foreign""".replace("as foreign", 'as "foreign"'),
    "strictest_filter": """with s as (select id, filter_level, unnest(domains) as domain from feed_source), r as (select distinct ord, source_id, publisher_domain from raw_entry),
        l as (select r.ord, greatest(list_position(['none', 'normal', 'strict'], coalesce(a.filter_level, 'none')), list_position(['none', 'normal', 'strict'], coalesce(b.filter_level, 'none'))) as k
        from r left join feed_source a on a.id = r.source_id left join (select distinct domain, filter_level from s) b on b.domain = r.publisher_domain) select ord, ['none', 'normal', 'strict'][k] as level from l""",
    "stream_first": "select distinct user_id from events",
    "stream_health": """with o as (select user_id, max(event_id) filter (where event_type <> 'error') as ok from events group by 1)
        select o.user_id, (select count(*) from events e where e.user_id = o.user_id and event_type = 'error' and (ok is null or event_id > ok)) as fails from o""",
}
