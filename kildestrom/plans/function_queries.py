"""Queries of further text, genre, topic and date rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kildestrom.functions import dates, patterns, registry, text
from kildestrom.operators import logs
from kildestrom.session import small_side, table
from kildestrom.sources import pages

TOPICS = {"gebyrer": ["gebyr*", "*pris", "*afgift"], "genanvendelse": ["*genbrug*", "*sortering"], "udbud": ["udbud*", "*aftale"], "klima": ["*klima*", "*energi*"], "regler": ["*godkendelse", "*forslag", "*regler"]}
FORCED = {"hoering": "regler", "folketing": "regler"}
PREFIXES = [("debat", ["derfor", "ugens store"]), ("analyse", ["rapport"]), ("hoering", ["høring"])]
CATEGORY_GENRES = {"budget": "analyse", "udvalg": "folketing", "forsyning": "pressemeddelelse"}


def _c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.first(table(spark, sf_dir, "candidate"), "id", [F.col("first_seen")])


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with their names: a few each."""
    return small_side(table(spark, sf_dir, "feed_source").select(F.col("id").alias("source"), registry.site_names(F.col("name"), F.coalesce("domains", F.array().cast("array<string>"))).alias("names")))


def site_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of raw entries without up to two tails that name a site."""
    rows = table(spark, sf_dir, "raw_entry").select("ord", F.col("source_id").alias("source"), text.strip(F.col("title")).alias("title")).distinct().join(_names(spark, sf_dir), "source")
    return rows.select("ord", text.strip_site_tail(F.col("title"), F.col("names")).alias("title"))


def normal_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of raw entries for comparison, and how many entries share one."""
    rows = table(spark, sf_dir, "raw_entry").select("ord", F.col("source_id").alias("source"), text.strip(F.col("title")).alias("title")).distinct().join(_names(spark, sf_dir), "source")
    return rows.groupBy(text.normal_title(F.col("title"), F.col("names")).alias("title")).agg(F.count("*").alias("n"), F.min("ord").alias("first"))


def publisher_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles without their own source's name at the end, however it is spaced and capitalised."""
    s = small_side(table(spark, sf_dir, "feed_source").select(F.col("id").alias("source_id"), "name"))
    rows = table(spark, sf_dir, "raw_entry").select("ord", "source_id", text.strip(F.col("title")).alias("title")).distinct().join(s, "source_id")
    return rows.select("ord", text.strip_publisher(F.col("title"), F.upper("name")).alias("title"))


def genre_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genre by the first rule that applies: a hearing source, the address, a feed's category, the title's start, else news."""
    s = small_side(table(spark, sf_dir, "feed_source").select(F.col("id").alias("source"), F.col("genre").alias("own")))
    rows = _c(spark, sf_dir).select("id", "url", "title", "source", "categories").join(s, "source", "left")
    start = F.lower(F.regexp_replace("title", r"^[\s\"'»“]+", ""))
    by_title = [F.when(start.rlike("^(?:" + "|".join(p) + r")(?![\p{L}\p{N}])"), g) for g, p in PREFIXES]
    form = lambda w: lambda c: F.lower(c).rlike(f"^{w}(?:r|e|er|en|et|ne|erne|s)?$")
    by_category = [F.when(F.exists("categories", form(w)), g) for w, g in CATEGORY_GENRES.items()]
    return rows.select("id", F.coalesce(F.when(F.col("own") == "hoering", "hoering"), F.when(F.col("url").contains("kategori=regler"), "hoering"), *by_category, *by_title, F.lit("nyhed")).alias("genre"))


def topic_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics by points: 3 a pattern in the title, 1 in the teaser, 1 if the address has any, 1 if the source has the topic.

    The best with three points or more, and a second with at least half as many; else the source's own topics; some
    genres add a topic if there is room. Ties go to the longer pattern, then to the order of the topics.
    """
    s = small_side(table(spark, sf_dir, "feed_source").select(F.col("id").alias("source"), F.col("topics").alias("own")))
    rows = _c(spark, sf_dir).select("id", "source", "genre", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("teaser", F.lit("")).alias("teaser"), registry.slug_text(F.col("url")).alias("slug")).join(s, "source", "left")
    points = []
    for k, (topic, names) in enumerate(TOPICS.items()):
        title, teaser = patterns.hits(F.col("title"), names), patterns.hits(F.col("teaser"), names)
        n = 3 * F.size(title) + F.size(teaser) + (F.size(patterns.hits(F.col("slug"), names)) > 0).cast("int") + F.coalesce(F.array_contains("own", topic), F.lit(False)).cast("int")
        longest = F.coalesce(F.array_max(F.transform(F.concat(title, teaser), F.length)), F.lit(0))
        points.append(F.struct((-n).alias("n"), (-longest).alias("l"), F.lit(k).alias("k"), F.lit(topic).alias("topic")))
    ranked = F.array_sort(F.filter(F.array(*points), lambda x: x["n"] <= -3))  # few topics a row: ranked within it, without a shuffle
    kept = F.transform(F.filter(F.slice(ranked, 1, 2), lambda x: 2 * x["n"] <= F.get(ranked, F.lit(0))["n"]), lambda x: x["topic"])
    found = F.when(F.size(kept) > 0, kept).otherwise(F.slice(F.coalesce("own", F.array().cast("array<string>")), 1, 2))
    forced = F.col("genre").isin(*FORCED) & (F.size(found) < 2) & ~F.array_contains(found, "regler")
    return rows.select("id", F.array_join(F.when(forced, F.concat(found, F.array(F.lit("regler")))).otherwise(found), ",").alias("topics"))


def text_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that the entries' time texts tell when they are read as plain text, half of them behind a label."""
    said = F.concat(F.when(F.col("ord") % 2 == 0, "Se 2024-01-05. Publiceret: ").otherwise("Vist "), F.coalesce("published", F.lit("")), F.lit(" i går 2031-01-01"))
    rows = table(spark, sf_dir, "raw_entry").select("ord", dates.text_date(said, F.lit("2026-11-01").cast("date")).alias("day")).distinct()
    return rows.select("ord", F.col("day").cast("string").alias("day"), dates.date_quality(F.col("day"), F.lit(None).cast("date")).alias("quality"))


def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and day of pages made of candidates: the site's name as og:title, a heading, a date that can't be, and a text that tells one."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    rows = _c(spark, sf_dir).select("id", "source", "first_seen", F.regexp_replace("title", r"[^\p{L}\p{N} ]", "").alias("title")).join(_names(spark, sf_dir), "source")
    name = F.get("names", F.lit(0))
    html = F.concat(F.lit('<html><head><meta property="og:title" content="'), escape(name), F.lit('"></head><body><nav><p>Publiceret 2001-01-01</p></nav><main><h1>'), escape(F.col("title")), F.lit(" | "), escape(name), F.lit("</h1><time datetime='2031-05-05'></time><p>Publiceret: "), F.date_format("first_seen", "d.M.yyyy"), F.lit(" i avisen. Se 2002-02-02.</p></main></body></html>"))
    read = rows.select("id", "names", pages.page(html, F.lit("https://a.example/x")).alias("p")).select("id", "names", "p.titles", "p.dates", "p.body")
    at = pages.page_times(read, "id", "dates", "body", F.lit("2026-12-31").cast("timestamp"))
    titles = read.select("id", pages.page_title(F.col("titles"), F.col("names")).alias("title"))
    return titles.join(at, "id").select("id", "title", F.date_format(F.from_utc_timestamp("at", "Europe/Copenhagen"), "yyyy-MM-dd").alias("day"), "quality")


def relative_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the events' days read on one day."""
    rows = table(spark, sf_dir, "timeline_line").filter("day is not null").select("seq", "day")
    return rows.select("seq", dates.relative_day(F.col("day"), F.lit("2026-10-20").cast("date")).alias("label"))


def sort_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local times by which canonical candidates are shown."""
    at = F.try_to_timestamp("published", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    rows = _c(spark, sf_dir).filter(F.col("published").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$"))
    return rows.select("id", F.date_format(dates.sort_key(at, F.col("first_seen"), F.col("date_quality")), "yyyy-MM-dd HH:mm:ss").alias("key"))


def short_teasers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teasers cut at a blank within 120 characters for display."""
    return _c(spark, sf_dir).filter(F.length("teaser") > 0).select("id", text.truncate(F.regexp_replace("teaser", r"\s+", " "), 120).alias("teaser"))


QUERIES = {f.__name__: f for f in (site_tails, normal_titles, publisher_suffixes, genre_rules, topic_rules, text_dates, page_facts, relative_days, sort_keys, short_teasers)}

_FIRST = "c as (select * from candidate qualify row_number() over (partition by id order by first_seen) = 1)"
_TAIL = r"^([\s\S]*\S)\s+([|–—-])\s+(\S[\s\S]*)$"
_FOLD = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]', '', 'g')"
_NAMES = r"n as (select id, unnest(list_concat([name, trim(regexp_replace(name, '\s*\([^)]*\)', '', 'g'))], list_concat(regexp_extract_all(name, '\(([^)]+)\)', 1), coalesce(domains, [])))) as name from feed_source)"


def _strip(source: str, out: str) -> str:
    """SQL of one round of taking a tail away, from table `source` to table `out`."""
    head, mark, tail = (f"regexp_extract(title, '{_TAIL}', {k})" for k in (1, 2, 3))
    words = r"len(regexp_split_to_array(trim({0}), '\s+'))"
    known = f"exists (select 1 from n where n.id = p.source_id and (k = {_FOLD.format('n.name')} or (length(k) >= 3 and contains({_FOLD.format('n.name')}, k)) or (length({_FOLD.format('n.name')}) >= 3 and contains(k, {_FOLD.format('n.name')}))))"
    return (
        f"{out}_p as (select *, {head} as h, {mark} as m, {tail} as t from {source}), {out}_k as (select *, {_FOLD.format('t')} as k from {out}_p), "
        f"{out} as (select ord, source_id, case when t <> '' and {words.format('h')} >= 2 and (case when k <> '' and {known} then true when length(t) > 40 then false when m = '|' then {words.format('t')} <= 5 "
        rf"else regexp_matches(t, '^[\p{{L}}\p{{N}}-]+(\.[\p{{L}}\p{{N}}-]+)+$') or ({words.format('t')} <= 4 and regexp_matches(t, '^[\p{{Lu}}\p{{N}}]\S*(\s+[\p{{Lu}}\p{{N}}]\S*)*$')) end) then h else title end as title from {out}_k p)"
    )


_ENTRIES = "r as (select distinct ord, source_id, trim(title) as title from raw_entry where source_id in (select id from feed_source))"
_A, _Z, _R = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])", r"[\p{L}\p{N}_]*"
# what the patterns of TOPICS mean, written out by hand
_MEANT = {
    "gebyr*": rf"(?i){_A}gebyr{_R}{_Z}", "*pris": rf"(?i){_R}pris{_Z}", "*afgift": rf"(?i){_R}afgift{_Z}", "*genbrug*": rf"(?i){_R}genbrug{_R}", "*sortering": rf"(?i){_R}sortering{_Z}", "udbud*": rf"(?i){_A}udbud{_R}{_Z}", "*aftale": rf"(?i){_R}aftale{_Z}",
    "*klima*": rf"(?i){_R}klima{_R}", "*energi*": rf"(?i){_R}energi{_R}", "*godkendelse": rf"(?i){_R}godkendelse{_Z}", "*forslag": rf"(?i){_R}forslag{_Z}", "*regler": rf"(?i){_R}regler{_Z}",
}
_HAS = lambda column, p: f"regexp_matches({column}, '{_MEANT[p]}')"
_POINTS = " union all ".join(
    f"""select id, '{t}' as topic, {k} as k, {' + '.join(f"3 * {_HAS('title', p)}::int + {_HAS('teaser', p)}::int" for p in names)} + ({' or '.join(_HAS('slug', p) for p in names)})::int + coalesce(list_contains(own, '{t}'), false)::int as n,
    greatest({', '.join(f"case when {_HAS('title', p)} or {_HAS('teaser', p)} then {len(p)} else 0 end" for p in names)}) as l from d"""
    for k, (t, names) in enumerate(TOPICS.items())
)
ORACLE = {
    "page_facts": rf"""with {_FIRST} select c.id, trim(regexp_replace(regexp_replace(title, '[^\p{{L}}\p{{N}} ]', '', 'g'), '\s+', ' ', 'g')) as title, strftime(timezone('UTC', first_seen), '%Y-%m-%d') as day, 'kilde' as quality from c join feed_source f on f.id = c.source""",
    "site_tails": f"with {_NAMES}, {_ENTRIES}, {_strip('r', 'a')}, {_strip('a', 'b')} select ord, title from b",
    "publisher_suffixes": rf"""with r as (select distinct ord, source_id, trim(title) as title from raw_entry), j as (select r.*, name from r join feed_source f on f.id = r.source_id)
        select ord, case when coalesce(lower(trim(regexp_replace(regexp_extract(title, '{_TAIL}', 3), '\s+', ' ', 'g'))) = lower(trim(regexp_replace(name, '\s+', ' ', 'g'))), false) then regexp_extract(title, '{_TAIL}', 1) else title end as title from j""",
    "genre_rules": rf"""with {_FIRST}, d as (select c.*, f.genre as own, lower(regexp_replace(title, '^[\s"''»“]+', '')) as st from c left join feed_source f on f.id = c.source)
        select id, case when own = 'hoering' then 'hoering' when url like '%kategori=regler%' then 'hoering' """
    + " ".join(f"when len(list_filter(categories, lambda x: regexp_matches(lower(x), '^{w}(?:r|e|er|en|et|ne|erne|s)?$'))) > 0 then '{g}'" for w, g in CATEGORY_GENRES.items())
    + " "
    + " ".join(rf"when regexp_matches(st, '^(?:{'|'.join(p)})(?:$|[^\p{{L}}\p{{N}}])') then '{g}'" for g, p in PREFIXES)
    + " else 'nyhed' end as genre from d",
    "topic_rules": rf"""with {_FIRST}, d as (select c.id, coalesce(title, '') as title, coalesce(teaser, '') as teaser, trim(regexp_replace(url_decode(regexp_extract(url, '^(?i:https?)://[^/?#]*([^?#]*)', 1)), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) as slug, f.topics as own from c left join feed_source f on f.id = c.source),
        p as ({_POINTS}), r as (select *, row_number() over (partition by id order by n desc, l desc, k) as pos, max(n) over (partition by id) as best from p where n >= 3),
        g as (select id, list(topic order by pos) filter (where pos <= 2 and 2 * n >= best) as found from r group by 1), h as (select c.id, c.genre, coalesce(g.found, list_slice(coalesce(d.own, []), 1, 2)) as t from c join d using (id) left join g using (id))
        select id, array_to_string(case when genre in ('hoering', 'folketing') and len(t) < 2 and not list_contains(t, 'regler') then list_concat(t, ['regler']) else t end, ',') as topics from h""",
    "relative_days": """select seq, case when day = date '2026-10-20' then 'i dag' when day = date '2026-10-19' then 'i går' when day between date '2026-10-14' and date '2026-10-18' then 'ugedag ' || cast((dayofweek(day) + 6) % 7 as varchar) else strftime(day, '%Y-%m-%d') end as label from timeline_line where day is not null""",
    "sort_keys": rf"""with {_FIRST}, d as (select id, date_quality as q, timezone('Europe/Copenhagen', timezone('UTC', try_strptime(published, '%Y-%m-%dT%H:%M:%SZ'))) as p, timezone('Europe/Copenhagen', first_seen) as s from c where regexp_matches(published, '^\d{{4}}-\d\d-\d\dT\d\d:\d\d:\d\dZ$'))
        select id, strftime(case when q in ('url', 'liste') and cast(p as date) = cast(s as date) then s when q in ('url', 'liste') then cast(cast(p as date) as timestamp) else p end, '%Y-%m-%d %H:%M:%S') as key from d""",
    "short_teasers": rf"""with {_FIRST}, d as (select id, trim(regexp_replace(teaser, '\s+', ' ', 'g')) as t from c where length(teaser) > 0), h as (select *, substr(t, 1, 119) as h, regexp_extract(substr(t, 1, 119), '^([\s\S]*)\s\S*$', 1) as w from d)
        select id, case when length(t) > 120 then regexp_replace(case when regexp_matches(substr(t, 120, 1), '\S') and length(w) >= 60 then w else h end, '[ ,;:–—·|/-]+$', '') || '…' else t end as teaser from h""",
}
