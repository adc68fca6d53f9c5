"""Queries of addresses, texts, patterns and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kildestrom.functions import dates, patterns, text, urls
from kildestrom.operators import logs, ranking
from kildestrom.session import small_side, table
from kildestrom.sources import feeds, pages

STRONG = ["gebyr*", "genbrug*", "*fraktion*", "udbud", "affaldssortering*", "*container*"]
WEAK = ["borgere", "budget*", "*vand*", "havne*", "under*"]
TOPICS = {"beholdere": ["*container*", "*beholder*", "*pose*"], "gebyrer": ["gebyr*", "*pris", "*afgift"], "anlaeg": ["*anlæg", "*ovn", "*depot"], "planer": ["*handleplan", "*strategi*", "*reform"]}
GENRES = [("hoering", r"(?:^|[^\p{L}])[hH]øring"), ("debat", r"^Derfor |læserspørgsmål"), ("analyse", r"^(?:Rapport|Efter \d+)"), ("politik", r"giver .* lov at")]


def _c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.first(table(spark, sf_dir, "candidate"), "id", [F.col("first_seen")])


def url_item_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item ids made from the collected addresses."""
    return table(spark, sf_dir, "candidate").select("id", urls.item_id(F.col("url")).alias("made")).distinct()


def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw entries per host."""
    return table(spark, sf_dir, "raw_entry").groupBy(urls.host_of(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


def url_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first raw entry of every address."""
    rows = table(spark, sf_dir, "raw_entry").select("ord", urls.address_key(F.col("url")).alias("address"))
    return rows.groupBy("address").agg(F.min("ord").alias("ord"), F.countDistinct("ord").alias("n"))


def host_publisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source with the longest registered parent domain of every entry's host."""
    domains = table(spark, sf_dir, "feed_source").select(F.col("id").alias("publisher"), F.explode("domains").alias("suffix"))
    hosts = table(spark, sf_dir, "raw_entry").select(urls.host_of(F.col("url")).alias("host")).distinct()
    parts = F.split("host", r"\.")
    suffixes = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))).alias("suffix"))
    found = suffixes.join(small_side(domains), "suffix").groupBy("host").agg(F.max_by("publisher", F.struct(F.length("suffix"), "publisher")).alias("publisher"))
    return hosts.join(found, "host", "left")


def unknown_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 hosts with most articles that no source has registered as domain."""
    domains = table(spark, sf_dir, "feed_source").filter("status = 'aktiv'").select(F.explode("domains").alias("host"))
    rows = table(spark, sf_dir, "raw_entry").select(urls.host_of(F.col("url")).alias("host"), "ord").join(small_side(domains.distinct()), "host", "left_anti")
    return ranking.top(rows.groupBy("host").agg(F.countDistinct("ord").alias("n"), F.max("ord").alias("newest")), [F.desc("n"), F.asc("host")], 50)


def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles for comparison, with word counts and short forms."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"))
    return rows.select("doc_id", text.title_key(F.col("title")).alias("title_key"), text.word_count(F.col("title")).alias("n_words"), text.slug(F.col("title")).alias("slug"))


def clean_teasers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teasers without markup and entities, cut at 300 characters as on intake."""
    return _c(spark, sf_dir).select("id", text.clean_text(F.col("teaser")).alias("teaser"))


def stripped_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles without a source's name at the end and without leading labels."""
    sources = table(spark, sf_dir, "feed_source").select(F.explode(F.concat(F.array("name"), F.coalesce("domains", F.array().cast("array<string>")))).alias("name"))
    names = sources.select(text.title_key(F.col("name")).alias("tail_key")).filter("tail_key <> ''").distinct().withColumn("known", F.lit(True))
    rows = table(spark, sf_dir, "raw_entry").select("ord", text.strip(F.col("title")).alias("title")).distinct()
    rows = rows.withColumn("tail_key", text.title_key(text.name_tail(F.col("title")))).join(small_side(names), "tail_key", "left")
    bare = F.when(F.col("known"), text.name_head(F.col("title"))).otherwise(F.col("title"))
    return rows.select("ord", text.strip_prefixes(bare, ["Opdateret: ", "Updated: ", "Uppdaterat: "]).alias("title"))


def folded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source names in both spellings without accents, and short."""
    rows = table(spark, sf_dir, "feed_source")
    return rows.select("id", text.fold(F.col("name"), text.LONG_FOLD).alias("long"), text.fold(F.col("name")).alias("short"), text.short_name(F.col("name")).alias("label"))


def pattern_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns found in every document."""
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", F.array_join(patterns.hits(F.col("text"), STRONG), ",").alias("hits"), F.size(patterns.hits(F.col("text"), WEAK)).alias("n_weak"))


def pattern_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance points of every candidate by title and teaser."""
    rows = _c(spark, sf_dir)
    return rows.select("id", patterns.score(F.col("title"), F.col("teaser"), STRONG, WEAK).alias("s")).select("id", "s.score", "s.in_title", "s.in_teaser", "s.weak")


def topic_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best topics: 3 points a pattern in the title, 1 in the teaser; the second needs half of the first."""
    rows = _c(spark, sf_dir).select("id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("teaser", F.lit("")).alias("teaser"))
    points = [F.struct(F.lit(t).alias("topic"), F.lit(k).alias("ord"), (3 * F.size(patterns.hits(F.col("title"), p)) + F.size(patterns.hits(F.col("teaser"), p))).alias("points")) for k, (t, p) in enumerate(TOPICS.items())]
    # four topics a row are ranked within the row, without a shuffle
    ranked = F.array_sort(F.filter(F.array(*points), lambda x: x["points"] >= 3), lambda a, b: F.when(a["points"] != b["points"], b["points"] - a["points"]).otherwise(a["ord"] - b["ord"]))
    kept = F.filter(F.slice(ranked, 1, 2), lambda x: 2 * x["points"] >= F.get(ranked, F.lit(0))["points"])
    return rows.select("id", F.array_join(F.transform(kept, lambda x: x["topic"]), ",").alias("topics"))


def genre_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first genre rule that a title meets, else that of the source."""
    sources = table(spark, sf_dir, "feed_source").select(F.col("id").alias("source"), F.col("genre").alias("source_genre"))
    rows = _c(spark, sf_dir).select("id", "title", "source").join(small_side(sources), "source", "left")
    return rows.select("id", F.coalesce(*[F.when(F.col("title").rlike(p), F.lit(g)) for g, p in GENRES], "source_genre").alias("genre"))


def local_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local days, weeks and months of the candidates' finding."""
    day = dates.local_day(F.col("first_seen"))
    rows = _c(spark, sf_dir).select("id", day.alias("d"), dates.local(F.col("first_seen")).alias("l"))
    return rows.select("id", F.col("d").cast("string").alias("day"), F.hour("l").alias("hour"), dates.iso_week(F.col("d")).alias("week"), dates.month_bounds(F.col("d"))["first"].cast("string").alias("month"), F.unix_timestamp(dates.day_start(F.col("d"))).alias("starts"))


def copy_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether judges' summaries copy the teaser they sum up."""
    sums = table(spark, sf_dir, "judgment").filter("summary_da is not null").select("seq", "id", "summary_da").distinct()
    rows = sums.join(_c(spark, sf_dir).select("id", "teaser"), "id")
    return rows.select("seq", F.size(text.grams(F.col("summary_da"), 3)).alias("n_grams"), text.copied(F.col("summary_da"), F.coalesce("teaser", F.lit(""))).alias("copied"))


def longest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of words that summary and teaser share."""
    sums = table(spark, sf_dir, "judgment").filter("summary_da is not null").select("seq", "id", "summary_da").distinct()
    rows = sums.join(_c(spark, sf_dir).select("id", "teaser"), "id")
    return rows.select("seq", text.longest_shared_run(text.words(F.col("summary_da")), text.words(F.col("teaser"))).alias("run"))


def rss_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries read back from feed documents that are made of the candidates."""
    escape = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    item = F.concat(F.lit("<rss version='2.0'><channel><item><title>"), escape(F.col("title")), F.lit("</title><link>"), escape(F.col("url")), F.lit("</link><category> a </category><category>a</category></item></channel></rss>"))
    docs = _c(spark, sf_dir).select("id", feeds.feed(item).alias("f"))
    return docs.select("id", F.explode("f.entries").alias("e")).select("id", "e.title", "e.link", F.array_join("e.categories", ",").alias("categories"))


def page_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and date read back from pages that are made of the candidates."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    html = F.concat(F.lit("<html><head><title>x</title></head><body><main><h1>"), escape(F.col("title")), F.lit("</h1><time datetime='"), F.date_format("first_seen", "yyyy-MM-dd"), F.lit("'></time></main></body></html>"))
    return _c(spark, sf_dir).select("id", pages.page(html, F.lit("https://a.example/")).alias("p")).select("id", "p.title", "p.published")


def sitemap_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the sitemap of every source, the three newest addresses."""
    escape = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    rows = _c(spark, sf_dir)
    doc = F.concat(F.lit("<urlset><url><loc>"), escape(F.col("url")), F.lit("</loc><lastmod>"), F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss"), F.lit("</lastmod></url></urlset>"))
    places = rows.select("source", F.explode(feeds.sitemap(doc)["places"]).alias("p")).select("source", "p.loc", "p.lastmod")
    return ranking.top_per(places, ["source"], [F.col("lastmod").desc(), F.col("loc")], 3).select("source", "rank", "loc", "lastmod")


QUERIES = {
    f.__name__: f
    for f in (url_item_id, url_hosts, url_first_seen, host_publisher, unknown_hosts, title_keys, clean_teasers, stripped_titles, folded_names, pattern_hits, pattern_scores, topic_top2, genre_first_match, local_calendar, copy_check, longest_runs, rss_round_trip, page_round_trip, sitemap_newest)
}

_FIRST = "c as (select * from candidate qualify row_number() over (partition by id order by first_seen) = 1)"
_HOST = r"regexp_replace(regexp_replace(regexp_extract(lower(trim(url)), '^https?://([^/?#]*)', 1), ':[0-9]+$', ''), '^www\.', '')"
_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_GRAMS = "list_distinct(list_transform(range(1, greatest(len({0}) - {1} + 2, 1)), lambda k: array_to_string(list_slice({0}, k, k + {1} - 1), ' ')))"


_TAIL = r"^([\s\S]*\S)\s+[|–—-]\s+(\S[\s\S]*)$"
_BEHIND = f"regexp_extract(title, '{_TAIL}', 2)"


# what the patterns mean, written out as regular expressions by hand
_A, _Z, _R = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])", r"[\p{L}\p{N}_]*"
_MEANT = {
    "gebyr*": rf"(?i){_A}gebyr{_R}{_Z}", "genbrug*": rf"(?i){_A}genbrug{_R}{_Z}", "*fraktion*": rf"(?i){_R}fraktion{_R}", "udbud": rf"(?i){_A}udbud{_Z}", "affaldssortering*": rf"(?i){_A}affaldssortering{_R}{_Z}", "*container*": rf"(?i){_R}container{_R}",
    "borgere": rf"(?i){_A}borgere{_Z}", "budget*": rf"(?i){_A}budget{_R}{_Z}", "*vand*": rf"(?i){_R}vand{_R}", "havne*": rf"(?i){_A}havne{_R}{_Z}", "under*": rf"(?i){_A}under{_R}{_Z}",
    "*beholder*": rf"(?i){_R}beholder{_R}", "*pose*": rf"(?i){_R}pose{_R}", "*pris": rf"(?i){_R}pris{_Z}", "*afgift": rf"(?i){_R}afgift{_Z}", "*anlæg": rf"(?i){_R}anlæg{_Z}", "*ovn": rf"(?i){_R}ovn{_Z}", "*depot": rf"(?i){_R}depot{_Z}",
    "*handleplan": rf"(?i){_R}handleplan{_Z}", "*strategi*": rf"(?i){_R}strategi{_R}", "*reform": rf"(?i){_R}reform{_Z}",
}


def _sql_hits(column: str, names: list[str]) -> str:
    return "(" + " + ".join(f"(case when regexp_matches({column}, '{_MEANT[p]}') then 1 else 0 end)" for p in names) + ")"


def _sql_list(column: str, names: list[str]) -> str:
    return "list_filter([" + ", ".join(f"case when regexp_matches({column}, '{_MEANT[p]}') then '{p}' end" for p in names) + "], lambda x: x is not null)"


def _sql_mask(column: str, names: list[str]) -> str:
    for p in names:
        column = f"regexp_replace({column}, '{_MEANT[p]}', ' ', 'g')"
    return column


_TOPIC_ROWS = " union all ".join(f"select id, '{t}' as topic, {k} as ord, 3 * {_sql_hits('title', p)} + {_sql_hits('teaser', p)} as points from d" for k, (t, p) in enumerate(TOPICS.items()))
ORACLE = {
    "url_item_id": "select distinct id, id as made from candidate",
    "url_hosts": f"select {_HOST} as host, count(*) as n from raw_entry group by 1",
    "url_first_seen": r"""with p as (select ord, regexp_replace(regexp_replace(regexp_extract(lower(regexp_extract(trim(url), '^(?i:https?)://([^/?#]*)', 1)), '^(.*)$', 1), ':(80|443)?$', ''), '^www\.', '') as host,
        regexp_replace(regexp_extract(trim(url), '^(?i:https?)://[^/?#]*([^?#]*)', 1), '/+$', '') as path, regexp_extract(trim(url), '\?([^#]*)', 1) as query from raw_entry),
        k as (select ord, host, path, array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' and not starts_with(lower(split_part(x, '=', 1)), 'utm_')
        and lower(split_part(x, '=', 1)) not in ('fbclid', 'gclid', 'ref', 'referrer', 'mc_cid', 'mc_eid'))), '&') as q from p)
        select host || path || case when q <> '' then '?' || q else '' end as address, min(ord) as ord, count(distinct ord) as n from k group by 1""",
    "host_publisher": f"""with h as (select distinct {_HOST} as host from raw_entry), d as (select id, unnest(domains) as suffix from feed_source),
        m as (select host, id, suffix from h join d on host = suffix or ends_with(host, '.' || suffix))
        select h.host, (select m.id from m where m.host = h.host order by length(suffix) desc, m.id desc limit 1) as publisher from h""",
    "unknown_hosts": f"""with d as (select unnest(domains) as host from feed_source where status = 'aktiv'), r as (select {_HOST} as host, ord from raw_entry)
        select host, count(distinct ord) as n, max(ord) as newest from r where host not in (select host from d) group by 1 order by n desc, host limit 50""",
    "title_keys": f"""with t as (select doc_id, split_part(text, chr(10), 1) as title from documents),
        s as (select *, lower(title) as l from t)
        select doc_id, array_to_string({_WORDS.format('title')}, ' ') as title_key,
        cast(case when trim(title) = '' then 0 else len(regexp_split_to_array(trim(title), '\\s+')) end as int) as n_words,
        regexp_replace(regexp_replace(translate(replace(replace(replace(replace(l, 'å', 'aa'), 'ø', 'oe'), 'æ', 'ae'), 'ß', 'ss'), 'äöüéèàâêëïîôûçñ', 'aoueeaaeeiioucn'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') as slug from s""".replace("\\\\", "\\"),
    "pattern_hits": f"select doc_id, array_to_string({_sql_list('text', STRONG)}, ',') as hits, cast({_sql_hits('text', WEAK)} as int) as n_weak from documents",
    "pattern_scores": f"""with {_FIRST}, d as (select id, coalesce(title, '') as title, coalesce(teaser, '') as teaser from c),
        m as (select *, {_sql_mask('title', STRONG)} as mt, {_sql_mask('teaser', STRONG)} as mz from d),
        n as (select id, {_sql_hits('title', STRONG)} as a, {_sql_hits('teaser', STRONG)} as b, {_sql_hits('mt', WEAK)} as wt, len(list_distinct(list_concat({_sql_list('mt', WEAK)}, {_sql_list('mz', WEAK)}))) as w from m)
        select id, cast(4 * a + least(6, 2 * b) + case when a + b > 0 or w >= 2 or wt > 0 then least(2, w) else 0 end as int) as score, cast(a as int) as in_title, cast(b as int) as in_teaser, cast(w as int) as weak from n""",
    "topic_top2": f"""with {_FIRST}, d as (select id, coalesce(title, '') as title, coalesce(teaser, '') as teaser from c), p as ({_TOPIC_ROWS}),
        r as (select *, row_number() over (partition by id order by points desc, ord) as n, max(points) over (partition by id) as best from p where points >= 3)
        select d.id, coalesce(string_agg(topic, ',' order by n) filter (where n <= 2 and 2 * points >= best), '') as topics from d left join r using (id) group by d.id""",
    "genre_first_match": f"with {_FIRST} select c.id, case " + " ".join(f"when regexp_matches(title, '{p}') then '{g}'" for g, p in GENRES) + " else s.genre end as genre from c left join feed_source s on s.id = c.source",
    "local_calendar": f"""with {_FIRST}, d as (select id, timezone('Europe/Copenhagen', first_seen) as l from c)
        select id, cast(cast(l as date) as varchar) as day, cast(hour(l) as int) as hour, strftime(l, '%G-W%V') as week, cast(cast(date_trunc('month', l) as date) as varchar) as month,
        cast(epoch(timezone('Europe/Copenhagen', cast(cast(l as date) as timestamp))) as bigint) as starts from d""",
    "copy_check": f"""with {_FIRST}, s as (select distinct j.seq, {_WORDS.format('j.summary_da')} as a, {_WORDS.format('c.teaser')} as b from judgment j join c using (id) where summary_da is not null),
        g as (select seq, {_GRAMS.format('a', 3)} as ga, {_GRAMS.format('b', 3)} as gb, {_GRAMS.format('a', 6)} as ra, {_GRAMS.format('b', 6)} as rb from s)
        select seq, cast(len(ga) as int) as n_grams, len(list_intersect(ra, rb)) > 0 or (len(ga) >= 4 and len(list_intersect(ga, gb)) > 0.5 * len(ga)) as copied from g""",
    "rss_round_trip": f"with {_FIRST} select id, trim(title) as title, trim(url) as link, 'a' as categories from c",
    "page_round_trip": f"with {_FIRST} select id, trim(regexp_replace(title, '[\\s\\x{{00a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{3000}}]+', ' ', 'g')) as title, strftime(timezone('UTC', first_seen), '%Y-%m-%d') as published from c",
    "sitemap_newest": f"""with {_FIRST}, r as (select source, url as loc, strftime(timezone('UTC', first_seen), '%Y-%m-%d %H:%M:%S') as lastmod from c)
        select source, cast(rank as int) as rank, loc, lastmod from (select *, row_number() over (partition by source order by lastmod desc, loc) as rank from r) where rank <= 3""",
    "stripped_titles": rf"""with n as (select distinct array_to_string({_WORDS.format('name')}, ' ') as k from (select name from feed_source union select unnest(domains) from feed_source)), r as (select distinct ord, trim(title) as title from raw_entry),
        t as (select *, array_to_string({_WORDS.format(_BEHIND)}, ' ') as k from r),
        b as (select ord, case when k <> '' and k in (select k from n) then regexp_extract(title, '{_TAIL}', 1) else title end as title from t),
        p as (select *, case when lower(title) like 'opdateret: %' then 12 when lower(title) like 'updated: %' then 10 when lower(title) like 'uppdaterat: %' then 13 end as start from b)
        select ord, case when start is not null and regexp_matches(substr(title, start), '[\p{{L}}\p{{N}}]') then trim(substr(title, start)) else title end as title from p""",
    "folded_names": r"""select id, strip_accents(replace(replace(replace(replace(lower(name), 'å', 'aa'), 'ø', 'oe'), 'æ', 'ae'), 'ß', 'ss')) as long, strip_accents(replace(replace(replace(replace(lower(name), 'å', 'a'), 'ø', 'o'), 'æ', 'ae'), 'ß', 'ss')) as short,
        case when regexp_extract(name, '\(([\p{Lu}\p{N}]{2,6})\)', 1) <> '' then regexp_extract(name, '\(([\p{Lu}\p{N}]{2,6})\)', 1) else trim(regexp_replace(name, '\s*\([^)]*\)', '', 'g')) end as label from feed_source""",
    "longest_runs": rf"""with {_FIRST}, s as (select distinct j.seq, {_WORDS.format('j.summary_da')} as a, {_WORDS.format('c.teaser')} as b from judgment j join c using (id) where summary_da is not null),
        x as (select seq, a, b, unnest(range(1, len(a) + 1)) as i from s), y as (select seq, i, b, a, unnest(range(1, len(b) + 1)) as k from x), m as (select seq, i, k, i - k as d from y where a[i] = b[k]),
        g as (select *, i - row_number() over (partition by seq, d order by i) as island from m), l as (select seq, count(*) as n from g group by seq, d, island)
        select s.seq, cast(coalesce(max(l.n), 0) as int) as run from s left join l using (seq) group by s.seq""",
}
