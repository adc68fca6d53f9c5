"""Queries of sources, addresses, sitemaps, admission and kept state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kildestrom.functions import registry, text, urls
from kildestrom.operators import intake, logs, ranking
from kildestrom.session import collect_small, small_side, table
from kildestrom.sources import feeds

NOW = "2026-11-01 12:00:00"
QUERIES_SOUGHT = ["affald", "grøn"]
TEMPLATES = ["https://news.google.com/rss/search?q={q}", "https://www.bing.com/news/search?q={q}&format=rss", "https://find.example/?q={q}"]
CATEGORIES = ["kommunal", "nyhedsmedie", "fagmedie", "myndighed", "forening", "organisation"]
_WEB = r"^https?://[\x21-\x7e]+"


def _now() -> object:
    return F.lit(NOW).cast("timestamp")


def _c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.first(table(spark, sf_dir, "candidate"), "id", [F.col("first_seen")])


def _visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with the last time that something of theirs was found."""
    last = table(spark, sf_dir, "candidate").groupBy(F.col("source").alias("id")).agg(F.max("first_seen").alias("last"))
    return table(spark, sf_dir, "feed_source").join(last, "id", "left")


def entry_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw entries with whether they may come in."""
    return table(spark, sf_dir, "raw_entry").select("ord", intake.admitted(F.col("url"), F.col("title")).alias("admitted")).distinct()


def age_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with canonical times, judged by their age when they were found: counts by gate and quality."""
    at = F.try_to_timestamp("published", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    rows = _c(spark, sf_dir).select("source", intake.dated(F.when(F.col("published").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$"), at), F.col("first_seen"), 14, F.col("found_via") == "sweep").alias("d"))
    return rows.groupBy("source", "d.gate", "d.quality").agg(F.count("*").alias("n"))


def quiet_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turned-down candidates per source: those stored and those too old for it."""
    since = _now() - F.expr("interval 90 days")
    rows = _c(spark, sf_dir).filter(F.col("why.decision") != "vis")
    return rows.groupBy("source").agg(F.count_if(F.col("first_seen") >= since).alias("stored"), F.count_if(F.col("first_seen") < since).alias("quiet"))


def due_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each source's visit is due; paused ones count as in trouble."""
    return _visits(spark, sf_dir).select("id", intake.due(F.col("method"), F.col("last"), _now(), F.col("status") == "pause").alias("due"))


def source_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which sources are visited: search last, paused later, longest waiting first."""
    rows = _visits(spark, sf_dir).select("id", (F.col("method") == "search").cast("int").alias("s"), (F.col("status") == "pause").cast("int").alias("p"), F.coalesce(F.unix_micros("last"), F.lit(0)).alias("last"))
    return ranking.with_position(rows, [F.asc("s"), F.asc("p"), F.asc("last"), F.asc("id")]).select("id", F.col("position").cast("bigint").alias("position"))


def lookback_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that each source looks back, by its last find before the day it was checked."""
    last = table(spark, sf_dir, "candidate").join(small_side(table(spark, sf_dir, "feed_source").select(F.col("id").alias("source"), "checked")), "source").filter(F.to_date("first_seen") <= F.col("checked"))
    days = last.groupBy(F.col("source").alias("id")).agg(F.max(F.to_date("first_seen")).alias("last"))
    return table(spark, sf_dir, "feed_source").join(days, "id", "left").select("id", intake.lookback_days(F.col("last"), F.col("checked")).alias("days"))


def sitemap_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every source's places those to fetch: own host, news path, changed in the window, unseen, newest 15."""
    places = table(spark, sf_dir, "candidate").select("source", F.col("url").alias("loc"), F.col("first_seen").alias("lastmod"))
    sources = table(spark, sf_dir, "feed_source").select(F.col("id").alias("source"), registry.source_hosts(F.col("homepage"), F.col("domains")).alias("hosts"), (F.col("checked") - F.expr("interval 120 days")).cast("timestamp").alias("since"))
    seen = table(spark, sf_dir, "raw_entry").select(urls.address_key(F.col("url")).alias("address"))
    found = intake.sitemap_targets(places, small_side(sources), seen, "/(?:nyheder|nyhed|artikel)", 15)
    return found.select("source", "address", F.col("rank").cast("int").alias("rank"))


def sitemap_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses behind the three newest monthly maps of every source, counted."""
    rows = table(spark, sf_dir, "candidate").select("source", F.col("url").alias("loc"), F.concat(F.lit("https://"), "source", F.lit(".example/kort-"), F.date_format("first_seen", "yyyy-MM"), F.lit(".xml")).alias("map"), "first_seen")
    maps = rows.groupBy("source", "map").agg(F.max("first_seen").alias("lastmod")).withColumn("position", F.col("map"))
    own = table(spark, sf_dir, "feed_source").select(F.col("id").alias("source"), registry.source_hosts(F.col("homepage"), F.col("domains")).alias("hosts"))
    return intake.traversed(maps, rows.select("map", "loc").distinct(), small_side(own), 3).groupBy("source").agg(F.count("*").alias("n"))


def newest_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two newest places of every source's index by change, date in the address and position."""
    places = _c(spark, sf_dir).select("source", F.col("url").alias("loc"), F.date_trunc("month", "first_seen").alias("lastmod"), F.col("id").alias("position"))
    return feeds.newest_maps(places, "source", 2).select("source", "position", F.col("url_date").cast("string").alias("url_date"), F.col("rank").cast("int").alias("rank"))


def sitemap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and newest change of every source's sitemap, from parsed documents."""
    escape = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    doc = F.concat(F.lit("<urlset><url><loc>"), escape(F.col("url")), F.lit("</loc><lastmod>"), F.date_format("first_seen", "yyyy-MM-dd"), F.lit("</lastmod></url></urlset>"))
    rows = table(spark, sf_dir, "candidate").select("source", F.explode(feeds.sitemap(doc)["places"]).alias("p"))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.max("p.lastmod").alias("newest"))


def day_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive addresses of every source for each day from the latest back to when it was checked."""
    template = F.concat("homepage", F.when(F.col("method") == "html", "/arkiv/{dato}").otherwise("/arkiv"))
    return table(spark, sf_dir, "feed_source").select("id", F.posexplode(feeds.expand_days(template, F.col("checked"), F.lit("2026-10-31").cast("date"))).alias("position", "url"))


def search_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search addresses of every active search source with their engine."""
    rows = table(spark, sf_dir, "feed_source").filter("method = 'search'").select("id", F.explode(F.array(*[F.lit(t) for t in TEMPLATES])).alias("t")).withColumn("q", F.explode(F.array(*[F.lit(q) for q in QUERIES_SOUGHT])))
    made = rows.select("id", feeds.search_address(F.col("t"), F.col("q"), F.lit("7d")).alias("url"))
    return made.select("id", "url", feeds.engine_of(urls.host_of(F.col("url"))).alias("engine"))


def wrapped_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses read back from links of two engines that are made of the raw entries."""
    rows = table(spark, sf_dir, "raw_entry").select("ord", "url").distinct()
    ascii_ = F.regexp_extract("url", _WEB, 0)
    n = F.length(ascii_)
    varint = F.when(n < 128, F.lpad(F.hex(n), 2, "0")).otherwise(F.concat(F.lpad(F.hex(n % 128 + 128), 2, "0"), F.lpad(F.hex(F.floor(n / 128)), 2, "0")))
    token = F.replace(F.replace(F.base64(F.concat(F.unhex(F.lit("0813")), F.unhex(F.lit("22")), F.unhex(varint), F.encode(ascii_, "UTF-8"))), F.lit("+"), F.lit("-")), F.lit("/"), F.lit("_"))
    bing = feeds.bing_target(F.concat(F.lit("https://www.bing.com/news/apiclick.aspx?ref=x&url="), F.url_encode("url"), F.lit("&c=1")))
    google = feeds.encoded_target(F.concat(F.lit("https://news.google.com/rss/articles/"), token, F.lit("?oc=5")))
    return rows.select("ord", bing.alias("bing"), google.alias("google"))


def feed_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether documents are feeds, and their first links: Atom for some candidates, pages for others."""
    escape = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    atom = F.concat(F.lit("<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>t</title><id>urn:x</id><link rel='self' href='https://x.example'/><link href='"), F.replace(escape(F.col("url")), F.lit("'"), F.lit("&apos;")), F.lit("'/><updated>"), F.date_format("first_seen", "yyyy-MM-dd"), F.lit("</updated></entry></feed>"))
    page = F.concat(F.lit("<html><body><p>"), escape(F.coalesce("title", F.lit(""))), F.lit("</p></body></html>"))
    rows = _c(spark, sf_dir).select("id", feeds.feed(F.when(F.col("found_via") == "feed", atom).otherwise(page)).alias("f"))
    first = F.get("f.entries", F.lit(0))
    return rows.select("id", "f.is_feed", first["link"].alias("link"), first["published"].alias("published"))


def skipped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parliament documents of JSON pages: why they are left out, and how many."""
    file = F.array(F.struct("filurl", "variantkode"))
    doc = F.struct("id", "titel", "dato", "frigivelsesdato", "offentlighedskode", F.struct(F.col("dokumenttype").alias("type")).alias("Dokumenttype"), F.when(F.col("filurl").isNotNull(), file).alias("Fil"))
    pages = table(spark, sf_dir, "oda_document").select(F.to_json(F.struct(F.array(doc).alias("value"))).alias("page"))
    return feeds.odata(pages, "page", ["Henvendelse"]).groupBy(F.coalesce("skipped", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


def import_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishers' domains as rows of an import: new, known, paused or repeated."""
    hosts = table(spark, sf_dir, "raw_entry").filter("publisher_domain is not null").select("ord", urls.host_of(F.col("publisher_domain")).alias("host")).distinct()
    first = hosts.groupBy("host").agg(F.min("ord").alias("first"))
    known = table(spark, sf_dir, "feed_source").select(F.explode(registry.source_hosts(F.col("homepage"), F.col("domains"))).alias("host"), "status").groupBy("host").agg(F.max("status").alias("status"))
    rows = hosts.join(first, "host").join(small_side(known), "host", "left")
    return rows.select("ord", "host", F.when(F.col("ord") > F.col("first"), "repeated").when(F.col("status") == "pause", "paused").when(F.col("status").isNotNull(), "known").otherwise("new").alias("state"))


def source_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts, other domains, names and feed addresses of every source."""
    hosts = registry.source_hosts(F.col("homepage"), F.col("domains"))
    join = lambda a: F.array_join(a, " ")
    return table(spark, sf_dir, "feed_source").select("id", join(hosts).alias("hosts"), join(registry.other_domains(F.col("homepage"), F.col("domains"))).alias("other"), F.array_join(registry.site_names(F.col("name"), hosts), "|").alias("names"), join(registry.feed_addresses(F.col("homepage"))).alias("feeds"))


def slug_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the entries' paths."""
    return table(spark, sf_dir, "raw_entry").select("ord", registry.slug_text(F.col("url")).alias("words")).distinct()


def place_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that sources would have as places, and the categories their names tell."""
    rows = table(spark, sf_dir, "feed_source")
    return rows.select("id", registry.place_id(F.lit("k"), F.col("name")).alias("place"), registry.category_of(F.col("name"), CATEGORIES).alias("category"))


def populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers read back from texts with dots and commas."""
    written = F.translate(F.format_number("c_acctbal", 2), ",.", ".,")
    return table(spark, sf_dir, "customer").select("c_custkey", registry.population(written).alias("n"), registry.population(F.concat(written, F.lit(" ca."))).alias("none"))


def image_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of files by their first bytes."""
    heads = ["89504E470D0A1A0A00", "FFD8FFE000", "4749463839610000", "524946460000000057454250", "0000010001002020", "3C73766720786D6C6E733D", "3C3F786D6C2076657273696F6E3D22312E30223F3E3C7376673E", "25504446"]
    head = F.element_at(F.array(*[F.lit(h) for h in heads]), (F.pmod(F.col("p_partkey"), F.lit(len(heads))) + 1).cast("int"))
    return table(spark, sf_dir, "part").groupBy(registry.image_kind(F.unhex(head)).alias("kind")).agg(F.count("*").alias("n"))


def colour_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrast of all pairs of a palette of the regions' colours; a palette is a parameter of a few hundred colours at most."""
    rows = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.element_at(F.array(*[F.lit(c) for c in ("#ffffff", "#123456", "#008f5a", "#d7263d", "#1b1b1b")]), F.col("r_regionkey").cast("int") + 1).alias("colour"))
    palette = F.array(*[F.struct(F.lit(r.k).alias("k"), F.lit(r.colour).alias("colour")) for r in collect_small(rows, 500, "colours")]).cast("array<struct<k:bigint,colour:string>>")
    pairs = rows.select(F.col("k").alias("a"), "colour", F.explode(F.filter(palette, lambda x: x["k"] > F.col("k"))).alias("other"))
    return pairs.select("a", F.col("other.k").alias("b"), F.round(registry.contrast(F.col("colour"), F.col("other.colour")), 6).alias("ratio"))


def window_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each source's window begins: its local day, or 60 days back; and whether it still has to be filled."""
    start = F.when(F.col("zone_name").isNotNull(), F.to_utc_timestamp(F.col("checked").cast("timestamp"), "Europe/Copenhagen")).otherwise(_now() - F.expr("interval 60 days"))
    return _visits(spark, sf_dir).select("id", F.unix_timestamp(start).alias("start"), F.coalesce(F.col("last") < start, F.lit(True)).alias("fill"))


def logo_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 sources with most items whose logo is due: older than 14 days, or paused and older than 7."""
    age = F.date_diff(_now().cast("date"), F.col("checked"))
    counts = table(spark, sf_dir, "candidate").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "feed_source").filter((age > 14) | ((F.col("status") == "pause") & (age > 7))).join(counts, "id", "left").fillna(0, ["n"])
    return ranking.top(rows, [F.desc("n"), F.asc("id")], 20).select("id", "n")


def address_logos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per entry the first source, by id, whose domain its host lies under, else the entry's own source."""
    domains = table(spark, sf_dir, "feed_source").select(F.col("id").alias("logo"), F.explode(registry.source_hosts(F.col("homepage"), F.col("domains"))).alias("suffix"))
    rows = table(spark, sf_dir, "raw_entry").select("ord", "source_id", urls.host_of(F.col("url")).alias("host")).distinct()
    parts = F.split("host", r"\.")
    suffixes = rows.select("ord", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))).alias("suffix"))
    best = suffixes.join(small_side(domains), "suffix").groupBy("ord").agg(F.min("logo").alias("logo"))
    return rows.join(best, "ord", "left").select("ord", F.coalesce("logo", "source_id").alias("logo")).distinct()


def kept_caches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache rows kept per source: addresses of active sources, and documents with a readable, recent time."""
    active = table(spark, sf_dir, "feed_source").filter("status = 'aktiv'").select(F.col("id").alias("source_id"))
    pages = intake.keep_referenced(table(spark, sf_dir, "raw_entry"), "source_id", small_side(active), "source_id").groupBy(F.lit("pages").alias("cache")).agg(F.countDistinct("url").alias("n"))
    at = F.try_to_timestamp("dato", F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    robots = intake.keep_recent(table(spark, sf_dir, "oda_document"), at, F.lit("2025-06-01").cast("timestamp")).groupBy(F.lit("robots").alias("cache")).agg(F.countDistinct("id").alias("n"))
    return pages.unionByName(robots)


def forgotten_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seen addresses per source and how many became candidates: the others are forgotten when a source is filled anew."""
    rows = table(spark, sf_dir, "raw_entry").select("source_id", urls.address_key(F.col("url")).alias("address")).distinct()
    known = table(spark, sf_dir, "candidate").select(urls.address_key(F.col("url")).alias("address")).distinct()
    kept = rows.join(known, "address", "left_semi").groupBy("source_id").agg(F.count("*").alias("kept"))
    return rows.groupBy("source_id").agg(F.count("*").alias("seen")).join(kept, "source_id", "left").fillna(0, ["kept"])


def source_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State per source in key order of its fields, written over only where it changed since the day it was checked."""
    rows = _c(spark, sf_dir).join(small_side(table(spark, sf_dir, "feed_source").select(F.col("id").alias("source"), "checked")), "source")
    old = rows.filter(F.to_date("first_seen") <= F.col("checked")).groupBy("source").agg(F.max("first_seen").alias("was"))
    new = rows.groupBy("source").agg(F.max("first_seen").alias("last"), F.count("*").alias("n"))
    return new.join(old, "source", "left").select("source", "n", (~F.col("last").eqNullSafe(F.col("was"))).alias("changed"))


def sweep_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every candidate's address: its id, the sender by host and the rule that holds there."""
    s = table(spark, sf_dir, "feed_source").select(F.col("id").alias("sender"), "filter_level", "status", F.explode("domains").alias("host"))
    rows = _c(spark, sf_dir).select("id", urls.item_id(F.col("url")).alias("made"), urls.host_of(F.col("url")).alias("host"))
    parts = F.split("host", r"\.")
    suffixes = rows.select("id", "made", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))).alias("host"))
    best = suffixes.join(small_side(s), "host").groupBy("id").agg(F.max_by(F.struct("sender", "filter_level", "status"), F.struct(F.length("host"), "sender")).alias("b"))
    return rows.join(best, "id", "left").select("id", "made", F.col("b.sender").alias("sender"), F.when(F.col("b.status") == "pause", "paused").otherwise(F.coalesce("b.filter_level", F.lit("unknown"))).alias("rule"))


def unknown_publishers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts without a source: distinct articles, the last three of them and the newest."""
    domains = table(spark, sf_dir, "feed_source").filter("status = 'aktiv'").select(F.explode("domains").alias("host")).distinct()
    rows = table(spark, sf_dir, "raw_entry").select(urls.host_of(F.col("url")).alias("host"), urls.address_key(F.col("url")).alias("id"), "ord").join(small_side(domains), "host", "left_anti")
    ids = rows.groupBy("host", "id").agg(F.max("ord").alias("ord"))
    last = ranking.top_per(ids, ["host"], [F.desc("ord"), F.asc("id")], 3)
    examples = last.groupBy("host").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]), ",").alias("examples"))  # three a host
    return ids.groupBy("host").agg(F.count("*").alias("n"), F.max("ord").alias("newest")).join(examples, "host")


QUERIES = {
    f.__name__: f
    for f in (
        entry_admission, age_gate, quiet_rejections, due_sources, source_plan, lookback_windows, sitemap_collect, sitemap_traversal, newest_children, sitemap_summary, day_addresses, search_addresses, wrapped_links, feed_shapes, skipped_documents,
        import_plan, source_facts, slug_texts, place_ids, populations, image_kinds, colour_pairs, window_starts, logo_queue, address_logos, kept_caches, forgotten_seen, source_states, sweep_check, unknown_publishers,
    )
}

_C = "c as (select * from candidate qualify row_number() over (partition by id order by first_seen) = 1)"
_HOST = r"regexp_replace(regexp_replace(regexp_extract(lower(trim({0})), '^https?://([^/?#]*)', 1), ':[0-9]+$', ''), '^www\.', '')"
_PLAIN_HOST = r"regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '^https?://', ''), '[:/?#].*$', ''), '^www\.', '')"
_TRACKERS = "('fbclid', 'gclid', 'ref', 'referrer', 'mc_cid', 'mc_eid')"
_ADDRESS = (
    r"regexp_replace(regexp_replace(regexp_extract(lower(regexp_extract(trim(url), '^(?i:https?)://([^/?#]*)', 1)), '^(.*)$', 1), ':(80|443)?$', ''), '^www\.', '')"
    r" || regexp_replace(regexp_extract(trim(url), '^(?i:https?)://[^/?#]*([^?#]*)', 1), '/+$', '')"
    r" || case when len(list_filter(string_split(regexp_extract(trim(url), '\?([^#]*)', 1), '&'), lambda x: x <> '' and not starts_with(lower(split_part(x, '=', 1)), 'utm_') and lower(split_part(x, '=', 1)) not in " + _TRACKERS + ")) > 0"
    r" then '?' || array_to_string(list_sort(list_filter(string_split(regexp_extract(trim(url), '\?([^#]*)', 1), '&'), lambda x: x <> '' and not starts_with(lower(split_part(x, '=', 1)), 'utm_') and lower(split_part(x, '=', 1)) not in " + _TRACKERS + ")), '&') else '' end"
)
_VISITS = "v as (select f.*, (select max(first_seen) from candidate c where c.source = f.id) as last from feed_source f)"
_SHOSTS = f"h as (select id, unnest(domains) as host from feed_source union select id, {_HOST.format('homepage')} from feed_source)"
_SLUG = "regexp_replace(regexp_replace(translate(replace(replace(replace(replace(lower(name), 'å', 'aa'), 'ø', 'oe'), 'æ', 'ae'), 'ß', 'ss'), 'äöüéèàâêëïîôûçñ', 'aoueeaaeeiioucn'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
_LUM = lambda c: "(" + " + ".join(f"{w} * (case when v[{k}] <= 0.04045 then v[{k}] / 12.92 else power((v[{k}] + 0.055) / 1.055, 2.4) end)".replace("v[", f"{c}[") for w, k in ((0.2126, 1), (0.7152, 2), (0.0722, 3))) + ")"
_N = f"timestamptz '{NOW}+00'"
ORACLE = {
    "entry_admission": r"select distinct ord, coalesce(regexp_matches(trim(url), '^(?i:https?)://[^/?#\s]') and trim(title) <> '', false) as admitted from raw_entry",
    "age_gate": rf"""with {_C}, p as (select *, case when regexp_matches(published, '^\d{{4}}-\d\d-\d\dT\d\d:\d\d:\d\dZ$') then timezone('UTC', try_strptime(published, '%Y-%m-%dT%H:%M:%SZ')) end as t from c),
        r as (select *, case when t <= first_seen + interval 2 hours then t end as u from p)
        select source, case when u is null and found_via = 'sweep' then 'undated' when u < first_seen - interval 14 days then 'old' else 'taken' end as gate, case when u is null then 'fundet' else 'kilde' end as quality, count(*) as n from r group by all""",
    "quiet_rejections": f"with {_C} select source, count(*) filter (where first_seen >= {_N} - interval 90 days) as stored, count(*) filter (where first_seen < {_N} - interval 90 days) as quiet from c where why.decision <> 'vis' group by 1",
    "due_sources": f"""with {_VISITS} select id, coalesce(epoch({_N}) - floor(epoch(last)) >= (case when status = 'pause' then 24 when method = 'rss' then 1 when method = 'search' then 2 else 6 end) * 3600 - 1800, true) as due from v""",
    "source_plan": f"with {_VISITS} select id, row_number() over (order by method = 'search', status = 'pause', coalesce(epoch_us(last), 0), id) - 1 as position from v",
    "lookback_windows": """with l as (select source, max(cast(timezone('UTC', first_seen) as date)) as last from candidate join feed_source f on f.id = source where cast(timezone('UTC', first_seen) as date) <= checked group by 1)
        select id, cast(coalesce(greatest(3, least(14, date_diff('day', last, checked) + 1)), 14) as int) as days from feed_source left join l on l.source = id""",
    "sitemap_collect": f"""with {_SHOSTS}, p as (select source, url, first_seen, {_ADDRESS} as address, {_HOST.format('url')} as host from candidate), s as (select distinct {_ADDRESS} as address from raw_entry),
        k as (select p.source, address, max(first_seen) as lastmod from p join feed_source f on f.id = p.source where regexp_matches(url, '/(?:nyheder|nyhed|artikel)') and exists (select 1 from h where h.id = p.source and (p.host = h.host or ends_with(p.host, '.' || h.host)))
        and first_seen >= timezone('UTC', cast(checked as timestamp) - interval 120 days) and address not in (select address from s) group by 1, 2),
        r as (select *, cast(row_number() over (partition by source order by lastmod desc, address) as int) as rank from k) select source, address, rank from r where rank <= 15""",
    "sitemap_traversal": f"""with {_SHOSTS}, r as (select source, url as loc, source || '.example' as host, strftime(timezone('UTC', first_seen), '%Y-%m') as m, first_seen from candidate),
        k as (select source, m, row_number() over (partition by source order by max(first_seen) desc, m desc) as n from r where exists (select 1 from h where h.id = source and (r.host = h.host or ends_with(r.host, '.' || h.host))) group by 1, 2)
        select source, count(distinct loc) as n from r join k using (source, m) where k.n <= 3 group by 1""",
    "newest_children": rf"""with {_C}, d as (select source, id, date_trunc('month', timezone('UTC', first_seen)) as m, regexp_extract(url, '/((?:19|20)\d{{2}})[/-](\d{{1,2}})[/-](\d{{1,2}})(?:[/-]|$)', ['y', 'm', 'd']) as u from c),
        e as (select *, try_cast(u.y || '-' || lpad(u.m, 2, '0') || '-' || lpad(u.d, 2, '0') as date) as url_date from d),
        r as (select source, id as position, cast(url_date as varchar) as url_date, cast(row_number() over (partition by source order by m desc, url_date desc nulls last, id desc) as int) as rank from e) select * from r where rank <= 2""",
    "sitemap_summary": "select source, count(*) as n, max(strftime(timezone('UTC', first_seen), '%Y-%m-%d')) as newest from candidate group by 1",
    "day_addresses": """with d as (select id, homepage, method, unnest(case when method = 'html' then range(0, date_diff('day', checked, date '2026-10-31') + 1) else [0] end) as k from feed_source)
        select id, cast(k as int) as position, homepage || case when method = 'html' then '/arkiv/' || strftime(date '2026-10-31' - cast(k as int), '%Y-%m-%d') else '/arkiv' end as url from d""",
    "search_addresses": """with q as (select unnest(['affald', 'gr%C3%B8n']) as q), t as (select * from (values ('https://news.google.com/rss/search?q=', '', 'google'), ('https://www.bing.com/news/search?q=', '&format=rss', 'bing'), ('https://find.example/?q=', '', 'other')) v(a, b, engine))
        select id, a || q || b as url, engine from feed_source, q, t where method = 'search'""",
    "wrapped_links": rf"select distinct ord, case when url is null then null when starts_with(url, 'http') then url else 'https://www.bing.com/news/apiclick.aspx?ref=x&url=' || url_encode(url) || '&c=1' end as bing, nullif(regexp_extract(url, '{_WEB}'), '') as google from raw_entry",
    "feed_shapes": f"with {_C} select id, found_via = 'feed' as is_feed, case when found_via = 'feed' then trim(url) end as link, case when found_via = 'feed' then strftime(timezone('UTC', first_seen), '%Y-%m-%d') end as published from c",
    "skipped_documents": """select case when offentlighedskode <> 'O' then 'not public' when dokumenttype = 'Henvendelse' then 'type' when filurl is null then 'no file' else 'kept' end as reason, count(*) as n, count(distinct id) as ids from oda_document group by 1""",
    "import_plan": f"""with {_SHOSTS}, k as (select host, max(status) as status from h join feed_source using (id) group by 1), r as (select distinct ord, {_PLAIN_HOST.format('publisher_domain')} as host from raw_entry where publisher_domain is not null),
        f as (select *, min(ord) over (partition by host) as first from r) select ord, f.host, case when ord > first then 'repeated' when status = 'pause' then 'paused' when status is not null then 'known' else 'new' end as state from f left join k using (host)""",
    "source_facts": rf"""with d as (select *, {_HOST.format('homepage')} as home, list_transform(domains, lambda d: {_PLAIN_HOST.format('d')}) as ds from feed_source), e as (select *, list_concat([home], list_filter(ds, lambda x: x <> home)) as hosts, trim(regexp_replace(name, '\s*\([^)]*\)', '', 'g')) as bare from d)
        select id, array_to_string(hosts, ' ') as hosts, array_to_string(list_filter(domains, lambda x: x <> home and not ends_with(x, '.' || home) and not ends_with(home, '.' || x)), ' ') as other,
        array_to_string(list_concat(list_concat([name], case when bare <> name then [bare] else [] end), list_concat(regexp_extract_all(name, '\(([^)]+)\)', 1), hosts)), '|') as names,
        array_to_string(list_transform(['/rss', '/feed', '/rss.xml', '/feed.xml', '/atom.xml', '/nyheder/rss'], lambda p: regexp_replace(homepage, '/+$', '') || p), ' ') as feeds from e""",
    "slug_texts": r"select distinct ord, trim(regexp_replace(url_decode(regexp_extract(url, '^(?i:https?)://[^/?#]*([^?#]*)', 1)), '[^\p{L}\p{N}]+', ' ', 'g')) as words from raw_entry",
    "place_ids": f"""with s as (select id, {_SLUG} as s from feed_source) select id, 'k:' || s as place, case when s in ({', '.join(f"'{c}'" for c in CATEGORIES)}) then s else list_filter([{', '.join(f"'{c}'" for c in CATEGORIES)}], lambda c: list_contains(string_split(s, '-'), c))[1] end as category from s""",
    "populations": "select c_custkey, cast(trunc(cast(c_acctbal as decimal(18, 2))) as bigint) as n, cast(null as bigint) as none from customer",
    "image_kinds": "select ['png', 'jpg', 'gif', 'webp', 'ico', 'svg', 'svg', null][cast(p_partkey % 8 as int) + 1] as kind, count(*) as n from part group by 1",
    "colour_pairs": f"""with p as (select r_regionkey as k, [[1.0, 1.0, 1.0], [18 / 255, 52 / 255, 86 / 255], [0.0, 143 / 255, 90 / 255], [215 / 255, 38 / 255, 61 / 255], [27 / 255, 27 / 255, 27 / 255]][cast(r_regionkey as int) + 1] as v from region),
        l as (select k, {_LUM('v')} as y from p) select a.k as a, b.k as b, round((greatest(a.y, b.y) + 0.05) / (least(a.y, b.y) + 0.05), 6) as ratio from l a join l b on a.k < b.k""",
    "window_starts": f"""with {_VISITS}, s as (select *, case when zone_name is not null then timezone('Europe/Copenhagen', cast(checked as timestamp)) else {_N} - interval 60 days end as st from v) select id, cast(epoch(st) as bigint) as start, coalesce(last < st, true) as fill from s""",
    "logo_queue": f"""select f.id, (select count(*) from candidate c where c.source = f.id) as n from feed_source f where date_diff('day', checked, date '2026-11-01') > 14 or (status = 'pause' and date_diff('day', checked, date '2026-11-01') > 7) order by n desc, id limit 20""",
    "address_logos": f"""with {_SHOSTS}, r as (select distinct ord, source_id, {_HOST.format('url')} as host from raw_entry) select distinct ord, coalesce((select min(h.id) from h where r.host = h.host or ends_with(r.host, '.' || h.host)), source_id) as logo from r""",
    "kept_caches": """select 'pages' as cache, count(distinct url) as n from raw_entry where source_id in (select id from feed_source where status = 'aktiv')
        union all select 'robots', count(distinct id) from oda_document where try_strptime(dato, '%Y-%m-%dT%H:%M:%S') >= timestamp '2025-06-01'""",
    "source_states": f"""with {_C}, r as (select c.*, checked from c join feed_source f on f.id = c.source) select source, count(*) as n, max(first_seen) is distinct from max(first_seen) filter (where cast(timezone('UTC', first_seen) as date) <= checked) as changed from r group by 1""",
    "sweep_check": f"""with {_C}, d as (select id as sender, filter_level, status, unnest(domains) as dom from feed_source), r as (select id, {_HOST.format('url')} as host from c),
        b as (select r.id, arg_max(d, (length(dom), sender)) as b from r join d on host = dom or ends_with(host, '.' || dom) group by 1)
        select r.id, r.id as made, b.b.sender as sender, case when b.b.status = 'pause' then 'paused' else coalesce(b.b.filter_level, 'unknown') end as rule from r left join b using (id)""",
    "forgotten_seen": f"""with r as (select distinct source_id, {_ADDRESS} as address from raw_entry), k as (select distinct {_ADDRESS} as address from candidate) select source_id, count(*) as seen, count(*) filter (where address in (select address from k)) as kept from r group by 1""",
    "unknown_publishers": f"""with d as (select distinct unnest(domains) as host from feed_source where status = 'aktiv'), i as (select {_HOST.format('url')} as host, {_ADDRESS} as id, max(ord) as ord from raw_entry group by 1, 2),
        r as (select *, row_number() over (partition by host order by ord desc, id) as k from i where host not in (select host from d)) select host, count(*) as n, max(ord) as newest, string_agg(id, ',' order by k) filter (where k <= 3) as examples from r group by 1""",
}
