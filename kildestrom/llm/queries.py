"""Queries of the training-data problems tagged llm, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kildestrom.llm.history import RunStore, entries, take_in_order
from kildestrom.llm.lookalikes import bigram_model, disguised_fields
from kildestrom.llm.mixing import mixture, mixture_report
from kildestrom.llm.neardup import group_pairs, near_groups
from kildestrom.llm.packing import pack, packing_report
from kildestrom.llm.quality import structural_kinds, text_statistics
from kildestrom.llm.tokens import token_count
from kildestrom.llm.truncation import judged, source_shares
from kildestrom.session import collect_small, cut, table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate fields that hold other characters than they show."""
    return p5_canonical(spark, sf_dir).select("id", "field").distinct()


def p5_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fields with their text brought to one form."""
    rows = table(spark, sf_dir, "candidate").select("id", "title", "teaser")
    return disguised_fields(rows, "id", ["title", "teaser"], bigram_model(rows, ["title", "teaser"]))


QUERIES = {"p5_found": p5_found, "p5_canonical": p5_canonical}
# what counts as a disguise, written out in classes of characters
_HIDDEN = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{2800}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{E0000}-\x{E0FFF}]"
_BLANKS = r"[\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_STYLED = r"[\x{FF01}-\x{FFEF}\x{1D400}-\x{1D7FF}\x{2460}-\x{24FF}\x{FB00}-\x{FB06}\x{0132}\x{0133}\x{01C4}-\x{01CC}\x{01F1}-\x{01F3}\x{2102}-\x{2115}\x{2119}-\x{211D}\x{2124}-\x{2131}\x{2133}\x{1F130}-\x{1F189}\x{02B0}-\x{02B8}\x{1D2C}-\x{1D6A}\x{2090}-\x{209C}\x{2071}\x{207F}]"
_MIXED = r"\p{Latin}[\p{L}\p{N}\p{M}]*[\p{Greek}\p{Cyrillic}]|[\p{Greek}\p{Cyrillic}][\p{L}\p{N}\p{M}]*\p{Latin}"
ORACLE: dict[str, str] = {
    "p5_found": rf"""with f as (select id, 'title' as field, title as t from candidate union all select id, 'teaser', teaser from candidate)
        select distinct id, field from f where regexp_matches(t, '{_HIDDEN}|{_BLANKS}|{_STYLED}|[\p{{L}}\p{{N}}]\p{{Mn}}|{_MIXED}')""",
}


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate with its group of near-copies and the group's size."""
    groups = near_groups(table(spark, sf_dir, "candidate"), "id", ["title", "teaser"])
    sizes = groups.groupBy("group").agg(F.min("key").alias("group_id"), F.countDistinct("key").alias("n_ids"))
    return groups.join(sizes, "group").select(F.col("key").alias("id"), "group_id", "n_ids").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of candidates in one group."""
    return group_pairs(near_groups(table(spark, sf_dir, "candidate"), "id", ["title", "teaser"]))


QUERIES |= {"p2_found": p2_found, "p2_groups": p2_groups}


def source_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and domains of the sources, one a row."""
    sources = table(spark, sf_dir, "feed_source")
    return sources.select("name").unionByName(sources.select(F.explode("domains").alias("name"))).filter("name is not null").distinct()


#: How many intakes the raw entries come in: consecutive batches are taken together.
INTAKES = 2


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw entries that bring nothing new; the accepted candidates are the first run of the history.

    Batches are taken in the order of `ord`, several consecutive ones at a time, and are history for the next.
    """
    names = source_names(spark, sf_dir)
    past, new = table(spark, sf_dir, "candidate"), table(spark, sf_dir, "raw_entry").filter("ord is not null")
    store = RunStore(spark)
    store.add(cut(entries(past, F.lit(-1), F.col("url"), F.col("title"), names), "entries"))
    ends = [r.last for r in new.groupBy("batch").agg(F.max("ord").alias("last")).orderBy("last").collect()]  # a row a batch
    cuts = sorted({ends[(k + 1) * len(ends) // INTAKES - 1] for k in range(INTAKES)} | {ends[-1]}) if ends else []
    found = take_in_order(store, new, [(low + 1, high) for low, high in zip([-1, *cuts], cuts)], names)
    store.close()
    return found


QUERIES |= {"p3_found": p3_found}


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose teaser was cut off."""
    return judged(table(spark, sf_dir, "candidate"), "id", "source", "teaser").filter("cut").select(F.col("key").alias("id")).distinct()


def p6_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source cuts its teasers off."""
    return source_shares(judged(table(spark, sf_dir, "candidate"), "id", "source", "teaser"))


QUERIES |= {"p6_found": p6_found, "p6_sources": p6_sources}


#: Common words that are shipped with the job.
MOST_WORDS = 10_000


def _common_words(spark: SparkSession, sf_dir: str) -> dict[str, list[str]]:
    """The table of common words per language, a few hundred at most."""
    rows = table(spark, sf_dir, "common_word").select("lang", F.lower("word").alias("word")).filter("lang is not null and word is not null").distinct()
    out: dict[str, list[str]] = {}
    for r in sorted(collect_small(rows, MOST_WORDS, "common words")):
        out.setdefault(r.lang, []).append(r.word)
    return out


def p9_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its structural kind and its shares of characters by kind."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return structural_kinds(docs, "doc_id", "text", "lang", frozenset(w for words in _common_words(spark, sf_dir).values() for w in words)).withColumnRenamed("key", "doc_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are lists, tables or junk."""
    return p9_kinds(spark, sf_dir).filter("kind <> 'prose'").select("doc_id", "kind")


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basic text statistics of every document; common words are those of its own language."""
    common = F.array().cast("array<string>")
    for lang, words in _common_words(spark, sf_dir).items():
        common = F.when(F.col("lang") == lang, F.array(*[F.lit(w) for w in words])).otherwise(common)
    return table(spark, sf_dir, "documents").select("doc_id", *text_statistics(F.col("text"), common))


QUERIES |= {"p9_found": p9_found, "p9_kinds": p9_kinds, "p9_statistics": p9_statistics}
ORACLE |= {
    "p9_statistics": r"""with d as (select doc_id, lang, coalesce(text, '') as t from documents),
        w as (select *, list_filter(regexp_split_to_array(t, '[^\p{L}\p{N}]+'), lambda x: x <> '') as words, list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '') as lines from d),
        c as (select lang, list(distinct lower(word)) as common from common_word group by 1)
        select doc_id, cast(len(words) as bigint) as n_words,
        round(case when len(words) > 0 then length(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')) / len(words) else 0 end, 6) as mean_word_length,
        round(case when length(t) > 0 then length(regexp_replace(t, '[\p{L}\p{N}\s]', '', 'g')) / length(t) else 0 end, 6) as symbol_ratio,
        cast(len(lines) as bigint) as n_lines,
        round(case when len(lines) > 0 then len(list_filter(lines, lambda x: regexp_matches(x, '[.?!:;,»”]\s*$'))) / len(lines) else 0 end, 6) as stopped_lines,
        round(case when len(words) > 0 then len(list_filter(words, lambda x: list_contains(coalesce(common, []), lower(x)))) / len(words) else 0 end, 6) as common_words
        from w left join c using (lang)""",
}


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their size in tokens, written once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", token_count(F.col("text")).alias("n_tokens"))
    return cut(docs, "tokens")


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in containers of every capacity."""
    return pack(_sized(spark, sf_dir), table(spark, sf_dir, "container_spec"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return packing_report(p7_packed(spark, sf_dir))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of every mixture with their copies."""
    return mixture(_sized(spark, sf_dir), table(spark, sf_dir, "mix_target"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached shares."""
    return mixture_report(p8_mixture(spark, sf_dir), table(spark, sf_dir, "mix_target"))


QUERIES |= {"p7_packed": p7_packed, "p7_report": p7_report, "p8_mixture": p8_mixture, "p8_shares": p8_shares}
