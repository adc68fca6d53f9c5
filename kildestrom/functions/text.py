"""Text functions as column expressions; Python only where Spark has no built-in (entities, Unicode forms, word runs)."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NOT_WORD = r"[^\p{L}\p{N}]+"
# Letters that no decomposition folds, in the two spellings that searches use.
LONG_FOLD = [("å", "aa"), ("ø", "oe"), ("æ", "ae"), ("ß", "ss")]
SHORT_FOLD = [("å", "a"), ("ø", "o"), ("æ", "ae"), ("ß", "ss")]


@F.pandas_udf(T.StringType())
def _unescape(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: t if t is None else unicodedata.normalize("NFC", html.unescape(html.unescape(t))))


@F.pandas_udf(T.StringType())
def _without_accents(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: t if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    """Lower-case words in order; null gives none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Words between white space; 0 for null and blank."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+")))


def truncate(text: Column, most: int) -> Column:
    """Cut at the last blank in the second half of the limit, without trailing signs, and mark the cut with …."""
    t = strip(text)
    head = F.substring(t, 1, most - 1)
    at_word = F.regexp_extract(head, r"^([\s\S]*)\s\S*$", 1)
    mid = F.substring(t, most, 1).rlike(r"\S") & (F.length(at_word) >= most // 2)
    cut = F.regexp_replace(F.when(mid, at_word).otherwise(head), r"[ ,;:–—·|/-]+$", "")
    return F.when(F.length(t) > most, F.concat(cut, F.lit("…"))).otherwise(t)


def clean_text(text: Column, most: int = 300) -> Column:
    """Without scripts, tags, entities, invisible characters and double blanks, cut at `most`; null stays null."""
    t = F.regexp_replace(text, r"<!\[CDATA\[([\s\S]*?)\]\]>", "$1")
    t = F.regexp_replace(t, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"<[^<>]*>", " ")
    odd = t.contains("&") | t.rlike(r"[^\x00-\xff–—‘’“”…€]")
    t = F.coalesce(_unescape(F.when(odd, t)), t)
    t = F.regexp_replace(t, r"[­​-‏⁠﻿]", "")
    return truncate(F.trim(F.regexp_replace(t, r"(?U)[\s ]+", " ")), most)


def title_key(title: Column) -> Column:
    """Title for comparison: lower-case words with single blanks."""
    return F.array_join(words(title), " ")


_TAIL = r"^([\s\S]*\S)\s+[|–—-]\s+(\S[\s\S]*)$"


def name_tail(title: Column) -> Column:
    """What stands behind the last ' | ', ' - ' or ' – ' of a title; empty if there is none."""
    return F.regexp_extract(title, _TAIL, 2)


def name_head(title: Column) -> Column:
    """What stands before it."""
    return F.regexp_extract(title, _TAIL, 1)


def strip_name_tail(title: Column, names: Column) -> Column:
    """Without a last ' | X', ' - X' or ' – X' whose words are one of `names` (an array of title keys)."""
    known = F.array_contains(names, title_key(name_tail(title))) & (name_tail(title) != "")
    return F.when(known, name_head(title)).otherwise(title)


def _folded(text: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def matches_name(text: Column, names: Column) -> Column:
    """Whether the letters and digits of a text are those of one of `names`; an empty text is no name."""
    key = _folded(text)
    return F.exists(names, lambda n: key == _folded(n)) & (key != "")


def _tells_name(text: Column, names: Column) -> Column:
    """The same, or one within the other with three letters or digits at least."""
    key = _folded(text)
    return F.exists(names, lambda n: (key == _folded(n)) | ((F.length(key) >= 3) & F.contains(_folded(n), key)) | ((F.length(_folded(n)) >= 3) & F.contains(key, _folded(n)))) & (key != "")


def _without_site_tail(title: Column, names: Column) -> Column:
    tail, head = name_tail(title), name_head(title)
    bar = F.regexp_extract(title, r"^[\s\S]*\S\s+([|–—-])\s+\S[\s\S]*$", 1) == "|"
    n = F.size(F.split(F.trim(tail), r"\s+"))
    domain = tail.rlike(r"^[\p{L}\p{N}-]+(\.[\p{L}\p{N}-]+)+$")
    proper = (n <= 4) & tail.rlike(r"^[\p{Lu}\p{N}]\S*(\s+[\p{Lu}\p{N}]\S*)*$")
    drop = F.when(_tells_name(tail, names), True).when(F.length(tail) > 40, False).when(bar, n <= 5).otherwise(domain | proper)
    return F.when((tail != "") & (F.size(F.split(F.trim(head), r"\s+")) >= 2) & drop, head).otherwise(title)


def strip_site_tail(title: Column, names: Column) -> Column:
    """Without up to two tails that name a site: a known name, up to five words behind a bar, a domain or a few capitalised words.

    At least two words remain; null stays null.
    """
    return _without_site_tail(_without_site_tail(title, names), names)


def strip_publisher(title: Column, publisher: Column) -> Column:
    """Without ' - Publisher' at the end, whatever the case and the blanks; nulls change nothing."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    known = (plain(name_tail(title)) == plain(publisher)) & (plain(publisher) != "")
    return F.when(F.coalesce(known, F.lit(False)), name_head(title)).otherwise(title)


@F.pandas_udf(T.StringType())
def _compatible(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t).casefold())


def normal_title(title: Column, names: Column) -> Column:
    """Title for comparison: compatibility form, without tails of sites, without case, signs as blanks; null counts as empty.

    Only titles beyond plain Latin reach Python.
    """
    bare = strip_site_tail(F.coalesce(title, F.lit("")), names)
    plain = F.coalesce(_compatible(F.when(bare.rlike(r"[^\x00-\x7eæøåäöéÆØÅÄÖÉ–—‘’“”»«…]"), bare)), F.lower(bare))
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))


def strip_prefixes(title: Column, prefixes: list[str]) -> Column:
    """Without the first prefix that fits, if a word remains."""
    out = title
    for p in reversed(prefixes):
        rest = F.trim(F.substr(title, F.lit(len(p) + 1)))
        out = F.when(F.lower(title).startswith(p.lower()) & rest.rlike(r"[\p{L}\p{N}]"), rest).otherwise(out)
    return out


def slug(text: Column) -> Column:
    """Lower-case letters and digits joined by hyphens, å ø æ spelt out."""
    t = F.lower(text)
    for a, b in LONG_FOLD:
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.translate(t, "äöüéèàâêëïîôûçñ", "aoueeaaeeiioucn")
    return F.regexp_replace(F.regexp_replace(t, "[^a-z0-9]+", "-"), "^-|-$", "")


def fold(text: Column, pairs: list[tuple[str, str]] = SHORT_FOLD) -> Column:
    """Lower case without accents; å ø æ ß by `pairs`."""
    t = F.lower(text)
    for a, b in pairs:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.coalesce(_without_accents(F.when(t.rlike(r"[^\x00-\x7f]"), t)), t)


def short_name(name: Column) -> Column:
    """An acronym in parentheses of at most six capitals, else the name before them."""
    acronym = F.regexp_extract(name, r"\(([\p{Lu}\p{N}]{2,6})\)", 1)
    return F.when(acronym != "", acronym).otherwise(F.trim(F.regexp_replace(name, r"\s*\([^)]*\)", "")))


def grams(text: Column, n: int) -> Column:
    """Distinct runs of n words, each joined by blanks."""
    w = words(text)
    starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda k: F.array_join(F.slice(w, k, n), " ")))


def copied(text: Column, original: Column, run: int = 5, share: float = 0.5) -> Column:
    """Whether text repeats more than `run` words in a row, or more than `share` of its three-word runs if it has four."""
    own = grams(text, 3)
    common = F.size(F.array_intersect(own, grams(original, 3)))
    return F.arrays_overlap(grams(text, run + 1), grams(original, run + 1)) | ((F.size(own) >= 4) & (common > share * F.size(own)))


@F.pandas_udf(T.IntegerType())
def longest_shared_run(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest run of words in both texts."""

    def one(x: list[str] | None, y: list[str] | None) -> int:
        best, before = 0, {}
        for w in x if x is not None else ():
            now = {}
            for k, v in enumerate(y if y is not None else ()):
                if v == w:
                    now[k] = before.get(k - 1, 0) + 1
                    best = max(best, now[k])
            before = now
        return best

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])
