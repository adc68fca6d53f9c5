"""A small language of word patterns, compiled to regular expressions that need no flags.

A pattern matches whole words; * stands for any letters, a blank for white space. With * at both ends it matches
within words. A capital at its start makes that letter (and only it) case-sensitive.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_IN, _OUT = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"


def compile_pattern(pattern: str, groups: bool = False) -> str:
    """The regular expression of a pattern, understood alike by Java and RE2; groups captures what surrounds it."""
    body = pattern.strip()
    out = []
    for k, ch in enumerate(body):
        if ch == "*":
            out.append(_IN + "*")
        elif ch.isspace():
            if out[-1] != r"\s+":
                out.append(r"\s+")
        elif ch.isalpha() and ch.lower() != ch.upper() and len(ch.upper()) == 1:
            out.append(ch if k == 0 and ch.isupper() else f"[{ch.lower()}{ch.upper()}]")
        else:
            out.append(re.escape(ch))
    open_, close = ("(", ")") if groups else ("(?:", ")")
    both = body.startswith("*") and body.endswith("*")
    return ("" if body.startswith("*") else f"{open_}^|{_OUT}{close}") + "".join(out) + ("" if both else f"{open_}$|{_OUT}{close}")


def _may_match(text: Column, pattern: str) -> Column:
    """Whether the longest word part of a pattern is in the text at all: a plain search before the regular expression."""
    stem = max(re.split(r"[*\s]+", pattern.strip()), key=len)
    if len(stem) < 3 or not all(len(c.lower()) == len(c.upper()) == 1 and c.upper().lower() == c.lower() for c in stem):
        return F.lit(True)
    return F.lower(text).contains(stem.lower())


def hits(text: Column, patterns: list[str]) -> Column:
    """Patterns that match, in their order; each stays a literal expression. Null text has none."""
    return F.array_compact(F.array(*[F.when(_may_match(text, p) & text.rlike(compile_pattern(p)), F.lit(p)) for p in dict.fromkeys(patterns)]))


def mask(text: Column, patterns: list[str]) -> Column:
    """The text with every match replaced by a blank."""
    for p in patterns:
        text = F.regexp_replace(text, compile_pattern(p), " ")
    return text


def score(title: Column, teaser: Column, strong: list[str], weak: list[str]) -> Column:
    """struct<score, in_title, in_teaser, weak>: 4 a strong hit in the title, 2 in the teaser up to 6, 1 a weak one up to 2.

    Weak words are sought where no strong one stood, and count only beside another hit, in pairs or in the title.
    """
    title, teaser = F.coalesce(title, F.lit("")), F.coalesce(teaser, F.lit(""))
    a, b = F.size(hits(title, strong)), F.size(hits(teaser, strong))
    weak_title, weak_teaser = hits(mask(title, strong), weak), hits(mask(teaser, strong), weak)
    w = F.size(F.array_union(weak_title, weak_teaser))
    counts = (a + b > 0) | (w >= 2) | (F.size(weak_title) > 0)
    points = 4 * a + F.least(F.lit(6), 2 * b) + F.when(counts, F.least(F.lit(2), w)).otherwise(0)
    return F.struct(points.alias("score"), a.alias("in_title"), b.alias("in_teaser"), w.alias("weak"))
