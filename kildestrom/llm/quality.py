"""Text statistics per document, and documents that are lists, tables or junk rather than prose.

A document is divided into segments of lines alike in holding function words. Each segment's distribution over
function words and character classes is compared with profiles by Jensen-Shannon divergence, which alone decides: a
segment takes the kind of its nearest profile, and a document the kind that holds most of its characters. Prose
profiles are learned per language and structural profiles per kind from all documents, as means of the segments that
are nearest to them; they start from segments with function words and from given shares.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kildestrom.llm.lookalikes import _CODE, _SIZE, bigram_model
from kildestrom.session import collect_small, cut

KINDS = ["prose", "list", "table", "junk"]
CLASSES = ["function words", "letters", "odd letters", "digits", "blanks", "sentence signs", "cell marks", "symbols", "line ends", "repeated lines", "aligned rows"]
# Where structural profiles start: shares of the CLASSES but the last, and the share of aligned rows; a kind may have several.
PROFILES = [
    ("list", 0.0, [0.005, 0.80, 0.04, 0.005, 0.04, 0.02, 0.004, 0.03, 0.06, 0.0]),
    ("list", 0.0, [0.005, 0.82, 0.04, 0.005, 0.06, 0.01, 0.0, 0.01, 0.06, 0.0]),
    ("list", 0.0, [0.005, 0.80, 0.04, 0.01, 0.05, 0.01, 0.05, 0.03, 0.005, 0.0]),
    ("table", 0.33, [0.002, 0.55, 0.04, 0.16, 0.02, 0.02, 0.16, 0.01, 0.05, 0.0]),
    ("table", 0.33, [0.002, 0.78, 0.04, 0.02, 0.0, 0.0, 0.10, 0.01, 0.05, 0.0]),
    ("table", 0.33, [0.002, 0.40, 0.03, 0.12, 0.02, 0.02, 0.38, 0.0, 0.04, 0.0]),
    ("table", 0.33, [0.002, 0.50, 0.03, 0.14, 0.18, 0.01, 0.09, 0.02, 0.04, 0.0]),
    ("table", 0.25, [0.002, 0.40, 0.03, 0.12, 0.02, 0.02, 0.38, 0.0, 0.04, 0.0]),
    ("junk", 0.0, [0.0, 0.12, 0.60, 0.15, 0.0, 0.0, 0.0, 0.03, 0.01, 0.0]),
    ("junk", 0.0, [0.0, 0.28, 0.44, 0.0, 0.14, 0.0, 0.0, 0.0, 0.0, 0.0]),
    ("junk", 0.0, [0.01, 0.02, 0.01, 0.03, 0.08, 0.02, 0.14, 0.66, 0.03, 0.0]),
    ("junk", 0.0, [0.01, 0.40, 0.08, 0.12, 0.05, 0.05, 0.03, 0.28, 0.0, 0.0]),
    ("junk", 0.33, [0.0, 0.12, 0.10, 0.26, 0.20, 0.24, 0.04, 0.0, 0.03, 0.0]),
    ("junk", 0.0, [0.0, 0.12, 0.10, 0.26, 0.20, 0.24, 0.04, 0.0, 0.03, 0.0]),
    ("junk", 0.0, [0.03, 0.38, 0.10, 0.11, 0.02, 0.03, 0.05, 0.25, 0.03, 0.0]),
    ("junk", 0.0, [0.02, 0.08, 0.01, 0.0, 0.05, 0.0, 0.0, 0.0, 0.12, 0.75]),
]
_WORD = re.compile(r"[^\W\d_]+")
_BULLET = re.compile(r"^\s*(?:[-–—*•·▪◦○●☐☑✓→o]|\(?\d{1,3}[.)]|\(?[a-zæøå][.)])\s+")
_CELLS = re.compile(r"\s*[|·•›>/]\s+|\s{2,}")
_LETTER, _UPPER, _DIGIT, _BLANK, _STOP, _CELL, _SYMBOL, _LINE, _COMMA = range(9)
_PROSE_SHARE = 0.055


def _class_table() -> np.ndarray:
    table = np.full(0x10000, _SYMBOL, "int8")
    for k in range(0x10000):
        if 0xD800 <= k < 0xE000:
            continue
        ch = chr(k)
        table[k] = (
            _UPPER if ch.isupper() else _LETTER if ch.isalpha() else _DIGIT if ch.isdigit() else _LINE if ch in "\n\r" else _CELL if ch in "|;\t" else _BLANK if ch.isspace() else _STOP if ch in ".?!:»«”“\"'()–" else _COMMA if ch == "," else _SYMBOL
        )
    return table


_CLASS = _class_table()


_CODE_SIGNS = re.compile(r"[{}<>=]")
_QUOTED = re.compile(r'"[^"\n]*"')
_GAP = re.compile(r"\S(?: {2,}|\t)\s*(?=\S)")


def _columns(line: str) -> tuple[str, int]:
    """The cell mark of a line and how often it stands: ('', 0) if it has none."""
    if _CODE_SIGNS.search(line):
        return "", 0
    if line.count("|") > 1:
        return "|", line.count("|")
    if "\t" in line.strip():
        return "\t", line.rstrip("\r").count("\t")
    bare = _QUOTED.sub("q", line.strip().rstrip(";,")) if '"' in line else line.strip()
    if n := bare.count(";") - bare.count("; ") - bare.endswith(";"):
        return ";", n
    if n := bare.count(",") - bare.count(", ") - bare.endswith(","):
        return ",", n
    return ("gap", 1) if _GAP.search(line) else ("", 0)


def segments(text: str, common: frozenset[str]) -> list[tuple[int, int, int, int, int, int]]:
    """Runs of lines of one sort: (start, end, characters of function words, of repeated short lines and of aligned rows, sort).

    Sort 1 has lines with function words, sort 0 others.
    """
    lines, start = [], 0
    for line in text.split("\n"):
        lines.append((start, line))
        start += len(line) + 1
    stripped = [line.strip() for _, line in lines]
    times = Counter(stripped) if len(lines) >= 6 else {}
    rows = []  # start, end, function characters, repeated characters, sort
    for (at, line), bare in zip(lines, stripped, strict=True):
        if not bare:
            rows.append((at, at + len(line) + 1, 0, 0, -1))
            continue
        words = _WORD.findall(line)
        known = [len(w) for w in words if w.lower() in common]
        function = sum(known)
        repeated = len(bare) if len(words) <= 3 and len(bare) <= 24 and times and times[bare] >= 2 and any(map(str.isalpha, bare)) else 0
        if not repeated and len(cells := _CELLS.split(bare)) >= 6 and len({c for c in cells if c}) < 0.7 * len(cells) and len(bare) < 20 * len(cells) and len(words) >= len(cells) / 2:
            repeated = len(bare)  # the words of a menu on one line
        often = function >= _PROSE_SHARE * len(bare) and len(words) >= 3 or known and len(words) >= 6
        prose = not repeated and often and sum(map(str.isdigit, bare)) < 0.25 * len(bare)
        rows.append((at, at + len(line) + 1, 0 if repeated else function, repeated, int(bool(prose))))
    sorts = [r[4] for r in rows]
    n = len(sorts)
    for k in range(n):  # a line of wrapped prose may lack function words
        if sorts[k] == 0 and not rows[k][3] and k and sorts[k - 1] == 1 and not _BULLET.match(lines[k][1]) and not _BULLET.match(lines[k - 1][1]):
            if k + 1 == n or sorts[k + 1] != 0 or (k + 2 < n and sorts[k + 2] == 1 and sum(1 for j in range(max(0, k - 4), k) if sorts[j] == 1) >= 2):
                if not _STOPS.search(stripped[k - 1]) or sorts[k - 1] == 1 and _STOPS.search(stripped[k]):
                    sorts[k] = 1
    columns = [_columns(lines[k][1]) if sorts[k] == 0 and not rows[k][3] else ("", 0) for k in range(n)]
    out: list[list[int]] = []
    for k, ((at, end, function, repeated, _), sort) in enumerate(zip(rows, sorts, strict=True)):
        if sort < 0:
            continue
        even = columns[k][1] and (k and columns[k - 1][0] == columns[k][0] and abs(columns[k - 1][1] - columns[k][1]) <= 1 or k + 1 < n and columns[k + 1][0] == columns[k][0] and abs(columns[k + 1][1] - columns[k][1]) <= 1)
        aligned = end - at if even else 0
        if out and out[-1][5] == sort:
            last = out[-1]
            last[1], last[2], last[3], last[4] = end, last[2] + function, last[3] + repeated, last[4] + aligned
        else:
            out.append([at, end, function, repeated, aligned, sort])
    return [(a, min(b, len(text)), f, r, x, s) for a, b, f, r, x, s in out]


_STOPS = re.compile(r"[.?!][»”\"')]*$")


def _distributions(texts: list[str], common: frozenset[str], rare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all segments of a batch: document index, characters that aren't blank, distribution over CLASSES, sort."""
    doc, bounds, extra = [], [], []
    offset = 0
    for k, t in enumerate(texts):
        for a, b, f, r, x, sort in segments(t, common):
            doc.append(k)
            bounds.append((offset + a, offset + b))
            extra.append((f, r, x / 2, sort))
        offset += len(t) + 1
    if not doc:
        return np.zeros(0, "int64"), np.zeros(0), np.zeros((0, len(CLASSES))), np.zeros(0)
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    low = np.where(points < 0x10000, points, 0x2603)
    cls = _CLASS[low]
    code = _CODE[low]
    before, after = np.r_[_LINE, cls[:-1]], np.r_[cls[1:], _LINE]
    letter = (cls == _LETTER) | (cls == _UPPER)
    odd = letter & (
        rare[np.r_[0, code[:-1]] * _SIZE + code] & (code > 0) & ((before == _LETTER) | (before == _UPPER)) | (before == _DIGIT) | ((cls == _UPPER) & (before == _LETTER)) | ((cls == _LETTER) & (before == _UPPER) & np.isin(np.r_[_LINE, before[:-1]], [_LETTER, _UPPER]))
    )
    wide = (cls == _BLANK) & ((before == _BLANK) | (after == _BLANK))
    joined = (cls == _COMMA) & (after != _BLANK) & (after != _LINE)
    marks = [letter & ~odd, odd, cls == _DIGIT, (cls == _BLANK) & ~wide, (cls == _STOP) | ((cls == _COMMA) & ~joined), (cls == _CELL) | wide | joined, cls == _SYMBOL, cls == _LINE]
    spans = np.array(bounds)
    counts = np.zeros((len(doc), len(CLASSES)))
    for k, m in enumerate(marks, 1):
        total = np.r_[0, np.cumsum(m)]
        counts[:, k] = total[spans[:, 1]] - total[spans[:, 0]]
    more = np.array(extra, float)
    counts[:, 0], counts[:, 9], counts[:, 10] = more[:, 0], more[:, 1], more[:, 2]
    counts[:, 1] = np.maximum(counts[:, 1] - more[:, 0] - more[:, 1], 0)
    size = counts[:, [0, 1, 2, 3, 5, 6, 7, 9]].sum(axis=1)
    return np.array(doc), size, counts / np.maximum(counts.sum(axis=1, keepdims=True), 1), more[:, 3]


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Divergence of every row of p from every row of q, in bits."""
    p, q = p[:, None, :] + 1e-9, q[None, :, :] + 1e-9
    m = (p + q) / 2
    return ((p * np.log2(p / m)).sum(-1) + (q * np.log2(q / m)).sum(-1)) / 2


def _rare_pairs(model: np.ndarray) -> np.ndarray:
    """Letter pairs that follow the first letter in less than one of a hundred cases."""
    rare = np.exp(model) < 0.01
    rare[0, :] = rare[:, 0] = False
    return rare.ravel()


#: Characters whose segments are measured together; a longer text is measured alone.
CHUNK_CHARACTERS = 1_000_000


def _measured(key: str, text: str, lang: str, common: frozenset[str], rare: np.ndarray):
    """Arrow batches of documents -> one row a document with its segments' sorts, sizes and distributions."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or "" for x in b[text].to_pylist()]
            start = 0
            while start < len(texts):
                end, total = start + 1, len(texts[start])
                while end < len(texts) and total + len(texts[end]) <= CHUNK_CHARACTERS:
                    total += len(texts[end])
                    end += 1
                doc, size, dist, sort = _distributions(texts[start:end], common, rare)
                offsets = pa.array(np.searchsorted(doc, np.arange(end - start + 1)).astype("int32"))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(sort.astype("int8"))), pa.ListArray.from_arrays(offsets, pa.array(size.astype("float32")))]
                flat = pa.ListArray.from_arrays(pa.array((offsets.to_numpy() * len(CLASSES)).astype("int32")), pa.array(dist.astype("float32").ravel()))
                yield pa.RecordBatch.from_arrays([b[key][start:end], b[lang][start:end], *lists, flat], ["key", "lang", "sort", "size", "dist"])
                start = end

    return rows


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    doc = np.repeat(np.arange(b.num_rows), np.diff(b["size"].offsets.to_numpy()))
    take = lambda c: b[c].flatten().to_numpy(zero_copy_only=False)
    return doc, take("size").astype(float), take("dist").astype(float).reshape(-1, len(CLASSES)), take("sort")


#: Languages whose prose profiles are compared with every segment.
MOST_LANGUAGES = 100


def prose_profiles(measured: DataFrame) -> dict[str, np.ndarray]:
    """Mean distribution of segments with function words per language, over all documents; few languages are expected."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for b in batches:
            langs = [x or "" for x in b["lang"].to_pylist()]
            doc, size, dist, sort = _flat(b)
            for name in set(langs):
                keep = (np.array([x == name for x in langs])[doc] if len(doc) else np.zeros(0, bool)) & (sort == 1)
                found[name] = found.get(name, 0) + np.r_[size[keep].sum(), (size[keep, None] * dist[keep]).sum(axis=0)]
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([v.tolist() for v in found.values()], pa.list_(pa.float64()))], ["lang", "total"])

    parts = measured.select("lang", "sort", "size", "dist").mapInArrow(sums, "lang string, total array<double>")
    flat = parts.groupBy("lang").agg(*[F.sum(F.col("total")[k]).alias(f"c{k}") for k in range(len(CLASSES) + 1)])
    return {r["lang"]: np.array(r[2:]) / r[1] for r in collect_small(flat.filter("c0 > 0").orderBy(F.desc("c0")), MOST_LANGUAGES, "languages")}


#: Characters that a profile's start weighs when it is learned, and how often it is.
START_WEIGHT, ROUNDS = 20_000.0, 2


def learned_profiles(measured: DataFrame, start: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Profiles as means of the segments nearest to them, over all documents; sums of fixed size reach the driver."""
    profiles = start
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], profiles: np.ndarray = profiles) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(profiles), len(CLASSES) + 1))
            for b in batches:
                _, size, dist, _ = _flat(b)
                if len(size):
                    nearest = jensen_shannon(dist, profiles).argmin(axis=1)
                    np.add.at(total, nearest, np.c_[size, size[:, None] * dist])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype="int32")), pa.array(total.tolist(), pa.list_(pa.float64()))], ["k", "total"])

        parts = measured.select("sort", "size", "dist").mapInArrow(sums, "k int, total array<double>")
        flat = parts.groupBy("k").agg(*[F.sum(F.col("total")[c]).alias(f"c{c}") for c in range(len(CLASSES) + 1)])
        profiles = profiles.copy()
        for r in flat.collect():  # a row a profile
            profiles[r.k] = (np.array(r[2:]) + START_WEIGHT * start[r.k]) / (r[1] + START_WEIGHT)
    return profiles


def structural_kinds(df: DataFrame, key: str, text: str, lang: str, common: frozenset[str]) -> DataFrame:
    """Rows (key, kind, prose, list, table, junk): the kind of every document and its shares of characters by kind.

    A document without characters is prose by definition of no other kind; nulls count as empty. Every segment is
    compared with the profiles of all languages; the whole text is read, once.
    """
    rare = _rare_pairs(bigram_model(df, [text]))
    kind_type = df.schema[key].dataType.simpleString()
    columns = f"key {kind_type}, lang string, sort array<tinyint>, size array<float>, dist array<float>"
    measured = cut(df.select(key, text, lang).mapInArrow(_measured(key, text, lang, common, rare), columns), "segments")
    prose = prose_profiles(measured)
    table = [*((("prose", v) for v in prose.values())), *((k, np.r_[np.array(v) / sum(v) * (1 - x), x]) for k, x, v in PROFILES)]
    profiles, kind_of = learned_profiles(measured, np.array([v for _, v in table])), np.array([KINDS.index(k) for k, _ in table])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, size, dist, _ = _flat(b)
            total = np.zeros((b.num_rows, len(KINDS)))
            if len(doc):
                np.add.at(total, (doc, kind_of[jensen_shannon(dist, profiles).argmin(axis=1)]), size)
            share = total / np.maximum(total.sum(axis=1, keepdims=True), 1)
            other = share[:, 1:].argmax(axis=1) + 1
            most = (share[:, 0] < 0.5) & (total.sum(axis=1) > 0)
            yield pa.RecordBatch.from_arrays([b["key"], pa.array(np.array(KINDS)[np.where(most, other, 0)]), *[pa.array(share[:, k]) for k in range(4)]], ["key", "kind", *KINDS])

    return measured.select("key", "sort", "size", "dist").mapInArrow(judge, f"key {kind_type}, kind string, prose double, list double, table double, junk double")


def text_statistics(text: Column, common: Column) -> list[Column]:
    """Basic counts of a text, null counting as empty: words, mean word length, symbol ratio, line and common-word shares.

    `common` is an array of lower-case common words. Ratios of an empty text are 0.
    """
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    n, m = F.size(words), F.size(lines)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return [
        n.cast("bigint").alias("n_words"),
        F.round(ratio(F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", "")), n), 6).alias("mean_word_length"),
        F.round(ratio(F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s]", "")), F.length(t)), 6).alias("symbol_ratio"),
        m.cast("bigint").alias("n_lines"),
        F.round(ratio(F.size(F.filter(lines, lambda x: x.rlike(r"[.?!:;,»”]\s*$"))), m), 6).alias("stopped_lines"),
        F.round(ratio(F.size(F.filter(words, lambda w: F.array_contains(common, F.lower(w)))), n), 6).alias("common_words"),
    ]
