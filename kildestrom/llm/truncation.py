"""Texts that were cut off: right-censored length distributions per source combined with the evidence of the ending.

Per source, lengths are fitted by maximum likelihood as normal and censored at candidate limits: lengths where values
pile up, and the longest stretch before a cliff, where texts are cut at the last blank before a limit. A value's
censoring posterior at such a limit is its prior of being cut; elsewhere that is the share of transfers that break.
Evidence of the ending comes from signs and words that mark a cut and from counts over every inner, hence complete,
sentence of all texts: how often a sentence ends after the last words, and how often a word ends after its last
letters. Counts live in hashed tables of fixed size and don't depend on how rows lie in partitions.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kildestrom.llm.lookalikes import SUSPICIOUS, Canoniser
from kildestrom.session import cut, small_side

BUCKETS = 1 << 17
#: Share of cut values that is assumed where lengths tell nothing.
BACKGROUND = 0.03
#: Log odds of a cut that a mark at the end gives.
MARKED = 20.0

# Signs and words that mark a cut at the end of a text.
MARKS = re.compile(
    r"(?:\s*(?:…|\.\.\.+|\[\s*(?:…|\.\.\.+)\s*\]\.?|\(\s*(?:…|\.\.\.+)\s*\)\.?|\(?(?:fortsættes|fortsætter|fortsätter|forts\.?|continued|continues|more)\)|\[(?:fortsættes|continued|more|mere|mer)\]"
    r"|(?:læs|les|læs hele|läs) mere?(?: her)?\s*[»›>.…]*|read more\s*[»›>.…]*|continue reading\s*[»›>.…]*|read on\s*[»›>.…]*|�+))+\s*$",
    re.I,
)
_ENTITY = re.compile(r"&(?:#?\w*)$")
_SENTENCE = re.compile(r"(?<=[.?!])[»«”\"')]*\s+(?=[»“\"'(]*[0-9A-ZÆØÅÄÖÉ])")
_TOKEN = re.compile(r"[^\W\d_]+(?:[.\-'’&/][^\W\d_]+)*\.?|\d+(?:[.,]\d+)*|[^\w\s]")
_STOPPED = re.compile(r"[.?!][»«”\"')\]]*$")
_ODD = re.compile(SUSPICIOUS.replace(r"\x{2212}", "−"))


def _shape(token: str, first: bool) -> str:
    if token[0].isdigit():
        return "#"
    if not token[0].isalpha():
        return token
    if token[0].isupper() and not first:
        return "<N>"
    low = token.lower()
    return low if len(low) <= 8 else "~" + low[-4:]


def _tokens(sentence: str) -> list[str]:
    return _TOKEN.findall(sentence)


def _bucket(key: str) -> int:
    return zlib.crc32(key.encode("utf-8", "surrogatepass")) % BUCKETS


class Reader:
    """Plain form of a text: entities and disguises read, invisible ends gone."""

    def __init__(self) -> None:
        self.canon = Canoniser()

    def __call__(self, text: str) -> str:
        if "&" in text:
            text = html.unescape(html.unescape(text))
        return (self.canon(text)[0] if _ODD.search(text) else text).strip()


def _contexts(shapes: list[str], k: int) -> tuple[str, str, str]:
    """The last word, the last two, and these with the word that the sentence begins with."""
    one = shapes[k]
    two = (shapes[k - 1] if k else "^") + " " + one
    return one, two, shapes[0] + " … " + two


_ROWS = "grams int, bucket int, ended bigint, seen bigint"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of all inner sentences of a partition: tables 0-2 are words in growing context, 3-4 the last letters of words."""
    reader, ends, seen = Reader(), [Counter() for _ in range(5)], [Counter() for _ in range(5)]
    tables = np.zeros((2, 5, BUCKETS), "int64")
    words: Counter[str] = Counter()

    def flush() -> None:
        for w, times in words.items():
            marked = "^" + w
            for table, n in ((3, 6), (4, 4)):
                ends[table][marked[-n:]] += times
                for k in range(2, len(marked)):
                    seen[table][marked[max(0, k - n) : k]] += times
        words.clear()
        for which, counters in enumerate((ends, seen)):
            for g, c in enumerate(counters):
                for key, n in c.items():
                    tables[which, g, _bucket(key)] += n
                c.clear()

    for b in batches:
        for text in b.column(0).drop_null().to_pylist():
            sentences = _SENTENCE.split(reader(text))
            for s in sentences[:-1]:
                tokens = _tokens(s.rstrip("»«”\"') "))
                if tokens and tokens[-1] in (".", "?", "!"):
                    tokens.pop()
                elif tokens:
                    tokens[-1] = tokens[-1].rstrip(".")
                shapes = [_shape(t, k == 0) for k, t in enumerate(tokens) if t]
                last = len(shapes) - 1
                for k in range(len(shapes)):
                    keys = _contexts(shapes, k)
                    for g in range(3):
                        (ends if k == last else seen)[g][keys[g]] += 1
                words.update(t.lower() for t in tokens if len(t) > 1 and t[0].isalpha())
            if len(words) > 100_000 or len(ends[2]) + len(seen[2]) > 300_000:
                flush()
    flush()
    total = tables[0] + tables[1]
    g, bucket = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(g.astype("int32")), pa.array(bucket.astype("int32")), pa.array(tables[0][g, bucket]), pa.array(total[g, bucket])], ["grams", "bucket", "ended", "seen"])


class Endings:
    """The probability that a text ends complete, from the counted tables."""

    def __init__(self, ended: np.ndarray, seen: np.ndarray) -> None:
        self.ended, self.seen = ended, seen
        self.base = max(ended[0].sum(), 1) / max(seen[0].sum(), 2)

    def ends(self, shapes: list[str]) -> float:
        p = self.base
        for g, key in enumerate(_contexts(shapes, len(shapes) - 1)):
            k = _bucket(key)
            p = (self.ended[g][k] + 2 * p) / (self.seen[g][k] + 2)
        return p

    def whole(self, word: str) -> float:
        marked = "^" + word.lower()
        p = 0.5
        for table, n in ((4, 4), (3, 6)):
            k = _bucket(marked[-n:])
            p = (self.ended[table][k] + p) / (self.seen[table][k] + 1)
        return p

    def inside(self, shapes: list[str]) -> tuple[float, float]:
        """How often the last shape stood within a sentence, and how often it ended one without its stop."""
        k, e = _bucket(shapes[-1]), _bucket(shapes[-1].rstrip("."))
        return float(self.seen[0][k] - self.ended[0][k]), float(self.ended[0][e])


def learn_endings(texts: DataFrame) -> Endings:
    """Count the endings of every inner sentence of a one-column table; at most 5 * BUCKETS sums reach the driver."""
    rows = texts.mapInArrow(_count, _ROWS).groupBy("grams", "bucket").agg(F.sum("ended").alias("ended"), F.sum("seen").alias("seen")).toPandas()
    ended, seen = np.zeros((5, BUCKETS), "int64"), np.zeros((5, BUCKETS), "int64")
    g, b = rows["grams"].to_numpy().astype("int64"), rows["bucket"].to_numpy().astype("int64")
    ended[g, b], seen[g, b] = rows["ended"].to_numpy(), rows["seen"].to_numpy()
    return Endings(ended, seen)


def censored_fit(length: np.ndarray, n: np.ndarray, limit: float) -> tuple[float, float]:
    """Mean and deviation of a normal distribution, by maximum likelihood (EM) with values from `limit` on censored."""
    free = length < limit
    censored = n[~free].sum()
    x, w = length[free].astype(float), n[free].astype(float)
    if w.sum() < 2:
        return float(np.average(length, weights=n)), 1.0
    mu, sigma = float(np.average(x, weights=w)), max(1.0, math.sqrt(np.average((x - np.average(x, weights=w)) ** 2, weights=w)))
    for _ in range(60):
        z = (limit - 0.5 - mu) / sigma
        tail = max(0.5 * math.erfc(z / math.sqrt(2)), 1e-12)
        hazard = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / tail
        mean_c, square_c = mu + sigma * hazard, sigma**2 * (1 + z * hazard) + 2 * mu * (mu + sigma * hazard) - mu**2
        total = w.sum() + censored
        new = (np.dot(w, x) + censored * mean_c) / total
        sigma = max(1.0, math.sqrt(max(1.0, (np.dot(w, x * x) + censored * square_c) / total - new**2)))
        if abs(new - mu) < 1e-4:
            mu = new
            break
        mu = new
    return mu, sigma


#: Characters before a cliff in which texts end that are cut at the last blank.
WINDOW = 16


def _share(low: float, high: float, mu: float, sigma: float) -> float:
    """Share of a normal distribution between two lengths, both included."""
    at = lambda x: 0.5 * math.erfc(-(x - mu) / sigma / math.sqrt(2))
    return at(high + 0.5) - at(low - 0.5)


def _posteriors(histogram: pd.DataFrame) -> pd.DataFrame:
    """Lengths of one source at candidate limits, with the share of them that the fit takes for censored."""
    h = histogram.sort_values("length")
    length, n = h["length"].to_numpy(), h["n"].to_numpy().astype(float)
    total, out = n.sum(), {}
    upto = np.r_[0, n.cumsum()]
    within = lambda low, high: upto[np.searchsorted(length, high, "right")] - upto[np.searchsorted(length, low)]
    around = (within(length - 8, length + 8) - n) / 16
    for at, count, near in zip(length, n, around, strict=True):
        if count < 5 or count < 5 * max(near, 0.3):
            continue
        mu, sigma = censored_fit(length, n, at)
        expected = max(total * _share(at, at, mu, sigma), near)
        out[int(at)] = (int(count), mu, sigma, max(0.0, 1 - expected / count))
    free = np.r_[0, np.where(np.isin(length, list(out)), 0, n).cumsum()]  # what piles up at one length makes no cliff
    before, after = free[1:] - free[np.searchsorted(length, length - WINDOW + 1)], within(length + 1, length + WINDOW)
    steep = np.where((before >= 8) & (after <= 0.1 * before), before / (after + 1), 0)
    if steep.max(initial=0) > 0:  # the cliff
        at = length[steep.argmax()]
        mu, sigma = censored_fit(length, n, at - WINDOW + 1)
        for k in range(at - WINDOW + 1, at + 1):  # with its neighbours, as few texts have one length
            count = float(within(k - 1, min(k + 1, at)))
            posterior = max(0.0, 1 - total * _share(k - 1, min(k + 1, at), mu, sigma) / max(count, 1.0))
            if posterior > 0 and (k not in out or out[k][3] < posterior):
                out[k] = (int(count), mu, sigma, posterior)
    rows = [(h["source"].iloc[0], k, c, float(mu), float(sigma), p) for k, (c, mu, sigma, p) in sorted(out.items())]
    return pd.DataFrame(rows, columns=["source", "length", "n", "mu", "sigma", "posterior"])


def length_limits(lengths: DataFrame) -> DataFrame:
    """Rows (source, length, n, mu, sigma, posterior) of likely field limits of a table (source, length); a source's histogram has its distinct lengths."""
    histogram = lengths.groupBy("source", "length").agg(F.count("*").alias("n"))
    return histogram.groupBy("source").applyInPandas(_posteriors, "source string, length int, n bigint, mu double, sigma double, posterior double")


def _evidence(endings: Endings):
    @F.pandas_udf("struct<stopped boolean, odds double>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        reader = Reader()
        base = endings.base / (1 - endings.base)

        def one(text: str | None) -> tuple[bool, float]:
            if not text or not text.strip():
                return True, 0.0
            if _ENTITY.search(text):
                return False, MARKED
            plain = reader(text)
            mark = MARKS.search(plain)
            body = plain[: mark.start()].rstrip() if mark else plain
            stopped = bool(_STOPPED.search(body))
            if mark:
                return stopped, MARKED
            tokens = _tokens(_SENTENCE.split(body)[-1].rstrip("»«”\"')] "))
            if not tokens:
                return stopped, 0.0
            if stopped:
                if not tokens[-1].endswith(".") or tokens[-1] == ".":
                    return True, -20.0
                shapes = [_shape(t, k == 0) for k, t in enumerate(tokens)]
                within, ended = endings.inside(shapes)
                return True, math.log((max(within - 2, 0) + 0.05) / (ended + 1))
            shapes = [_shape(t, k == 0) for k, t in enumerate(tokens)]
            if not tokens[-1][0].isalnum():
                return False, 12.0 if tokens[-1] in ",;:&-–(«»„“/" else 2.0
            whole = endings.whole(tokens[-1]) if tokens[-1][0].isalpha() else 0.9
            p = min(max(endings.ends(shapes) * whole, 1e-6), 1 - 1e-6)
            if text != text.rstrip(" "):
                p *= 0.3
            return False, math.log(base) - math.log(p / (1 - p))

        for s in batches:
            yield pd.DataFrame([one(t) for t in s], columns=["stopped", "odds"])

    return judge


def judged(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """Rows (key, source, cut): every record with a text and whether it was cut off.

    Null, empty and blank texts are left out; exact repeats of a row count once. A text whose last sentence is complete
    is not cut, with or without its full stop. Records without a source share one.
    """
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("text")).filter(F.length(F.trim("text")) > 0)
    judge = _evidence(learn_endings(rows.select("text")))
    seen = rows.select("key", "source", F.length("text").alias("length"), judge(F.col("text")).alias("e")).select("key", "source", "length", "e.*").distinct()
    seen = cut(seen, "endings")
    # how a source ends its complete texts: with a stop, or without
    likely = F.when(F.col("stopped"), 1.0).otherwise(0.0)
    bare = F.when(~F.col("stopped") & (F.col("odds") < MARKED), 1 / (1 + F.exp("odds"))).otherwise(0.0)
    style = seen.groupBy("source").agg(((F.sum(likely) + 1.0) / (F.sum(likely) + F.sum(bare) + 1.5)).alias("stops"))
    limits = length_limits(seen).select("source", "length", "posterior")
    whole = seen.join(small_side(cut(style, "styles")), "source").join(small_side(cut(limits, "limits")), ["source", "length"], "left")
    posterior = F.when(F.col("stopped"), 0.0).otherwise(F.coalesce("posterior", F.lit(0.0)))  # a stop at a limit is chance
    prior = F.greatest(F.lit(BACKGROUND), F.least(posterior, F.lit(0.98)))
    missing = F.greatest(1 - F.col("stops"), F.lit(0.01))
    total = F.log(prior / (1 - prior)) - F.when(F.col("stopped"), 0.0).otherwise(F.log(missing)) + F.col("odds")
    return whole.select("key", "source", (total > 0).alias("cut"))


def source_shares(records: DataFrame) -> DataFrame:
    """Per source: records with a text, cut ones and their share."""
    return records.groupBy("source").agg(F.count("*").alias("n"), F.count_if("cut").alias("n_cut")).withColumn("share", F.col("n_cut") / F.col("n"))
