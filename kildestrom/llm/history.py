"""New batches against everything accepted: sorted-neighbourhood runs under several keys.

Every distinct title is entered under keys made of pairs of its rarest words and its numbers, every address under its
own. Titles that differ in at most two words share such a key, so a new record's window is its key's stretch of the
sorted order, within two words of its length; it is bounded by order, not by a number of rows, and cuts nothing off. A
run holds one batch, divided into fixed ranges of the key and sorted inside them. A new batch is written as a run first
and then merged with the older runs range by range: the history is neither shuffled, grouped nor sorted again. Runs are
compacted when there are many, which also settles the order of the words anew. A key that many titles share is replaced
by keys of three words, by a hashed count table of fixed size.
"""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import html
import itertools
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kildestrom.functions.urls import address_key
from kildestrom.llm.lookalikes import Canoniser
from kildestrom.llm.words import chunks, code_points, count_table, lengths, mix, place_of, plain_texts, spread, word_spans
from kildestrom.session import collect_small, cut, fresh_path, remove_path

EDITS = 2
MAX_RUNS = 8
#: Titles under one pair of words from which on three words make the key.
HOT_KEY = 10_000
#: Names that may stand behind a title: a registry of sources.
MOST_NAMES = 100_000
#: The length that marks an address among the keys.
ADDRESS = -10
_TAIL = re.compile(r"^([\s\S]*\S)\s+[|–—-]\s+(\S[\s\S]*)$")
_WORD = re.compile(r"[^\W_]+")
_NUMBER = re.compile(r"[0-9]+")
_ENTRY = "ord bigint, a1 bigint, a2 int, t1 bigint, t2 bigint, wl array<int>, numbers bigint"
_KEYS = "key bigint, t1 bigint, t2 bigint, first bigint, n int, sketch bigint"


def _numbers(text: str) -> int:
    found = sorted(_NUMBER.findall(text))
    return int.from_bytes(hashlib.blake2b(" ".join(found).encode(), digest_size=8).digest(), "little", signed=True) if found else 0


def _read(names: frozenset[str]):
    """Arrow batches (ord, a1, a2, title) -> entries."""

    def bare(title: str) -> str:
        if ("|" in title or "–" in title or "—" in title or " -" in title) and (m := _TAIL.match(title)) and " ".join(_WORD.findall(m[2])) in names:
            return m[1]
        return title

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canoniser()
        for b in batches:
            titles = [html.unescape(html.unescape(t)) if t and "&" in t else t or "" for t in b["title"].to_pylist()]
            for start, end in chunks(titles):
                texts = [bare(t) for t in plain_texts(titles[start:end], canon)]
                begins, full = word_spans(code_points(texts))
                of = np.searchsorted(np.cumsum(lengths(texts) + 1), begins, side="right")
                size = np.bincount(of, minlength=len(texts))
                place = (np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)).astype("uint64")
                filled = np.flatnonzero(size)
                starts = (np.cumsum(size) - size)[filled]
                t1, t2 = np.zeros(len(texts), "uint64"), np.zeros(len(texts), "uint64")
                if len(filled):
                    t1[filled] = np.add.reduceat(mix(full + place * np.uint64(0x9E3779B97F4A7C15)), starts)
                    t2[filled] = np.add.reduceat(mix(full ^ mix(place + np.uint64(0xD1B54A32D192ED03))), starts)
                wl = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype("int32")), pa.array((full >> np.uint64(32)).astype("uint32").view("int32")))
                numbers = np.fromiter(map(_numbers, texts), "int64", len(texts))
                part = b.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([part["ord"], part["a1"], part["a2"], pa.array(t1.view("int64"), mask=size == 0), pa.array(t2.view("int64")), wl, pa.array(numbers)], ["ord", "a1", "a2", "t1", "t2", "wl", "numbers"])

    return rows


def entries(df: DataFrame, ord_: Column, url: Column, title: Column, names: DataFrame) -> DataFrame:
    """Rows (ord, a1, a2, t1, t2, wl, numbers): address and title keys of a batch, from one pass over its rows.

    Titles are read without entities, disguises, case, punctuation and a tail that is one of `names` (name), a small
    table. Null or empty titles and addresses have no key and match nothing.
    """
    known = frozenset(" ".join(_WORD.findall(r.name.lower())) for r in collect_small(names.filter("name is not null").select("name").distinct(), MOST_NAMES, "names")) - {""}
    address = df.select(ord_.cast("bigint").alias("ord"), address_key(url).alias("address"), title.alias("title"))
    rows = address.select("ord", F.when(F.col("address").isNotNull(), F.xxhash64("address")).alias("a1"), F.when(F.col("address").isNotNull(), F.hash(F.lit("a"), "address")).alias("a2"), "title")
    return rows.mapInArrow(_read(known), _ENTRY)


def _pair_keys(counts: np.ndarray, hot: np.ndarray | None):
    """Arrow batches of titles -> their keys: one row for each pair of rare words.

    Without `hot`, only the column of pair keys is given, to be counted.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.diff(b["wl"].offsets.to_numpy()).astype("int64")
            w = b["wl"].flatten().to_numpy(zero_copy_only=False)
            if not len(w):
                continue
            of = np.repeat(np.arange(len(size)), size)
            # the k-th occurrence of a word is a token of its own
            order = np.lexsort((w, of))
            same = np.r_[False, (w[order][1:] == w[order][:-1]) & (of[order][1:] == of[order][:-1])]
            run = np.arange(len(w)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(w))))
            occurrence = np.empty(len(w), "uint64")
            occurrence[order] = run
            token = mix(spread(w) + np.uint64(0x9E3779B97F4A7C15) * occurrence)
            start = np.cumsum(size) - size
            order = np.lexsort((token, counts[place_of(w)], of))
            numbers = mix(b["numbers"].to_numpy(zero_copy_only=False).view("uint64"))
            top = np.zeros((len(size), 5), "uint64")
            for k in range(5):
                has = size > k
                top[has, k] = token[order[start[has] + k]]
            keys, who = [], []

            def put(has: np.ndarray, sums: np.ndarray) -> None:
                keys.append(mix(mix(sums) + numbers[has]))
                who.append(has)

            for i, j in itertools.combinations(range(4), 2):  # both of two among the four rarest
                has = np.flatnonzero(size > j)
                pair = top[has, i] + top[has, j]
                if hot is None:
                    put(has, pair)
                    continue
                many = hot[place_of(mix(mix(pair) + numbers[has]).view("int64"))]
                put(has[~many], pair[~many])
                has, pair = has[many], pair[many]
                short = size[has] <= 4  # two of up to four words may be all that two short titles share
                put(has[short], mix(pair[short] + np.uint64(4)))
                for k in range(5):  # three among the five rarest
                    if k not in (i, j):
                        more = size[has] > k
                        put(has[more], mix(pair[more] + top[has[more], k] + np.uint64(3)))
            if hot is None:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view("int64"))], ["key"])
                continue
            for i in range(3):  # one among the three rarest, for titles that need to share no more
                has = np.flatnonzero((size > i) & (size <= 5))
                put(has, top[has, i])
            sketch = np.zeros(len(size), "uint64")
            filled = size > 0
            sketch[filled] = np.bitwise_xor.reduceat(np.left_shift(np.uint64(1), token & np.uint64(63)), start[filled])
            of_key = np.concatenate(who)
            take = lambda c: b[c].take(pa.array(of_key))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view("int64")), take("t1"), take("t2"), take("first"), pa.array(size[of_key].astype("int32")), pa.array(sketch[of_key].view("int64"))], ["key", "t1", "t2", "first", "n", "sketch"]
            )

    return rows


@dataclass(frozen=True)
class Run:
    """Names of a run's tables: keys and titles, in ranges and sorted, and the first short title of each set of numbers."""

    keys: str
    titles: str
    short: DataFrame
    rows: int


class RunStore:
    """The accepted history as sorted runs; `take` screens a batch and takes it in."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, max_runs: int = MAX_RUNS, hot_key: int = HOT_KEY) -> None:
        self.spark, self.runs, self.max_runs, self.hot_key = spark, [], max_runs, hot_key
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.counts = self.hot = None
        self.paths: dict[str, str] = {}
        atexit.register(self.close)

    def close(self) -> None:
        """Drop every table of the store."""
        for name in list(self.paths):
            with contextlib.suppress(Exception):  # the session may be gone at exit
                self._drop(name)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"drop table if exists {name}")
        remove_path(self.spark, self.paths.pop(name))

    def _write(self, df: DataFrame, column: str) -> str:
        name, path = f"kildestrom_run_{uuid.uuid4().hex}", fresh_path(self.spark, "run")
        self.paths[name] = path
        df.repartition(self.buckets, column).sortWithinPartitions(column).write.bucketBy(self.buckets, column).sortBy(column).option("path", path).format("parquet").saveAsTable(name)
        return name

    def _settle(self, titles: DataFrame) -> None:
        """The order of words, rarest first and in steps of an eighth of a doubling, and the keys that too many titles share."""
        self.counts = np.minimum(8 * np.log2(count_table(titles.select("wl")) + 1.0), 255).astype("uint8")
        self.hot = count_table(titles.select("wl", "numbers").mapInArrow(_pair_keys(self.counts, None), "key bigint")) > self.hot_key

    def _run(self, titles: DataFrame, addresses: DataFrame) -> Run:
        """Write distinct titles and addresses (key, t1, t2, first) as a run."""
        name = self._write(titles, "t1")
        titles = self.spark.table(name)
        if self.counts is None:
            self._settle(titles)
        keys = titles.mapInArrow(_pair_keys(self.counts, self.hot), _KEYS)
        marks = addresses.select("key", "t1", "t2", "first", F.lit(ADDRESS).alias("n"), F.lit(0).cast("bigint").alias("sketch"))
        return self._finish(self._write(keys.unionByName(marks), "key"), name)

    def _finish(self, keys: str, titles: str) -> Run:
        rows = self.spark.table(titles)
        short = rows.filter(F.size("wl") <= EDITS).groupBy("numbers").agg(F.min("first").alias("least"))
        return Run(keys, titles, cut(short, "short"), rows.count())

    def _run_of(self, batch: DataFrame) -> Run:
        titles = batch.filter("t1 is not null").groupBy("t1", "t2").agg(F.min("ord").alias("first"), F.first("wl").alias("wl"), F.first("numbers").alias("numbers"))
        addresses = batch.filter("a1 is not null").groupBy("a1", "a2").agg(F.min("ord").alias("first"))
        return self._run(titles, addresses.select(F.col("a1").alias("key"), F.col("a1").alias("t1"), F.col("a2").cast("bigint").alias("t2"), "first"))

    def add(self, batch: DataFrame) -> None:
        """Take in a written batch of entries that needs no screening."""
        self._keep(self._run_of(batch))

    def _keep(self, run: Run) -> None:
        self.runs.append(run)
        if len(self.runs) > self.max_runs:
            self.compact()

    def compact(self) -> None:
        """Merge the newest runs, and every older one that isn't twice as large as they are together: a large history is left alone.

        A title or address keeps the order of its first row. When the oldest run takes part, words are ordered anew.
        """
        old = [self.runs.pop(), self.runs.pop()] if len(self.runs) > 1 else []
        while self.runs and self.runs[-1].rows < 2 * sum(r.rows for r in old):
            old.append(self.runs.pop())
        if not old:
            return
        union = lambda names: _union([self.spark.table(n) for n in names])
        titles = union([r.titles for r in old]).groupBy("t1", "t2").agg(F.min("first").alias("first"), F.first("wl").alias("wl"), F.first("numbers").alias("numbers"))
        keys = union([r.keys for r in old])
        if self.runs:
            merged = keys.groupBy("key", "t1", "t2", "n", "sketch").agg(F.min("first").alias("first")).select("key", "t1", "t2", "first", "n", "sketch")
            run = self._finish(self._write(merged, "key"), self._write(titles, "t1"))
        else:
            self.counts = None
            run = self._run(titles, keys.filter(F.col("n") == ADDRESS).groupBy("key", "t1", "t2").agg(F.min("first").alias("first")))
        self.runs.append(run)
        for r in old:
            self._drop(r.keys)
            self._drop(r.titles)

    def take(self, batch: DataFrame) -> DataFrame:
        """Orders (ord) of a written batch's rows that repeat an earlier row of the batch or of the history; it is history then.

        Earlier means a smaller order; history comes with orders below those of the batch. Copies of one address or
        title are met through its first row, however many there are. The result is written.
        """
        run, spark = self._run_of(batch), self.spark
        late = spark.table(run.keys).select("key", *[F.col(c).alias(f"b_{c}") for c in ("t1", "t2", "first", "n", "sketch")])
        new = spark.table(run.titles)
        new_words = new.select(F.col("t1").alias("b_t1"), F.col("t2").alias("b_t2"), F.col("wl").alias("b_wl"))
        window = (F.col("first") < F.col("b_first")) & F.col("n").between(F.col("b_n") - EDITS, F.col("b_n") + EDITS) & (F.bit_count(F.col("sketch").bitwiseXOR(F.col("b_sketch"))) <= 2 * EDITS)
        same = (F.col("t1") == F.col("b_t1")) & (F.col("t2") == F.col("b_t2"))
        sides = [*self.runs, run]
        met = [spark.table(side.keys).join(late, "key").filter(window & (same == (F.col("n") == ADDRESS))).select(F.lit(k).alias("side"), (F.col("n") == ADDRESS).alias("address"), "t1", "t2", "b_t1", "b_t2") for k, side in enumerate(sides)]
        met = cut(_union(met).distinct(), "met")
        titles = [self._near_short(new, run)]
        for k, side in enumerate(sides):
            words = spark.table(side.titles).select("t1", "t2", "wl")
            both = met.filter((F.col("side") == k) & ~F.col("address")).select("t1", "t2", "b_t1", "b_t2").join(new_words, ["b_t1", "b_t2"]).join(words, ["t1", "t2"])
            titles.append(both.filter(word_distance(F.col("wl"), F.col("b_wl")) <= EDITS).select(F.col("b_t1").alias("t1"), F.col("b_t2").alias("t2")))
            if side is not run:
                titles.append(new.select("t1", "t2").join(words.select("t1", "t2"), ["t1", "t2"], "left_semi"))
        found = _union(titles).distinct().withColumn("old", F.lit(True))
        known = met.filter("address").select("t1", "t2").distinct().withColumn("old", F.lit(True))
        rows = batch.select("ord", "a1", "a2", "t1", "t2").distinct()
        firsts = new.select("t1", "t2", "first").join(found, ["t1", "t2"], "left")
        places = spark.table(run.keys).filter(F.col("n") == ADDRESS).select("t1", "t2", "first").join(known, ["t1", "t2"], "left").select(F.col("t1").alias("a1"), F.col("t2").cast("int").alias("a2"), "first", "old")
        late_one = F.col("old") | (F.col("ord") > F.col("first"))
        out = rows.join(firsts, ["t1", "t2"]).filter(late_one).select("ord").unionByName(rows.join(places, ["a1", "a2"]).filter(late_one).select("ord"))
        out = cut(out.distinct(), "repeats")
        self._keep(run)
        return out

    def _near_short(self, titles: DataFrame, run: Run) -> DataFrame:
        """Titles of at most EDITS words after another of the same numbers: any two are within the limit, without a common word.

        The first row of each set of numbers decides, so no pairs are formed.
        """
        short = titles.filter(F.size("wl") <= EDITS).select("t1", "t2", "first", "numbers")
        least = _union([r.short for r in [*self.runs, run]]).groupBy("numbers").agg(F.min("least").alias("least"))
        return short.join(least, "numbers").filter("least < first").select("t1", "t2")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def word_distance(a: Column, b: Column) -> Column:
    """Words added, dropped or replaced between two arrays of word hashes: Levenshtein over one character per word."""
    union = F.array_union(a, b)
    letters = lambda x: F.array_join(F.transform(x, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(union, w).cast("int") + 0x1000), 4, "0")), "UTF-16BE")), "")
    return F.levenshtein(letters(a), letters(b))


def take_in_order(store: RunStore, rows: DataFrame, batches: list[tuple[int, int]], names: DataFrame, url: str = "url", title: str = "title") -> DataFrame:
    """Screen batches of rows (ord and the named columns), given as ranges of orders, one after the other."""
    found = []
    for low, high in batches:
        part = rows.filter(F.col("ord").between(low, high))
        found.append(store.take(cut(entries(part, F.col("ord"), F.col(url), F.col(title), names), "entries")))
    return _union(found) if found else rows.sparkSession.createDataFrame([], "ord bigint")
