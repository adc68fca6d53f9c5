"""Words of texts, free of case and disguises, read as arrays of characters."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kildestrom.llm.lookalikes import Canoniser, chunks, odd_texts

#: Places of a count table; what meets in one is counted together.
COUNT_PLACES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit number spread over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def _word_points() -> np.ndarray:
    """For every code point whether it is a letter or digit."""
    every = "".join(map(chr, range(0x110000)))
    word = np.zeros(len(every), bool)
    for m in re.finditer(r"[^\W_]+", every):
        word[m.start() : m.end()] = True
    return word


def code_points(texts: list[str]) -> np.ndarray:
    """The characters of all texts, each text followed by a line end."""
    return np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")


def lengths(texts: list[str]) -> np.ndarray:
    return np.fromiter(map(len, texts), "int64", len(texts))


def word_spans(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a character array begin, and the 64-bit hash of each."""
    word = _word_points()[points]
    begins = np.flatnonzero(word & ~np.r_[False, word[:-1]])
    if not len(begins):
        return begins, np.zeros(0, "uint64")
    at = np.flatnonzero(word)
    first = np.searchsorted(at, begins)
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
    letters = mix(points[at].astype("uint64") | (place.astype("uint64") + np.uint64(1)) << np.uint64(21))
    return begins, mix(np.add.reduceat(letters, first))


def plain_texts(texts: list[str], canon: Callable[[str], tuple[str, bool]]) -> list[str]:
    """Lower-case canonical forms; only texts with a suspicious character are looked into."""
    for k in odd_texts(texts):
        texts[k] = canon(texts[k])[0]
    return [t.lower() for t in texts]


def word_sets(texts: list[str], canon: Canoniser) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 32-bit hashes of the distinct words of every text, and how many each has."""
    texts = plain_texts(texts, canon)
    begins, full = word_spans(code_points(texts))
    of = np.searchsorted(np.cumsum(lengths(texts) + 1), begins, side="right")
    both = np.sort(of << 32 | (full >> np.uint64(32)).astype("int64"))
    new = np.r_[True, both[1:] != both[:-1]][: len(both)]
    both = both[new]
    return both.astype("uint32").view("int32"), np.bincount(both >> 32, minlength=len(texts))


def spread(hashes: np.ndarray) -> np.ndarray:
    """Mixed 64-bit forms of short hashes."""
    return mix(hashes.astype("int64").view("uint64") + np.uint64(0x9E3779B97F4A7C15))


def place_of(hashes: np.ndarray) -> np.ndarray:
    """The places of hashes in a count table."""
    return (spread(hashes) >> np.uint64(20)).astype("int64") & (COUNT_PLACES - 1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNT_PLACES, "int64")
    for b in batches:
        values = b.column(0)
        values = values.flatten() if pa.types.is_list(values.type) else values
        total += np.bincount(place_of(values.to_numpy(zero_copy_only=False)), minlength=COUNT_PLACES)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype("int32")), pa.array(total[seen])], ["place", "n"])


def count_table(hashes: DataFrame) -> np.ndarray:
    """How often the hashes of a one-column table (numbers or arrays) come, never too low: a hashed table of fixed size.

    Each partition counts into one array; at most COUNT_PLACES sums reach the driver.
    """
    rows = hashes.mapInArrow(_counted, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(COUNT_PLACES, "int64")
    counts[rows["place"].to_numpy("int64")] = rows["n"].to_numpy("int64")
    return counts


__all__ = ["chunks", "code_points", "count_table", "lengths", "mix", "place_of", "plain_texts", "spread", "word_sets", "word_spans"]
