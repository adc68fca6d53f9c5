"""Text that looks ordinary but holds other characters than it shows, brought to one form.

Ignorable characters are deleted, spaces become plain, compatibility forms (full-width, styled, joined) are replaced and
accents composed. A word that mixes Latin with Greek or Cyrillic letters becomes a lattice of look-alikes, in which
Viterbi's algorithm finds the path with the best script-consistent character bigram score.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Greek and Cyrillic letters with the Latin letters that they look like, likeliest first.
LOOKALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "α": "a", "β": "ß", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "uv", "χ": "x", "ω": "w", "ϲ": "c", "ϳ": "j", "ό": "ó", "ά": "á", "έ": "é", "ί": "í",
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ї": "Ï", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ғ": "F", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ё": "Ë", "З": "3", "Ь": "b", "Ӕ": "Æ", "Ӧ": "Ö", "Ӓ": "Ä",
    "а": "a", "в": "b", "г": "r", "е": "e", "ё": "ë", "з": "3", "и": "u", "й": "ü", "к": "k", "м": "m", "н": "hn", "о": "o", "п": "n", "р": "p", "с": "c", "т": "t", "у": "yu", "х": "x", "ь": "b", "ѕ": "s", "і": "i", "ї": "ï", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "ѵ": "v", "ӏ": "l", "ӕ": "æ", "ӧ": "ö", "ӓ": "ä", "ғ": "f", "ԍ": "g",
}

# Characters that no field needs to be looked into for: plain Latin text with its usual signs.
SUSPICIOUS = r"[^\t\n\r -~¡-¬®-ıĴ-ňŊ-ž–—‘’‚“”„†•…‹›€₂₃\x{2212}]"
_ORDINALS = "ªº™℠№ℓ℃℉"
_WORD = re.compile(r"(?:[^\W_]|[̀-ͯ])+")
_MARK = re.compile(r"[^\W_][̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]")
_IGNORABLE = {0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, 0x180F, 0x2800, 0x3164, 0xFEFF, 0xFFA0, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), *range(0xFFF9, 0xFFFC), *range(0xE0000, 0xE1000)}


def _kind(ch: str) -> str:
    """ignorable, space, compat or plain."""
    if ord(ch) in _IGNORABLE:
        return "ignorable"
    cat = unicodedata.category(ch)
    if cat in ("Zs", "Zl", "Zp") and ch != " ":
        return "space"
    if cat == "Cc" and ch not in "\t\n\r" or cat == "Cf":
        return "ignorable"
    tag = unicodedata.decomposition(ch).partition(" ")[0]
    if tag in ("<wide>", "<narrow>", "<font>", "<circle>", "<square>") and ch not in _ORDINALS:
        return "compat"
    if tag in ("<super>", "<sub>") and cat[0] == "L" and ch not in _ORDINALS:
        return "compat"
    if tag == "<compat>" and cat[0] in "LN" and ch not in _ORDINALS:
        plain = unicodedata.normalize("NFKC", ch)
        if len(plain) > 1 and all(c.isalnum() or c in "().," for c in plain) or "LATIN" in unicodedata.name(ch, ""):
            return "compat"
    if 0x1F130 <= ord(ch) <= 0x1F189 and "LATIN" in unicodedata.name(ch, ""):
        return "compat"
    return "plain"


def _script(ch: str) -> str:
    if ch.isascii():
        return "L" if ch.isalpha() else ""
    name = unicodedata.name(ch, "")
    return "L" if name.startswith("LATIN") else "G" if name.startswith("GREEK") else "C" if name.startswith("CYRILLIC") else ""


_LETTERS = "abcdefghijklmnopqrstuvwxyzæøåäöéàüßëïóáíèêñç" + "αβγδεζηθικλμνξοπρστυφχψω" + "абвгдежзийклмнопрстуфхцчшщъыьэюяѕіїјһ"
_CODE = np.zeros(0x10000, "int64")
for _i, _c in enumerate(_LETTERS, 1):
    _CODE[ord(_c)] = _CODE[ord(_c.upper()) if len(_c.upper()) == 1 else ord(_c)] = _i
_SIZE = len(_LETTERS) + 1


def bigram_model(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Log probabilities of letter bigrams (0 is anything that isn't a letter) over every text of the columns.

    Each partition counts into one array of fixed size; at most _SIZE squared sums reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SIZE * _SIZE, "int64")
        for b in batches:
            for column in b.columns:
                joined = "\n".join(column.drop_null().to_pylist())
                points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
                code = _CODE[np.where(points < 0x10000, points, 0)]
                if len(code) > 1:
                    total += np.bincount(code[:-1] * _SIZE + code[1:], minlength=_SIZE * _SIZE)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["pair", "n"])

    counts = np.full(_SIZE * _SIZE, 0.5)
    for row in df.select(*columns).mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        counts[row.pair] += row.n
    table = counts.reshape(_SIZE, _SIZE)
    return np.log(table / table.sum(axis=1, keepdims=True))


_SWITCH = 12.0  # log-probability price of neighbours in different scripts


def best_word(word: str, model: np.ndarray | None = None) -> str:
    """The likeliest reading of a word of mixed scripts: Viterbi over the lattice of look-alikes."""
    lattice = [[ch, *LOOKALIKES.get(ch, "")] for ch in word]
    scores, back, before = {"": 0.0}, [], ""
    for options in lattice:
        now, source = {}, {}
        for rank, ch in enumerate(options):
            code = _CODE[ord(ch)] if ord(ch) < 0x10000 else 0
            own = _script(ch)
            best = None
            for prev, score in scores.items():
                pair = -0.01 * rank if model is None else model[_CODE[ord(prev)] if prev and ord(prev) < 0x10000 else 0, code]
                other = _script(prev) if prev else "L"
                s = score + pair - (_SWITCH if own and other and own != other else 0)
                if best is None or s > best:
                    best, source[ch] = s, prev
            now[ch] = best
        back.append(source)
        scores = now
    ch = max(scores, key=scores.get) if scores else before
    out = []
    for source in reversed(back):
        out.append(ch)
        ch = source[ch]
    return "".join(reversed(out))


class _Shown(dict):
    """What each character shows, for str.translate; learned as characters come."""

    def __missing__(self, code: int) -> int | str:
        ch = chr(code)
        kind = "plain" if ch.isascii() else _kind(ch)
        self[code] = shown = {"plain": code, "space": " ", "ignorable": ""}.get(kind) if kind != "compat" else unicodedata.normalize("NFKC", ch)
        return shown


class _Scripts(dict):
    def __missing__(self, ch: str) -> str:
        self[ch] = script = _script(ch)
        return script


class Canoniser:
    """Canonical form of a text, and whether the text held anything that it doesn't show."""

    def __init__(self, model: np.ndarray | None = None) -> None:
        self.model, self.shown, self.script, self.words = model, _Shown(), _Scripts(), {}

    def __call__(self, text: str) -> tuple[str, bool]:
        plain = text.translate(self.shown)
        found = plain != text or _MARK.search(plain) is not None
        plain = unicodedata.normalize("NFC", plain)
        if not any(self.script[c] in ("G", "C") for c in set(plain)):
            return plain, found

        def fix(m: re.Match[str]) -> str:
            nonlocal found
            word = m[0]
            scripts = {self.script[c] for c in word}
            if "L" not in scripts or not scripts & {"G", "C"}:
                return word
            found = True
            if word not in self.words:
                if len(self.words) > 50_000:
                    self.words.clear()
                self.words[word] = best_word(word, self.model)
            return self.words[word]

        return _WORD.sub(fix, plain), found


def canonical(text: Column, model: np.ndarray | None = None) -> Column:
    """struct<text, found> of a string column; only texts with a suspicious character reach Python.

    Null text gives null text and found false; an empty text stays empty; very long texts are read whole.
    """

    @F.pandas_udf("struct<text string, found boolean>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        canon = Canoniser(model)
        for s in batches:
            pairs = [(None, False) if t is None else canon(t) for t in s]
            yield pd.DataFrame(pairs, columns=["text", "found"])

    odd = text.rlike(SUSPICIOUS)
    seen = read(F.when(odd, text))
    return F.struct(F.coalesce(seen["text"], text).alias("text"), F.coalesce(seen["found"], F.lit(False)).alias("found"))


@functools.lru_cache(maxsize=1)
def _odd_points() -> np.ndarray:
    """For every code point whether a text that holds it has to be looked into."""
    every = "".join(map(chr, range(0x110000)))
    odd = np.zeros(len(every), bool)
    for m in re.finditer(f"(?:{SUSPICIOUS})+".replace(r"\x{2212}", "−"), every):
        odd[m.start() : m.end()] = True
    return odd


def odd_texts(texts: list[str]) -> list[int]:
    """Which texts hold a suspicious character, found over the characters of all of them at once."""
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    size = np.fromiter(map(len, texts), "int64", len(texts)) + 1
    ends = np.cumsum(size)
    seen = np.r_[0, np.cumsum(_odd_points()[points])]
    return np.flatnonzero(seen[ends] > seen[ends - size]).tolist()


#: Characters that are looked through together; a longer text is looked through alone.
CHUNK_CHARACTERS = 2_000_000


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold CHUNK_CHARACTERS together, or one text."""
    start = total = 0
    for k, t in enumerate(texts):
        if k > start and total + len(t) > CHUNK_CHARACTERS:
            yield start, k
            start, total = k, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def disguised_fields(df: DataFrame, key: str, fields: list[str], model: np.ndarray | None = None) -> DataFrame:
    """Rows (key, field, text) of every field that holds characters it doesn't show, with its canonical text, each once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canoniser(model)
        for b in batches:
            for k, field in enumerate(fields, 1):
                texts = [t or "" for t in b.column(k).to_pylist()]
                where, plain = [], []
                for start, end in chunks(texts):
                    for i in odd_texts(texts[start:end]):
                        text, found = canon(texts[start + i])
                        if found:
                            where.append(start + i)
                            plain.append(text)
                if where:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(where)), pa.array([field] * len(where)), pa.array(plain, pa.string())], [key, "field", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, *fields).mapInArrow(read, f"`{key}` {kind}, field string, text string").distinct()
