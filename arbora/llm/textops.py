"""Whole-text word arithmetic on Arrow string buffers, shared by the operators of this subpackage.

Texts are looked at as one byte array per slice of a record batch; words, their 64-bit hashes and
n-gram hashes come out as numpy arrays, so no Python object is made per word. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of every operator on shingles: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
WORD_BYTES = np.ones(256, bool)
for _lo, _hi in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    WORD_BYTES[_lo : _hi + 1] = False
#: Words between white space: [^\x20\x09-\x0D]+.
BLANK_BYTES = np.zeros(256, bool)
BLANK_BYTES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Bytes of text that are looked at together; a longer text is a slice by itself.
SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def powers(base: int, n: int) -> np.ndarray:
    return _powers(base, max(1 << 20, 1 << int(n).bit_length()))[:n]


@dataclass
class Texts:
    """Rows lo..hi of a record batch: their bytes, and where each begins (with the end as last)."""

    lo: int
    hi: int
    data: np.ndarray
    at: np.ndarray

    def __len__(self) -> int:
        return self.hi - self.lo


@lru_cache(maxsize=1)
def _trim():
    """What gives freed memory of the C library back to the system, where there is such a call."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return lambda _: 0


#: What drops things that an operator remembers in a worker; called when texts of another one are read in it.
REMEMBERED: list[Callable[[], object]] = []


def give_back() -> None:
    """Give back what Arrow and numpy have freed: a worker that lives on for later tasks shouldn't keep the most it ever held."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def release() -> None:
    """Drop what other operators remember, and give back what is free."""
    for drop in REMEMBERED:
        drop()
    give_back()


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Texts]:
    """Cut a string column into runs of whole texts of about `most` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield Texts(lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        lo = hi
    release()


@dataclass
class Words:
    """start, end: byte offsets; hash: of the lower-cased bytes; doc: row within the slice; first: index of each row's first word."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(texts: Texts, inside: np.ndarray = WORD_BYTES, lower: bool = True) -> Words:
    """The maximal runs of bytes for which inside[byte] holds, never across two texts."""
    data, at = texts.data, texts.at
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), none, np.zeros(len(texts) + 1, np.int64))
    word = inside[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    before[at[:-1][at[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, word[1:]
    after[at[1:][at[1:] > 0] - 1] = False
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    low = LOWER[data] if lower else data
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers(int(_BASE), n), out=total[1:])
    hashed = mix((total[end] - total[start]) * powers(int(_INVERSE), n)[start])
    first = np.searchsorted(start, at)
    return Words(start, end, hashed, np.repeat(np.arange(len(texts)), np.diff(first)), first)


def grams(w: Words, n: int, where: np.ndarray | None = None) -> np.ndarray:
    """Hash of the n words from each place on (from the places `where`, if given); places without n words left wrap and must be masked."""
    h = w.hash
    if where is None:
        out = np.zeros(len(h), np.uint64)
        for j in range(n):
            out *= np.uint64(0xD1342543DE82EF95)
            out[: max(0, len(h) - j)] += h[j:]
    else:
        out = np.zeros(len(where), np.uint64)
        for j in range(n):
            out *= np.uint64(0xD1342543DE82EF95)
            out += h[where + j]
    return mix(out + np.uint64(n))


def whole(w: Words, n: int) -> np.ndarray:
    """Whether n words of the same text begin at each place."""
    ok = np.zeros(len(w.hash), bool)
    if len(ok) >= n:
        ok[: len(ok) - n + 1] = w.doc[: len(ok) - n + 1] == w.doc[n - 1 :]
    return ok


def shingles(w: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each n-word shingle in order; a text of fewer words, but not none, is one shingle."""
    ok = whole(w, n)
    at = np.flatnonzero(ok)
    doc, hashed = w.doc[at], grams(w, n)[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    if len(short):
        own = np.array([np.bitwise_xor.reduce(mix(w.hash[w.first[d] : w.first[d + 1]] + powers(int(_BASE), n)[: w.counts[d]])) for d in short], np.uint64)
        doc, hashed = np.concatenate([doc, short]), np.concatenate([hashed, mix(own)])
        order = np.argsort(doc, kind="stable")
        doc, hashed = doc[order], hashed[order]
    return doc, hashed


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum over x[i : i + width] (shorter at the end), by doubling."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:-step]
        have += step
    return out


def sliding_max_back(x: np.ndarray, width: int) -> np.ndarray:
    """Maximum over x[i - width + 1 : i + 1] (shorter at the begin), by doubling."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        if len(out) > step:
            out[step:] = np.maximum(out[step:], out[:-step].copy())
        have += step
    return out


def member(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each value in the sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    i = np.searchsorted(table, values)
    i[i == len(table)] = 0
    return i, table[i] == values


class Bloom:
    """A set of ids in `words` 64-bit words: has() holds for every id of the set, and for few others.

    It spares moving texts that the exact join after it would drop, at any size of the set.
    """

    def __init__(self, ids: DataFrame, words: int = 1 << 20):
        """ids: one bigint column without nulls."""
        bits = ids.mapInArrow(_bloom_bits(words), "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
        table = np.zeros(words, np.uint64)
        table[bits["at"].to_numpy()] = bits["bits"].to_numpy().view(np.uint64)
        self.table = ids.sparkSession.sparkContext.broadcast(table)

    def has(self, ids: np.ndarray) -> np.ndarray:
        table, found = self.table.value, np.ones(len(ids), bool)
        for at, bit in _bloom_places(ids, len(table)):
            found &= (table[at] & bit) != 0
        return found


def _bloom_places(ids: np.ndarray, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for seed in (1, 2):
        h = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        yield (h % np.uint64(words)).astype(np.int64), np.uint64(1) << (h >> np.uint64(58))


def _bloom_bits(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, bit in _bloom_places(batch.column(0).to_numpy(), words):
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bit.view(np.int64))], names=["at", "bits"])

    return run


#: Entries of a side that is broadcast so that texts needn't be shuffled; beyond them Spark joins by shuffle.
SMALL = 500_000


def small(df: DataFrame, entries: Column | None = None) -> DataFrame:
    """df, which is written already, with a hint to broadcast it if it has at most SMALL rows, or entries in them."""
    n = df.agg(F.count("*") if entries is None else F.sum(entries)).first()[0] or 0
    return F.broadcast(df) if n <= SMALL else df


def packed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and all other columns in one struct `rest`, so that no name of theirs can clash with ours."""
    rest = [c for c in df.columns if c not in (id_col, text_col)]
    spare = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(None).cast("int").alias("_"))
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), spare.alias("rest"))


def unpacked(df: DataFrame, like: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Undo packed(): the columns `like`, in that order."""
    own = {id_col: F.col("doc_id"), text_col: F.col("text")}
    return df.select(*[own[c].alias(c) if c in own else F.col(f"rest.`{c}`").alias(c) for c in like])
