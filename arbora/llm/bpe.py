"""Byte-level BPE encoding and decoding with overlapping chunks.

A text of more than `chunk` characters is cut into chunks that overlap by `overlap`; the chunks are
pre-tokenised and encoded in parallel. A pre-token that ends before its chunk does depends on nothing
behind it, so from the first boundary that two neighbours share in their overlap they go on alike: there
they are stitched. Where the overlap holds no common boundary, the text from the last certain boundary is
pre-tokenised again up to one. Each pre-token is encoded by itself; decoding concatenates the raw bytes of
the ids.

Defined cases: null and empty texts have no tokens; repeated rows are encoded each; other columns are kept
apart in a struct, so their names cannot clash.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm import textops as T
from arbora.session import persisted

CHUNK, OVERLAP = 32_768, 1_024
#: Bytes of a pre-token up to which merges are found without a heap.
SHORT = 32
#: Pre-tokens that a worker remembers at most, of at most so many bytes each: the half that came last, and the half before.
REMEMBERED, LONGEST = 400_000, 64
#: Documents that are encoded, and chunks that are pre-tokenised, before they are handed on; ids that are decoded at once.
ROWS, CHUNKS, IDS = 128, 16, 1 << 16


class Ids(dict):
    """Pre-token -> its ids as decimal text."""

    def __init__(self, codec: Codec):
        self.codec, self.before = codec, {}

    def __missing__(self, piece: str) -> str:
        if (out := self.before.get(piece)) is None:
            raw = piece.encode()
            out = " ".join(map(str, self.codec.merge(raw)))
            if len(raw) > LONGEST:
                return out
        if len(self) >= REMEMBERED // 2:
            self.before = dict(self)
            self.clear()
        self[piece] = out
        return out


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.vocabulary = ranks, {i: b for b, i in ranks.items()}
        self.pattern, self.ids = regex.compile(pattern), Ids(self)

    def merge(self, piece: bytes) -> list[int]:
        """Join the neighbours of lowest rank, the leftmost first, until no two neighbours have a rank."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        if n <= SHORT:
            return self._short(piece)
        part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            if part[i] is None or (j := after[i]) >= n or len(part[i]) + len(part[j]) != size:
                continue
            part[i] += part[j]
            part[j] = None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(both := part[i] + part[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, len(both)))
            if (k := before[i]) >= 0 and (r := ranks.get(both := part[k] + part[i])) is not None:
                heapq.heappush(heap, (r, k, len(both)))
        return [ranks[p] for p in part if p is not None]

    def _short(self, piece: bytes) -> list[int]:
        """The same by looking at all neighbours each time, which is faster for few."""
        ranks, none = self.ranks, 1 << 62
        part = [piece[i : i + 1] for i in range(len(piece))]
        joined = [ranks.get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while joined and (least := min(joined)) < none:
            i = joined.index(least)
            part[i] += part.pop(i + 1)
            joined.pop(i)
            if i < len(joined):
                joined[i] = ranks.get(part[i] + part[i + 1], none)
            if i:
                joined[i - 1] = ranks.get(part[i - 1] + part[i], none)
        return [ranks[p] for p in part]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))

    def encoded(self, pieces: list[str]) -> tuple[str, bytes, np.ndarray]:
        """The ids as decimal text, the bytes they decode to, and the ids."""
        text = " ".join(map(self.ids.__getitem__, pieces))
        ids = np.fromstring(text, np.int32, sep=" ") if text else np.zeros(0, np.int32)
        return text, b"".join(self.decode(ids[i : i + IDS].tolist()) for i in range(0, len(ids), IDS)), ids


@lru_cache(maxsize=4)
def _codec(ranks: bytes, pattern: str) -> Codec:
    return Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, pattern)


def _forget() -> None:
    """Drop the codecs and the pre-tokens they remember: the workers live on for other operators' tasks."""
    if _codec.cache_info().currsize:
        _codec.cache_clear()
        gc.collect()


T.REMEMBERED.append(_forget)

OUT = "n_tokens bigint, ids_sha256 string, decoded_sha256 string, ids array<int>"


def _row(codec: Codec, pieces: list[str], with_ids: bool):
    text, raw, ids = codec.encoded(pieces)
    return len(ids), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(raw).hexdigest(), ids if with_ids else None


def _whole(ranks, pattern: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern)
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                part = batch.slice(lo, ROWS)
                rows = [_row(codec, codec.pattern.findall(text or ""), with_ids) for text in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("rest"), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())), strict=True))],
                    names=["doc_id", "rest", "n_tokens", "ids_sha256", "decoded_sha256", "ids"],
                )
                del rows
            T.give_back()

    return run


def cut(text: str, chunk: int, overlap: int) -> list[str]:
    return [text[i : i + chunk + overlap] for i in range(0, max(1, len(text)), chunk)]


def starts(codec: Codec, text: str) -> np.ndarray:
    """Where each pre-token begins, and the end."""
    return np.array([m.start() for m in codec.pattern.finditer(text)] + [len(text)], np.int64)


def stitched(codec: Codec, chunks: list[str], begins: list[np.ndarray], chunk: int) -> list[str]:
    """The pre-tokens of the text that was cut into `chunks`, whose own boundaries are `begins`."""
    pieces: list[str] = []
    p = 0  # a boundary of the whole text, within the chunk at hand
    text, own = chunks[0], begins[0]
    base = 0
    for k in range(1, len(chunks)):
        nxt = begins[k] + (k * chunk - base)
        while True:
            sure = own[own <= len(text) - 1]  # a boundary at the very end may be the cut's
            both = np.intersect1d(sure[sure >= max(p, k * chunk - base)], nxt)
            if len(both) or base + len(text) >= k * chunk + len(chunks[k]):
                break
            # No common boundary in the overlap: go on from the last certain one over the next chunk's text too.
            p_new = int(sure[sure >= p][-1])
            cuts = own[(own >= p) & (own <= p_new)]
            pieces += [text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            text = text[p_new:] + chunks[k][base + len(text) - k * chunk :]
            base, p = base + p_new, 0
            own, nxt = starts(codec, text), begins[k] + (k * chunk - base)
        if len(both):
            q = int(both[0])
            cuts = own[(own >= p) & (own <= q)]
            pieces += [text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            p, base, text, own = base + q - k * chunk, k * chunk, chunks[k], begins[k]
    cuts = own[own >= p]
    return pieces + [text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _cut(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                parts = cut(row.column("text")[0].as_py(), chunk, overlap)
                same = row.take(pa.array([0] * len(parts)))
                yield pa.RecordBatch.from_arrays([same.column("key"), pa.array(range(len(parts)), pa.int32()), pa.array(parts)], names=["key", "k", "part"])

    return run


def _boundaries(ranks, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern)
        for batch in batches:
            for lo in range(0, len(batch), CHUNKS):
                part = batch.slice(lo, CHUNKS)
                found = [starts(codec, t) for t in part.column("part").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("k"), part.column("part"), pa.array(found, pa.list_(pa.int64()))], names=["key", "k", "part", "begins"])
            T.give_back()

    return run


def encode(spark: SparkSession, docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, with_ids: bool = True) -> DataFrame:
    """doc_id, rest, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids."""
    with open(ranks_path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    rows = T.packed(docs)
    kind = rows.drop("text").schema
    for field in spark.createDataFrame([], OUT).schema:
        kind = kind.add(field)
    short = rows.where(F.coalesce(F.length("text"), F.lit(0)) <= chunk).mapInArrow(_whole(ranks, pattern, with_ids), kind)
    long = persisted(rows.where(F.length("text") > chunk).withColumn("key", F.monotonically_increasing_id()), "long")  # so that a key stays with its text

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        codec = _codec(ranks.value, pattern)
        pdf = pdf.sort_values("k")
        row = _row(codec, stitched(codec, list(pdf["part"]), [np.asarray(x) for x in pdf["begins"]], chunk), with_ids)
        return pd.DataFrame({"key": pdf["key"].iloc[:1].to_numpy(), **{n: [v] for n, v in zip(("n_tokens", "ids_sha256", "decoded_sha256", "ids"), row, strict=True)}})

    parts = long.select("key", "text").mapInArrow(_cut(chunk, overlap), "key bigint, k int, part string").repartition(F.xxhash64("key", "k"))
    done = parts.mapInArrow(_boundaries(ranks, pattern), "key bigint, k int, part string, begins array<bigint>").groupBy("key").applyInPandas(joined, f"key bigint, {OUT}")
    return short.unionByName(long.select("key", "doc_id", "rest").join(done, "key").drop("key"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(spark, docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
