"""Language identification by prediction by partial matching (PPM).

For each language a tree of byte contexts of up to ORDER bytes holds how often each byte followed. A byte costs
-log2(c / (n + u)) in the longest context that has seen it, plus -log2(u / (n + u)) for each longer seen context that
has not (escape method C: n bytes, u of them different), and 8 bits below order 0. The statistics are frozen after learning,
so that the code length of a text is a sum over its bytes; the language with the shortest code wins.

A model is fitted on a bounded sample: pieces of PIECE characters of the texts drawn by a hash, SAMPLE_BYTES for each language on
average, and the piece of smallest hash in any case, so that each language is learnt. Its tables
are bounded by the sample, so they are broadcast. Distinct values of lang are taken to be few.

Defined cases: null texts and texts without a letter are `und`, score 0, and so is all when there is nothing to
learn from; rows with a null doc_id are predicted but not learnt from; ties go to the first language in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm import textops as T

ORDER = 3
SAMPLE_BYTES, PIECE = 4 << 20, 4_096
_PAD = 0x0A


def grams(texts: T.Texts) -> np.ndarray:
    """Each byte (A-Z lower-cased) with the ORDER bytes before it, as one number; line feeds stand before a text."""
    b = T.LOWER[texts.data]
    begin = texts.at[:-1][texts.at[:-1] < len(b)]
    out, shifted = b.astype(np.uint32), b
    for k in range(1, ORDER + 1):
        shifted = np.concatenate([np.full(1, _PAD, np.uint8), shifted[:-1]])
        shifted[begin] = _PAD
        out |= shifted.astype(np.uint32) << np.uint32(8 * k)
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang = batch.column("lang").dictionary_encode()
        code, names = lang.indices.to_numpy().astype(np.uint64), lang.dictionary
        seen = []
        for t in T.slices(batch.column("text")):
            seen.append((np.repeat(code[t.lo : t.hi], np.diff(t.at)) << np.uint64(32)) | grams(t))
        both, n = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([names.take(pa.array((both >> np.uint64(32)).astype(np.int64))), pa.array((both & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


class Model:
    def __init__(self, lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        """Counts of grams by language."""
        self.langs = sorted(set(lang.tolist()))
        which = np.searchsorted(np.array(self.langs, object), lang)
        self.codes: list[tuple[np.ndarray, np.ndarray]] = []  # by order: grams, and their cost in each language
        self.escapes: list[tuple[np.ndarray, np.ndarray]] = []  # by order: contexts, and the cost of leaving them
        for k in range(ORDER + 1):
            cut = (gram & (256 ** (k + 1) - 1)).astype(np.uint32)
            keys, at = np.unique(cut, return_inverse=True)
            count = np.zeros((len(keys), len(self.langs)))
            np.add.at(count, (at, which), n)
            contexts, of = np.unique(keys >> np.uint32(8), return_inverse=True)
            total, kinds = (np.zeros((len(contexts), len(self.langs))) for _ in "ab")
            np.add.at(total, of, count)
            np.add.at(kinds, of, count > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0)
                code = -np.log2(count / (total + kinds)[of])
            lower = self._cost(keys & np.uint32(256**k - 1), k - 1) if k else np.full((len(keys), len(self.langs)), 8.0)
            self.codes.append((keys, np.where(count > 0, code, escape[of] + lower).astype(np.float32)))
            self.escapes.append((contexts, escape.astype(np.float32)))

    def _cost(self, gram: np.ndarray, k: int) -> np.ndarray:
        """Bits of each gram's last byte after the k bytes before it, by language."""
        if k < 0:
            return np.full((len(gram), len(self.langs)), 8, np.float32)
        i, found = T.member(gram, self.codes[k][0])
        out = self.codes[k][1][i]
        if not found.all():
            rest = np.flatnonzero(~found)
            j, known = T.member(gram[rest] >> np.uint32(8), self.escapes[k][0])
            out[rest] = self._cost(gram[rest] & np.uint32(256**k - 1), k - 1) + self.escapes[k][1][j] * known[:, None]
        return out

    def bits(self, texts: T.Texts) -> np.ndarray:
        """Code length of each text in each language."""
        total = np.zeros((len(texts), len(self.langs)))
        full = np.flatnonzero(np.diff(texts.at))
        if len(full):
            total[full] = np.add.reduceat(self._cost(grams(texts), ORDER), texts.at[full], axis=0, dtype=np.float64)
        return total


def learn(rows: DataFrame, sample_bytes: int = SAMPLE_BYTES, piece: int = PIECE) -> Model | None:
    """rows: text, lang."""
    turns = F.expr(f"transform(sequence(0, cast((length(text) - 1) div {int(piece)} as int)), k -> pmod(xxhash64(text, k), 1000003))")
    rows = rows.where("lang is not null and length(text) > 0").select("lang", "text", turns.alias("turns"))
    sizes = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"), F.min(F.array_min("turns")).alias("first"))
    bound = sizes.select("lang", F.greatest(F.col("first"), F.floor(F.lit(1_000_003.0 * sample_bytes) / F.col("bytes")) - 1).alias("bound"))
    kept = F.expr(f"filter(transform(turns, (t, k) -> if(t <= bound, substring(text, k * {int(piece)} + 1, {int(piece)}), null)), p -> p is not null)")
    drawn = rows.join(F.broadcast(bound), "lang").where("array_min(turns) <= bound").select("lang", F.explode(kept).alias("text"))
    counts = drawn.mapInArrow(_counted, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return Model(counts["lang"].to_numpy(object), counts["gram"].to_numpy(), counts["n"].to_numpy()) if len(counts) else None


def _identified(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = known.value
        names = pa.array(model.langs, pa.string())
        for batch in batches:
            best, score = [], []
            for t in T.slices(batch.column("text"), max(1 << 16, T.SLICE_BYTES * 4 // len(model.langs))):
                bits = model.bits(t)
                best.append(bits.argmin(1))
                score.append(1 / np.exp2(bits.min(1, keepdims=True) - bits).sum(1))
            pick, score = (np.concatenate(x) if x else np.zeros(0) for x in (best, score))
            told = pa.compute.is_valid(batch.column("text"))
            lang = pa.compute.if_else(told, names.take(pa.array(pick.astype(np.int64))), "und")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rest"), lang, pa.compute.if_else(told, pa.array(score.astype(float)), 0.0)], names=["doc_id", "rest", "lang_pred", "score"])

    return run


def identify(spark: SparkSession, docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, rest, lang_pred, score of each document; only the text decides."""
    rows = T.packed(docs).withColumn("text", F.when(F.col("text").rlike(r"\p{L}"), F.col("text")))
    if model is None:
        return rows.select("doc_id", "rest", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(_identified(spark.sparkContext.broadcast(model)), rows.drop("text").schema.add("lang_pred", "string").add("score", "double"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = learn(docs.where(fold != 1).select("text", "lang"))
    return identify(spark, docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
