"""Benchmark decontamination by winnowing.

The smallest k-gram hash of every sliding window of w grams is a fingerprint; a span of w + k - 1 words
that two texts share holds a fingerprint of both, so joining fingerprints finds every shared window.
Around a document's fingerprint that a Bloom filter of the benchmark's fingerprints does not rule out, it is extended to the whole
windows of `window` = w + k - 1 words that hold it; these are joined with the windows of the items, each known by two
64-bit hashes of its words. An item of fewer words than a window is one window of all its words (k = its length, w = 1).
The filter has a fixed size and only spares rows that the join would drop, so a benchmark may be of any size; a document's windows that
are equal enter the join once, and a window of many documents is a skewed join, which Spark splits.

Defined cases: null and word-less texts have no words and no hits; null items and items without words hit
nothing; null item ids are passed over; repeated rows and repeated items each count for themselves, an id once;
an empty benchmark leaves all documents clean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.llm import textops as T
from arbora.session import persisted

WINDOW, GRAM = 10, 5
WINDOWS = pa.struct([("n", pa.int32()), ("hash", pa.int64()), ("check", pa.int64()), ("starts", pa.list_(pa.int32()))])


def winnowed(grams: np.ndarray, width: int) -> np.ndarray:
    """Whether each gram is the smallest of some window of `width` grams (all equal ones are)."""
    return T.sliding_max_back(T.sliding_min(grams, width), width) == grams


def fingerprints(w: T.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of the fingerprints of texts of at least `window` words."""
    g, ok = T.grams(w, gram), T.whole(w, gram)
    g[~ok] = np.iinfo(np.uint64).max
    at = np.flatnonzero(winnowed(g, window - gram + 1) & ok & (w.counts >= window)[w.doc])
    return at, g[at]


def _hashes(w: T.Words, n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the n words from each place on."""
    return tuple(T.grams(x, n, at).view(np.int64) for x in (w, replace(w, hash=T.mix(w.hash ^ np.uint64(0x2545F4914F6CDD1D)))))


def _asked(hashes: np.ndarray, n: int) -> np.ndarray:
    """What a window of n words is called in the filter; fingerprints go by their own hash."""
    return T.mix(hashes.view(np.uint64) + np.uint64(n)).view(np.int64)


def _items(window: int, gram: int):
    """item_id, n, hash, check of each item's windows, and with n = 0 its fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in T.slices(batch.column("text")):
                w = T.words(t)
                at, prints = fingerprints(w, window, gram)
                parts = [(w.doc[at], 0, prints.view(np.int64), np.zeros(len(at), np.int64))]
                for n in range(1, window + 1):
                    at = np.flatnonzero(T.whole(w, n)) if n == window else w.first[:-1][w.counts == n]
                    parts.append((w.doc[at], n, *_hashes(w, n, at)))
                for row, n, h, check in parts:
                    if len(row):
                        ids = batch.column("item_id").take(pa.array(row + t.lo))
                        yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(row), n, np.int32)), pa.array(h), pa.array(check)], names=["item_id", "n", "hash", "check"])

    return run


def _scan(known: T.Bloom, lengths: list[int], window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = window - gram + 1
        for batch in batches:
            for t in T.slices(batch.column("text")):
                w = T.words(t)
                parts = []
                for n in lengths:
                    ok = T.whole(w, n)
                    if n == window:
                        at, prints = fingerprints(w, window, gram)
                        at = at[known.has(prints.view(np.int64))]
                        at = np.unique((at[:, None] - np.arange(width)).ravel())
                        at = at[at >= 0]
                        at = at[ok[at]]
                    else:
                        at = np.flatnonzero(ok)
                    h, check = _hashes(w, n, at)
                    met = known.has(_asked(h, n))
                    parts.append((w.doc[at[met]], np.full(met.sum(), n), h[met], check[met], at[met]))
                row, n, h, check, at = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 5
                order = np.lexsort((at, check, h, n, row))
                row, n, h, check, at = (x[order] for x in (row, n, h, check, at))
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (n[1:] != n[:-1]) | (h[1:] != h[:-1]) | (check[1:] != check[:-1])
                own = np.flatnonzero(new)
                starts = pa.ListArray.from_arrays(pa.array(np.append(own, len(row)).astype(np.int32)), pa.array((at - w.first[row]).astype(np.int32)))
                windows = pa.StructArray.from_arrays([pa.array(n[own].astype(np.int32)), pa.array(h[own]), pa.array(check[own]), starts], fields=list(WINDOWS))
                cut = pa.array(np.searchsorted(row[own], np.arange(len(t) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(t.lo, len(t)) for c in ("row", "doc_id", "text_hash")), pa.array(w.counts), pa.ListArray.from_arrays(cut, windows)], names=["row", "doc_id", "text_hash", "n_words", "windows"])

    return run


def scan(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """row, doc_id, text_hash, n_words of each document; and row, spans (structs of begin and end, in words), items (ids, sorted) of those that are hit."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    known = persisted(items.mapInArrow(_items(window, gram), "item_id string, n int, hash bigint, check bigint").distinct(), "windows")
    lengths = sorted(r[0] for r in known.where("n > 0").select("n").distinct().collect())
    bloom = T.Bloom(known.where("n = 0").select("hash").union(known.where("n > 0").mapInArrow(_named, "hash bigint")))
    rows = T.packed(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), "text")
    kind = f"row bigint, doc_id {dict(rows.dtypes)['doc_id']}, text_hash bigint, n_words bigint, windows array<struct<n: int, hash: bigint, check: bigint, starts: array<int>>>"
    found = rows.mapInArrow(_scan(bloom, lengths, window, gram), kind)
    found = persisted(found, "scanned")
    met = found.where(F.size("windows") > 0).select("row", F.explode("windows").alias("w")).select("row", "w.*").join(known.where("n > 0"), ["n", "hash", "check"])
    met = persisted(met.select("row", "n", "starts", "item_id"), "met")
    order = Window.partitionBy("row").orderBy("begin", "end")
    runs = met.select("row", "n", F.explode("starts").alias("begin")).select("row", "begin", (F.col("begin") + F.col("n")).alias("end")).distinct()
    runs = runs.withColumn("before", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    runs = runs.withColumn("run", F.sum((F.col("before").isNull() | (F.col("begin") > F.col("before"))).cast("int")).over(order))
    runs = runs.groupBy("row", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    spans = runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans"))
    items = met.select("row", "item_id").distinct().groupBy("row").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    return found.drop("windows"), persisted(spans.join(items, "row"), "hits")


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.column("n").to_numpy()
        for k in np.unique(n).tolist():
            yield pa.RecordBatch.from_arrays([pa.array(_asked(batch.column("hash").to_numpy()[n == k], k))], names=["hash"])


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items, spans, contaminated."""
    found, hits = scan(spark, docs, benchmark, **options)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["begin"])
    out = found.join(hits, "row", "left").withColumn("contaminated", F.col("spans").isNotNull())
    out = out.withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<begin: int, end: int>>)"))).withColumn("items", F.coalesce("items", F.expr("cast(array() as array<string>)")))
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), "items", "spans", "contaminated")


def without_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents, all columns, that share no window with the benchmark."""
    found, hits = scan(spark, docs, benchmark, **options)
    gone = persisted(found.join(hits.select("row"), "row", "left_semi").select(F.col("doc_id").alias("__gone"), F.col("text_hash").alias("__text")).distinct(), "leaks")
    gone = T.small(gone)
    rows = T.packed(docs)
    return T.unpacked(rows.join(gone, rows["doc_id"].eqNullSafe(gone["__gone"]) & (F.xxhash64(rows["text"]) == gone["__text"]), "left_anti"), docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontaminate(spark, docs, items).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated"
    )
