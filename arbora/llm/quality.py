"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

A document is a few statistics of its whole text. Random cosine features of them approximate a Gaussian kernel; each
partition sums its part of the normal equations, for two folds apart, and the sums are fitted by ridge regression.
Each fold is scored by the other's fit; from these scores, counted in fine bins, isotonic regression learns how likely label 1
is. The final fit is on both folds' sums.

The fit uses a bounded sample: at most about MOST_LABELS labelled documents, drawn by a hash of doc_id. All
documents are scored.

Defined cases: null and empty texts have statistics of 0 and are scored like any other; null ids and null labels are not
learnt from; a document with several labels counts with the smallest; without labels, or with one kind only,
every score is the mean label (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm import textops as T
from arbora.session import persisted

FEATURES, RIDGE, MOST_LABELS, BINS, SEED = 256, 1e-3, 50_000, 2_000, 17


def _bytes(*spans: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in spans:
        out[lo : hi + 1] = True
    return out


UPPER, LETTER, DIGIT, HIGH = _bytes((65, 90)), _bytes((65, 90), (97, 122)), _bytes((48, 57)), _bytes((128, 255))
SIGN = _bytes((33, 47), (58, 64), (91, 96), (123, 126))
STOP, LINE, SHOUT, BAR, PLAIN = _bytes((46, 46)), _bytes((10, 10)), _bytes((33, 33)), _bytes((124, 124)), _bytes((44, 44), (46, 46))
STATISTICS = 18


def statistics(t: T.Texts) -> np.ndarray:
    """One row of STATISTICS numbers for each text."""
    out = np.zeros((len(t), STATISTICS))
    if not len(t.data):
        return out

    def count(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(mask, dtype=np.int64))[at])

    n = np.diff(t.at)
    per = np.maximum(n, 1)
    upper, letter, digit, high, sign, stop, line, shout, bar, plain = (count(m[t.data], t.at) for m in (UPPER, LETTER, DIGIT, HIGH, SIGN, STOP, LINE, SHOUT, BAR, PLAIN))
    w = T.words(t, ~T.BLANK_BYTES)
    size, words = w.end - w.start, np.maximum(w.counts, 1)
    again = np.zeros(len(size), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    last = t.data[w.end - 1] if len(size) else np.zeros(0, np.uint8)

    def distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many kinds each row has, and how often its most frequent one occurs."""
        both = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
        begin = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
        run, owner = np.diff(np.append(begin, len(both))), (both[begin] >> np.uint64(44)).astype(np.int64)
        most = np.zeros(len(t), np.int64)
        np.maximum.at(most, owner, run)
        return np.bincount(owner, minlength=len(t)), most

    kinds, most = distinct(w.hash, w.doc)
    pair = T.whole(w, 2)
    pairs, most_pair = distinct(T.grams(w, 2)[pair], w.doc[pair])
    columns = [
        np.log1p(n), np.log1p(w.counts), count(np.ones(len(t.data), bool) & ~T.BLANK_BYTES[t.data], t.at) / words, kinds / words, upper / np.maximum(letter, 1), digit / per, high / per, (sign - plain) / per,
        stop / words, np.log1p(words / (line + 1)), 4 * shout / per, 4 * bar / per, count(again, w.first) / words, most / words, pairs / np.maximum(words - 1, 1), most_pair / words, count(size <= 3, w.first) / words, count(SIGN[last] & ~PLAIN[last], w.first) / words,
    ]
    return np.where(n[:, None] > 0, np.stack(columns, 1), 0.0)


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    turn: np.ndarray  # statistics x features
    phase: np.ndarray
    weight: np.ndarray  # of the features, and of 1
    at: np.ndarray  # raw scores, rising
    to: np.ndarray  # and the chance of label 1 there

    def lifted(self, x: np.ndarray) -> np.ndarray:
        z = np.cos((x - self.mean) / self.spread @ self.turn + self.phase) * np.sqrt(2 / len(self.phase))
        return np.hstack([z, np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.lifted(x) @ self.weight, self.at, self.to)


def isotonic(at: np.ndarray, n: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points in rising order: their place, number and hits. Returns mean place and rate of each pool."""
    pools: list[list[float]] = []
    for x, k, h in zip(at, n, hits, strict=True):
        pools.append([x * k, k, h])
        while len(pools) > 1 and pools[-2][2] / pools[-2][1] >= pools[-1][2] / pools[-1][1]:
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top, strict=True)]
    return np.array([p[0] / p[1] for p in pools]), np.array([p[2] / p[1] for p in pools])


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [statistics(t) for t in T.slices(batch.column("text"))]
        x = np.concatenate(found) if found else np.zeros((0, STATISTICS))
        yield pa.RecordBatch.from_arrays([batch.column("fold"), batch.column("y"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), STATISTICS).cast(pa.list_(pa.float64()))], names=["fold", "y", "x"])


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS, features: int = FEATURES) -> Model:
    """docs: doc_id, text. labels: doc_id, quality (0 or 1)."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("y"))
    share = min(1.0, most / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003).select(F.col("doc_id").alias("__id"), "y", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int").alias("fold"))
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("__id")).select("text", F.col("y").cast("double").alias("y"), "fold")
    rows = persisted(rows.mapInArrow(_statistics, "fold int, y double, x array<double>"), "statistics")
    sums = rows.agg(F.count("*").alias("n"), F.avg("y").alias("y"), *[f(F.col("x")[i]).alias(f"{f.__name__}{i}") for i in range(STATISTICS) for f in (F.avg, F.stddev_pop)]).first()
    draw = np.random.default_rng(SEED)
    model = Model(np.zeros(STATISTICS), np.ones(STATISTICS), draw.normal(size=(STATISTICS, features)) / np.sqrt(STATISTICS), draw.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.zeros(1), np.full(1, 0.5 if sums["y"] is None else sums["y"]))
    if not sums["n"] or sums["y"] in (0.0, 1.0):
        return model
    model.mean, model.spread = np.array([sums[f"avg{i}"] for i in range(STATISTICS)]), np.array([sums[f"stddev_pop{i}"] for i in range(STATISTICS)])
    model.spread[model.spread < 1e-9] = 1
    size = features + 1
    i, j = np.triu_indices(size)
    lift = model.lifted  # by value: mean, spread, turn and phase

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {f: (np.zeros((size, size)), np.zeros(size), 0) for f in (0, 1)}
        for pdf in batches:
            for f in (0, 1):
                own = pdf[pdf["fold"] == f]
                if len(own):
                    z, y = lift(np.stack(own["x"])), own["y"].to_numpy()
                    a, b, n = total[f]
                    total[f] = a + z.T @ z, b + z.T @ y, n + len(own)
        for f, (a, b, n) in total.items():
            if n:
                yield pd.DataFrame({"fold": f, "cell": np.arange(len(i)), "v": a[i, j]})
                yield pd.DataFrame({"fold": f, "cell": -1 - np.arange(size), "v": b})

    summed = rows.coalesce(64).mapInPandas(equations, "fold int, cell int, v double").groupBy("fold", "cell").agg(F.sum("v").alias("v")).toPandas()

    def solved(folds: list[int]) -> np.ndarray:
        v = summed[summed["fold"].isin(folds)].groupby("cell")["v"].sum()
        a = np.zeros((size, size))
        a[i, j] = v.reindex(np.arange(len(i)), fill_value=0.0)
        a = a + np.triu(a, 1).T
        n = max(1.0, a[-1, -1])
        return np.linalg.solve(a + RIDGE * n / size * np.diag(np.append(np.ones(features), 1e-6)), v.reindex(-1 - np.arange(size), fill_value=0.0))

    other = {0: solved([1]), 1: solved([0])}

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                z = lift(np.stack(pdf["x"]))
                raw = np.where(pdf["fold"] == 0, z @ other[0], z @ other[1])
                yield pd.DataFrame({"bin": np.clip(np.round((raw + 1) / 3 * BINS), 0, BINS).astype(int), "y": pdf["y"]})

    points = rows.mapInPandas(binned, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("hits")).orderBy("bin").toPandas()
    model.at, model.to = isotonic(points["bin"].to_numpy() / BINS * 3 - 1, points["n"].to_numpy(), points["hits"].to_numpy())
    model.weight = solved([0, 1])
    return model


def _scored(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = known.value
        for batch in batches:
            found = [model.score(statistics(t)) for t in T.slices(batch.column("text"))]
            score = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "score"])

    return run


def scored(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """packed(docs) with the score of each document."""
    rows = T.packed(docs)
    return rows.mapInArrow(_scored(spark.sparkContext.broadcast(model)), rows.select("*").schema.add("score", "double"))


def accepted(spark: SparkSession, docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents, all columns, that score `least` or more under a model fitted on those that are labelled."""
    model = learn(spark, docs, labels)
    return T.unpacked(scored(spark, docs, model).where(F.col("score") >= least), docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = learn(spark, docs, labels.where(fold != 1))
    out = scored(spark, docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
