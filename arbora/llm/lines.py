"""Line dedup: lines that many documents hold stay in one of them, by levelled sorted runs of line hashes.

Documents come in batches. What is known of the lines so far lies in runs: tables of (key, docs, owner), bucketed by key and sorted within the
buckets, so that a batch is merged with them without moving them. A batch is anti-joined with the keys that are settled already (enough
documents, and the owner from an earlier batch), which therefore enter no further run; the rest is written as a run of its own. Two runs of one
level are compacted into one of the next, with summed counts. At the end the settled keys' lines go from all documents but their owners.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm import textops as T
from arbora.session import persisted, shared_dir

#: Code points of a key, and documents that hold it.
LEAST = 40
DOCUMENTS = 5
#: Batches that a whole table is cut into, and lines in a bucket of a run.
BATCHES = 6
PER_BUCKET = 1 << 20
MOST_BUCKETS = 100_000
_BREAK = 0x0A


def keys(texts: T.Texts, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Where the lines of all texts begin and end, in order; the lines that are long enough, and their keys: 128-bit hashes of the line without white
    space around it, in lower case."""
    data, at = texts.data, texts.at
    cuts = np.flatnonzero(data == _BREAK)
    begin, end = np.sort(np.concatenate([at[:-1], cuts + 1])), np.sort(np.concatenate([at[1:], cuts]))
    solid = np.flatnonzero(~T.BLANK_BYTES[data])
    a, b = np.searchsorted(solid, begin), np.searchsorted(solid, end)
    full = np.flatnonzero(a < b)
    lo, hi = solid[a[full]], solid[b[full] - 1] + 1
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    long = points[hi] - points[lo] >= least
    low = T.LOWER[data].tobytes()
    found = [blake2b(low[x:y], digest_size=16).digest() for x, y in zip(lo[long].tolist(), hi[long].tolist(), strict=True)]
    return begin, end, full[long], found


def _first(texts: T.Texts) -> np.ndarray:
    """Index of the first line of each text, and the number of all."""
    breaks = np.concatenate([[0], np.cumsum(texts.data == _BREAK)])[texts.at]
    return breaks + np.arange(len(texts) + 1)


def _lines(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in T.slices(batch.column("text")):
                _, _, line, found = keys(texts, least)
                doc = np.searchsorted(_first(texts), line, "right") - 1
                once = sorted(set(zip(doc.tolist(), found, strict=True)))
                rows = batch.column("doc_id").take(pa.array([texts.lo + d for d, _ in once], pa.int64()))
                yield pa.RecordBatch.from_arrays([rows, pa.array([k for _, k in once], pa.binary())], names=["doc_id", "key"])

    return run


def lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, key of every long line, once for each row of docs (doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(_lines(least), f"doc_id {dict(docs.dtypes)['doc_id']}, key binary")


class LineRuns:
    """What is known of lines: at most one run a level, each a bucketed table in the shared folder; a second one of a level is merged with the first into the next."""

    def __init__(self, spark: SparkSession, buckets: int, documents: int = DOCUMENTS):
        self.spark, self.buckets, self.documents = spark, buckets, documents
        self.levels: list[str | None] = []
        self.batches = 0
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.made = 0

    def _path(self, table: str) -> str:
        return f"{shared_dir(self.spark)}/arbora/{self.spark.sparkContext.applicationId}/{table}"

    def _run(self, rows: DataFrame) -> str:
        """Write key, docs, owner, batch; rows are dealt out by key already, so that each bucket is one sorted file."""
        self.made += 1
        table = f"{self.name}_{self.made}"
        rows.write.bucketBy(self.buckets, "key").sortBy("key").option("path", self._path(table)).option("compression", "lz4").saveAsTable(table)
        return table

    def _forget(self, table: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(table))
        self.spark.sql(f"DROP TABLE {table}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _merged(self, early: str, late: str) -> str:
        """One run of two, merge-joined bucket by bucket: the owner of a key is the largest document of the earliest batch that holds it."""
        a, b = (self.spark.table(t).select("key", *[F.col(c).alias(f"{side}_{c}") for c in ("docs", "owner", "batch")]) for t, side in ((early, "a"), (late, "b")))
        first = F.col("b_batch").isNull() | (F.col("a_batch") <= F.col("b_batch"))
        rows = a.hint("merge").join(b, "key", "full").select(
            "key", (F.coalesce("a_docs", F.lit(0)) + F.coalesce("b_docs", F.lit(0))).alias("docs"), F.when(first, F.col("a_owner")).otherwise(F.col("b_owner")).alias("owner"), F.least("a_batch", "b_batch").alias("batch")
        )
        out = self._run(rows)
        for t in (early, late):
            self._forget(t)
        return out

    def unsettled(self, own: DataFrame) -> DataFrame:
        """Rows of own, dealt out by key, whose key isn't settled: own is merge-joined with run after run, bucket by bucket, and no run is moved."""
        columns, known = own.columns, F.lit(0)
        for k, t in enumerate(filter(None, self.levels)):
            own = own.join(self.spark.table(t).select("key", F.col("docs").alias(f"_{k}")).hint("merge"), "key", "left")
            known += F.coalesce(f"_{k}", F.lit(0))
        return own.where(known < self.documents).select(columns)

    def add(self, held: DataFrame) -> None:
        """held: doc_id, key as lines() gives them, of documents that no earlier batch had."""
        own = held.distinct().repartition(self.buckets, "key").groupBy("key").agg(F.count("*").alias("docs"), F.max("doc_id").alias("owner")).withColumn("batch", F.lit(self.batches))
        run, k = self._run(self.unsettled(own)), 0
        self.batches += 1
        while k < len(self.levels) and self.levels[k]:
            run, self.levels[k], k = self._merged(self.levels[k], run), None, k + 1
        self.levels[k : k + 1] = [run]

    def settled(self) -> DataFrame:
        """key, docs, owner of what enough documents hold, after all runs are compacted into one; docs counts up to the batch in which a key was settled. Needs a batch."""
        runs = [t for t in self.levels if t]
        while len(runs) > 1:  # the latest are the smallest
            runs[:2] = [self._merged(runs[1], runs[0])]
        self.levels = [None] * (len(self.levels) - 1) + runs
        return self.spark.table(runs[0]).where(F.col("docs") >= self.documents).select("key", "docs", "owner")

    def forget(self) -> None:
        for table in filter(None, self.levels):
            self._forget(table)
        self.levels = []


def _kept(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = batch.column("gone")
            for texts in T.slices(batch.column("text")):
                first = _first(texts)
                n = np.diff(first)
                dropped = np.zeros(len(texts), np.int64)
                raw = texts.data.tobytes()
                begin, end, line, found = keys(texts, least)
                out, before = [], np.searchsorted(line, first)
                for i in range(len(texts)):
                    own = gone[texts.lo + i].as_py()
                    if own:
                        own = set(own)
                        out_ = {int(line[k]) for k in range(before[i], before[i + 1]) if found[k] in own}
                        dropped[i] = len(out_)
                        out.append(b"\n".join(raw[begin[j] : end[j]] for j in range(first[i], first[i + 1]) if j not in out_))
                    else:
                        out.append(raw[texts.at[i] : texts.at[i + 1]])
                part = batch.slice(texts.lo, len(texts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("rest"), pa.array(out, pa.binary()).cast(pa.string()), pa.array(n), pa.array(dropped)], names=["doc_id", "rest", "text", "n_lines", "n_dropped"])

    return run


def without_repeated_lines(spark: SparkSession, docs: DataFrame, least: int = LEAST, documents: int = DOCUMENTS, batches: int = BATCHES) -> DataFrame:
    """docs (doc_id, text and any further columns) -> doc_id, rest (the further columns), text (without the lines that go), n_lines (before), n_dropped.

    Lines are cut at line feeds alone. A key that at least `documents` documents hold stays in the one of largest doc_id; there all its lines do.
    A document is its doc_id: rows of one id are one document when they are counted and each keep their own row. A null doc_id is a document too, and
    smaller than all others. A null or empty text is one empty line; its text comes out empty. If all lines go, the text is empty. Batches go from the largest ids down, so
    that the owner of a key is in the first batch that holds it.
    """
    rows = T.packed(docs)
    held = persisted(lines(rows, least), "lines")
    buckets = int(np.clip(-(-held.count() // PER_BUCKET), 4, MOST_BUCKETS))
    bounds = held.approxQuantile("doc_id", [k / batches for k in range(batches - 1, 0, -1)], 0.01) if batches > 1 else []
    bounds = [int(b) for b in dict.fromkeys(bounds)]
    runs = LineRuns(spark, buckets, documents)
    upper = None
    for low in [*bounds, None]:
        part = held if low is None else held.where(F.col("doc_id") >= low)
        if upper is not None:
            part = part.where((F.col("doc_id") < upper) | F.col("doc_id").isNull()) if low is None else part.where(F.col("doc_id") < upper)
        runs.add(part)
        upper = low
    settled = persisted(runs.settled(), "settled")
    runs.forget()
    gone = held.join(T.small(settled.select("key", "owner")), "key").where(~F.col("doc_id").eqNullSafe(F.col("owner")))
    gone = persisted(gone.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("key").alias("gone")), "gone")
    met = rows.join(T.small(gone, F.size("gone")), F.col("doc_id").eqNullSafe(F.col("id")), "left")
    kinds = dict(rows.dtypes)
    return met.select("doc_id", "rest", "text", "gone").mapInArrow(_kept(least), f"doc_id {kinds['doc_id']}, rest {kinds['rest']}, text string, n_lines bigint, n_dropped bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_repeated_lines(spark, docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = f"""
WITH l AS (SELECT row, doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents)),
k AS (SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= {LEAST} GROUP BY key HAVING count(DISTINCT coalesce(doc_id, -9223372036854775808)) >= {DOCUMENTS}),
d AS (SELECT k.*, owner IS NOT NULL AND doc_id IS DISTINCT FROM owner AS gone FROM k LEFT JOIN f USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM d GROUP BY row
"""
