"""Vector code compression: vectors as four bytes, each the index of the nearest entry in the codebook of its part.

Everything is whole numbers, so that the codes do not depend on the order of any sum. The codebooks (256 entries for each of four parts) are
broadcast; tasks work out all distances of an Arrow batch by |x|^2 - 2xc + |c|^2 with exact 64-bit matrix products and take the first least.
Each task sums the vectors of each entry, and a grouped shuffle merges these sums in each round.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm import textops as T
from arbora.session import persisted

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Vectors whose distances are worked out at once: a matrix of 4,096 x 256 numbers.
BLOCK = 4_096


def finite(embedding: Column) -> Column:
    """Whether a vector is there and all of its components are numbers."""
    return F.coalesce(F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def largest(size: int) -> int:
    """The largest component (as a whole number) with which no distance of vectors of this size leaves 64 bits."""
    return isqrt((2**63 - 1) // (4 * max(1, size)))


def whole(embedding: Column) -> Column:
    """Components as whole numbers; those that 64 bits cannot hold as the largest they can, which is beyond largest()."""
    return F.transform(embedding, lambda v: F.floor(v.cast("double") * SCALE))


def _integers(column: pa.Array, size: int) -> np.ndarray:
    """Rows x parts x components of a part; a size that four does not divide is filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    width = -(-size // PARTS) * PARTS
    out = np.zeros((len(column), width), np.int64)
    out[:, :size] = flat.reshape(len(column), size)
    return out.reshape(len(column), PARTS, width // PARTS)


def nearest(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of rows x parts x components: the index of each part's nearest entry (the first of equal ones) and the squared distance."""
    index, distance = np.empty(x.shape[:2], np.int64), np.empty(x.shape[:2], np.int64)
    for part, book in enumerate(books):
        norms = (book * book).sum(1)
        for lo in range(0, len(x), BLOCK):
            own = x[lo : lo + BLOCK, part]
            apart = norms - 2 * (own @ book.T)
            at = apart.argmin(1)
            index[lo : lo + BLOCK, part] = at
            distance[lo : lo + BLOCK, part] = apart[np.arange(len(own)), at] + (own * own).sum(1)
    return index, distance


def _sums(known, size: int):
    """One row for each entry and component that a task met: part, entry, at (-1: how many), sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = known.value
        width = books[0].shape[1]
        sums = np.zeros((PARTS, len(books[0]), width + 1), np.int64)
        for batch in batches:
            for lo in range(0, len(batch), BLOCK):
                x = _integers(batch.column("vector").slice(lo, BLOCK), size)
                index, _ = nearest(x, books)
                for part in range(PARTS):
                    np.add.at(sums[part, :, 1:], index[:, part], x[:, part])
                    sums[part, :, 0] += np.bincount(index[:, part], minlength=len(books[0]))
        part, entry, at = (a.ravel() for a in np.indices(sums.shape, np.int32))
        met = np.repeat((sums[:, :, :1] > 0).ravel(), width + 1)
        yield pa.RecordBatch.from_arrays([pa.array(part[met]), pa.array(entry[met]), pa.array(at[met] - 1), pa.array(sums.ravel()[met])], names=["part", "entry", "at", "sum"])

    return run


def _coded(known, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), BLOCK):
                part = batch.slice(lo, BLOCK)
                index, distance = nearest(_integers(part.column("vector"), size), known.value)
                codes = [row.tobytes().hex() for row in index.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([part.column("rest"), pa.array(codes, pa.string()), pa.array(distance.sum(1))], names=["rest", "code", "error"])

    return run


def start(vectors: DataFrame, size: int, entries: int = ENTRIES) -> list[np.ndarray]:
    """The parts of the vectors of smallest vec_id; of equal ids those of smaller components."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow()["vector"]
    x = _integers(first, size)
    return [np.ascontiguousarray(x[:, part]) for part in range(PARTS)]


def improved(vectors: DataFrame, books: list[np.ndarray], size: int) -> list[np.ndarray]:
    """A round: each entry becomes the mean, rounded down, of the parts that are nearest to it; one that is nearest to none stays."""
    known = vectors.sparkSession.sparkContext.broadcast(books)
    each = vectors.select("vector").mapInArrow(_sums(known, size), "part int, entry int, at int, sum bigint")
    # A sum over all tasks may leave 64 bits.
    total = each.groupBy("part", "entry", "at").agg(F.sum(F.col("sum").cast("decimal(38,0)")).cast("string").alias("sum")).collect()
    many = {(r.part, r.entry): int(r.sum) for r in total if r.at < 0}
    out = [b.copy() for b in books]
    for r in total:
        if r.at >= 0:
            out[r.part][r.entry, r.at] = int(r.sum) // many[r.part, r.entry]
    known.unpersist()
    return out


def digest(books: list[np.ndarray], size: int) -> str:
    """sha256 of all components in order, without those a size was filled up with."""
    width, numbers = books[0].shape[1], []
    for part, book in enumerate(books):
        own = max(0, min(width, size - part * width))
        numbers += [str(v) for row in book for v in row[:own].tolist()]
    return sha256(",".join(numbers).encode()).hexdigest()


def compressed(spark: SparkSession, rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray], str]:
    """rows: vec_id, embedding, label and any further columns. Returns rest (these columns without the vector), code, error; the codebooks, and their digest.

    Rows whose vector is null or holds null or non-finite components are dropped. The size of vectors is that of the kept one of smallest
    vec_id; vectors of another size, and those with a component so large that a distance could leave 64 bits (beyond 16,000 in 1,024
    components), have a null code and error and take no part. Sizes that four does not divide are filled with zeros. Repeated rows and ids are vectors of
    their own, a null vec_id comes last. Fewer vectors than entries make smaller codebooks. Without any vector there are no rows, and the digest is that of the empty text.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != "embedding"])
    kept = rows.where(finite(F.col("embedding"))).select("vec_id", rest.alias("rest"), whole(F.col("embedding")).alias("vector"))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select(F.size("vector").alias("size")).first()
    size = first["size"] if first else 0
    most = largest(size)
    fits = (F.size("vector") == size) & F.forall("vector", lambda v: v.between(-most, most))
    own = kept.where(fits)
    books = start(own, size, entries)
    if len(books[0]):
        for _ in range(rounds):
            books = improved(own, books, size)
    known = spark.sparkContext.broadcast(books)
    kind = f"rest {dict(kept.dtypes)['rest']}, code string, error bigint"
    coded = own.select("rest", "vector").mapInArrow(_coded(known, size), kind)
    odd = kept.where(~fits).select("rest", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    return coded.unionByName(odd), books, digest(books, size)


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error: the errors of all rows of the same label, nulls together. Sums are made before anything is joined, so that a hot label is one row of each task."""
    coded = persisted(coded, "codes")
    sums = persisted(coded.groupBy(F.col("rest.label").alias("label")).agg(F.sum("error").alias("label_error")), "label-errors")
    return coded.join(T.small(sums), F.col("rest.label").eqNullSafe(sums["label"]), "left").drop(sums["label"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, _, books = compressed(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    return with_label_errors(coded).select("rest.vec_id", "code", "error", "label_error", F.lit(books).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same in SQL; products of doubles, which are exact for components as these are."""
    parts = [
        f"v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"w AS (SELECT max(len(x)) // {PARTS} AS w FROM v)",
        f"p AS (SELECT vec_id, label, p, x[p * w + 1:p * w + w] AS y FROM v, w, range({PARTS}) r(p))",
        f"c0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, y AS c FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {ENTRIES}))",
    ]
    for k in range(ROUNDS + 1):
        parts.append(
            f"d{k} AS MATERIALIZED (SELECT vec_id, label, p, arg_min(e, d * {ENTRIES} + e) AS e, min(d) AS d FROM (SELECT vec_id, label, p.p, e, list_inner_product(y, y) - 2 * list_inner_product(y, c) + list_inner_product(c, c) AS d"
            f" FROM p JOIN c{k} ON c{k}.p = p.p) GROUP BY vec_id, label, p)"
        )
        if k < ROUNDS:
            parts.append(f"m{k} AS (SELECT p, e, list(floor(s / n) ORDER BY i) AS c FROM (SELECT p, e, i, sum(x) AS s, count(*) AS n FROM (SELECT p, e, unnest(y) AS x, generate_subscripts(y, 1) AS i FROM p JOIN d{k} USING (vec_id, p)) GROUP BY p, e, i) GROUP BY p, e)")
            parts.append(f"c{k + 1} AS MATERIALIZED (SELECT c{k}.p, c{k}.e, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} ON m{k}.p = c{k}.p AND m{k}.e = c{k}.e)")
    last = ROUNDS
    return (
        "WITH " + ",\n".join(parts) + f",\nh AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) AS h FROM c{last}),"
        f" o AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM d{last} GROUP BY vec_id, label)"
        " SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM o, h"
    )


SQL = _oracle()
