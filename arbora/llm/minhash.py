"""Near-duplicate documents by ProbMinHash, banding and verification.

A text is its five-word shingles, each weighted by how often it occurs. Every shingle is a Poisson process whose
rate is its weight; each arrival goes to one of m registers, which keeps the earliest, and a shingle stops as soon
as its next arrival comes later than the latest of all registers. Two texts agree in a register with the
probability Jaccard similarity of their weights. Bands of registers find candidates; the similarity of each
candidate is then computed exactly from the weights, and pairs of `threshold` or more are links.

Texts with the same shingles in the same order are one class and enter the search once. Where few classes meet in a band they are
joined with each other; the pairs are gathered over all bands and verified once each. Where more than ALL_PAIRS meet they
are dealt into blocks, and every two blocks of a band key meet in a task of its own, which verifies all their pairs by products of
matrices and gives back how many links each class has and a spanning forest of these, never the pairs. A
pair that shares several bands counts in the first of them. So all pairs that share a band are compared, however many meet.

Defined cases: null texts and texts without words link to nothing; a text of one to four words is one shingle;
rows with a null doc_id come back as they are, kept; repeated rows are copies of each other; different texts that share a doc_id
are compared like any others, and both stay if they aren't linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm import textops as T
from arbora.llm.components import components, forest
from arbora.session import persisted

SHINGLE, THRESHOLD = 5, 0.8
#: 24 bands of 5 registers: a pair of similarity 0.8 shares a band with a chance of 1 - (1 - 0.8**5)**24 > 0.9999.
BANDS, ROWS = 24, 5
#: A band key of more classes than these is compared in blocks, of so many classes and shingles at most on average.
ALL_PAIRS, BLOCK, BLOCK_SHINGLES = 24, 1_024, 4 << 20
#: Columns of the matrices that are multiplied at once.
COLUMNS = 2_048
#: Linked pairs whose bands are compared at once.
PAIRS = 1 << 15


def weighted(texts: T.Texts, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, weight), rows in order and shingles in order within each, and a 64-bit hash of each row's sequence."""
    w = T.words(texts)
    row, h = T.shingles(w, n)
    first = np.searchsorted(row, np.arange(len(texts) + 1))
    place = np.arange(len(h)) - first[row]
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(T.mix(h ^ T.mix(place.astype(np.uint64) + np.uint64(1))), out=total[1:])
    sequence = T.mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64))
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return row[at], h[at], np.diff(np.append(at, len(h))), sequence


def probminhash(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, m: int) -> np.ndarray:
    """rows x m registers: the element of the earliest arrival in each; rows without elements stay 0."""
    first, owner = np.full(rows * m, np.inf), np.zeros(rows * m, np.uint64)
    h, step = np.zeros(len(row)), 0
    row, element, weight = row.copy(), element.copy(), weight.astype(float)
    while len(row):
        many = int(np.clip(40_000 // len(row), 1, 64))
        draw = T.mix(element[:, None] + T.mix(np.arange(step, step + many, dtype=np.uint64) * np.uint64(2) + np.uint64(1)))
        time = h[:, None] + np.cumsum(-np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53), 1) / weight[:, None]
        cell = row[:, None] * m + (T.mix(draw + np.uint64(0x5851F42D4C957F2D)) % np.uint64(m)).astype(np.int64)
        h, step = time[:, -1].copy(), step + many
        flat, when, who = cell.ravel(), time.ravel(), np.repeat(element, many)
        sooner = when < first[flat]
        flat, when, who = flat[sooner], when[sooner], who[sooner]
        order = np.lexsort((when, flat))
        flat, when, who = flat[order], when[order], who[order]
        lead = np.ones(len(flat), bool)
        lead[1:] = flat[1:] != flat[:-1]
        first[flat[lead]], owner[flat[lead]] = when[lead], who[lead]
        alive = h < first.reshape(rows, m).max(1)[row]
        row, element, weight, h = row[alive], element[alive], weight[alive], h[alive]
    return owner.reshape(rows, m)


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Exact: the sum over common elements d of 1 / sum over d' of max(wa'/wa, wb'/wb). a and b are sorted and distinct."""
    both = np.union1d(a, b)
    x, y = np.zeros(len(both)), np.zeros(len(both))
    x[np.searchsorted(both, a)], y[np.searchsorted(both, b)] = wa, wb
    common = (x > 0) & (y > 0)
    if not common.any():
        return 0.0
    ratio = np.divide(x, y, out=np.full(len(x), np.inf), where=y > 0)
    order = np.argsort(ratio)
    at = np.searchsorted(ratio[order], ratio[common], "left")
    above, below = np.append(np.cumsum(x[order][::-1])[::-1], 0)[at], np.append(0, np.cumsum(y[order]))[at]
    return float((1 / (above / x[common] + below / y[common])).sum())


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def products(left: tuple, right: tuple, by: tuple[np.ndarray, np.ndarray], rows: tuple[int, int], *values) -> list[np.ndarray]:
    """For each (x, y) of `values` the matrix of sums of x * y over the elements that a left and a right text have in common.

    left, right: row of each element; by: its key on either side, once a row; x, y: a number for each element.
    """
    common = np.intersect1d(*by)
    out = [np.zeros(rows) for _ in values]
    found = [T.member(k, common) for k in by]
    at = [np.where(ok, i, -1) for i, ok in found]
    for c in range(0, len(common), COLUMNS):
        own = [np.flatnonzero((i >= c) & (i < c + COLUMNS)) for i in at]
        for k, v in enumerate(values):
            both = []
            for side, o, i, n, x in zip((left, right), own, at, rows, v, strict=True):
                m = np.zeros((n, min(COLUMNS, len(common) - c)), np.float32)
                m[side[o], i[o] - c] = x[o]
                both.append(m)
            out[k] += both[0] @ both[1].T
    return out


def linked(left: list[tuple[np.ndarray, np.ndarray]], right: list[tuple[np.ndarray, np.ndarray]], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all pairs of a left and a right text, each (shingles, weights), whose similarity is `threshold` or more.

    It is a sum over common shingles of their weight by the sum of all larger weights, of the one text or, at this shingle's ratio, the other. Where
    all weights are 1 the products give it. Else shingles of equal weights bound it from below; from above, with all other common ones
    by the text's own weight; between the two it is computed.
    """
    sides = []
    for texts in (left, right):
        row = np.repeat(np.arange(len(texts)), [len(h) for h, _ in texts])
        h, w = (np.concatenate([t[k] for t in texts]) for k in (0, 1))
        sides.append((row, h, w, np.bincount(row, weights=w, minlength=len(texts)), np.bincount(row, weights=w != 1, minlength=len(texts)) == 0))
    (row, h, w, total, unit), (orow, oh, ow, ototal, ounit) = sides
    size = len(left), len(right)
    keys = [T.mix(x + T.mix(y.astype(np.uint64))) for x, y in ((h, w), (oh, ow))]
    (same,) = products(row, orow, keys, size, (w, np.ones(len(ow))))
    plain = unit[:, None] & ounit[None]
    both, least = total[:, None] + ototal[None], threshold - 1e-12
    ok = same / (both - same) >= least
    if not plain.all():
        mine, theirs = products(row, orow, [h, oh], size, (w, np.ones(len(ow))), (np.ones(len(w)), ow))
        most = same / (both - np.minimum(mine, theirs)) + np.minimum((mine - same) / total[:, None], (theirs - same) / ototal[None])
        for i, j in zip(*np.nonzero(~plain & ~ok & (most >= least)), strict=True):
            ok[i, j] = probability_jaccard(*left[i], *right[j]) >= least
    return np.nonzero(ok)


def _signatures(bands: int, rows: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in T.slices(batch.column("text")):
                row, h, weight, sequence = weighted(t, n)
                z = probminhash(row, h, weight, len(t), bands * rows)
                key = np.zeros((len(t), bands), np.uint64)
                for j in range(rows):
                    key = T.mix(key + z[:, j::rows][:, :bands] + np.arange(1, bands + 1, dtype=np.uint64))
                size = np.bincount(row, weights=weight, minlength=len(t)).astype(np.int64)
                offsets = pa.array(np.arange(len(t) + 1, dtype=np.int32) * bands)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(t.lo, len(t)) for c in ("doc_id", "text_hash")), pa.array(size), _signed(sequence), pa.ListArray.from_arrays(offsets, _signed(key.ravel()))], names=["doc_id", "text_hash", "size", "node", "bands"]
                )

    return run


def _weights(n: int, wanted: T.Bloom):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(wanted.has(batch.column("turn").to_numpy()), pa.bool_()))
            for t in T.slices(batch.column("text")):
                row, h, weight, sequence = weighted(t, n)
                offsets = pa.array(np.searchsorted(row, np.arange(len(t) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([_signed(sequence), pa.ListArray.from_arrays(offsets, _signed(h)), pa.ListArray.from_arrays(offsets, pa.array(weight.astype(np.int32)))], names=["node", "h", "w"])

    return run


def _cells(table, *columns: str) -> list[list[np.ndarray]]:
    """The lists of each column as arrays; of shingles without a sign."""
    out = []
    for c in columns:
        column = table.column(c)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        flat, at = column.flatten().to_numpy(), np.append(0, np.cumsum(column.value_lengths().to_numpy()))
        flat = flat.view(np.uint64) if c[0] == "h" else flat
        out.append([flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)])
    return out


def _similar(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                sim = np.array([probability_jaccard(*x) for x in zip(*_cells(batch, "ha", "wa", "hb", "wb"), strict=True)])
                keep = pa.array(sim >= threshold - 1e-12, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sim, pa.float64())], names=["a", "b", "similarity"]).filter(keep)

    return run


def _blocks(threshold: float):
    """Two blocks of a band key: node, links, low (a node that it is linked with by way of others)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 3
        if len(left) and len(right):
            a, b = left["node"].to_numpy(), right["node"].to_numpy()
            band = left["band"][0].as_py()
            i, j = linked(list(zip(*_cells(left, "h", "w"), strict=True)), list(zip(*_cells(right, "h", "w"), strict=True)), threshold)
            if left["i"][0].as_py() == left["j"][0].as_py():
                i, j = i[a[i] < b[j]], j[a[i] < b[j]]
            keys, okeys = (np.stack(_cells(x, "bands")[0]) for x in (left, right))
            large = (left["large"].to_numpy()[:, None] >> np.arange(keys.shape[1])) & 1 == 1
            # Counted here unless in an earlier band, or among the pairs of a smaller meeting.
            ok = [np.zeros(0, bool)]
            for lo in range(0, len(i), PAIRS):
                ii, jj = i[lo : lo + PAIRS], j[lo : lo + PAIRS]
                shared = keys[ii] == okeys[jj]
                ok.append(~(shared & ~large[ii]).any(1) & (shared.argmax(1) == band))
            ok = np.concatenate(ok)
            x, y = a[i[ok]], b[j[ok]]
            ids, which = np.unique(np.concatenate([x, y]), return_inverse=True)
            node, low = forest(x, y)
            more = ids, np.bincount(which, minlength=len(ids)).astype(np.int64), ids
            tree = node, np.zeros(len(node), np.int64), low
            out = [np.concatenate(z) for z in zip(more, tree, strict=True)]
        return pa.table(dict(zip(("node", "links", "low"), map(pa.array, out), strict=True)))

    return run


def near_duplicates(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, n: int = SHINGLE, all_pairs: int = ALL_PAIRS, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, size (shingles), copy_of (smallest doc_id with the same shingles), class_id (smallest doc_id reachable by links), n_links (other texts linked directly), kept, text_hash.

    One document of each class is kept, of rows that share its doc_id those that have its text.
    """
    texts = T.packed(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    signed = persisted(texts.mapInArrow(_signatures(bands, rows, n), "doc_id bigint, text_hash bigint, size bigint, node bigint, bands array<bigint>"), "signatures")
    found = signed.where("doc_id is not null and size > 0")
    # A class, known by a hash of its sequence of shingles, and the row that stands for it.
    heads = persisted(found.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash", "size", "bands")).alias("head")).select("node", "head.*"), "heads")
    met = heads.select("node", "size", F.posexplode("bands").alias("band", "key"))
    meeting = met.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")).where("n > 1")
    met = persisted(met.join(meeting, "key"), "met")
    few = met.where(F.col("n") <= all_pairs).select("key", "node")
    pairs = persisted(few.withColumnRenamed("node", "a").join(few.withColumnRenamed("node", "b"), "key").where("a < b").select("a", "b").distinct(), "candidates")
    many = met.where(F.col("n") > all_pairs)

    turn = F.xxhash64("doc_id", "text_hash")
    named = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).union(many.select("node")).distinct()
    wanted = T.Bloom(heads.join(named, "node", "left_semi").select(turn.alias("turn")))
    weights = texts.where("doc_id is not null").select("text", turn.alias("turn")).mapInArrow(_weights(n, wanted), "node bigint, h array<bigint>, w array<int>")
    if found.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count():
        weights = weights.dropDuplicates(["node"])
    weights = persisted(weights, "weights")
    left, right = (weights.select(F.col("node").alias(c), F.col("h").alias(f"h{c}"), F.col("w").alias(f"w{c}")) for c in "ab")
    links = persisted(pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "wa", "hb", "wb").mapInArrow(_similar(threshold), "a bigint, b bigint, similarity double"), "links")

    large = many.groupBy("node").agg(F.bit_or(F.expr("shiftleft(1L, band)")).alias("large"))
    blocks = F.ceil(F.greatest(F.col("n") / block, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    facts = weights.join(large, "node").join(heads.select("node", "bands"), "node")
    dealt = many.select("key", "band", "node", blocks.alias("blocks")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    keys = ["key", "i", "j"]
    lefts = dealt.withColumnRenamed("own", "i").withColumn("j", F.explode(F.expr("sequence(i, blocks - 1)"))).drop("blocks").join(facts, "node")
    rights = dealt.withColumnRenamed("own", "j").withColumn("i", F.explode(F.expr("sequence(0, j)"))).drop("blocks").join(facts, "node")
    rights = rights.toDF(*rights.columns)
    told = persisted(lefts.groupBy(*keys).cogroup(rights.groupBy(*keys)).applyInArrow(_blocks(threshold), "node bigint, links bigint, low bigint"), "blocks")

    group = components(links.select("a", "b").union(told.where("low <> node").select("node", "low")), "near")
    degree = links.select(F.explode(F.array("a", "b")).alias("node"), F.lit(1).cast("bigint").alias("links")).union(told.select("node", "links")).groupBy("node").agg(F.sum("links").alias("n_links"))
    classes = heads.select("node", "doc_id", "text_hash").join(group, "node", "left").join(degree, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.struct("doc_id", "node", "text_hash").alias("head"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    first = classes.groupBy("component").agg(F.min("head").alias("first"))
    classes = classes.join(first, "component").select("node", F.col("head.doc_id").alias("head"), F.col("first.doc_id").alias("class_id"), F.col("first").alias("stays"), "n_links", F.lit(True).alias("joins"))
    by = signed.withColumn("joins", (F.col("size") > 0) & F.col("doc_id").isNotNull())
    out = by.join(classes, ["joins", "node"], "left")
    kept = F.coalesce(F.col("stays") == F.struct("doc_id", "node", "text_hash"), F.lit(True))
    return out.select("doc_id", "size", F.coalesce("head", "doc_id").alias("copy_of"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), kept.alias("kept"), "text_hash")


def one_of_each(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The documents, all columns, that are the first of their class; of repeated rows (same doc_id and text) one stays, whether or not the text has words."""
    found = near_duplicates(spark, docs, **options)
    gone = persisted(found.where("not kept").select(F.col("doc_id").alias("__gone"), F.col("text_hash").alias("__text")).distinct(), "gone")
    gone = T.small(gone)
    rows = T.packed(docs)
    rest = rows.join(gone, (rows["doc_id"].cast("bigint") == gone["__gone"]) & (F.xxhash64(rows["text"]) == gone["__text"]), "left_anti")
    if rows.where("doc_id is not null").groupBy("doc_id", F.xxhash64("text")).count().where("count > 1").limit(1).count():
        rest = rest.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(rest.where("doc_id is null"))
    return T.unpacked(rest, docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
