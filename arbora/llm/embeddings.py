"""Near-duplicate vectors by product quantisation with inverted lists.

Vectors are compared by cosine, so by their unit vectors x. Coarse centroids deal all vectors into inverted lists; the residual
to the list's centroid is coded by its nearest codeword in each of PARTS subspaces. A pair at cosine c is
sqrt(2 - 2c) apart, and a list's members lie on its side of the plane midway between its centroid and any other. How much of the
way to its partner a vector goes across a plane depends on the direction: the mean square of that share, over the linked pairs of the sample,
gives a standard deviation for each two lists, and a vector probes every list whose plane to its own is within `spread` of
these, at most the whole way. Where the sample has few pairs, where differences lie near few directions, or with spread=None it is the whole way, which
loses nothing. A link that one side alone probes for counts at both ends. A table of the vector's residual's distances to all codewords gives its distance to every
coded member. A member further away than a link can be and its own coding error, which is kept with it, cannot be a
link; the others are computed again from the vectors, in double precision.

Equal vectors of a label are one class and enter once. Members and queries of a list meet in blocks, so that no task
holds a list whole, and a block gives back counts and a spanning forest of its links, never the pairs. Centroids and codewords are
fitted on a sample of classes, DRAWN for each list and SAMPLE at least; there is a list for every LIST_SIZE classes, MOST_LISTS at most.

Defined cases: null, empty and zero vectors, and such as hold null or non-finite components, and all with a null label, link with nothing, as do
vectors of different lengths; rows that share a vec_id count each; null ids are kept and link with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.components import components, forest
from arbora.session import persisted

COSINE, PARTS, CODES, SPREAD = 0.93, 8, 256, 4.0
SAMPLE, DRAWN, MOST_LISTS, LIST_SIZE = 20_000, 20, 4_096, 400
#: Rows of the sample whose partners in it are looked for, and pairs for each component that the shares are measured on at least.
ASKED, PAIRS = 2_000, 4
#: Queries and members that meet in one block at most, on average.
BLOCK = 2_048


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    k = min(k, len(x))
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T, 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def shares(x: np.ndarray, c: np.ndarray, apart: np.ndarray, cosine: float, spread: float | None) -> np.ndarray:
    """For each two centroids of c: `spread` standard deviations of the share of a linked pair's difference that lies along the line between them, 1 at most."""
    out = np.ones((len(c), len(c)))
    if spread is None or len(x) < 2:
        return out
    draw = np.random.default_rng(11)
    first, ways = draw.permutation(len(x))[:ASKED], []
    for k in range(0, len(first), 100):
        dot = x[first[k : k + 100]] @ x.T
        i, j = np.nonzero((dot >= cosine) & (np.arange(len(x)) != first[k : k + 100, None]))
        some = draw.permutation(len(i))[:2_048]
        ways.append(x[first[k : k + 100][i[some]]] - x[j[some]])
    way = np.concatenate(ways)
    way = way[(way * way).sum(1) > 0]
    if len(way) < PAIRS * x.shape[1]:
        return out
    way = _unit(way)
    met = c @ (way.T @ way / len(way)) @ c.T
    own = np.diag(met)
    along = np.sqrt(np.maximum(own[:, None] + own[None] - 2 * met, 0)) / np.maximum(apart, 1e-12)
    return np.minimum(1.0, spread * along)


@dataclass
class Index:
    lists: np.ndarray
    cuts: list[slice]
    words: list[np.ndarray]
    #: For each two lists the distance between their centroids, and the share of a link that may lead across the plane between them.
    apart: np.ndarray
    share: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, cosine: float = COSINE, spread: float | None = SPREAD) -> Index:
        c = kmeans(x, lists)
        rest = x - c[nearest(x, c)]
        edge = np.linspace(0, x.shape[1], min(PARTS, x.shape[1]) + 1).astype(int)
        cuts = [slice(a, b) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        apart = np.sqrt(squared(c, c))
        return cls(c, cuts, [kmeans(rest[:, s], CODES) for s in cuts], apart, shares(x, c, apart, cosine, spread))

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, and coding error of each."""
        at = nearest(x, self.lists)
        rest = x - self.lists[at]
        codes = np.stack([nearest(rest[:, s], w) for s, w in zip(self.cuts, self.words, strict=True)], 1).astype(np.uint8)
        near = np.hstack([w[codes[:, j]] for j, w in enumerate(self.words)])
        return at, codes, np.sqrt(((rest - near) ** 2).sum(1))

    def probes(self, x: np.ndarray, at: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(row of x, list) of the lists that may hold a vector at most `reach` away from x, whose own list is `at`; rows in order."""
        d = squared(x, self.lists)
        own = np.take_along_axis(d, at[:, None], 1)
        return np.nonzero(d - own <= 2 * (reach * self.share[at] + 1e-6) * self.apart[at] + 1e-9)

    def distances(self, x: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Of each x to each coded member of list `at`, by table look-up."""
        rest = x - self.lists[at]
        out = np.zeros((len(x), len(codes)))
        for j, (s, w) in enumerate(zip(self.cuts, self.words, strict=True)):
            out += squared(rest[:, s], w)[:, codes[:, j]]
        return np.sqrt(out)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def _coded(known, cosine: float):
    reach = np.sqrt(2 - 2 * cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = known.value
        for batch in batches:
            if not len(batch):
                continue
            x = _unit(_matrix(batch.column("embedding")))
            at, codes, error = index.coded(x)
            row, tried = index.probes(x, at, reach)
            offsets = pa.array(np.searchsorted(row, np.arange(len(x) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("vec_id", "label", "embedding", "copies")] + [pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.ListArray.from_arrays(offsets, pa.array(tried.astype(np.int32)))],
                names=["vec_id", "label", "embedding", "copies", "list", "codes", "error", "tried"],
            )

    return run


def _met(known, cosine: float):
    reach = np.sqrt(2 - 2 * cosine)

    def run(members: pa.Table, queries: pa.Table) -> pa.Table:
        index: Index = known.value
        out = {"vec_id": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "low": np.zeros(0, np.int64)}
        if len(members) and len(queries):
            m, q = _matrix(members["embedding"]), _matrix(queries["embedding"])
            m_id, q_id = members["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
            at = members["list"][0].as_py()
            codes = np.frombuffer(b"".join(members["codes"].to_pylist()), np.uint8).reshape(len(members), -1)
            near = index.distances(_unit(q), at, codes) <= reach + members["error"].to_numpy() + 1e-6
            i, j = np.nonzero(near & (q_id[:, None] != m_id[None]))
            dot = np.concatenate([(q[i[k : k + 65536]] * m[j[k : k + 65536]]).sum(1) for k in range(0, len(i), 65536)]) if len(i) else np.zeros(0)
            ok = dot / (np.sqrt((q * q).sum(1))[i] * np.sqrt((m * m).sum(1))[j]) >= cosine
            i, j = i[ok], j[ok]
            who, n = q_id[i], members["copies"].to_numpy()[j]
            # The pair is met again, the other way round, if the member probes the query's list; otherwise both ends count here.
            tried = members["tried"].combine_chunks() if isinstance(members["tried"], pa.ChunkedArray) else members["tried"]
            probed = np.sort(np.repeat(np.arange(len(members)), np.diff(tried.offsets.to_numpy())) * len(index.lists) + tried.flatten().to_numpy())
            wanted = j * len(index.lists) + queries["list"].to_numpy()[i]
            place = np.minimum(np.searchsorted(probed, wanted), len(probed) - 1)
            alone = probed[place] != wanted
            who, n = np.concatenate([who, m_id[j[alone]]]), np.concatenate([n, queries["copies"].to_numpy()[i[alone]]])
            ids, which = np.unique(who, return_inverse=True)
            total = np.bincount(which, weights=n, minlength=len(ids)).astype(np.int64)
            tree, low = forest(q_id[i], m_id[j])
            out = {"vec_id": np.concatenate([ids, tree]), "links": np.concatenate([total, np.zeros(len(tree), np.int64)]), "low": np.concatenate([ids, low])}
        return pa.table({k: pa.array(v.astype(np.int64)) for k, v in out.items()})

    return run


def links(spark: SparkSession, classes: DataFrame, cosine: float, spread: float | None = SPREAD) -> DataFrame:
    """classes: vec_id, label, embedding (all of one length), copies. Returns vec_id, links, low in parts."""
    count = classes.count()
    lists = int(np.clip(count // LIST_SIZE, 1, MOST_LISTS))
    share = min(1.0, max(SAMPLE, DRAWN * lists) / max(1, count))
    drawn = classes.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_003)) < share * 1_000_003).select("embedding").toArrow()["embedding"]
    if not len(drawn):
        drawn = classes.limit(1).select("embedding").toArrow()["embedding"]
    index = Index.fit(_unit(_matrix(drawn)), lists, cosine, spread)
    known = spark.sparkContext.broadcast(index)
    coded = persisted(classes.mapInArrow(_coded(known, cosine), f"vec_id bigint, label int, embedding {dict(classes.dtypes)['embedding']}, copies bigint, list int, codes binary, error double, tried array<int>"), "coded")
    asked = coded.select(*[F.col(c).alias(c) for c in ("vec_id", "label", "embedding", "copies", "list")], F.explode("tried").alias("at"))
    held = coded.groupBy("label", F.col("list").alias("at")).agg(F.count("*").alias("n"))
    asks = asked.groupBy("label", "at").agg(F.count("*").alias("k"))
    blocks = persisted(held.join(asks, ["label", "at"]).select("label", "at", F.ceil(F.col("n") / BLOCK).cast("int").alias("rows"), F.ceil(F.col("k") / BLOCK).cast("int").alias("columns")), "blocks")
    spread = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = coded.withColumn("at", F.col("list")).join(blocks, ["label", "at"]).withColumn("row", spread("rows")).withColumn("column", each("columns")).drop("rows", "columns")
    queries = asked.join(blocks, ["label", "at"]).withColumn("column", spread("columns")).withColumn("row", each("rows")).drop("rows", "columns")
    keys = ["label", "at", "row", "column"]
    return members.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(_met(known, cosine), "vec_id bigint, links bigint, low bigint")


def near_vectors(spark: SparkSession, vectors: DataFrame, cosine: float = COSINE, spread: float | None = SPREAD) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast(kind).alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite, F.lit(False))
    exact = F.sha2(F.concat_ws(",", F.transform("embedding", lambda v: F.hex(F.when(v == 0, F.lit(0.0)).otherwise(v).cast("double").cast("string").cast("binary")))), 256)
    rows = persisted(rows.withColumn("usable", usable).withColumn("same", F.when(F.col("usable"), exact)), "vectors")
    classes = persisted(rows.where("usable").groupBy("label", "same").agg(F.min("vec_id").alias("head"), F.count("*").alias("copies")).withColumn("node", F.xxhash64("label", "same")), "classes")
    heads = rows.where("usable").join(classes, ["label", "same"]).where("vec_id = head").dropDuplicates(["label", "same"])
    heads = persisted(heads.select(F.col("node").alias("vec_id"), "label", "embedding", "copies"), "heads")
    found = None
    for (size,) in heads.select(F.size("embedding").alias("size")).distinct().collect():
        part = persisted(links(spark, heads.where(F.size("embedding") == size), cosine, spread), "met")
        found = part if found is None else found.unionAll(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    degree = found.groupBy(F.col("vec_id").alias("node")).agg(F.sum("links").alias("links"))
    group = components(found.where("low <> vec_id").select(F.col("vec_id").alias("a"), F.col("low").alias("b")), "vectors")
    told = classes.join(degree, "node", "left").join(group, "node", "left").select("label", "same", "head", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "node").alias("component"), F.lit(True).alias("usable"))
    told = told.join(told.groupBy("component").agg(F.min("head").alias("low")), "component").drop("head", "component")
    out = rows.join(told, ["usable", "label", "same"], "left")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("low", "vec_id").alias("component_id"), F.coalesce(F.col("low") == F.col("vec_id"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
