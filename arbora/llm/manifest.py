"""Merkle dataset manifest: a root over all documents, and for each document the proof that it belongs to it.

Documents of a source are the leaves of its tree in order of doc_id; sources, in order of name, are the leaves of the tree above. A tree is cut
into aligned blocks of FANOUT ** depth nodes, each a contiguous matrix of hex digests in one task: its rows are hashed level by level, and
index arithmetic finds every sibling. The roots of the blocks are the nodes of the next tier, which is cut in the same way, so that no task
and not the driver ever holds more than a block, however many documents a source has.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.llm import textops as T
from arbora.session import persisted

FANOUT = 3
#: Levels in a block: 6,561 nodes, about a megabyte of digests.
DEPTH = 8
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(values: dict[str, Column]) -> Column:
    """Digest of a document: of its fields, each with its length in front, so that no two documents read the same."""
    return F.sha2(F.concat(*[_field(values[c]) for c in FIELDS]), 256)


def _hashed(rows: np.ndarray) -> np.ndarray:
    """Digest of each row of a uint8 matrix, as a matrix of hex letters."""
    width, raw = rows.shape[1], np.ascontiguousarray(rows).tobytes()
    found = [sha256(raw[k : k + width]).hexdigest() for k in range(0, len(raw), width)] if width else [sha256(b"").hexdigest()] * len(rows)
    return np.frombuffer("".join(found).encode(), np.uint8).reshape(-1, HEX)


def _matrix(digests: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer("".join(digests.to_pylist()).encode(), np.uint8).reshape(-1, HEX)


def _up(nodes: np.ndarray) -> np.ndarray:
    """The next level: whole runs as rows of one matrix, the last run, if shorter, by itself."""
    whole = len(nodes) // FANOUT * FANOUT
    out = _hashed(nodes[:whole].reshape(-1, FANOUT * HEX))
    return out if whole == len(nodes) else np.concatenate([out, _hashed(nodes[whole:].reshape(1, -1))])


def levels(nodes: np.ndarray, rise: int | None) -> list[np.ndarray]:
    """The matrices of a block from its nodes to its root: rise levels, or until one node remains."""
    out = [nodes]
    while len(out) <= rise if rise is not None else len(out[-1]) > 1:
        out.append(_up(out[-1]))
    return out


def _rise(table: pa.Table, depth: int) -> int | None:
    """A block that is a whole tree ends at its root, one of several rises through all levels, even by runs of one."""
    return depth if table.column("n")[0].as_py() > FANOUT**depth else None


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by("pos")


def siblings(level: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the nodes `at` of a level: the runs they are in (FANOUT digests side by side), which of these exist, and their own place in the run."""
    place = at % FANOUT
    run = (at - place)[:, None] + np.arange(FANOUT)
    there = run < len(level)
    return level[np.where(there, run, 0)], there, place


def _steps(tower: list[np.ndarray]):
    """Level by level: siblings() of every node of the block."""
    at = np.arange(len(tower[0]))
    for level in tower[:-1]:
        yield siblings(level, at)
        at = at // FANOUT


def _text(run: np.ndarray, chosen: np.ndarray) -> list[str]:
    return [r[c].tobytes().decode() for r, c in zip(run, chosen, strict=True)]


def _roots(depth: int):
    def run(table: pa.Table) -> pa.Table:
        table = _ordered(table)
        top = levels(_matrix(table.column("digest")), _rise(table, depth))[-1]
        first = table.slice(0, 1)
        return pa.table({"grp": first.column("grp"), "pos": first.column("block"), "n": pa.array([-(-first.column("n")[0].as_py() // FANOUT**depth)]), "digest": pa.array([top.tobytes().decode()])})

    return run


def _paths(depth: int):
    def run(table: pa.Table) -> pa.Table:
        table = _ordered(table)
        tower = levels(_matrix(table.column("digest")), _rise(table, depth))
        before, behind = [[] for _ in range(len(table))], [[] for _ in range(len(table))]
        for nodes, there, place in _steps(tower):
            own = np.arange(FANOUT) - place[:, None]
            for out, part in ((before, own < 0), (behind, own > 0)):
                for each, x in zip(out, _text(nodes, there & part), strict=True):
                    each.append(x)
        top = tower[-1].tobytes().decode()
        return pa.table({"grp": table.column("grp"), "pos": table.column("pos"), "block": table.column("block"), "n": table.column("n"), "before": pa.array(before, pa.list_(pa.string())), "behind": pa.array(behind, pa.list_(pa.string())), "top": pa.array([top] * len(table))})

    return run


def _proofs(depth: int):
    def run(table: pa.Table, above: pa.Table) -> pa.Table:
        table = _ordered(table)
        tower = levels(_matrix(table.column("digest")), _rise(table, depth))
        now = _matrix(table.column("tampered"))
        proofs = [sha256() for _ in range(len(table))]
        for nodes, there, place in _steps(tower):
            own = np.arange(FANOUT) == place[:, None]
            for proof, nodes_, chosen in zip(proofs, nodes, there & ~own, strict=True):
                proof.update(nodes_[chosen].tobytes())
            mixed = np.where(own[:, :, None], now[:, None, :], nodes)
            now = np.empty_like(now)
            for k in np.unique(there.sum(1)):
                like = there.sum(1) == k
                now[like] = _hashed(mixed[like, :k].reshape(-1, int(k) * HEX))
        up = above.slice(0, 1).to_pylist()[0]
        rest = "".join(a + b for a, b in zip(up["before"], up["behind"], strict=True)).encode()
        ends: dict[str, str] = {}
        folded = []
        for row in now:
            start = row.tobytes().decode()
            if start not in ends:
                node = start
                for a, b in zip(up["before"], up["behind"], strict=True):
                    node = sha256((a + node + b).encode()).hexdigest()
                ends[start] = node
            folded.append(ends[start])
        for proof in proofs:
            proof.update(rest)
        n = len(table)
        return pa.table(
            {
                "doc_id": table.column("doc_id"), "rest": table.column("rest"), "leaf": table.column("digest"), "subroot": pa.array([up["subroot"]] * n), "root": pa.array([up["root"]] * n),
                "proof_sha256": pa.array([p.hexdigest() for p in proofs]), "folded_root": pa.array(folded), "verified": pa.array([x == up["root"] for x in folded]),
            }
        )

    return run


def ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes (grp and more) with pos, their place in the group by `order`, without gaps, and n, the group's size.

    Sorted ranges are written once, then counted: a place is the place in the range and the rows of the group in earlier ranges.
    """
    sorted_ = nodes.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).withColumn("_at", F.monotonically_increasing_id())
    sorted_ = persisted(sorted_.withColumn("_range", F.shiftright("_at", 33)), "ranges")
    held = sorted_.groupBy("_range", "grp").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    group = Window.partitionBy("grp")
    before = F.sum("_n").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    held = persisted(held.select("_range", "grp", "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(group).alias("n")), "held")
    placed = sorted_.join(T.small(held), ["_range", "grp"])
    return placed.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_range", "_first", "_before")


def _block(nodes: DataFrame, depth: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / FANOUT**depth))


NODE = "grp string, pos bigint, n bigint, digest string"


def climbed(nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """nodes: grp, pos, n, digest. Per node: grp, pos, root of its group, and the siblings on the way there, before and behind it at each level."""
    if not nodes.where("n > 1").take(1):
        none = F.array().cast("array<string>")
        return nodes.select("grp", "pos", none.alias("before"), none.alias("behind"), F.col("digest").alias("root"))
    kind = "grp string, pos bigint, block bigint, n bigint, before array<string>, behind array<string>, top string"
    own = persisted(_block(nodes.select("grp", "pos", "n", "digest"), depth).groupBy("grp", "block").applyInArrow(_paths(depth), kind), "paths")
    blocks = own.groupBy("grp", "block").agg(F.first("n").alias("n"), F.first("top").alias("digest"))
    up = climbed(persisted(blocks.select("grp", F.col("block").alias("pos"), F.ceil(F.col("n") / FANOUT**depth).alias("n"), "digest"), "tops"), depth)
    up = up.select("grp", F.col("pos").alias("block"), F.col("before").alias("_a"), F.col("behind").alias("_b"), "root")
    return persisted(own.join(up, ["grp", "block"]).select("grp", "pos", F.concat("before", "_a").alias("before"), F.concat("behind", "_b").alias("behind"), "root"), "climbed")


def manifest(docs: DataFrame, tampered: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """docs (doc_id, source, lang, n_chars, text and any further columns) -> doc_id, rest (all other columns but the text), leaf, subroot, root, proof_sha256,
    folded_root, verified.

    tampered: the text that is found later in place of the own; folded_root is made from it and the proof, and verified where it is the root.

    Any field may be null. Rows of one doc_id and source are leaves of their own, in order of their digests, a null doc_id first; so repeated rows
    have equal leaves and different proofs. An empty text is a value, a null one is not. Further columns are kept in `rest` and do not count.
    An empty table has no root and no rows. Raises ValueError if one of the five columns is missing.
    """
    missing = [c for c in FIELDS if c not in docs.columns]
    if missing:
        raise ValueError(f"documents lack {missing}")
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")])
    values = {c: F.col(c) for c in FIELDS}
    digest = leaf(values)
    other = digest if tampered is None else F.coalesce(leaf(values | {"text": tampered}), digest)
    group = F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce("source", F.lit("")))
    leaves = persisted(docs.select(group.alias("grp"), "doc_id", rest.alias("rest"), digest.alias("digest"), other.alias("tampered")).withColumn("row", F.monotonically_increasing_id()), "leaves")
    placed = persisted(_block(ranked(leaves, ["doc_id", "digest", "row"]).drop("row"), depth), "placed")
    tops = persisted(placed.select("grp", "block", "pos", "n", "digest").groupBy("grp", "block").applyInArrow(_roots(depth), NODE), "tops")
    trees = climbed(tops, depth)
    subroots = trees.groupBy("grp").agg(F.first("root").alias("digest"))
    order = ranked(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("source"), "digest"), ["source"])
    order = persisted(order, "sources")
    whole = climbed(order, depth).select("pos", F.col("before").alias("_a"), F.col("behind").alias("_b"), F.col("root").alias("whole"))
    whole = order.join(whole, "pos").select(F.col("source").alias("grp"), "_a", "_b", "whole")
    above = trees.join(whole, "grp").select("grp", F.col("pos").alias("block"), F.concat("before", "_a").alias("before"), F.concat("behind", "_b").alias("behind"), F.col("root").alias("subroot"), F.col("whole").alias("root"))
    above = persisted(above, "above")
    kinds = dict(placed.dtypes)
    out = f"doc_id {kinds['doc_id']}, rest {kinds['rest']}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return placed.groupBy("grp", "block").cogroup(above.groupBy("grp", "block")).applyInArrow(_proofs(depth), out)


def without_breaks() -> Column:
    """The text that has lost its line breaks, where 2 divides the crc32 of the doc_id."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    return manifest(docs, without_breaks()).drop("rest")


def _oracle(levels_: int = 12, above: int = 6) -> str:
    """The same in SQL, level by level: trees of up to 3 ** 12 documents a source and 3 ** 6 sources."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    record = lambda text: f"sha256(concat({', '.join(field(c) if c != 'text' else field(text) for c in FIELDS)}))"
    table = "(SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i)))"
    crc = "xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295), 4294967295)"
    parts = [
        f"crc AS {table}",
        f"doc AS (SELECT *, row_number() OVER () AS row, {record('text')} AS leaf, CASE WHEN {crc} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS bad FROM documents, crc)",
        f"l AS (SELECT doc_id, row, leaf, {record('bad')} AS own, '' || coalesce('1' || source, '0') AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM doc)",
        "a0 AS (SELECT g, i, leaf AS h FROM l)",
        "p0 AS (SELECT row, g, i, own, [] AS way FROM l)",
    ]

    def rise(a: str, p: str, count: int) -> None:
        for k in range(count):
            parts.append(f"{a}n{k} AS (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {a}{k})")
            parts.append(f"{a}r{k} AS (SELECT g, i // 3 AS i, max(n) AS n, list(h ORDER BY i) AS hs FROM {a}n{k} GROUP BY g, i // 3)")
            parts.append(f"{a}{k + 1} AS (SELECT g, i, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {a}r{k})")
            parts.append(
                f"{p}{k + 1} AS (SELECT row, g, i // 3 AS i, CASE WHEN n = 1 THEN own ELSE sha256(array_to_string(list_concat(list_concat(hs[1:i % 3], [own]), hs[i % 3 + 2:]), '')) END AS own,"
                f" CASE WHEN n = 1 THEN way ELSE list_concat(way, list_concat(hs[1:i % 3], hs[i % 3 + 2:])) END AS way FROM (SELECT {p}{k}.*, hs, n FROM {p}{k} JOIN {a}r{k} ON {a}r{k}.g = {p}{k}.g AND {a}r{k}.i = {p}{k}.i // 3))"
            )

    rise("a", "p", levels_)
    parts.append(f"s AS (SELECT g AS source, h, row_number() OVER (ORDER BY g) - 1 AS i FROM a{levels_})")
    parts.append("b0 AS (SELECT '' AS g, i, h FROM s)")
    parts.append(f"q0 AS (SELECT row, '' AS g, s.i, own, way FROM p{levels_} p JOIN s ON s.source = p.g)")
    rise("b", "q", above)
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, s.h AS subroot, b{above}.h AS root, sha256(array_to_string(way, '')) AS proof_sha256, q{above}.own AS folded_root, q{above}.own = b{above}.h AS verified"
        f" FROM l JOIN q{above} USING (row) JOIN s ON s.source = l.g, b{above}"
    )


SQL = _oracle()
