"""How many moves a tree has and what the best and the worst of them change, without a row for each.

The leaves of a node hang at the same place, and what a site adds to a move depends on the place and on the bases there alone (scoring.py). So
two leaves of each node stand for all of it: their moves are proposed, and each is scored by site once for every base, or pair of bases, that the leaves
have there. A leaf's change is the sum of its cells of that table, that of two leaves the sum over their pairs of bases. Leaves of equal genomes are one; the others meet in blocks, every two
blocks in a task of their own, where the sums of all pairs are a product of matrices. All pairs are looked at; only their least and largest sums are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.functions import bases as B
from arbora.functions import genomes as G
from arbora.model import Dag
from arbora.operators import graph, sankoff, search
from arbora.operators import index as I
from arbora.operators.scoring import COUNTS, MOVE, _first, _followed, _placed, fitch_scores, site_counts
from arbora.session import persisted

KEY = graph.KEY
#: Different genomes in a block; rows of a product that are made at once.
BLOCK, ROWS = 8_192, 128
DIGITS = "0123456789ABCDEF"
_VALUE = np.zeros(256, np.uint8)
_VALUE[[ord(x) for x in DIGITS]] = range(16)


def _matrix(text: str, n: int) -> np.ndarray:
    """The masks of n leaves by site."""
    return _VALUE[np.frombuffer(text.encode(), np.uint8)].reshape(n, -1)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _kinds(table: pa.Table) -> pa.Table:
    """How many leaves of a block have each mask at each site."""
    n = _column(table, "n")
    masks = _matrix(table.column("text")[0].as_py(), len(n))
    found = np.stack([((masks == m) * n[:, None]).sum(0) for m in range(16)], 1) if masks.shape[1] else np.zeros((0, 16), np.int64)
    at, mask = found.nonzero()
    same = lambda name: pa.array(table.column(name).to_pylist() * len(at), table.schema.field(name).type)
    return pa.table({"dag_id": same("dag_id"), "parent_id": same("parent_id"), "at": pa.array(at, pa.int32()), "mask": pa.array(mask, pa.int32()), "n": pa.array(found[at, mask], pa.int64())})


def spans(cells: np.ndarray, a: np.ndarray | None, b: np.ndarray | None, single: np.ndarray | None = None) -> tuple[float, float] | None:
    """The least and the largest sum over sites of cells[site, mask in a, mask in b] of all rows of a with all of b; where a side is None, it has one mask at each site.

    single: a and b are the same rows, and these of them do not meet themselves. None if there is no pair.
    """
    sites = np.arange(len(cells))
    if a is None or b is None:
        table, rows = (cells.sum(2), a) if b is None else (cells.sum(1), b)
        sums = np.zeros(1) + cells.sum() if rows is None else table[sites, rows].sum(1)
        return float(sums.min()), float(sums.max())
    # A row of a has the differences of its cells to those with a mask of b that is left out; that mask is chosen such that few columns are not 0.
    left, right, rest = [], [], np.zeros(len(a))
    for k in sites:
        own, masks = cells[k], np.unique(b[:, k])
        used = own[np.unique(a[:, k])]
        least = min(masks, key=lambda m: (used[:, masks] != used[:, [m]]).any(0).sum())
        rest += own[a[:, k], least]
        for m in masks:
            if (used[:, m] != used[:, least]).any():
                left.append((own[:, m] - own[:, least])[a[:, k]])
                right.append(b[:, k] == m)
    exact = np.float32 if np.abs(cells).max(axis=(1, 2), initial=0).sum() < 2**22 else np.float64  # whole numbers of up to 24 bits
    left = np.ascontiguousarray(np.stack([*left, rest], 1), exact)
    right = np.ascontiguousarray(np.stack([*right, np.ones(len(b), bool)], 0), exact)
    low, high = np.inf, -np.inf
    product = np.empty((ROWS, right.shape[1]), exact)
    for start in range(0, len(left), ROWS):
        some = left[start : start + ROWS]
        out = np.matmul(some, right, out=product[: len(some)])
        for no in (np.inf, -np.inf):
            if single is not None:
                own = single[(start <= single) & (single < start + ROWS)]
                out[own - start, own] = no
            if no > 0:
                low = min(low, float(out.min()))
            else:
                high = max(high, float(out.max()))
    return (low, high) if low <= high and np.isfinite(low) else None


def _extremes(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Of a move's two blocks: MOVE, best, worst."""
    sides = []
    for table in (left, right):
        there = table.num_rows and table.column("text")[0].is_valid
        n = _column(table, "n") if there else None
        sides.append(_matrix(table.column("text")[0].as_py(), len(n)) if there else None)
        if table is left:
            single = np.flatnonzero(n == 1) if there and left.column("siblings")[0].as_py() and key[3].as_py() == key[4].as_py() else None
    cells = np.zeros((next(x for x in sides if x is not None).shape[1], 16, 16))
    if left.column("cells")[0].is_valid:
        at, x, y, d = left.column("cells").combine_chunks().flatten().flatten()
        cells[at.to_numpy(), x.to_numpy(), y.to_numpy()] = d.to_numpy()
    found = spans(cells, *sides, single)
    ends = [[]] * 2 if found is None else [[int(x)] for x in found]
    return pa.table({name: pa.array([k.as_py()] * len(ends[0]), k.type) for name, k in zip(MOVE, key, strict=False)} | {name: pa.array(x, pa.int64()) for name, x in zip(("best", "worst"), ends, strict=True)})


def _at_sites(rows: DataFrame, sites: DataFrame, places: DataFrame) -> DataFrame:
    """rows (dag_id, genome and more) with masks, those of the genome at the DAG's sites in order, for genome."""
    if sites.count() <= sankoff.FEW_SITES:
        met = rows.join(F.broadcast(places), "dag_id", "left")
    else:
        part = F.pmod(F.xxhash64("genome"), F.lit(sankoff.SALTS)).cast("int")
        met = rows.withColumn("_part", part).join(places.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(sankoff.SALTS - 1)))), ["dag_id", "_part"], "left").drop("_part")
    both = G._zipped(F.col("genome"), F.coalesce("_sites", G.empty()), lambda i, x, y: B.mask(F.coalesce(x, y)))
    return met.withColumn("masks", F.transform(F.array_sort(F.map_entries(both)), lambda e: e["value"])).drop("genome", "_sites")


def move_ranges(dag: Dag, radius: int, block: int = BLOCK) -> DataFrame:
    """dag_id, distance, moves, best, worst: of all moves that search.proposals() makes, how many there are and the least and largest change that scoring.move_changes() gives.

    For trees with many leaves at a node; leaves of nodes with few are a row of scoring each, as there.
    """
    # Genomes have entries only where they differ from the reference, which the UA has.
    sites = persisted(dag.nodes.select("dag_id", F.explode("genome.pos").alias("pos")).distinct(), "sites")
    places = persisted(sites.groupBy("dag_id").agg(F.array_sort(F.collect_list(G.entry(F.col("pos"), F.substring(dag.reference_column(), F.col("pos"), F.lit(1))))).alias("_sites")), "places")
    numbered = persisted(places.select("dag_id", F.posexplode("_sites.pos").alias("at", "pos")), "numbered")
    up = dag.edges.select("dag_id", F.col("child_id").alias("node_id"), "parent_id")
    digit = lambda m: F.substring(F.lit(DIGITS), m + 1, F.lit(1))
    leaf = _at_sites(graph.leaves(dag).select(*KEY, "genome").join(up, KEY), sites, places).select(*KEY, "parent_id", F.array_join(F.transform("masks", digit), "").alias("text"))
    leaf = persisted(leaf, "leaf-masks")
    inner = dag.edges.select("dag_id", F.col("parent_id").alias("node_id")).distinct()
    own = _at_sites(dag.nodes.join(inner, KEY, "left_semi").select(*KEY, "genome"), sites, places)
    own = persisted(own.select(*KEY, F.posexplode("masks").alias("at", "mask")), "inner-masks")

    hub = ["dag_id", "parent_id"]
    hubs = persisted(leaf.groupBy(*hub).agg(F.min("node_id").alias("first"), F.max("node_id").alias("last"), F.count("*").alias("m")), "hubs")
    classes = persisted(leaf.groupBy(*hub, "text").agg(F.count("*").alias("n")), "classes")
    large = classes.groupBy(*hub).agg(F.ceil(F.count("*") / block).alias("blocks")).where("blocks > 1")  # few: of so many leaves each
    dealt = classes.join(F.broadcast(large), hub, "left").withColumn("block", F.pmod(F.xxhash64("text"), F.coalesce("blocks", F.lit(1))).cast("int"))
    packed = dealt.groupBy(*hub, "block").agg(F.collect_list(F.struct("text", "n")).alias("rows")).select(*hub, "block", F.array_join("rows.text", "").alias("text"), F.col("rows.n").alias("n"))
    packed = persisted(packed, "packed")
    kinds = packed.groupBy(*hub, "block").applyInArrow(_kinds, "dag_id string, parent_id bigint, at int, mask int, n bigint").groupBy(*hub, "at", "mask").agg(F.sum("n").alias("n"))
    kinds = persisted(kinds, "kinds")

    # The tree with the first and the last leaf of each node, and with the first alone, which has the bases of all.
    role = lambda rows, node, name: rows.select("dag_id", F.col(node).alias("node_id"), F.lit(name).alias("role"), F.col("parent_id").alias("hub"), "m")
    roles = role(hubs, "first", "first").unionByName(role(hubs.where("last <> first"), "last", "last"))
    roles = persisted(roles.unionByName(inner.select(*KEY, F.lit("inner").alias("role"), F.lit(None).cast("bigint").alias("hub"), F.lit(1).cast("bigint").alias("m"))), "roles")
    held = lambda rows: dag.replace(dag.nodes.join(rows, KEY, "left_semi"), dag.edges.join(rows.withColumnRenamed("node_id", "child_id"), ["dag_id", "child_id"], "left_semi"))
    thin = held(roles.select(*KEY)).persisted("thin")
    one = held(roles.where("role <> 'last'").select(*KEY)).persisted("one-leaf")
    index = I.build(thin)
    children = dag.edges.groupBy("dag_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n"))
    side = lambda name: roles.select("dag_id", F.col("node_id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("role", "hub", "m")])
    siblings = F.coalesce(F.col("src_hub") == F.col("dst_hub"), F.lit(False))
    moves = search.proposals(thin, radius, index, children=children).join(side("src"), ["dag_id", "src"]).join(side("dst"), ["dag_id", "dst"]).withColumn("siblings", siblings)
    moves = moves.where("src_role <> 'last' and (dst_role <> 'last' or siblings)").withColumn("moves", F.col("src_m") * F.when(F.col("siblings"), F.col("dst_m") - 1).otherwise(F.col("dst_m")))
    moves = persisted(moves.select(*MOVE, "distance", "src_hub", "dst_hub", "siblings", "moves"), "classes-of-moves")

    states = kinds.join(numbered, ["dag_id", "at"]).join(hubs, hub).select("dag_id", F.col("first").alias("node_id"), "pos", "mask", "n")
    sets = persisted(sankoff.fitch_sets(one, sites, states), "sets")
    counts = persisted(site_counts(one, sets).join(index.nodes.select(*KEY, "parent_id"), KEY), "site-counts")
    masks = sets.select(*KEY, "pos", "mask")
    twins = masks.join(hubs.where("last <> first").select("dag_id", F.col("first").alias("node_id"), "last"), KEY).select("dag_id", F.col("last").alias("node_id"), "pos", "mask")
    masks = persisted(masks.unionByName(twins), "masks")
    met = _placed(index, moves)
    for node, keys in (("src", ["dag_id", "src"]), ("dst", ["dag_id", "dst", "pos"])):
        met = met.join(masks.select("dag_id", F.col("node_id").alias(node), "pos", F.col("mask").alias(f"{node}_mask")), keys)
    for node in "pq":
        met = met.join(counts.select("dag_id", F.col("node_id").alias(node), "pos", *[F.col(c).alias(f"{node}_{c}") for c in ("mask", "k", *COUNTS)]), ["dag_id", node, "pos"])
    key = [*MOVE, "src_mask", "dst_mask"]
    deltas = persisted(_followed(_first(persisted(met, "met"), key), counts, key, [*key, "pos"]), "deltas")

    whole = F.col("src_hub").isNull() & F.col("dst_hub").isNull()
    single = moves.where(whole).join(deltas.groupBy(*MOVE).agg(F.sum("delta").cast("bigint").alias("best")), MOVE, "left").select(*MOVE, F.coalesce("best", F.lit(0)).alias("best")).withColumn("worst", F.col("best"))
    cells = deltas.join(numbered, ["dag_id", "pos"]).groupBy(*MOVE).agg(F.collect_list(F.struct("at", "src_mask", "dst_mask", F.col("delta").cast("int").alias("delta"))).alias("cells"))
    ids = moves.where(~whole).select(*MOVE, "src_hub", "dst_hub", "siblings")
    for end, number in (("src", "i"), ("dst", "j")):
        ids = ids.join(packed.select("dag_id", F.col("parent_id").alias(f"{end}_hub"), F.col("block").alias(number)), ["dag_id", f"{end}_hub"], "left")
    ids = persisted(ids.where("not siblings or i <= j").fillna(-1, ["i", "j"]), "pairs-of-blocks")
    of = lambda end, number: packed.select("dag_id", F.col("parent_id").alias(f"{end}_hub"), F.col("block").alias(number), "text", "n")
    lefts = ids.join(of("src", "i"), ["dag_id", "src_hub", "i"], "left").join(cells, MOVE, "left").select(*MOVE, "i", "j", "siblings", "text", "n", "cells")
    rights = ids.join(of("dst", "j"), ["dag_id", "dst_hub", "j"]).select(*MOVE, "i", "j", "text", "n")
    rights, by = rights.toDF(*rights.columns), [*MOVE, "i", "j"]
    ends = lefts.groupBy(*by).cogroup(rights.groupBy(*by)).applyInArrow(_extremes, "dag_id string, src bigint, dst bigint, best bigint, worst bigint")
    found = persisted(ends, "ends").unionByName(single).join(moves.select(*MOVE, "distance"), MOVE).groupBy("dag_id", "distance").agg(F.min("best").alias("best"), F.max("worst").alias("worst"))

    # The best genomes against those that the tree has.
    of_parent = own.select("dag_id", F.col("node_id").alias("parent_id"), "at", F.col("mask").alias("_p"))
    apart = F.col("mask").bitwiseAND(F.col("_p")) == 0
    inside = up.join(own, KEY).join(of_parent, [*hub, "at"]).where(apart).select("dag_id", F.lit(1).cast("bigint").alias("n"))
    score = kinds.join(of_parent, [*hub, "at"]).where(apart).select("dag_id", "n").unionByName(inside).groupBy("dag_id").agg(F.sum("n").alias("score"))
    base = persisted(fitch_scores(one, sets).join(score, "dag_id", "full").select("dag_id", (F.coalesce("fitch", F.lit(0)) - F.coalesce("score", F.lit(0))).alias("base")), "base")
    out = moves.groupBy("dag_id", "distance").agg(F.sum("moves").alias("moves")).join(found, ["dag_id", "distance"]).join(base, "dag_id", "left").withColumn("base", F.coalesce("base", F.lit(0)))
    return out.select("dag_id", "distance", "moves", *[(F.col(c) + F.col("base")).cast("bigint").alias(c) for c in ("best", "worst")])
