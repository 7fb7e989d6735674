"""Weights of trees by dynamic programming over the DAG, one level of height at a time.

A weight is folded from the leaves up: an edge's weight is put above its child's, the alternatives of a clade are
brought together within the clade, and clades are brought together at their node. Each level is one join and two
aggregations with partial sums on the map side, so a node is one row however many trees hold it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.functions import bases as B
from arbora.functions import genomes as G
from arbora.functions import numbers as N
from arbora.model import Dag
from arbora.operators import graph
from arbora.session import persisted

KEY = graph.KEY
COUNT = "decimal(38,0)"
Fold = Callable[[Column], Column]


def product(w: Column) -> Column:
    """Exact product of decimals; an error beyond 38 digits (number_product has no such end)."""
    return F.aggregate(F.collect_list(w), F.lit(1).cast(COUNT), lambda a, b: (a * b).cast(COUNT))


Step = Callable[[DataFrame, list[str]], DataFrame]


def by(agg: Fold) -> Step:
    """An aggregate as a step of fold_rows."""
    return lambda rows, key: rows.groupBy(*key).agg(agg(F.col("weight")).alias("weight"))


def log_sum(rows: DataFrame, key: list[str]) -> DataFrame:
    """A step: logarithm of the sum of what the weights are logarithms of. The largest first, then the sum of the rest in proportion to it."""
    most = rows.groupBy(*key).agg(F.max("weight").alias("_most"))
    apart = rows.join(most, key).groupBy(*key).agg(F.first("_most").alias("_most"), F.sum(F.exp(F.col("weight") - F.col("_most"))).alias("_sum"))
    return apart.select(*key, (F.col("_most") + F.log("_sum")).alias("weight"))


def number_sum(rows: DataFrame, key: list[str]) -> DataFrame:
    """A step: the sum of numbers of any size (functions/numbers.py)."""
    return N.add_up(rows, key, "weight")


def number_product(rows: DataFrame, key: list[str]) -> DataFrame:
    """A step: the product of numbers of any size over the clades of a node."""
    return N.multiply_up(rows, key, "clade", "weight", lambda df: persisted(df, "product"))


def fold_rows(dag: Dag, leaf: Column, within: Step, between: Step, above: Callable[[Column, Column], Column] | None = None, edge_weights: DataFrame | None = None, heights: DataFrame | None = None) -> DataFrame:
    """dag_id, node_id, weight.

    leaf: of the node's columns. above(edge, child): the weight of an edge (column `edge` of edge_weights: dag_id, edge_id, edge) and its child's.
    within and between: steps from rows (dag_id, parent_id, clade, weight) to one for each clade, and from these to one for each dag_id, parent_id.
    """
    high = persisted(graph.heights(dag), "heights") if heights is None else heights
    edges = dag.edges
    if edge_weights is not None:
        edges = edges.join(edge_weights, ["dag_id", "edge_id"])
    edges = persisted(edges.join(high.select("dag_id", F.col("node_id").alias("parent_id"), "height"), ["dag_id", "parent_id"]), "by-height")
    done = persisted(graph.leaves(dag).select(*KEY, leaf.alias("weight")), "weight0")
    edge = F.col("edge") if edge_weights is not None else None
    for h in range(1, (high.agg(F.max("height")).first()[0] or 0) + 1):
        met = edges.where(F.col("height") == h).join(done.withColumnRenamed("node_id", "child_id"), ["dag_id", "child_id"])
        w = F.col("weight") if above is None else above(edge, F.col("weight"))
        clades = within(met.select("dag_id", "parent_id", "clade", w.alias("weight")), ["dag_id", "parent_id", "clade"])
        level = persisted(between(clades, ["dag_id", "parent_id"]).withColumnRenamed("parent_id", "node_id"), f"weight{h}")
        done = done.unionByName(level)
    return done


def fold(dag: Dag, leaf: Column, within: Fold, between: Fold, above: Callable[[Column, Column], Column] | None = None, edge_weights: DataFrame | None = None, heights: DataFrame | None = None) -> DataFrame:
    """fold_rows, where within and between are aggregates over the alternatives of a clade, and over the clades of a node."""
    return fold_rows(dag, leaf, by(within), by(between), above, edge_weights, heights)


def at_root(dag: Dag, weights: DataFrame) -> DataFrame:
    """dag_id, weight of each UA."""
    return graph.roots(dag).select(*KEY).join(weights, KEY).select("dag_id", "weight")


def mutations(dag: Dag) -> DataFrame:
    """dag_id, edge_id, parent_id, child_id, muts: the mutations of every edge, from its nodes' genomes."""
    g = dag.nodes.select("dag_id", "node_id", "genome")
    p = g.select("dag_id", F.col("node_id").alias("parent_id"), F.col("genome").alias("_p"))
    c = g.select("dag_id", F.col("node_id").alias("child_id"), F.col("genome").alias("_c"))
    both = dag.edges.join(p, ["dag_id", "parent_id"]).join(c, ["dag_id", "child_id"])
    return both.select("dag_id", "edge_id", "parent_id", "child_id", "clade", G.mutations_between(F.col("_p"), F.col("_c"), dag.reference_column()).alias("muts"))


def mutation_rows(dag: Dag) -> DataFrame:
    """dag_id, edge_id, pos, par, mut."""
    return mutations(dag).select("dag_id", "edge_id", F.explode("muts").alias("m")).select("dag_id", "edge_id", "m.pos", "m.par", "m.mut")


def parsimony_weights(dag: Dag, ua_free: bool = False, declared: DataFrame | None = None) -> DataFrame:
    """dag_id, edge_id, edge: the number of mutations on each edge.

    On an edge to a leaf a mutation to an ambiguous base from an unambiguous one does not count; with ua_free,
    edges from the UA count nothing and all other mutations do. declared: dag_id, edge_id, pos, par, mut instead of what the genomes say.
    """
    if declared is None:
        each = mutations(dag).select("dag_id", "edge_id", "parent_id", "child_id", F.explode_outer("muts").alias("m")).select("dag_id", "edge_id", "parent_id", "child_id", "m.par", "m.mut")
    else:
        each = dag.edges.join(declared, ["dag_id", "edge_id"], "left").select("dag_id", "edge_id", "parent_id", "child_id", "par", "mut")
    kinds = graph.kinds(dag).select(*KEY, "is_ua", "is_leaf")
    each = each.join(kinds.select("dag_id", F.col("node_id").alias("child_id"), "is_leaf"), ["dag_id", "child_id"]).join(kinds.select("dag_id", F.col("node_id").alias("parent_id"), "is_ua"), ["dag_id", "parent_id"])
    counts = F.col("mut").isNotNull()
    if ua_free:
        counts &= ~F.col("is_ua")
    else:
        counts &= ~(F.col("is_leaf") & B.is_ambiguous(B.mask(F.col("mut"))) & ~B.is_ambiguous(B.mask(F.col("par"))))
    return each.groupBy("dag_id", "edge_id").agg(F.sum(counts.cast("bigint")).alias("edge"))


@dataclass(frozen=True)
class WeightOps:
    """A weight to optimise, or to count: the five operations of the fold as columns.

    best: how the alternatives of a clade are brought together; F.min and F.max choose, and keep all ties.
    """

    leaf: Column
    above: Callable[[Column, Column], Column]
    between: Fold
    best: Fold


def parsimony(best: Fold = F.min) -> WeightOps:
    return WeightOps(F.lit(0).cast("bigint"), lambda e, w: e + w, F.sum, best)


def optimum(dag: Dag, edge_weights: DataFrame, ops: WeightOps | None = None, heights: DataFrame | None = None) -> DataFrame:
    """dag_id, node_id, weight: the best weight of a tree below each node."""
    ops = ops or parsimony()
    return fold(dag, ops.leaf, ops.best, ops.between, ops.above, edge_weights, heights)


def optimal_edges(dag: Dag, edge_weights: DataFrame, ops: WeightOps | None = None, below: DataFrame | None = None) -> DataFrame:
    """The edges, all ties kept, that a best tree below their parent can take."""
    ops = ops or parsimony()
    below = optimum(dag, edge_weights, ops) if below is None else below
    met = dag.edges.join(edge_weights, ["dag_id", "edge_id"]).join(below.withColumnRenamed("node_id", "child_id"), ["dag_id", "child_id"])
    met = met.withColumn("total", ops.above(F.col("edge"), F.col("weight")))
    best = met.groupBy("dag_id", "parent_id", "clade").agg(ops.best(F.col("total")).alias("best"))
    return met.join(best, ["dag_id", "parent_id", "clade"]).where("total = best").select(*dag.edges.columns)


def trim(dag: Dag, edge_weights: DataFrame, ops: WeightOps | None = None) -> Dag:
    """The part of the DAG that holds exactly the trees of best weight."""
    kept = persisted(optimal_edges(dag, edge_weights, ops), "optimal")
    seen = graph.reachable(kept, graph.roots(dag))
    edges = kept.join(seen.withColumnRenamed("node_id", "parent_id"), ["dag_id", "parent_id"], "left_semi").select(*dag.edges.columns)
    return dag.replace(dag.nodes.join(seen, KEY, "left_semi"), edges)


def number_counts(dag: Dag, heights: DataFrame | None = None) -> DataFrame:
    """dag_id, node_id, weight: how many trees are below each node, as a number of any size."""
    return fold_rows(dag, N.one(), number_sum, number_product, heights=heights)


def tree_counts(dag: Dag, exact: bool = False, heights: DataFrame | None = None) -> DataFrame:
    """dag_id, node_id, weight: how many trees are below each node; exact: as text, of any size."""
    if exact:
        return number_counts(dag, heights).withColumn("weight", N.text(F.col("weight")))
    return fold(dag, F.lit(1).cast(COUNT), lambda w: F.sum(w).cast(COUNT), product, heights=heights)


def log_tree_counts(dag: Dag, heights: DataFrame | None = None) -> DataFrame:
    """dag_id, node_id, weight: the natural logarithm of the number of trees below each node, however many they are."""
    return fold_rows(dag, F.lit(0.0), log_sum, by(F.sum), heights=heights)


def optimal_tree_counts(dag: Dag, edge_weights: DataFrame, ops: WeightOps | None = None, exact: bool = False, heights: DataFrame | None = None) -> DataFrame:
    """dag_id, node_id, weight: how many best trees are below each node."""
    best = optimal_edges(dag, edge_weights, ops, optimum(dag, edge_weights, ops, heights))
    return tree_counts(dag.replace(edges=persisted(best, "optimal")), exact, heights)


# Histograms: weight -> how many trees have it, as rows (key columns, weight, n); n is a number of any size (functions/numbers.py).


def counter_sum(counters: DataFrame, key: list[str]) -> DataFrame:
    """Multiset union of the counters of each key; n: numbers of any size, or decimals of 38 digits."""
    if dict(counters.dtypes)["n"] == N.KIND:
        return N.add_up(counters, [*key, "weight"], "n")
    return counters.groupBy(*key, "weight").agg(F.sum("n").cast(COUNT).alias("n"))


def counter_product(a: DataFrame, b: DataFrame, key: list[str], pair: Callable[[Column, Column], Column] = lambda x, y: x + y) -> DataFrame:
    """Every weight of a with every weight of b of the same key, paired; a key that one of them lacks has no rows."""
    times = N.times if dict(a.dtypes)["n"] == N.KIND else lambda x, y: (x * y).cast(COUNT)
    b = b.select(*key, F.col("weight").alias("_w"), F.col("n").alias("_n"))
    met = a.join(b, key) if key else a.crossJoin(b)
    return counter_sum(met.select(*key, pair(F.col("weight"), F.col("_w")).alias("weight"), times(F.col("n"), F.col("_n")).alias("n")), key)


def distribution(dag: Dag, edge_weights: DataFrame, ops: WeightOps | None = None, pair: Callable[[Column, Column], Column] = lambda x, y: x + y, heights: DataFrame | None = None) -> DataFrame:
    """dag_id, node_id, weight, n: of all trees below each node, how many have each weight, for any weight; n is a number of any size.

    pair(a, b): what ops.between makes of two clades. Clades with alternatives are folded in pairs, so that a node of k clades takes log2(k) rounds, the
    others by ops.between at once; rows are distinct weights, not trees.
    """
    ops = ops or parsimony()
    high = persisted(graph.heights(dag), "heights") if heights is None else heights
    edges = persisted(dag.edges.join(edge_weights, ["dag_id", "edge_id"]).join(high.select("dag_id", F.col("node_id").alias("parent_id"), "height"), ["dag_id", "parent_id"]), "by-height")
    done = persisted(graph.leaves(dag).select(*KEY, ops.leaf.alias("weight"), N.one().alias("n")), "counter0")
    key = ["dag_id", "parent_id", "clade"]
    for h in range(1, (high.agg(F.max("height")).first()[0] or 0) + 1):
        met = edges.where(F.col("height") == h).join(done.withColumnRenamed("node_id", "child_id"), ["dag_id", "child_id"])
        part = persisted(counter_sum(met.select(*key, ops.above(F.col("edge"), F.col("weight")).alias("weight"), "n"), key), "counter")
        # Clades of a single weight and tree are one aggregate; only those with alternatives are paired.
        many = part.groupBy(*key).agg(F.count("*").alias("_k"), F.first("n").alias("_n")).where((F.col("_k") > 1) | (F.col("_n") != N.one())).select(*key)
        single = part.join(many, key, "left_anti").groupBy("dag_id", "parent_id").agg(ops.between(F.col("weight")).alias("weight"), F.min("clade").alias("clade"))
        part = persisted(part.join(many, key, "left_semi").unionByName(single.select(*key, "weight", N.one().alias("n"))), "counter")
        while (part.agg(F.max("clade")).first()[0] or 0) > 0:
            of = lambda r: part.where(F.col("clade") % 2 == r).withColumn("clade", F.floor(F.col("clade") / 2).cast("int"))  # noqa: B023, E731
            even, odd = of(0), of(1)
            alone = even.join(odd.select(*key).distinct(), key, "left_anti")
            part = persisted(counter_product(even, odd, key, pair).unionByName(alone.select(*key, "weight", "n")), "counter")
        done = done.unionByName(part.select("dag_id", F.col("parent_id").alias("node_id"), "weight", "n"))
    return done


def histogram(dag: Dag, edge_weights: DataFrame, heights: DataFrame | None = None) -> DataFrame:
    """dag_id, node_id, weight, n: of all trees below each node, how many have each sum of edge weights; n is text, of any size."""
    return distribution(dag, edge_weights, heights=heights).withColumn("n", N.text(F.col("n")))
