"""Robinson-Foulds distances between all trees of two DAGs, from counts, without listing a tree.

Trees are compared by the leaf sets of their nodes. With N trees in the reference DAG and count(s) of them holding leaf set s, a tree is
sum over its nodes of (N - 2 count) plus the sum of all counts away from them in total.

Counts are decimals of 38 digits; with exact=True they are text, of any size, and numbers of functions/numbers.py in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.functions import numbers as N
from arbora.model import Dag
from arbora.operators import graph
from arbora.operators import weights as W
from arbora.operators.weights import COUNT, WeightOps, number_counts, optimum, parsimony, tree_counts
from arbora.session import persisted

KEY = graph.KEY


def above_counts(dag: Dag, below: DataFrame, heights: DataFrame | None = None, exact: bool = False) -> DataFrame:
    """dag_id, node_id, above: in how many ways a tree can be completed around the tree below each node.

    Top-down: of a parent's ways, times the alternatives of its other clades, the sum over parents. exact: below and above are numbers of any size.
    """
    high = persisted(graph.heights(dag), "heights") if heights is None else heights
    met = dag.edges.join(below.withColumnRenamed("node_id", "child_id"), ["dag_id", "child_id"])
    if exact:
        ways = persisted(W.number_sum(met.select("dag_id", "parent_id", "clade", "weight"), ["dag_id", "parent_id", "clade"]), "ways")
        others = N.others_up(ways, ["dag_id", "parent_id"], "clade", "weight", lambda df: persisted(df, "others")).withColumnRenamed("weight", "others")
    else:
        alternatives = persisted(met.groupBy("dag_id", "parent_id", "clade").agg(F.sum("weight").cast(COUNT).alias("ways")), "ways")
        # A clade has a tree at least, so that the product of the others is that of all, divided.
        whole = alternatives.groupBy("dag_id", "parent_id").agg(W.product(F.col("ways")).alias("all"))
        others = alternatives.join(whole, ["dag_id", "parent_id"]).select("dag_id", "parent_id", "clade", F.call_function("div", F.col("all"), F.col("ways")).cast(COUNT).alias("others"))
    edges = persisted(dag.edges.join(others, ["dag_id", "parent_id", "clade"]).join(high.select("dag_id", F.col("node_id").alias("child_id"), "height"), ["dag_id", "child_id"]), "others")
    done = persisted(graph.roots(dag).select(*KEY, (N.one() if exact else F.lit(1).cast(COUNT)).alias("above")), "above")
    top = high.agg(F.max("height")).first()[0] or 0
    for h in range(top - 1, -1, -1):
        met = edges.where(F.col("height") == h).join(done.withColumnRenamed("node_id", "parent_id"), ["dag_id", "parent_id"])
        if exact:
            each = met.select("dag_id", F.col("child_id").alias("node_id"), N.times(F.col("above"), F.col("others")).alias("above"))
            level = N.add_up(each, KEY, "above")
        else:
            level = met.groupBy("dag_id", F.col("child_id").alias("node_id")).agg(F.sum((F.col("above") * F.col("others")).cast(COUNT)).cast(COUNT).alias("above"))
        done = done.unionByName(persisted(level, "above"))
    return done


def leafset_counts(dag: Dag, sets: DataFrame, heights: DataFrame | None = None, exact: bool = False) -> DataFrame:
    """leafset_key, n_leaves, count: how many trees have a node with these leaves; the UA does not count."""
    below = number_counts(dag, heights) if exact else tree_counts(dag, heights=heights)
    above = above_counts(dag, below, heights, exact)
    met = below.join(above, KEY).join(sets.select(*KEY, "leafset_key", "n_leaves"), KEY).join(graph.roots(dag).select(*KEY), KEY, "left_anti")
    if exact:
        each = met.select("leafset_key", "n_leaves", N.times(F.col("weight"), F.col("above")).alias("count"))
        return N.add_up(each, ["leafset_key", "n_leaves"], "count").withColumn("count", N.text(F.col("count")))
    return met.groupBy("leafset_key", "n_leaves").agg(F.sum((F.col("weight") * F.col("above")).cast(COUNT)).cast(COUNT).alias("count"))


def rf_weights(dag: Dag, sets: DataFrame, counts: DataFrame, n_trees: int, exact: bool = False) -> DataFrame:
    """Edge weights N - 2 count(leaf set of the child), N where the reference lacks it."""
    child = sets.select("dag_id", F.col("node_id").alias("child_id"), "leafset_key")
    met = dag.edges.join(child, ["dag_id", "child_id"]).join(counts.select("leafset_key", "count"), "leafset_key", "left")
    n = F.lit(str(n_trees))
    if exact:
        twice = N.times(N.of_long(F.lit(-2)), N.of_text(F.coalesce("count", F.lit("0"))))
        return met.select("dag_id", "edge_id", N.plus(N.of_text(n), twice).alias("edge"))
    n = n.cast(COUNT)
    return met.select("dag_id", "edge_id", (n - 2 * F.coalesce("count", F.lit(0).cast(COUNT))).cast(COUNT).alias("edge"))


def sum_rf(dag: Dag, sets: DataFrame, counts: DataFrame, n_trees: int, most: bool = False, heights: DataFrame | None = None, exact: bool = False) -> DataFrame:
    """dag_id, weight: the least (or largest) sum of distances of a tree of dag to all trees of the reference.

    counts, n_trees: of the reference. With a reference of one tree this is the least (largest) distance to it.
    """
    edges = rf_weights(dag, sets, counts, n_trees, exact)
    if exact:
        edges = persisted(edges, "rf")
        shift = N.add_up(counts.select(N.of_text(F.col("count")).alias("n")), [], "n")
        best = W.fold_rows(dag, N.zero(), W.by(F.max if most else F.min), W.number_sum, N.plus, edges, heights)
        return graph.roots(dag).select(*KEY).join(best, KEY).join(F.broadcast(shift)).select("dag_id", N.text(N.plus(F.col("weight"), F.coalesce("n", N.zero()))).alias("weight"))
    shift = counts.agg(F.sum("count").cast(COUNT)).first()[0] or 0
    ops = parsimony(F.max if most else F.min)
    best = optimum(dag, edges, WeightOps(F.lit(0).cast(COUNT), lambda e, w: (e + w).cast(COUNT), lambda w: F.sum(w).cast(COUNT), ops.best), heights)
    return graph.roots(dag).select(*KEY).join(best, KEY).select("dag_id", (F.col("weight") + F.lit(str(shift)).cast(COUNT)).cast(COUNT).alias("weight"))


def sum_rf_trees(dag: Dag, sets: DataFrame, counts: DataFrame, n_trees: int, most: bool = False, heights: DataFrame | None = None) -> DataFrame:
    """dag_id, weight: how many trees of dag have the least (or largest) sum of distances, as text; counts: exact, as text."""
    edges = persisted(rf_weights(dag, sets, counts, n_trees, exact=True), "rf")
    best = F.max if most else F.min
    below = W.fold_rows(dag, N.zero(), W.by(best), W.number_sum, N.plus, edges, heights)
    kept = W.optimal_edges(dag, edges, WeightOps(N.zero(), N.plus, F.first, best), below)
    return W.at_root(dag, tree_counts(dag.replace(edges=persisted(kept, "optimal")), exact=True, heights=heights))
