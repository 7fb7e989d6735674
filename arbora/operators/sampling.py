"""Sampling trees from a DAG: one alternative of each clade, from the root down.

Draws are functions of (seed, edge), so a sample is the same wherever and how often a task runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.model import Dag
from arbora.operators import graph
from arbora.operators.weights import WeightOps, log_tree_counts, optimal_edges
from arbora.session import persisted

KEY = graph.KEY


def uniform_draw(seed: int, *columns: str) -> Column:
    """A number in (0, 1)."""
    return (F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)) + 0.5) / (1 << 52)


def _chosen(edges: DataFrame, seed: int, log_weight: Column | None = None) -> DataFrame:
    """One edge of each clade, with a chance in proportion to its weight: the one whose exponential waiting time, here its logarithm, is least."""
    wait = F.log(-F.log(uniform_draw(seed, "dag_id", "edge_id")))
    if log_weight is not None:
        wait = wait - log_weight
    best = edges.withColumn("_wait", F.struct(wait.alias("w"), F.col("edge_id").alias("e")))
    first = best.groupBy("dag_id", "parent_id", "clade").agg(F.min("_wait").alias("_first"))
    return best.join(first, ["dag_id", "parent_id", "clade"]).where("_wait = _first").drop("_wait", "_first")


def _sampled(dag: Dag, edges: DataFrame, start: DataFrame | None) -> Dag:
    edges = persisted(edges.select(*dag.edges.columns), "chosen")
    seen = graph.reachable(edges, graph.roots(dag) if start is None else start)
    kept = edges.join(seen.withColumnRenamed("node_id", "parent_id"), ["dag_id", "parent_id"], "left_semi").select(*dag.edges.columns)
    return dag.replace(dag.nodes.join(seen, KEY, "left_semi"), kept)


def sample_tree(dag: Dag, seed: int, start: DataFrame | None = None) -> Dag:
    """Uniform over the edges of each clade; start (dag_id, node_id): the tree below a node instead of the whole. Node ids are the DAG's own."""
    return _sampled(dag, _chosen(dag.edges, seed), start)


def uniform_sample_tree(dag: Dag, seed: int, start: DataFrame | None = None) -> Dag:
    """Uniform over trees: an edge's chance is in proportion to the trees below its child."""
    n = log_tree_counts(dag).select("dag_id", F.col("node_id").alias("child_id"), "weight")
    return _sampled(dag, _chosen(dag.edges.join(n, ["dag_id", "child_id"]), seed, F.col("weight")), start)


def best_sample_tree(dag: Dag, edge_weights: DataFrame, seed: int, ops: WeightOps | None = None, start: DataFrame | None = None) -> Dag:
    """Uniform over the optimal edges of each clade."""
    return _sampled(dag, _chosen(optimal_edges(dag, edge_weights, ops), seed), start)


def best_uniform_sample_tree(dag: Dag, edge_weights: DataFrame, seed: int, ops: WeightOps | None = None, start: DataFrame | None = None) -> Dag:
    """Uniform over the optimal trees."""
    best = persisted(optimal_edges(dag, edge_weights, ops), "optimal")
    n = log_tree_counts(dag.replace(edges=best)).select("dag_id", F.col("node_id").alias("child_id"), "weight")
    kept = best.join(n, ["dag_id", "child_id"])
    return _sampled(dag, _chosen(kept, seed, F.col("weight")), start)


def subtree_roots(dag: Dag, sets: DataFrame, edge_weights: DataFrame, least: int, most: int, seed: int) -> DataFrame:
    """One node of each DAG to search below: least..most leaves, inner, a genome of its own; weight 1 + (fewest mutations above) squared."""
    kinds = graph.kinds(dag).where("not is_ua and not is_leaf and size(genome) > 0").select(*KEY)
    above = dag.edges.join(edge_weights, ["dag_id", "edge_id"]).groupBy("dag_id", F.col("child_id").alias("node_id")).agg(F.min("edge").alias("muts"))
    met = kinds.join(sets.where(F.col("n_leaves").between(least, most)), KEY).join(above, KEY)
    wait = -F.log(uniform_draw(seed, "dag_id", "node_id")) / (1 + F.col("muts") * F.col("muts"))
    return met.groupBy("dag_id").agg(F.min_by("node_id", wait).alias("node_id"))
