"""Merging: the union of many DAGs, in which nodes with the same label are one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.model import Dag
from arbora.operators import graph, labels
from arbora.session import persisted

KEY = graph.KEY


@dataclass(frozen=True)
class Merged:
    """dag: the merged DAG. labels: node_id, label_key, leafset_key, n_leaves of its nodes."""

    dag: Dag
    labels: DataFrame

    def contains_leafset(self, keys: DataFrame) -> DataFrame:
        """keys (leafset_key) that some node has."""
        return keys.join(self.labels.select("leafset_key").distinct(), "leafset_key", "left_semi")


def labelled(dag: Dag) -> DataFrame:
    high = persisted(graph.heights(dag), "heights")
    sets = persisted(labels.leaf_sets(dag, high), "leafsets")
    return persisted(labels.labels(dag, sets), "labels")


def _relabelled(dag: Dag, label: DataFrame) -> DataFrame:
    """Edges by label: parent_key, child_key, clade_key."""
    p = label.select("dag_id", F.col("node_id").alias("parent_id"), F.col("label_key").alias("parent_key"))
    c = label.select("dag_id", F.col("node_id").alias("child_id"), F.col("label_key").alias("child_key"), F.col("leafset_key").alias("clade_key"))
    return dag.edges.join(p, ["dag_id", "parent_id"]).join(c, ["dag_id", "child_id"]).select("parent_key", "child_key", "clade_key").distinct()


def _nodes(dag: Dag, label: DataFrame, order: list[str] | None) -> DataFrame:
    """One row for each label: the leaf genome is that of the first DAG in order."""
    rank = F.col("dag_id") if order is None else F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col("dag_id")), F.lit(len(order) + 1))
    rows = dag.nodes.join(label, KEY).withColumn("_r", F.struct(rank.alias("a"), F.col("node_id").alias("b")))
    return rows.groupBy("label_key").agg(F.min_by(F.struct("sample_id", "genome", "n_leaves", "leafset_key"), "_r").alias("v")).select("label_key", "v.*")


def _built(nodes: DataFrame, edges: DataFrame, reference: str, name: str) -> Merged:
    """nodes: node_id, label_key, ...; edges: parent_key, child_key, clade_key."""
    dag_id = F.lit(name).alias("dag_id")
    clade = (F.dense_rank().over(Window.partitionBy("parent_key").orderBy("clade_key")) - 1).cast("int")
    ids = nodes.select("node_id", "label_key")
    e = edges.withColumn("clade", clade)
    e = e.join(ids.select(F.col("node_id").alias("parent_id"), F.col("label_key").alias("parent_key")), "parent_key").join(ids.select(F.col("node_id").alias("child_id"), F.col("label_key").alias("child_key")), "child_key")
    e = persisted(e.select(dag_id, F.monotonically_increasing_id().alias("edge_id"), "parent_id", "child_id", "clade"), f"{name}-edges")
    dag = Dag(nodes.select(dag_id, "node_id", "sample_id", "genome"), e, reference)
    return Merged(dag, nodes.select("node_id", "label_key", "leafset_key", "n_leaves"))


def merge(dag: Dag, name: str = "merged", order: list[str] | None = None, label: DataFrame | None = None) -> Merged:
    """The union of all DAGs of the collection; order: which DAG's leaf genomes come first."""
    label = labelled(dag) if label is None else label
    nodes = persisted(_nodes(dag, label, order).withColumn("node_id", F.monotonically_increasing_id()), f"{name}-nodes")
    return _built(nodes, _relabelled(dag, label), dag.reference, name)


def add(merged: Merged, more: Dag, order: list[str] | None = None, label: DataFrame | None = None, edges: DataFrame | None = None) -> Merged:
    """The union with further DAGs: known nodes keep their ids and genomes, new ones follow. edges: more of them, by label (parent_key, child_key, clade_key)."""
    label = labelled(more) if label is None else label
    known = merged.dag.nodes.join(merged.labels, "node_id").select("node_id", "label_key", "sample_id", "genome", "n_leaves", "leafset_key")
    new = _nodes(more, label, order).join(known.select("label_key"), "label_key", "left_anti")
    base = (known.agg(F.max("node_id")).first()[0] or 0) + 1
    new = new.withColumn("node_id", F.monotonically_increasing_id() + F.lit(base))
    nodes = persisted(known.unionByName(new.select(*known.columns)), "merged-nodes")
    own = merged.labels.withColumn("dag_id", F.lit("merged"))
    before = _relabelled(Dag(merged.dag.nodes.withColumn("dag_id", F.lit("merged")), merged.dag.edges.withColumn("dag_id", F.lit("merged")), merged.dag.reference), own)
    found = before.union(_relabelled(more, label))
    return _built(nodes, (found if edges is None else found.union(edges)).distinct(), merged.dag.reference, "merged")


def add_below(merged: Merged, more: Dag, below: DataFrame) -> Merged:
    """The union with what lies below one node (below: dag_id, node_id, a row) of a further DAG: that node, its subtrees and no more, its UA and root left out.

    Labels depend only on what is below a node, so those of the part are those of the whole. The node hangs wherever the merged DAG has a clade of the
    same leaves: its edges from there are added, so that every tree may take it. Below a UA the whole DAG is meant. Raises ValueError if no clade has these leaves.
    """
    if below.join(graph.roots(more), KEY, "left_semi").take(1):
        return add(merged, more)
    part = graph.fragment(more, persisted(graph.reachable(more.edges, below), "below")).persisted("below")
    label = labelled(part)
    top = persisted(label.join(below, KEY, "left_semi").select("leafset_key", F.col("label_key").alias("child_key")), "top")
    known = merged.labels.select("node_id", F.col("label_key").alias("parent_key"))
    sets = merged.labels.select(F.col("node_id").alias("child_id"), "leafset_key")
    holders = merged.dag.edges.join(sets, "child_id").join(top, "leafset_key").select(F.col("parent_id").alias("node_id"), "child_key", F.col("leafset_key").alias("clade_key")).distinct()
    holders = persisted(holders.join(known, "node_id").select("parent_key", "child_key", "clade_key"), "holders")
    if not holders.take(1):
        raise ValueError("no clade of the merged DAG has the leaves of this node")
    return add(merged, part, label=label, edges=holders)


def same(a: Dag, b: Dag) -> DataFrame:
    """Edges by label that only one of two DAGs has: parent_key, child_key, side. No rows if they are equal."""
    x, y = (_relabelled(d, labelled(d)).select("parent_key", "child_key") for d in (a, b))
    return x.exceptAll(y).withColumn("side", F.lit("first")).unionByName(y.exceptAll(x).withColumn("side", F.lit("second")))
