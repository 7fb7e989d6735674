"""An index of trees: depths, preorder intervals and jumps to ancestors at distances that double.

A tree of depth d takes log2(d) rounds of one row a node, however it is shaped: no row for each pair of a node and its ancestor. A node's
descendants are those that enter within its interval, so that "below" is a comparison; common ancestors are found by jumps.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.model import Dag
from arbora.session import persisted

KEY = ["dag_id", "node_id"]
#: Children of a node that are numbered in one task.
CHUNK = 4_096


def doubled(dag: Dag) -> tuple[DataFrame, list[DataFrame]]:
    """dag_id, node_id, depth, size (nodes below, itself included); and by k the ancestors 2 ** k edges above: dag_id, node_id, up, of nodes that have one.

    In round k a node knows the steps of its way up, and the nodes below it, within 2 ** k edges. Raises ValueError on a cycle, or if a node has two parents.
    """
    parent = dag.edges.select("dag_id", F.col("child_id").alias("node_id"), F.col("parent_id").alias("up"))
    first = dag.nodes.select(*KEY).join(parent, KEY, "left").select(*KEY, "up", F.col("up").isNotNull().cast("bigint").alias("depth"), F.lit(1).cast("bigint").alias("size"))
    step, nodes = persisted(first, "step"), dag.nodes.count()
    if step.count() != nodes:
        raise ValueError("only trees have an index: a node has several parents")
    jumps, reach = [], 1
    while step.where("up is not null").take(1):
        if reach > nodes:
            raise ValueError("no ancestors on a cycle")
        reach *= 2
        jumps.append(step.where("up is not null").select(*KEY, "up"))
        above = step.select("dag_id", F.col("node_id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        below = step.where("up is not null").groupBy("dag_id", F.col("up").alias("node_id")).agg(F.sum("size").alias("_size"))
        met = step.join(above, ["dag_id", "up"], "left").join(below, KEY, "left")
        step = persisted(met.select(*KEY, F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), (F.col("size") + F.coalesce("_size", F.lit(0))).alias("size")), "step")
    return step.select(*KEY, "depth", "size"), jumps


def along_path(own: DataFrame, jumps: list[DataFrame], combine: Callable[[Column, Column], Column]) -> DataFrame:
    """own: dag_id, node_id, value. The values on the way from the root to each node, its own included, combined; combine(above, below) is associative."""
    for jump in jumps:
        above = own.select("dag_id", F.col("node_id").alias("up"), F.col("value").alias("_above"))
        met = own.join(jump.join(above, ["dag_id", "up"]), KEY, "left")
        own = persisted(met.select(*KEY, F.when(F.col("up").isNull(), F.col("value")).otherwise(combine(F.col("_above"), F.col("value"))).alias("value")), "path")
    return own


@dataclass(frozen=True)
class TreeIndex:
    """nodes: dag_id, node_id, parent_id, depth, enter (the place in depth-first order, from 0) and leave (that of the last node below).
    jumps: by k, dag_id, node_id, up, and up's enter, leave and depth."""

    nodes: DataFrame
    jumps: list[DataFrame]

    def side(self, name: str, *columns: str) -> DataFrame:
        """nodes as dag_id, <name>, and the columns asked for as <name>_<column>."""
        return self.nodes.select("dag_id", F.col("node_id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])


def over(upper: str, lower: str) -> Column:
    """Whether the node whose enter and leave are <upper>_enter, <upper>_leave is strictly above that of <lower>_enter."""
    return (F.col(f"{upper}_enter") < F.col(f"{lower}_enter")) & (F.col(f"{lower}_enter") <= F.col(f"{upper}_leave"))


def build(dag: Dag) -> TreeIndex:
    sizes, jumps = doubled(dag)
    child = dag.edges.join(sizes.select("dag_id", F.col("node_id").alias("child_id"), "size"), ["dag_id", "child_id"]).withColumn("_chunk", F.floor(F.col("clade") / CHUNK))
    # Places among siblings: sums over earlier chunks, and over earlier siblings of the chunk, so that a hub's children are not one task.
    chunks = child.groupBy("dag_id", "parent_id", "_chunk").agg(F.sum("size").alias("_all"))
    earlier = lambda value, *order: F.coalesce(F.sum(value).over(Window.partitionBy(*order[:-1]).orderBy(order[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunks = chunks.select("dag_id", "parent_id", "_chunk", earlier("_all", "dag_id", "parent_id", "_chunk").alias("_before"))
    within = child.withColumn("_own", F.coalesce(F.sum("size").over(Window.partitionBy("dag_id", "parent_id", "_chunk").orderBy("clade", "child_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    offset = within.join(chunks, ["dag_id", "parent_id", "_chunk"]).select("dag_id", F.col("child_id").alias("node_id"), "parent_id", (F.col("_before") + F.col("_own") + 1).alias("value"))
    start = persisted(sizes.join(offset, KEY, "left").select(*KEY, "parent_id", "depth", "size", F.coalesce("value", F.lit(0)).alias("value")), "offsets")
    entered = along_path(start.select(*KEY, "value"), jumps, lambda above, below: above + below)
    nodes = persisted(start.drop("value").join(entered, KEY).select(*KEY, "parent_id", "depth", F.col("value").alias("enter"), (F.col("value") + F.col("size") - 1).alias("leave")), "index")
    up = nodes.select("dag_id", F.col("node_id").alias("up"), *[F.col(c).alias(f"up_{c}") for c in ("enter", "leave", "depth")])
    return TreeIndex(nodes, [persisted(j.join(up, ["dag_id", "up"]), "jump") for j in jumps])


def lca(index: TreeIndex, pairs: DataFrame) -> DataFrame:
    """pairs: dag_id, a, b and any more. Adds lca, their deepest common ancestor (itself, where one is above the other), and distance, the edges between them.

    From a, the longest jumps that do not reach an ancestor of b, and one edge more.
    """
    met = pairs.join(index.side("a", "enter", "leave", "depth"), ["dag_id", "a"]).join(index.side("b", "enter", "depth"), ["dag_id", "b"])
    state = ["at", "at_enter", "at_leave", "at_depth"]
    met = met.withColumns({"at": F.col("a"), "at_enter": F.col("a_enter"), "at_leave": F.col("a_leave"), "at_depth": F.col("a_depth")})
    covers = lambda x: F.col("b_enter").between(F.col(f"{x}_enter"), F.col(f"{x}_leave"))
    keep = [c for c in met.columns if c not in state]
    for jump in reversed(index.jumps):
        up = met.join(jump.withColumnRenamed("node_id", "at"), ["dag_id", "at"], "left")
        goes = F.col("up").isNotNull() & ~covers("up")
        met = up.select(*keep, *[F.when(goes, F.col(c.replace("at", "up", 1))).otherwise(F.col(c)).alias(c) for c in state])
    last = index.nodes.select("dag_id", F.col("node_id").alias("at"), F.col("parent_id").alias("_parent"))
    found = met.join(last, ["dag_id", "at"])
    depth = F.when(covers("at"), F.col("at_depth")).otherwise(F.col("at_depth") - 1)
    return found.select(*pairs.columns, F.when(covers("at"), F.col("at")).otherwise(F.col("_parent")).alias("lca"), (F.col("a_depth") + F.col("b_depth") - 2 * depth).alias("distance"))
