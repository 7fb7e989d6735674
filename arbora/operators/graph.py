"""Building, looking at, editing and validating the graph itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions import genomes as G
from arbora.model import Dag
from arbora.session import persisted

KEY = ["dag_id", "node_id"]


def _as_child(edges: DataFrame) -> DataFrame:
    return edges.select("dag_id", F.col("child_id").alias("node_id")).distinct()


def _as_parent(edges: DataFrame) -> DataFrame:
    return edges.select("dag_id", F.col("parent_id").alias("node_id")).distinct()


def roots(dag: Dag) -> DataFrame:
    """Nodes without a parent: the UA of each DAG."""
    return dag.nodes.join(_as_child(dag.edges), KEY, "left_anti")


def tree_roots(dag: Dag) -> DataFrame:
    """Children of the UA."""
    return roots(dag).select("dag_id", F.col("node_id").alias("parent_id")).join(dag.edges, ["dag_id", "parent_id"]).select("dag_id", F.col("child_id").alias("node_id")).distinct()


def leaves(dag: Dag) -> DataFrame:
    return dag.nodes.join(_as_parent(dag.edges), KEY, "left_anti")


def kinds(dag: Dag) -> DataFrame:
    """nodes with is_ua, is_leaf and is_tree_root."""
    flag = lambda df, name: df.select(*KEY).distinct().withColumn(name, F.lit(True))
    out = dag.nodes.join(flag(_as_child(dag.edges), "_c"), KEY, "left").join(flag(_as_parent(dag.edges), "_p"), KEY, "left").join(flag(tree_roots(dag), "_r"), KEY, "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return out.select(*dag.nodes.columns, (~yes("_c")).alias("is_ua"), (~yes("_p")).alias("is_leaf"), yes("_r").alias("is_tree_root"))


def is_tree(dag: Dag) -> DataFrame:
    """dag_id, nodes, edges, is_tree: a connected DAG is a tree if it has one node more than edges."""
    n = dag.nodes.groupBy("dag_id").agg(F.count("*").alias("nodes"))
    e = dag.edges.groupBy("dag_id").agg(F.count("*").alias("edges"))
    return n.join(e, "dag_id", "left").select("dag_id", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), (F.col("nodes") == F.coalesce("edges", F.lit(0)) + 1).alias("is_tree"))


def neighbours(dag: Dag) -> DataFrame:
    """dag_id, node_id, parents (ids), clades (array of arrays of child ids)."""
    up = dag.edges.groupBy("dag_id", F.col("child_id").alias("node_id")).agg(F.array_sort(F.collect_set("parent_id")).alias("parents"))
    down = dag.edges.groupBy("dag_id", "parent_id", "clade").agg(F.array_sort(F.collect_set("child_id")).alias("children"))
    down = down.groupBy("dag_id", F.col("parent_id").alias("node_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("clade", "children"))), lambda x: x["children"]).alias("clades"))
    none = F.array()
    return dag.nodes.select(*KEY).join(up, KEY, "left").join(down, KEY, "left").select(*KEY, F.coalesce("parents", none.cast("array<bigint>")).alias("parents"), F.coalesce("clades", none.cast("array<array<bigint>>")).alias("clades"))


def heights(dag: Dag) -> DataFrame:
    """dag_id, node_id, height: 0 for leaves, else one more than the highest child. Nodes on or above a cycle are left out.

    Bottom-up: each round takes the nodes all of whose edges lead to nodes that have their height; a frontier of one level at a time.
    """
    need = dag.edges.groupBy("dag_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("open"))
    need = persisted(need, "open")
    level = persisted(leaves(dag).select(*KEY, F.lit(0).alias("height")), "height0")
    out, h = level, 0
    while True:
        h += 1
        met = level.select("dag_id", F.col("node_id").alias("child_id")).join(dag.edges, ["dag_id", "child_id"]).groupBy("dag_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("met"))
        need = persisted(need.join(met, KEY, "left").select(*KEY, (F.col("open") - F.coalesce("met", F.lit(0))).alias("open")), "open")
        level = persisted(need.where("open = 0").select(*KEY, F.lit(h).alias("height")), f"height{h}")
        if not level.take(1):
            return out
        need = need.where("open > 0")
        out = out.unionByName(level)


def cyclic(dag: Dag) -> DataFrame:
    """Nodes on a cycle or above one: what is left when leaves are peeled off again and again."""
    return dag.nodes.select(*KEY).join(heights(dag), KEY, "left_anti")


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """dag_id, node_id of what can be reached downwards from start, start itself included."""
    seen = persisted(start.select(*KEY).distinct(), "reach")
    front = seen
    while True:
        step = front.select("dag_id", F.col("node_id").alias("parent_id")).join(edges, ["dag_id", "parent_id"]).select("dag_id", F.col("child_id").alias("node_id")).distinct()
        front = persisted(step.join(seen, KEY, "left_anti"), "reach")
        if not front.take(1):
            return seen
        seen = seen.unionByName(front)


def ancestors(dag: Dag, most: int | None = None) -> DataFrame:
    """dag_id, node_id, ancestor_id, distance: the closure of the parent relation of trees, each node its own ancestor at 0; only ancestors at
    most `most` edges above, if given. The whole closure has a row for each node and ancestor: index.py answers most questions without it.

    Distances double with each round, so a tree of depth d takes log2(d) rounds. Raises ValueError if there is a cycle: a path longer
    than there are nodes.
    """
    nodes, reach = dag.nodes.count(), 1
    hop = persisted(dag.edges.select("dag_id", F.col("child_id").alias("node_id"), F.col("parent_id").alias("up"), F.lit(1).alias("d")), "hop")
    closure = dag.nodes.select(*KEY, F.col("node_id").alias("ancestor_id"), F.lit(0).alias("distance"))
    while hop.take(1) and (most is None or reach <= most):
        if reach > nodes:
            raise ValueError("no ancestors on a cycle")
        reach *= 2
        further = closure.join(hop.withColumnRenamed("node_id", "ancestor_id"), ["dag_id", "ancestor_id"]).select("dag_id", "node_id", F.col("up").alias("ancestor_id"), (F.col("distance") + F.col("d")).alias("distance"))
        if most is not None:
            further = further.where(F.col("distance") <= most)
        closure = persisted(closure.unionByName(further), "closure")
        twice = hop.select("dag_id", F.col("node_id").alias("low"), F.col("up").alias("node_id"), F.col("d").alias("e"))
        hop = persisted(twice.join(hop, KEY).select("dag_id", F.col("low").alias("node_id"), "up", (F.col("d") + F.col("e")).alias("d")), "hop")
    return closure


def depths(dag: Dag) -> DataFrame:
    """dag_id, node_id, depth of trees: the distance to the UA."""
    from arbora.operators import index

    return index.doubled(dag)[0].select(*KEY, "depth")


def preorder(dag: Dag) -> DataFrame:
    """dag_id, node_id, depth, enter, leave: enter is the place in depth-first order, children by clade; descendants enter up to leave."""
    from arbora.operators import index

    return index.build(dag).nodes.select(*KEY, "depth", "enter", "leave")


def leaves_below(dag: Dag) -> DataFrame:
    """dag_id, node_id, leaves: the sorted set of sample ids under each node. O(nodes x leaves): for small DAGs; labels.py has keys for large ones."""
    from arbora.operators.weights import fold

    below = fold(dag, leaf=F.array("sample_id"), within=lambda w: F.array_distinct(F.flatten(F.collect_list(w))), between=lambda w: F.array_sort(F.array_distinct(F.flatten(F.collect_list(w)))))
    return below.select(*KEY, F.col("weight").alias("leaves"))


def renumbered(edges: DataFrame) -> DataFrame:
    """Clade indices without gaps, in the order they had."""
    return edges.withColumn("clade", (F.dense_rank().over(Window.partitionBy("dag_id", "parent_id").orderBy("clade")) - 1).cast("int"))


def add(dag: Dag, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> Dag:
    return dag.replace(dag.nodes if nodes is None else dag.nodes.unionByName(nodes), dag.edges if edges is None else dag.edges.unionByName(edges))


def remove_edges(dag: Dag, gone: DataFrame) -> Dag:
    """Without the edges of gone (dag_id, edge_id); later clades move down."""
    return dag.replace(edges=renumbered(dag.edges.join(gone, ["dag_id", "edge_id"], "left_anti")))


def change_parent(dag: Dag, moves: DataFrame) -> Dag:
    """moves: dag_id, edge_id, parent_id, clade."""
    m = moves.select("dag_id", "edge_id", F.col("parent_id").alias("_p"), F.col("clade").alias("_c"))
    e = dag.edges.join(m, ["dag_id", "edge_id"], "left")
    return dag.replace(edges=renumbered(e.select("dag_id", "edge_id", F.coalesce("_p", "parent_id").alias("parent_id"), "child_id", F.coalesce("_c", "clade").alias("clade"))))


def with_ua(dag: Dag, ua_id: int) -> Dag:
    """A new UA above the old root, which keeps its genome."""
    top = roots(dag)
    node = top.select("dag_id", F.lit(ua_id).cast("bigint").alias("node_id"), F.lit(None).cast("string").alias("sample_id"), G.empty().alias("genome")).distinct()
    next_id = dag.edges.groupBy("dag_id").agg((F.max("edge_id") + 1).alias("edge_id"))
    edge = top.join(next_id, "dag_id", "left").select("dag_id", F.coalesce("edge_id", F.lit(0)).alias("edge_id"), F.lit(ua_id).cast("bigint").alias("parent_id"), F.col("node_id").alias("child_id"), F.lit(0).alias("clade"))
    return add(dag, node, edge)


def fragment(dag: Dag, node_ids: DataFrame, edge_ids: DataFrame | None = None) -> Dag:
    """The part with these nodes (dag_id, node_id) and the edges among them, or only those of edge_ids."""
    nodes = dag.nodes.join(node_ids, KEY, "left_semi")
    edges = dag.edges
    for side in ("parent_id", "child_id"):
        edges = edges.join(node_ids.select("dag_id", F.col("node_id").alias(side)), ["dag_id", side], "left_semi")
    if edge_ids is not None:
        edges = edges.join(edge_ids, ["dag_id", "edge_id"], "left_semi")
    return dag.replace(nodes, edges.select(*dag.edges.columns))


def overlaid(base: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """Rows of delta in place of those of base with the same key, and its new ones; a null field of delta leaves base's."""
    rest = [c for c in base.columns if c not in key]
    d = delta.select(*key, *[F.col(c).alias(f"_{c}") for c in rest])
    return base.join(d, key, "full").select(*[c if c in key else F.coalesce(f"_{c}", c).alias(c) for c in base.columns])


def suppressed(dag: Dag) -> Dag:
    """Without unifurcations: a node other than the UA with a single child is replaced by it."""
    ua = roots(dag).select(*KEY)
    single = dag.edges.groupBy("dag_id", F.col("parent_id").alias("node_id")).agg(F.countDistinct("child_id").alias("n")).where("n = 1").select(*KEY).join(ua, KEY, "left_anti")
    single = persisted(single, "single")
    up = persisted(dag.edges.select("dag_id", F.col("child_id").alias("node_id"), F.col("parent_id").alias("up"), "clade").join(single, KEY, "left_semi"), "up")
    edges = dag.edges
    while True:
        hop = up.select("dag_id", F.col("node_id").alias("parent_id"), "up", F.col("clade").alias("_c"))
        met = edges.join(hop, ["dag_id", "parent_id"], "left")
        if not met.where("up is not null").take(1):
            break
        edges = persisted(met.select("dag_id", "edge_id", F.coalesce("up", "parent_id").alias("parent_id"), "child_id", F.when(F.col("up").isNotNull(), F.col("_c")).otherwise(F.col("clade")).alias("clade")), "jumped")
    edges = edges.join(single.select("dag_id", F.col("node_id").alias("child_id")), ["dag_id", "child_id"], "left_anti")
    return dag.replace(dag.nodes.join(single, KEY, "left_anti"), edges.select(*dag.edges.columns))


def violations(dag: Dag, allow_dag: bool = True) -> DataFrame:
    """dag_id, rule, node_id: what is wrong; no rows if all is well."""
    e, ua = dag.edges, roots(dag)
    rows = []

    def found(df: DataFrame, rule: str, node: str = "node_id") -> None:
        rows.append(df.select("dag_id", F.lit(rule).alias("rule"), F.col(node).cast("bigint").alias("node_id")))

    found(ua.groupBy("dag_id").agg(F.count("*").alias("n"), F.max("node_id").alias("node_id")).where("n > 1"), "more than one root")
    found(dag.nodes.select("dag_id").distinct().join(ua, "dag_id", "left_anti").withColumn("node_id", F.lit(None)), "no root")
    clades = e.groupBy("dag_id", "parent_id").agg(F.countDistinct("clade").alias("n"), F.min("clade").alias("lo"), F.max("clade").alias("hi"), F.count("*").alias("edges"))
    found(clades.where("lo <> 0 or hi <> n - 1"), "clade indices with gaps", "parent_id")
    found(clades.join(ua.select("dag_id", F.col("node_id").alias("parent_id")), ["dag_id", "parent_id"], "left_anti").where("n = 1"), "unifurcation", "parent_id")
    found(e.groupBy("dag_id", "edge_id").count().where("count > 1").withColumn("node_id", F.lit(None)), "edge id used twice")
    found(dag.nodes.groupBy(*KEY).count().where("count > 1"), "node id used twice")
    for side in ("parent_id", "child_id"):
        found(e.join(dag.nodes.select("dag_id", F.col("node_id").alias(side)), ["dag_id", side], "left_anti"), f"edge without its {side[:-3]}", side)
    found(leaves(dag).where("sample_id is not null").groupBy("dag_id", "sample_id").agg(F.count("*").alias("n"), F.min("node_id").alias("node_id")).where("n > 1"), "leaf twice")
    found(leaves(dag).where("sample_id is null"), "leaf without sample")
    found(cyclic(dag), "cycle")
    if not allow_dag:
        found(e.groupBy("dag_id", F.col("child_id").alias("node_id")).count().where("count > 1"), "several parents")
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
