"""What makes two nodes of different trees the same: leaf sets, their partition into clades, and genomes.

The set of leaves below a node is known by a key: the number of leaves and two 64-bit exclusive-ors of their hashes.
It is folded level by level from the children's keys, so no row ever holds the leaves themselves (a node near the root has
them all). A node's partition is the sorted list of its clades' keys, hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.functions import genomes as G
from arbora.model import Dag
from arbora.operators import graph
from arbora.operators.index import along_path, doubled
from arbora.operators.weights import fold
from arbora.session import persisted

KEY = graph.KEY


def leaf_key(sample: Column) -> Column:
    """Key of the set that holds one leaf."""
    return F.struct(F.lit(1).cast("bigint").alias("n"), F.xxhash64(sample, F.lit(1)).alias("x"), F.xxhash64(sample, F.lit(2)).alias("y"))


def union_key(keys: Column) -> Column:
    """Aggregate: key of the union of disjoint sets."""
    return F.struct(F.sum(keys["n"]).alias("n"), F.bit_xor(keys["x"]).alias("x"), F.bit_xor(keys["y"]).alias("y"))


def key_text(key: Column) -> Column:
    return F.concat_ws("-", key["n"].cast("string"), F.hex(key["x"]), F.hex(key["y"]))


def leaf_keys(dag: Dag, heights: DataFrame | None = None) -> DataFrame:
    """dag_id, node_id, key (n, x, y). The alternatives of a clade have the same leaves, so any of them tells."""
    return fold(dag, leaf_key(F.col("sample_id")), F.min, union_key, heights=heights).withColumnRenamed("weight", "key")


def leaf_sets(dag: Dag, heights: DataFrame | None = None) -> DataFrame:
    """dag_id, node_id, n_leaves, leafset_key."""
    return leaf_keys(dag, heights).select(*KEY, F.col("key")["n"].alias("n_leaves"), key_text(F.col("key")).alias("leafset_key"))


def labels(dag: Dag, sets: DataFrame) -> DataFrame:
    """dag_id, node_id, n_leaves, leafset_key, label_key: leaves are the same by sample id, inner nodes by partition and genome."""
    child = sets.select("dag_id", F.col("node_id").alias("child_id"), F.col("leafset_key").alias("clade_key"))
    clades = dag.edges.join(child, ["dag_id", "child_id"]).groupBy("dag_id", F.col("parent_id").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_set("clade_key")), ",").alias("partition"))
    out = dag.nodes.join(sets, KEY).join(clades, KEY, "left")
    inner = F.concat(F.lit("I:"), F.sha2(F.concat_ws("|", "partition", G.text(F.col("genome"))), 256))
    return out.select(*KEY, "n_leaves", "leafset_key", F.when(F.col("partition").isNull(), F.concat(F.lit("L:"), F.col("sample_id"))).otherwise(inner).alias("label_key"))


def sample_ids(dag: Dag, coerce: bool = False) -> Dag:
    """Leaves without a sample id (or all of them) are named by their genome."""
    leaf = graph.leaves(dag).select(*KEY, F.lit(True).alias("_leaf"))
    name = F.when(F.col("_leaf"), G.text(F.col("genome")) if coerce else F.coalesce("sample_id", G.text(F.col("genome"))))
    nodes = dag.nodes.join(leaf, KEY, "left").select("dag_id", "node_id", name.alias("sample_id"), "genome")
    return dag.replace(nodes)


def recomputed_genomes(dag: Dag, mutations: DataFrame, skip_leaves: bool = False) -> Dag:
    """Genomes from edge mutations (dag_id, edge_id, pos, par, mut), along each node's first parent: the last mutation of a site on the way down counts.

    A node's row holds what changes on the last 1, 2, 4, ... edges above it, overlaid on what changes above those; the UA's genome is empty.
    """
    first = dag.edges.groupBy("dag_id", "child_id").agg(F.min_by(F.struct("edge_id", "parent_id", "clade"), "edge_id").alias("e"))
    tree = dag.replace(edges=first.select("dag_id", "e.edge_id", "e.parent_id", "child_id", "e.clade"))
    own = tree.edges.join(mutations, ["dag_id", "edge_id"]).groupBy("dag_id", F.col("child_id").alias("node_id")).agg(F.array_sort(F.collect_list(G.entry(F.col("pos"), F.col("mut")))).alias("value"))
    start = persisted(dag.nodes.select(*KEY).join(own, KEY, "left").select(*KEY, F.coalesce("value", G.empty()).alias("value")), "own")
    found = along_path(start, doubled(tree)[1], G.upsert)
    new = G.without_reference(F.col("value"), dag.reference_column())
    nodes = dag.nodes.join(found, KEY)
    if skip_leaves:
        inner = dag.edges.select("dag_id", F.col("parent_id").alias("node_id")).distinct().withColumn("_inner", F.lit(True))
        nodes = nodes.join(inner, KEY, "left")
        new = F.when(F.col("_inner"), new).otherwise(F.col("genome"))
    return dag.replace(nodes.select("dag_id", "node_id", "sample_id", new.alias("genome")))


def inconsistent_mutations(dag: Dag, mutations: DataFrame) -> DataFrame:
    """Mutations of a tree's edges whose par is not what the way down from the root says: dag_id, edge_id, pos, par, expected."""
    above = recomputed_genomes(dag, mutations).nodes.select("dag_id", F.col("node_id").alias("parent_id"), F.col("genome").alias("_above"))
    own = dag.edges.select("dag_id", "edge_id", "parent_id").join(mutations, ["dag_id", "edge_id"]).join(above, ["dag_id", "parent_id"])
    expected = G.base_at(F.col("_above"), F.col("pos"), dag.reference_column())
    return own.select("dag_id", "edge_id", "pos", "par", expected.alias("expected")).where("par <> expected")


def leafset_nodes(sets: DataFrame) -> DataFrame:
    """leafset_key -> the nodes that have it."""
    return sets.groupBy("dag_id", "leafset_key").agg(F.array_sort(F.collect_set("node_id")).alias("nodes"))


def completed(dag: Dag, sets: DataFrame) -> Dag:
    """Every clade joined with every node that has its leaves, not the parent itself; the UA with every node that has all leaves."""
    child = sets.select("dag_id", F.col("node_id").alias("child_id"), F.col("leafset_key").alias("clade_key"))
    clades = dag.edges.join(child, ["dag_id", "child_id"]).select("dag_id", "parent_id", "clade", "clade_key").distinct()
    ua = graph.roots(dag).select("dag_id", F.col("node_id").alias("child_id"))
    met = clades.join(child, ["dag_id", "clade_key"]).where("child_id <> parent_id").join(ua, ["dag_id", "child_id"], "left_anti")
    edges = met.select("dag_id", F.xxhash64("parent_id", "clade", "child_id").alias("edge_id"), "parent_id", "child_id", "clade")
    return dag.replace(edges=edges)


def clades_combined(a: Column, b: Column, difference: bool = False) -> Column:
    """Clade by clade union (or difference) of two arrays of sorted sample arrays."""
    each = lambda x, y: F.array_sort((F.array_except if difference else F.array_union)(F.coalesce(x, F.array().cast("array<string>")), F.coalesce(y, F.array().cast("array<string>"))))
    return F.array_sort(F.zip_with(a, b, each))


def novel_leafsets(sets: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of sets whose leaf set no node of known has."""
    return sets.join(known.select("leafset_key").distinct(), "leafset_key", "left_anti")
