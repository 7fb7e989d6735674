"""Deterministic history DAGs from the test tables.

Leaves are customers. A genome is 32 bases made of the md5 of the leaf's id; an inner node has that of the smallest customer key below it,
so it depends on its leaf set only. Four trees hold the same leaves: A by nation, then segment; B by segment, then nation; C by nation;
D by segment. Unifurcations are suppressed. The reference sequence is the genome of key 0.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions import genomes as G
from arbora.model import Dag
from arbora.operators import graph
from arbora.operators.merge import Merged, merge
from arbora.session import load

TREES = {"A": ("n", "c"), "B": ("s", "c"), "C": ("n",), "D": ("s",)}
REFERENCE = hashlib.md5(b"0").hexdigest().translate(str.maketrans("0123456789abcdef", "ACGT" * 4))


def sequence(key: Column) -> Column:
    return F.translate(F.md5(key.cast("string")), "0123456789abcdef", "ACGT" * 4)


def customers(spark: SparkSession, sf_dir: str, where: str | None = None) -> DataFrame:
    """ck, n, s, c (the cell: nation and segment), all text but ck."""
    rows = load(spark, sf_dir, "customer")
    if where:
        rows = rows.where(where)
    n, s = F.col("c_nationkey").cast("string"), F.col("c_mktsegment")
    return rows.select(F.col("c_custkey").alias("ck"), F.concat(F.lit("n:"), n).alias("n"), F.concat(F.lit("s:"), s).alias("s"), F.concat(F.lit("c:"), n, F.lit("|"), s).alias("c"))


def trees(customers: DataFrame, kinds: dict[str, tuple[str, ...]] | None = None, suppress: bool = True) -> Dag:
    """A collection with one tree for each of kinds; nodes are named by their group, ids are hashes of names."""
    nodes, edges = None, None
    for dag_id, groups in (kinds or TREES).items():
        path = ["UA", "root", *groups, "leaf"]
        rows = customers.withColumn("UA", F.lit("UA")).withColumn("root", F.lit("root")).withColumn("leaf", F.concat(F.lit("l:"), F.col("ck").cast("string")))
        for k, name in enumerate(path):
            own = rows.groupBy(F.col(name).alias("name")).agg(F.min("ck").alias("low"))
            own = own.select(F.lit(dag_id).alias("dag_id"), "name", "low", F.lit(k).alias("rank"))
            nodes = own if nodes is None else nodes.unionByName(own)
            if k:
                e = rows.select(F.lit(dag_id).alias("dag_id"), F.col(path[k - 1]).alias("p"), F.col(name).alias("c")).distinct()
                edges = e if edges is None else edges.unionByName(e)
    ident = lambda c: F.xxhash64(F.col("dag_id"), F.col(c))
    leaf = F.col("name").startswith("l:")
    genome = F.when(F.col("name") == "UA", G.empty()).otherwise(G.from_sequence(sequence(F.col("low")), F.lit(REFERENCE)))
    table = nodes.select("dag_id", ident("name").alias("node_id"), F.when(leaf, F.col("low").cast("string")).alias("sample_id"), genome.alias("genome"))
    lines = edges.select("dag_id", F.xxhash64("dag_id", "p", "c").alias("edge_id"), ident("p").alias("parent_id"), ident("c").alias("child_id"), F.xxhash64("c").alias("clade"))
    # Clade indices only need to be distinct before merging, which makes its own; trees used by themselves renumber them.
    from pyspark.sql import Window

    lines = lines.withColumn("clade", (F.row_number().over(Window.partitionBy("dag_id", "parent_id").orderBy("clade", "child_id")) - 1).cast("int"))
    dag = Dag(table, lines, REFERENCE).persisted("trees")
    return graph.suppressed(dag).persisted("suppressed") if suppress else dag


_MADE: dict[tuple, object] = {}


def _once(spark: SparkSession, what: tuple, make):
    """Tables are written once for each application and folder."""
    key = (spark.sparkContext.applicationId, *what)
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def all_trees(spark: SparkSession, sf_dir: str, where: str | None = None) -> Dag:
    return _once(spark, ("trees", sf_dir, where), lambda: trees(customers(spark, sf_dir, where)))


def tree(spark: SparkSession, sf_dir: str, kind: str) -> Dag:
    """One of the trees; made alone where the others are not there yet."""
    if (spark.sparkContext.applicationId, "trees", sf_dir, None) in _MADE:
        return all_trees(spark, sf_dir).only(kind)
    return _once(spark, ("tree", sf_dir, kind), lambda: trees(customers(spark, sf_dir), {kind: TREES[kind]}))


def merged(spark: SparkSession, sf_dir: str, where: str | None = None) -> Merged:
    return _once(spark, ("merged", sf_dir, where), lambda: merge(all_trees(spark, sf_dir, where), order=list(TREES)))
