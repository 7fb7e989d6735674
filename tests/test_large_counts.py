"""A DAG of 2 ** 140 trees: counts beyond 38 digits."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from arbora.__main__ import info
from arbora.functions import numbers as N
from arbora.model import from_rows
from arbora.operators import distances, graph, labels, sampling
from arbora.operators import weights as W
from arbora.session import persisted

CLADES = 140


@pytest.fixture(scope="module")
def dag(spark):
    """The root has CLADES clades of three leaves each, which are resolved as ((x, y), z) or as (x, (y, z))."""
    edges, node = [(0, 1, 0)], 2
    for k in range(CLADES):
        x, y, z, a, xy, b, yz = range(node, node + 7)
        node += 7
        edges += [(1, a, k), (1, b, k), (a, xy, 0), (a, z, 1), (xy, x, 0), (xy, y, 1), (b, x, 0), (b, yz, 1), (yz, y, 0), (yz, z, 1)]
    return from_rows(spark, "A", edges).persisted("large")


def test_counts_and_distances(spark, dag):
    total = 2**CLADES
    assert int(W.at_root(dag, W.tree_counts(dag, exact=True)).first()["weight"]) == total
    assert W.at_root(dag, W.log_tree_counts(dag)).first()["weight"] == pytest.approx(CLADES * math.log(2))
    sets = labels.leaf_sets(dag).persist()
    counts = distances.leafset_counts(dag, sets, exact=True).persist()
    told = {(r.n_leaves, int(r["count"])): r.n for r in counts.groupBy("n_leaves", "count").agg(F.count("*").alias("n")).collect()}
    assert told == {(1, total): 3 * CLADES, (2, total // 2): 2 * CLADES, (3, total): CLADES, (3 * CLADES, total): 1}
    for most in (False, True):
        assert int(distances.sum_rf(dag, sets, counts, total, most, exact=True).first()["weight"]) == CLADES * total


def test_histogram_and_information(spark, dag):
    """One mutation on one alternative of each clade: as many as heads among 140 coins."""
    heads = dag.edges.select("dag_id", "edge_id", F.when((F.col("parent_id") == 1) & (F.pmod(F.col("child_id") - 2, F.lit(7)) == 3), 1).otherwise(0).cast("bigint").alias("edge"))
    top = graph.roots(dag).select("dag_id", "node_id")
    got = {r.weight: int(r.n) for r in W.histogram(dag, persisted(heads, "heads")).join(top, ["dag_id", "node_id"]).collect()}
    assert got == {k: math.comb(CLADES, k) for k in range(CLADES + 1)}
    told = info(dag, histogram=True, rf=True)
    total = 2**CLADES
    assert told["trees"] == told["least_parsimony_trees"] == told["most_parsimony_trees"] == total and told["parsimony"] == {0: total}
    assert told["least_sum_rf"] == told["most_sum_rf"] == CLADES * total


def test_distribution_of_any_weight(spark):
    """Of each tree the largest edge weight: pairs and alternatives combine by greatest."""
    edges = [(0, 1, 0), (1, 2, 0), (1, 3, 0), (1, 4, 1), (1, 5, 1), (1, 6, 2)]
    dag = from_rows(spark, "A", edges).persisted("small")
    weights = dag.edges.select("dag_id", "edge_id", F.col("child_id").alias("edge"))
    ops = W.WeightOps(F.lit(0).cast("bigint"), lambda e, w: F.greatest(e, w), F.max, F.min)
    top = graph.roots(dag).select("dag_id", "node_id")
    rows = W.distribution(dag, weights, ops, F.greatest).join(top, ["dag_id", "node_id"]).select("weight", N.text(F.col("n")).alias("n"))
    assert {r.weight: r.n for r in rows.collect()} == {6: "4"}
    least = W.WeightOps(F.lit(99).cast("bigint"), lambda e, w: F.least(e, w), F.min, F.min)
    rows = W.distribution(dag, weights.withColumn("edge", F.col("edge") + 0), least, F.least).join(top, ["dag_id", "node_id"]).select("weight", N.text(F.col("n")).alias("n"))
    assert {r.weight: r.n for r in rows.collect()} == {1: "4"}


def test_numbers_are_those_of_python(spark):
    draw = random.Random(3)
    values = [0, 1, -1, 999_999, 10**6, -(10**6), 10**18, -(2**63), 2**63 - 1, 2**140, -(3**200)] + [draw.choice([1, -1]) * draw.randrange(10 ** draw.randrange(1, 60)) for _ in range(120)]
    pairs = [(str(a), str(b), i % 7) for i, (a, b) in enumerate(zip(values, reversed(values), strict=True))]
    df = spark.createDataFrame(pairs, "a string, b string, k int").withColumns({"x": N.of_text(F.col("a")), "y": N.of_text(F.col("b"))}).persist()
    out = df.select("a", "b", N.text(N.plus(F.col("x"), F.col("y"))).alias("sum"), N.text(N.times(F.col("x"), F.col("y"))).alias("product"), N.text(F.col("x")).alias("same"), (F.col("x") < F.col("y")).alias("less"))
    for r in out.collect():
        a, b = int(r.a), int(r.b)
        assert (int(r["sum"]), int(r.product), r.same, r.less) == (a + b, a * b, str(a), a < b)
    sums, products = Counter(), dict.fromkeys(range(7), 1)
    for a, _, k in pairs:
        sums[k] += int(a)
        products[k] *= int(a) or 7
    got = N.add_up(df, ["k"], "x").select("k", N.text(F.col("x")).alias("t")).collect()
    assert {r.k: int(r.t) for r in got} == sums
    rows = df.withColumn("at", F.row_number().over(Window.partitionBy("k").orderBy("a", "b")) - 1).withColumn("x", F.when(F.size("x") == 1, N.of_long(F.lit(7))).otherwise(F.col("x"))).persist()
    got = N.multiply_up(rows, ["k"], "at", "x").select("k", N.text(F.col("x")).alias("t")).collect()
    assert {r.k: int(r.t) for r in got} == products
    others = N.others_up(rows, ["k"], "at", "x").join(rows.select("k", "at", N.text(F.col("x")).alias("own")), ["k", "at"]).select("k", "own", N.text(F.col("x")).alias("t")).collect()
    assert len(others) == len(pairs) and all(int(r.t) * int(r.own) == products[r.k] for r in others)
    for v in (2**63 - 1, -(2**63) + 1, 0, -5):
        assert spark.range(1).select(N.text(N.of_long(F.lit(v)))).first()[0] == str(v)


def test_logarithms_of_many_alternatives(spark):
    rows = spark.range(50_000).select(F.lit(1).alias("k"), F.log(F.col("id") + 1.0).alias("weight"))
    assert W.log_sum(rows, ["k"]).first()["weight"] == pytest.approx(math.log(50_000 * 50_001 / 2))


def test_uniform_samples(dag):
    ones = dag.edges.select("dag_id", "edge_id", F.lit(1).cast("bigint").alias("edge"))
    for tree in (sampling.uniform_sample_tree(dag, 5), sampling.best_uniform_sample_tree(dag, ones, 6)):
        assert graph.violations(tree, allow_dag=False).count() == 0 and graph.leaves(tree).count() == 3 * CLADES
        left = tree.edges.where("parent_id = 1 and (child_id - 2) % 7 = 3").count()
        assert 35 < left < 105


def test_weights_of_sampled_edges_count(spark):
    """Of an edge to three trees and one to a single tree the first is drawn three times in four."""
    edges = [(0, 1, 0), (1, 2, 0), (1, 3, 0), (1, 4, 1)] + [(2, c, k) for k in (0,) for c in (5, 6, 7)] + [(3, 5, 0)]
    dag = from_rows(spark, "A", edges).persisted("small")
    n = W.log_tree_counts(dag).select("dag_id", F.col("node_id").alias("child_id"), "weight")
    rows = dag.edges.where("parent_id = 1 and clade = 0").join(n, ["dag_id", "child_id"])
    hits = sum(sampling._chosen(rows, seed, F.col("weight")).first()["child_id"] == 2 for seed in range(20))
    assert 9 <= hits <= 20
