"""Queries over whole tables, and moves scored by changed path, by brute force."""

import numpy as np
from pyspark.sql import functions as F

from arbora.model import Dag, from_rows
from arbora.operators import graph, index, labels, search
from arbora.operators import weights as W
from arbora.plans import adapter, catalog
from arbora.session import persisted

TINY = "/root/testdata/sf0.001"


def whole(spark, name):
    return catalog.queries()[name](spark, TINY).collect()


def test_histogram_and_info_hold_all_trees(spark):
    c = catalog.Case(spark, TINY)
    low, high = (c.root(W.optimum(c.dag, c.parsimony, W.parsimony(f), c.heights)).first()["weight"] for f in (F.min, F.max))
    h = {r.parsimony: int(r.trees) for r in whole(spark, "parsimony_histogram")}
    assert sum(h.values()) == c.n_trees() and (min(h), max(h)) == (low, high)
    (i,) = whole(spark, "dag_info")
    assert (int(i.trees), i.least, int(i.n_least), i.most, int(i.n_most)) == (c.n_trees(), low, h[low], high, h[high])


def test_leaves_below_and_calls_of_all_rows(spark):
    rows = spark.read.parquet(f"{TINY}/customer.parquet").select("c_custkey", "c_nationkey").collect()
    groups = [[r.c_custkey for r in rows if r.c_nationkey == n] for n in {r.c_nationkey for r in rows}]
    everyone = [r.c_custkey for r in rows]
    want = [everyone, everyone, *[g for g in groups if len(g) > 1], *[[k] for k in everyone]]
    assert sorted((r.n, r.leaves) for r in whole(spark, "leaves_below")) == sorted((len(g), ",".join(sorted(map(str, g)))) for g in want)
    parts = [r.p_partkey for r in spark.read.parquet(f"{TINY}/part.parquet").select("p_partkey").collect()]
    calls = [(f"S{i}", k, "N" if k * i % 4 == 3 else "ACGT"[(k + k * i % 4 % 3) % 4]) for k in parts for i in range(1, 6) if k * i % 4]
    assert sorted((r.sample_id, r.pos, r.base) for r in whole(spark, "vcf_unpivot")) == sorted(calls) and max(parts) > 60


def test_changed_path_scores_as_the_moved_trees(spark):
    t = adapter.trees(adapter.customers(spark, TINY, "c_custkey <= 14"), {"A": ("s",)})
    moves = persisted(search.proposals(t, 3), "moves")
    want = {(r.src, r.dst): r.change for r in search.scored_moves(t, moves)[0].collect()}
    assert {(r.src, r.dst): r.change for r in search.move_changes(t, moves).collect()} == want and want


def fitch(kids, mask, reference, node=0):
    """Set and changes by the majority rule, of a tree whose UA is 0."""
    if node not in kids:
        return mask[node], 0
    sets, steps = zip(*(fitch(kids, mask, reference, c) for c in kids[node]), strict=True)
    n = ((np.array(sets)[..., None] >> np.arange(4)) & 1).sum(0)
    most = n.max(1)
    own = ((n == most[:, None]) << np.arange(4)).sum(1)
    return own, sum(steps) + (len(sets) - most).sum() + (((own & reference) == 0).sum() if node == 0 else 0)


def test_changed_path_of_random_trees_by_brute_force(spark):
    reference, want, dags = "ACGTA", {}, []
    letters = "ACGT"
    ref = np.array([1 << letters.index(x) for x in reference])
    for seed in range(10):
        draw = np.random.default_rng(seed)
        kids, open_, size = {0: [1]}, [1], 2
        while open_ and size < 24:
            node = open_.pop(int(draw.integers(len(open_))) if seed % 3 else -1)
            kids[node] = list(range(size, size := size + int(draw.integers(2, 5))))
            open_ += kids[node]
        own = {i: 1 << draw.integers(4, size=5) for i in range(size) if i not in kids}
        up = {c: p for p, own_kids in kids.items() for c in own_kids}
        below = lambda i: [i, *(x for c in kids.get(i, []) for x in below(c))]  # noqa: B023, E731
        for s in range(2, size):
            for d in range(1, size):
                if d not in below(s) and d != up[s] and not (up[s] == up[d] and len(kids[up[s]]) == 2):
                    new = {p: [size if c == d else c for c in own_kids if c != s] for p, own_kids in kids.items()} | {size: [d, s]}
                    want[str(seed), s, d] = int(fitch(new, own, ref)[1])
        sequences = {i: "".join(letters[int(m).bit_length() - 1] for m in masks) for i, masks in own.items()}
        dags.append(from_rows(spark, reference, [(p, c, k) for p, own_kids in kids.items() for k, c in enumerate(own_kids)], sequences, dag_id=str(seed)))
    dag = dags[0].union(*dags[1:]).persisted("random")
    moves = spark.createDataFrame([(*m, 0) for m in want], "dag_id string, src bigint, dst bigint, distance int")
    old = {r.dag_id: r.score for r in search.scores(dag).collect()}
    got = {(r.dag_id, r.src, r.dst): r.change + old[r.dag_id] for r in search.move_changes(dag, moves).collect()}
    assert len(want) > 2_000 and got == want
    every = {(r.dag_id, r.src, r.dst) for r in search.proposals(dag, 99).collect()}
    assert every == set(want)


def test_index_of_a_caterpillar(spark):
    """As deep as a tree can be: no row for each pair of a node and its ancestor."""
    n = 50_000
    inner = spark.range(n).select(F.col("id").alias("parent_id"), F.when(F.col("id") < n - 1, F.col("id") + 1).otherwise(2 * n).alias("child_id"), F.lit(0).alias("clade"))
    leaf = spark.range(1, n).select(F.col("id").alias("parent_id"), (F.col("id") + n).alias("child_id"), F.lit(1).alias("clade"))
    edges = persisted(inner.unionByName(leaf).select(F.lit("dag").alias("dag_id"), F.monotonically_increasing_id().alias("edge_id"), "parent_id", "child_id", "clade"), "edges")
    nodes = edges.select(F.col("child_id").alias("node_id")).unionByName(spark.range(1).select(F.lit(0).cast("bigint").alias("node_id")))
    nodes = persisted(nodes.select(F.lit("dag").alias("dag_id"), "node_id", F.lit(None).cast("string").alias("sample_id"), F.array().cast("array<struct<pos:int,base:string>>").alias("genome")), "nodes")
    found = index.build(Dag(nodes, edges, "A"))
    bad = found.nodes.where((F.col("node_id") < n) & ((F.col("depth") != F.col("node_id")) | (F.col("enter") != F.col("node_id")) | (F.col("leave") != 2 * n - F.greatest("node_id", F.lit(1)))))
    assert found.nodes.count() == 2 * n and bad.count() == 0 and len(found.jumps) == 16
    pairs = [(n + 7, n + 40_000), (n + 40_000, n + 7), (5, 30_000), (30_000, 5), (2 * n, 2 * n - 1), (9, 9)]
    rows = index.lca(found, spark.createDataFrame([("dag", a, b) for a, b in pairs], "dag_id string, a bigint, b bigint")).collect()
    assert {(r.a, r.b): (r.lca, r.distance) for r in rows} == {
        (n + 7, n + 40_000): (7, 39_995), (n + 40_000, n + 7): (7, 39_995), (5, 30_000): (5, 29_995), (30_000, 5): (5, 29_995), (2 * n, 2 * n - 1): (n - 1, 2), (9, 9): (9, 0)
    }


def test_moves_made_together_touch_different_nodes(spark):
    t = adapter.trees(adapter.customers(spark, TINY), {"A": ("n", "c")})
    tree = index.build(t)
    moves = persisted(search.proposals(t, 3, tree, 2), "moves")
    scored = search.move_changes(t, moves, tree).withColumn("rank", F.col("change"))
    ways = persisted(search.touched(t, tree, moves, 3), "ways")
    chosen = persisted(search.independent(ways, scored, 2), "chosen")
    met = ways.join(chosen, ["dag_id", "src", "dst"])
    assert met.groupBy("copy", "node_id").agg(F.countDistinct("src", "dst").alias("n")).where("n > 1").count() == 0
    assert chosen.select("copy").distinct().count() == 2 and chosen.count() > 4
    made = search.applied(t, chosen)
    assert graph.violations(made, False).collect() == []
    parent = {(r.dag_id, r.child_id): r.parent_id for r in made.edges.collect()}
    for r in chosen.collect():
        assert parent[r.copy, r.src] == parent[r.copy, r.dst] == ~r.src


def test_new_leaf_sets_of_moves_are_those_of_the_moved_trees(spark):
    t = adapter.trees(adapter.customers(spark, TINY, "c_custkey <= 20"), {"A": ("s", "c")})
    tree = index.build(t)
    moves = persisted(search.proposals(t, 4, tree), "moves")
    known = persisted(labels.leaf_sets(t), "known")
    got = {(r.src, r.dst): r.novel for r in search.novel_sets(t, search.touched(t, tree, moves, 4), known).collect()}
    sets = labels.novel_leafsets(labels.leaf_sets(search.moved(t, moves)), known)
    want = {r.dag_id: r.n for r in sets.groupBy("dag_id").agg(F.countDistinct("leafset_key").alias("n")).collect()}
    assert {f"A|{s}|{d}": n for (s, d), n in got.items()} == want and want


def test_moves_of_the_whole_table(spark):
    t = adapter.trees(adapter.customers(spark, TINY), {"A": ("s",)})
    assert sum(r.moves for r in whole(spark, "spr_moves")) == search.proposals(t, 3).count() > 1000
