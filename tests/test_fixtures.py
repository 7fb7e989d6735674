"""Small DAGs with known answers."""

import pytest
from pyspark.sql import functions as F

from arbora.functions import genomes as G
from arbora.model import from_rows
from arbora.operators import distances, graph, index, labels, sampling, sankoff, search
from arbora.operators import merge as M
from arbora.operators import weights as W
from arbora.session import persisted

TOPOLOGY = [(0, 10, 0), (7, 1, 0), (7, 2, 1), (8, 3, 0), (8, 4, 1), (9, 5, 0), (9, 6, 1), (8, 7, 2), (10, 8, 0), (10, 9, 1)]
SEQUENCES = {1: "ACC", 2: "GTT", 3: "AGG", 4: "ACG", 5: "CTT", 6: "TCC", 7: "TGG", 8: "CTC", 9: "AGT", 10: "GAA"}
PLAIN = {1: "ACC", 2: "TAG", 3: "GGG", 4: "ACG", 5: "CTT", 6: "TCC", 7: "TGG", 8: "GTC", 9: "AGT", 10: "GAA"}
AMBIGUOUS = {**PLAIN, 2: "TNN", 4: "ANG"}
SAMPLES = {i: SEQUENCES[i] for i in range(1, 7)}


@pytest.fixture(scope="module")
def three(spark):
    a = from_rows(spark, "GAA", TOPOLOGY, SEQUENCES, SAMPLES, "1")
    leaves = {1: "TCC", 2: "ACG", 3: "GTT", 4: "AGG", 5: "ACC", 6: "CTT"}
    b = from_rows(spark, "GAA", [(0, 10, 0), (8, 1, 0), (8, 2, 1), (10, 3, 0), (7, 4, 0), (7, 5, 1), (9, 6, 0), (9, 7, 1), (10, 8, 1), (10, 9, 2)], leaves, leaves, "2")
    more = {**SEQUENCES, 10: "GGA", 11: "GAA"}
    c = from_rows(spark, "GAA", [(0, 11, 0), (7, 1, 0), (7, 2, 1), (8, 3, 0), (8, 4, 1), (9, 5, 0), (9, 6, 1), (10, 8, 0), (10, 7, 1), (11, 10, 0), (11, 9, 1)], more, SAMPLES, "3")
    return [x.persisted("fixture") for x in (a, b, c)]


def score(dag):
    return search.scores(dag).first()["score"]


def test_topology(spark):
    dag = from_rows(spark, "GAA", TOPOLOGY)
    assert graph.is_tree(dag).first()[1:] == (11, 10, True) and graph.leaves(dag).count() == 6
    assert graph.violations(dag, allow_dag=False).count() == 0
    pairs = spark.createDataFrame([("dag", a, b) for a, b in ((1, 2), (1, 3), (2, 4), (1, 5), (1, 7), (1, 8), (5, 10))], "dag_id string, a bigint, b bigint")
    assert {(r.a, r.b): r.lca for r in index.lca(index.build(dag), pairs).collect()} == {(1, 2): 7, (1, 3): 8, (2, 4): 8, (1, 5): 10, (1, 7): 7, (1, 8): 8, (5, 10): 10}
    assert {r.node_id: r.height for r in graph.heights(dag).collect()} == {**dict.fromkeys(range(1, 7), 0), 7: 1, 9: 1, 8: 2, 10: 3, 0: 4}
    order = [r.node_id for r in graph.preorder(dag).orderBy("enter").collect()]
    assert order == [0, 10, 8, 3, 4, 7, 1, 2, 9, 5, 6]
    near = {r.node_id: r for r in graph.neighbours(dag).collect()}
    assert near[8].clades == [[3], [4], [7]] and near[8].parents == [10]


def test_parsimony_and_ambiguity(spark):
    assert score(from_rows(spark, "GAA", TOPOLOGY, SEQUENCES)) == 26
    assert score(from_rows(spark, "GAA", TOPOLOGY, PLAIN)) == 22
    for sequences, expected in ((PLAIN, {2: 1, 4: 3}), (AMBIGUOUS, {2: 0, 4: 2})):
        found = {r.edge_id: r.n for r in W.mutations(from_rows(spark, "GAA", TOPOLOGY, sequences)).select("edge_id", F.size("muts").alias("n")).collect()}
        assert {e: found[e] for e in expected} == expected
    dag = from_rows(spark, "GAA", TOPOLOGY, AMBIGUOUS)
    assert sorted(r.node_id for r in dag.nodes.where(G.is_ambiguous(F.col("genome"))).collect()) == [2, 4]


def test_robinson_foulds(three):
    sets = [labels.leaf_sets(d) for d in three]
    counts = [distances.leafset_counts(d, s) for d, s in zip(three, sets, strict=True)]
    d = {(i, j): int(distances.sum_rf(three[i], sets[i], counts[j], 1).first()["weight"]) for i in range(3) for j in range(3)}
    assert d == {(0, 0): 0, (1, 1): 0, (2, 2): 0, (0, 1): 6, (1, 0): 6, (0, 2): 1, (2, 0): 1, (1, 2): 7, (2, 1): 7}


def test_merge_count_trim_sample(three):
    a, b, c = three
    have = M.merge(a.union(b, c))
    dag = have.dag.persisted("merged")
    assert graph.violations(dag).count() == 0
    assert W.at_root(dag, W.tree_counts(dag)).first()["weight"] == 3 and W.at_root(dag, W.tree_counts(dag, exact=True)).first()["weight"] == "3"
    w = persisted(W.parsimony_weights(dag), "w")
    top = graph.roots(dag).select(*graph.KEY)
    histogram = {int(r.weight): int(r.n) for r in W.histogram(dag, w).join(top, graph.KEY).collect()}
    assert sum(histogram.values()) == 3 and min(histogram) == W.at_root(dag, W.optimum(dag, w)).first()["weight"]
    trimmed = W.trim(dag, w)
    assert W.at_root(trimmed, W.tree_counts(trimmed)).first()["weight"] == histogram[min(histogram)]
    for tree in (sampling.sample_tree(dag, 1), sampling.uniform_sample_tree(dag, 2), sampling.best_uniform_sample_tree(dag, w, 3)):
        assert graph.is_tree(tree).first()["is_tree"] and graph.violations(tree, allow_dag=False).count() == 0
    sets = have.labels.select(F.lit("merged").alias("dag_id"), "node_id", "leafset_key", "n_leaves")
    counts = distances.leafset_counts(dag, sets)
    assert distances.sum_rf(dag, sets, counts, 3).first()["weight"] == 7 and distances.sum_rf(dag, sets, counts, 3, most=True).first()["weight"] == 13
    again = M.add(M.merge(a.union(b)), c)
    assert M.same(again.dag, dag).count() == 0 and M.same(a, b).count() > 0
    assert {r.node_id for r in graph.reachable(dag.edges, top).collect()} == {r.node_id for r in dag.nodes.collect()}


def test_counter_algebra(spark):
    def counter(*xs):
        return spark.createDataFrame([(x,) for x in xs], "weight bigint").groupBy("weight").agg(F.count("*").cast(W.COUNT).alias("n"))

    def told(df):
        return {r.weight: int(r.n) for r in df.collect()}

    assert told(W.counter_product(counter(), counter(1, 2), [])) == {}
    assert told(W.counter_product(counter(0), counter(1, 2, 2), [])) == {1: 1, 2: 2}
    assert told(W.counter_product(counter(2, 2, 3), counter(2, 2, 3, 3, 3, 4), [])) == {4: 4, 5: 8, 6: 5, 7: 1}
    assert told(W.counter_sum(counter(0, 1, 2, 2, 3).unionByName(counter(2, 2, 2, 3, 4)), [])) == {0: 1, 1: 1, 2: 5, 3: 2, 4: 1}


def test_sankoff(spark):
    dag = from_rows(spark, "AAAA", [(0, 1, 0), (1, 2, 0), (1, 5, 1), (2, 3, 0), (2, 4, 1)], {3: "CTAA", 4: "CACC", 5: "AGTC"})
    sites = persisted(sankoff.variable_sites(dag), "sites")
    table = sankoff.cost_table(spark, sites)
    below = sankoff.costs(dag, sites, table)
    assert {r.pos: r.score for r in sankoff.site_scores(dag, below).collect()} == {1: 1.0, 2: 2.0, 3: 2.0, 4: 1.0}
    again = sankoff.with_states(dag, sankoff.reconstruction(dag, below, table))
    top = W.mutations(again).where("parent_id <> 0").agg(F.sum(F.size("muts"))).first()[0]
    assert top == 6
    by_site = {1: [[0, 2, 1, 2], [2, 0, 2, 1], [1, 2, 0, 2], [2, 1, 2, 0]]}
    weighted = sankoff.costs(dag, sites, sankoff.cost_table(spark, sites, by_site=by_site))
    assert {r.pos: r.score for r in sankoff.site_scores(dag, weighted).collect()} == {1: 2.0, 2: 2.0, 3: 2.0, 4: 1.0}
    one = from_rows(spark, "A", [(0, 1, 0), (1, 2, 0), (1, 3, 1)], {2: "C", 3: "T"})
    s = sankoff.variable_sites(one)
    assert sankoff.site_scores(one, sankoff.costs(one, s, sankoff.cost_table(spark, s))).first()["score"] == 1.0


def test_validation_finds_what_is_wrong(spark):
    rules = lambda edges, **k: {r.rule for r in graph.violations(from_rows(spark, "A", edges, **k), allow_dag=False).collect()}
    assert "cycle" in rules([(0, 1, 0), (1, 2, 0), (1, 3, 1), (2, 4, 0), (2, 1, 1)])
    assert "unifurcation" in rules([(0, 1, 0), (1, 2, 0), (2, 3, 0), (2, 4, 1)])
    assert "clade indices with gaps" in rules([(0, 1, 0), (1, 2, 0), (1, 3, 2)])
    assert "leaf twice" in rules([(0, 1, 0), (1, 2, 0), (1, 3, 1)], samples={2: "x", 3: "x"})
    assert "several parents" in rules([(0, 1, 0), (1, 2, 0), (1, 3, 1), (2, 4, 0), (2, 5, 1), (3, 4, 0), (3, 6, 1)])


def test_edits_fragments_overlays(spark):
    dag = from_rows(spark, "GAA", TOPOLOGY, SEQUENCES).persisted("edit")
    gone = graph.remove_edges(dag, spark.createDataFrame([("dag", 3)], "dag_id string, edge_id bigint"))
    assert sorted(r.clade for r in gone.edges.where("parent_id = 8").collect()) == [0, 1]
    part = graph.fragment(dag, spark.createDataFrame([("dag", i) for i in (7, 1, 2)], "dag_id string, node_id bigint"))
    assert part.edges.count() == 2 and part.nodes.count() == 3
    delta = spark.createDataFrame([("dag", 1, "renamed", None)], dag.nodes.schema)
    over = graph.overlaid(dag.nodes, delta, graph.KEY).where("node_id = 1").first()
    assert over.sample_id == "renamed" and len(over.genome) > 0
    up = graph.with_ua(dag, 99)
    assert graph.roots(up).first()["node_id"] == 99 and up.edges.count() == 11
    thin = graph.suppressed(from_rows(spark, "A", [(0, 1, 0), (1, 2, 0), (2, 3, 0), (3, 4, 0), (3, 5, 1)]))
    assert sorted((r.parent_id, r.child_id) for r in thin.edges.collect()) == [(0, 3), (3, 4), (3, 5)]


def test_search_improves_and_stays_valid(three):
    a = three[0]
    moves = persisted(search.proposals(a, 4), "moves")
    scored, trees = search.scored_moves(a, moves)
    assert scored.count() == moves.count() > 0 and graph.violations(trees, allow_dag=False).count() == 0
    leaf = graph.leaves(trees).groupBy("dag_id").agg(F.sort_array(F.collect_list("sample_id")).alias("s")).select("s").distinct().collect()
    assert [r.s for r in leaf] == [sorted(SAMPLES.values())]
    have, log = search.optimise(a, rounds=1, moves_for_each=2)
    assert log[0]["parsimony"] < 26 and graph.violations(have.dag).count() == 0


def test_adapter_counts(spark):
    from arbora.plans import adapter

    m = adapter.merged(spark, "/root/testdata/sf0.001")
    assert (m.dag.nodes.count(), m.dag.edges.count()) == (251, 639)
    assert m.dag.edges.groupBy("child_id").count().where("count > 1").count() == 189
    assert W.at_root(m.dag, W.tree_counts(m.dag)).first()["weight"] == 16_777_248
