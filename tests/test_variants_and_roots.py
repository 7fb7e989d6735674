"""Genomes from calls with ambiguous bases, merging below a node, trees hung up elsewhere."""

import pytest
from pyspark.sql import functions as F

from arbora.functions import genomes as G
from arbora.model import from_rows
from arbora.operators import graph, sankoff, search
from arbora.operators import merge as M
from arbora.operators import weights as W
from arbora.plans import adapter, catalog
from arbora.session import persisted
from arbora.sources import newick, sequences

TINY = "/root/testdata/sf0.001"
TOPOLOGY = [(0, 10, 0), (7, 1, 0), (7, 2, 1), (8, 3, 0), (8, 4, 1), (9, 5, 0), (9, 6, 1), (8, 7, 2), (10, 8, 0), (10, 9, 1)]
HEAD = "#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT x1 x2 x3 x4 x5 x6"
CALLS = {
    "ambiguous": ["ref 1 . G A,T,C . . . GT 1 2 0 1 3 2", "ref 2 . A C,G,T . . . GT 1 . 2 . 3 1", "ref 3 . A C,G,T . . . GT 1 . 2 2 3 1"],
    "plain": ["ref 1 . G A,T,C . . . GT 1 2 0 1 3 2", "ref 2 . A C,G,T . . . GT 1 0 2 1 3 1", "ref 3 . A C,G,T . . . GT 1 2 2 2 3 1"],
}
LEAVES = {"ambiguous": "ACC TNN GGG ANG CTT TCC", "plain": "ACC TAG GGG ACG CTT TCC"}


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def dense(dag, variants):
    """The same by sets of all nodes at all sites: what differs from the reference, states of inner nodes, changes by site."""
    full = sequences.with_variants(dag.replace(dag.nodes.withColumn("genome", G.empty())), variants).persisted("full")
    sites = persisted(variants.select("pos").distinct().crossJoin(dag.nodes.select("dag_id").distinct()).select("dag_id", "pos"), "sites")
    sets = persisted(sankoff.fitch_sets(full, sites), "sets")
    states = sankoff.fitch_states(full, sets).join(graph.leaves(dag).select("dag_id", "node_id"), ["dag_id", "node_id"], "left_anti")
    return sets, states


def agree(dag, variants):
    reference = F.substring(dag.reference_column(), F.col("pos"), F.lit(1))
    bit = F.expr("int(pow(2, instr('ACGT', r) - 1))")
    sets, states = dense(dag, variants)
    other = lambda df: df.withColumn("r", reference).where(F.col("mask") != bit).select("dag_id", "node_id", "pos", "mask")
    sparse = persisted(sankoff.sparse_sets(dag, variants), "sparse")
    assert rows_of(sparse.withColumn("r", reference).where(F.col("mask") != bit).select("dag_id", "node_id", "pos", "mask")) == rows_of(other(sets))
    inner = sankoff.sparse_states(dag, sparse).join(graph.leaves(dag).select("dag_id", "node_id"), ["dag_id", "node_id"], "left_anti").select("dag_id", "node_id", "pos", "mask")
    assert rows_of(inner) == rows_of(other(states))
    made, steps = sankoff.variant_genomes(dag, variants)
    made = made.persisted("made")
    assert sum(r.steps for r in steps.collect()) == W.mutation_rows(made).count()
    return made


@pytest.mark.parametrize("kind", ["ambiguous", "plain"])
def test_calls_on_a_small_tree(spark, kind):
    dag = from_rows(spark, "GAA", TOPOLOGY, samples={i: f"x{i}" for i in range(1, 7)}).persisted("tree")
    lines = spark.createDataFrame([(x.replace(" ", "\t"),) for x in (HEAD, *CALLS[kind])], "value string")
    calls = persisted(sequences.vcf_lines(lines), "calls")
    made = agree(dag, calls)
    text = made.nodes.where("sample_id is not null").orderBy("sample_id").select(G.to_sequence(F.col("genome"), F.lit("GAA"))).collect()
    assert " ".join(r[0] for r in text) == LEAVES[kind]
    known = sankoff.variant_genomes(dag, calls, resolved=True)[0].persisted("resolved")
    assert known.nodes.where(G.is_ambiguous(F.col("genome"))).count() == 0
    assert search.scores(known).first().score == W.mutation_rows(made).count()


def test_calls_on_a_whole_table_and_none(spark):
    dag = adapter.all_trees(spark, TINY).only("A")
    agree(dag, persisted(catalog._calls(spark, TINY), "calls"))
    none = spark.createDataFrame([], "sample_id string, pos int, base string")
    made, steps = sankoff.variant_genomes(dag, none)
    assert steps.collect() == [] and made.nodes.where("size(genome) > 0").count() == 0


def test_rows_are_only_what_differs(spark):
    dag = adapter.all_trees(spark, TINY).only("C")
    one = graph.leaves(dag).orderBy("sample_id").limit(1).select("sample_id", F.lit(3).alias("pos"), F.lit("N").alias("base"))
    assert sankoff.sparse_sets(dag, persisted(one, "one")).count() == 1


def test_merging_below_a_node(spark):
    small = [(0, 1, 0), (1, 2, 0), (1, 3, 1), (2, 4, 0), (2, 5, 1), (2, 6, 2), (3, 7, 0), (3, 8, 1)]
    more = [(0, 1, 0), (1, 2, 0), (1, 3, 1), (2, 9, 0), (2, 6, 1), (9, 4, 0), (9, 5, 1), (3, 7, 0), (3, 8, 1)]
    flat = from_rows(spark, "A", small, dag_id="flat").persisted("flat")
    deep = from_rows(spark, "A", more, {3: "C"}, dag_id="deep").persisted("deep")
    have = M.merge(flat)
    at = lambda node: spark.createDataFrame([("deep", node)], "dag_id string, node_id bigint")
    part = M.add_below(have, deep, at(2))
    assert (part.dag.nodes.count(), part.dag.edges.count()) == (11, 8 + 5)  # two new nodes; 3 of the other genome is not below 2
    assert W.at_root(part.dag, W.tree_counts(part.dag)).first()["weight"] == 2
    assert graph.violations(part.dag).collect() == []
    whole = M.add_below(have, deep, at(0))
    assert M.same(whole.dag, M.add(have, deep).dag).collect() == [] and W.at_root(whole.dag, W.tree_counts(whole.dag)).first()["weight"] == 4
    with pytest.raises(ValueError, match="no clade"):
        M.add_below(have, deep, at(9))


def test_rerooted_trees(spark):
    cases = {
        "flat": ("(a:1,b:2,(c:3,d:4)e:5)r;", "b", "(a:1,(c:3,d:4)e:5)b:2;"),
        "deep": ("(a:1,b:2,(c:3,d:4)e:5)r;", "c", "(d:4,(a:1,b:2)r:5)c:3;"),
        "binary": ("((a:1,b:2)x:3,(c:4,d:5)y:6)r;", "a", "(b:2,(c:4,d:5)y:9)a:1;"),
        "single": ("((a:1,b:2)x:3)r;", "a", "(b:2)a:1;"),
        "path": ("(((a:1,b:2)x:3,c:4)y:5,d:6,e:7)r;", "a", "(b:2,(c:4,(d:6,e:7)r:5)y:3)a:1;"),
    }
    trees = persisted(newick.read(spark.createDataFrame([(k, t) for k, (t, _, _) in cases.items()], "dag_id string, newick string")), "trees")
    out = newick.rerooted(trees, spark.createDataFrame([(k, o) for k, (_, o, _) in cases.items()], "dag_id string, label string"))
    assert {r.dag_id: r.newick for r in newick.write(out).collect()} == {k: w for k, (_, _, w) in cases.items()}
    with pytest.raises(ValueError, match="outgroup"):
        newick.rerooted(trees, spark.createDataFrame([("flat", "z")], "dag_id string, label string"))
