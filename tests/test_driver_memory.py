"""Rows of a table are not sent through the driver, however small Spark takes the table for."""

import contextlib

from arbora.operators import sankoff
from arbora.plans import adapter, catalog

TINY = "/root/testdata/sf0.001"


@contextlib.contextmanager
def setting(spark, name, value):
    old = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, old)


def test_genome_pairs_meet_without_a_broadcast(spark):
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "10m"):
        df = catalog.queries()["genome_pairs"](spark, TINY)
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
        rows = df.collect()
    assert len(rows) == 149 and all(r.round_trip and not r.compatible and r.mutations.count(",") == r.n_sites for r in rows)


def test_calls_meet_leaves_without_a_broadcast(spark, monkeypatch):
    plans, keep = [], sankoff.persisted
    monkeypatch.setattr(sankoff, "persisted", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), keep(df, name))[1])
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "10m"):
        assert len(catalog.queries()["vcf_fitch_sankoff"](spark, TINY).collect()) == 32
    calls = [p for p in plans if "posexplode" in p]
    assert len(calls) == 1 and "Broadcast" not in calls[0]


def test_one_tree_is_made_alone(spark, tmp_path):
    spark.read.parquet(f"{TINY}/customer.parquet").write.parquet(str(tmp_path / "customer.parquet"))
    tree = adapter.tree(spark, str(tmp_path), "C")
    assert {r.dag_id for r in tree.nodes.select("dag_id").distinct().collect()} == {"C"}
    assert not [k for k in adapter._MADE if k[1:3] == ("trees", str(tmp_path))]
    whole = adapter.all_trees(spark, str(tmp_path)).only("C")
    for mine, all_ in ((tree.nodes, whole.nodes), (tree.edges, whole.edges)):
        assert mine.count() == all_.count() and mine.exceptAll(all_).count() == 0
