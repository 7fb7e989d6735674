import gzip

import pytest
from pyspark.sql import functions as F

from arbora.functions import likelihood as J
from arbora.model import from_rows
from arbora.operators import graph, labels
from arbora.operators import merge as M
from arbora.operators import weights as W
from arbora.sources import files, newick, protobuf, sequences
from tests.test_fixtures import SAMPLES, SEQUENCES, TOPOLOGY


@pytest.fixture
def dag(spark):
    return from_rows(spark, "GAA", TOPOLOGY, SEQUENCES, SAMPLES)


def test_newick(spark):
    texts = [("a", "((a:1e-3,b:-2)x:0.5,'c d''e')r;"), ("b", "(((1,2),(3,4)),(5,6))"), ("c", "only;"), ("d", "")]
    rows = newick.read(spark.createDataFrame(texts, "dag_id string, newick string"))
    got = {(r.dag_id, r.node_id): (r.parent_id, r.clade, r.label, r.length) for r in rows.collect()}
    assert got["a", 0] == (2, 0, "a", 1e-3) and got["a", 1] == (2, 1, "b", -2.0) and got["a", 2] == (4, 0, "x", 0.5) and got["a", 3] == (4, 1, "c d'e", None) and got["a", 4] == (None, 0, "r", None)
    assert sum(k[0] == "b" for k in got) == 11 and got["c", 0] == (None, 0, "only", None) and not any(k[0] == "d" for k in got)
    assert {r.dag_id: r.newick for r in newick.write(rows).collect()}["b"] == "(((1,2),(3,4)),(5,6));"


def test_fasta_newick_vcf(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">s1 first\nAC\nGT\n>s2\nACGA\n>s1 later\nTTTT\n")
    with gzip.open(tmp_path / "y.fa.gz", "wt") as f:
        f.write(">s3\nAAGT\n")
    got = {r.sample_id: r.sequence for r in sequences.fasta(spark, str(tmp_path / "x.fa")).unionByName(sequences.fasta(spark, str(tmp_path / "y.fa.gz"))).collect()}
    assert got == {"s1": "TTTT", "s2": "ACGA", "s3": "AAGT"}
    trees = newick.read(spark.createDataFrame([("t", "((s1,s2),s3);")], "dag_id string, newick string"))
    dag = sequences.tree_with_sequences(trees, spark.createDataFrame(list(got.items()), "sample_id string, sequence string"), "ACGT").persisted("t")
    assert graph.violations(dag, allow_dag=False).count() == 0
    assert {r.sample_id: len(r.genome) for r in graph.leaves(dag).collect()} == {"s1": 3, "s2": 1, "s3": 1}
    vcf = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts3\tother\nc\t1\t.\tA\tG,T\t.\t.\t.\tGT\t2\t0\t1\nc\t3\t.\tG\tC\t.\t.\t.\tGT\t.\t1:9\t0\n"
    (tmp_path / "v.vcf").write_text(vcf)
    v = sequences.vcf(spark, str(tmp_path / "v.vcf"))
    assert sorted(tuple(r) for r in v.collect()) == [("other", 1, "G"), ("s1", 1, "T"), ("s1", 3, "N"), ("s3", 3, "C")]
    assert sorted(tuple(r) for r in sequences.unmatched(dag, v).collect()) == [("other", "variants"), ("s2", "leaf")]
    after = {r.sample_id: {(g.pos, g.base) for g in r.genome} for r in graph.leaves(sequences.with_variants(dag, v)).collect()}
    assert after["s3"] == {(2, "A"), (3, "C")} and (3, "N") in after["s1"]


def test_mutations_round_trip(spark, dag):
    again = labels.recomputed_genomes(dag, W.mutation_rows(dag))
    a, b = ({r.node_id: [tuple(x) for x in r.genome] for r in d.nodes.collect()} for d in (dag, again))
    assert a == b and labels.inconsistent_mutations(dag, W.mutation_rows(dag)).count() == 0
    wrong = W.mutation_rows(dag).withColumn("par", F.when((F.col("edge_id") == 1) & (F.col("pos") == 1), "C").otherwise(F.col("par")))
    assert labels.inconsistent_mutations(dag, wrong).count() == 1


def test_protobuf_and_tables(spark, dag, tmp_path):
    content = protobuf.encode_dags(dag).first()["content"]
    (tmp_path / "x.dag-pb").write_bytes(content)
    (tmp_path / "y.dag-pb.gz").write_bytes(gzip.compress(bytes(content)))
    (tmp_path / "z.pb_tree").write_bytes(protobuf.encode_trees(dag).first()["content"])
    for name in ("x.dag-pb", "y.dag-pb.gz", "z.pb_tree"):
        back = files.read(spark, str(tmp_path / name), reference="GAA")
        assert M.same(dag, back).count() == 0 and back.nodes.count() == 11
    files.write(dag, str(tmp_path / "store.parquet"))
    more = graph.with_ua(dag, 99)
    files.write(more, str(tmp_path / "store.parquet"), append=True)
    assert files.read(spark, str(tmp_path / "store.parquet")).nodes.count() == 12
    assert files.infer_format("a/b.json.gz") == "json" and files.infer_format("x.pb_dag") == "dag-pb"
    with pytest.raises(ValueError):
        files.infer_format("a/readme")


def test_json_and_dot(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"refseq": ["r", "GAA"], "compact_genomes": [[], [[1, ["G", "A"]], [3, ["A", "C"]]], [[2, ["A", "T"]]]], "nodes": [[0, [[1, 2]]], [0, [[1], [2]]], [1, []], [2, []]], "edges": [[0, 1, 0], [1, 2, 0], [1, 3, 1]]}')
    dag = files.read(spark, str(tmp_path / "d.json"))
    assert {r.sample_id for r in graph.leaves(dag).collect()} == {"<1A,3C,>", "<2T,>"} and graph.violations(dag).count() == 0
    lines = [r.value for r in files.dot(dag).orderBy("at").collect()]
    assert lines[0] == "digraph {" and lines[-1] == "}" and '  "n1" -> "n2"[ label="G1A A3C" ]' in lines


def test_likelihood(spark):
    import math

    sites = spark.createDataFrame([(1, 0, 1, 2.0, [0.0, 0.5, 0.25, 0.25]), (1, 1, 1, 1.0, [0.5, 0.0, 0.25, 0.25]), (1, 2, 4, 9.0, [0.0] * 4), (2, 1, 1, 1.0, [0.5, 0.0, 0.25, 0.25])], "e int, parent int, child int, rate double, csp array<double>")
    got = {r.e: r.log_likelihood for r in J.edge_log_likelihood(sites, ["e"]).collect()}
    assert got[1] == pytest.approx(math.log(1.0) + math.log(1 / 3) - 1) and got[2] == 0.0
    row = spark.createDataFrame([("ACGTN",)], "s string").select(J.encoded(F.col("s"), 3, 6).alias("k"), J.base_codes(F.col("s")).alias("b")).first()
    assert row.k == [64, 6, 27, 64, 64, 64] and row.b == [0, 1, 2, 3, 4]


def test_stream_of_trees(spark, tmp_path):
    from arbora.streaming.trees import MergedStream, read_version

    samples = spark.createDataFrame([(x, s) for x, s in zip("abcd", ("AC", "AT", "GC", "GT"), strict=True)], "sample_id string, sequence string")
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text('{"dag_id": "t1", "newick": "((a,b),(c,d));"}\n{"dag_id": "t2", "newick": "((a,c),(b,d));"}\n')
    sink = MergedStream(spark, str(tmp_path / "out"), samples, "AA")
    stream = spark.readStream.schema("dag_id string, newick string").json(str(source))
    sink.start(stream, str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    (source / "2.json").write_text('{"dag_id": "t3", "newick": "((a,d),(b,c));"}\n')
    sink.start(stream, str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    dag = read_version(spark, str(tmp_path / "out"), 1, "AA")
    assert W.at_root(dag, W.tree_counts(dag)).first()["weight"] == 3


@pytest.mark.parametrize("kind", ["dag-pb", "tree-pb"])
def test_protobuf_files_come_back(spark, dag, tmp_path, kind):
    """Through write() and read(): each file is one message, also for other readers."""
    path = str(tmp_path / f"x.{kind}")
    two = dag.replace(*(df.unionByName(df.withColumn("dag_id", F.lit("b/2 %41"))) for df in (dag.nodes, dag.edges))).persisted("two")
    files.write(two, path)
    back = files.read(spark, path, reference="GAA")
    assert {r.dag_id for r in back.nodes.select("dag_id").distinct().collect()} == {r.dag_id for r in two.nodes.select("dag_id").distinct().collect()}
    for name in ("b/2 %41", two.nodes.where("dag_id <> 'b/2 %41'").first().dag_id):
        one = lambda d: d.replace(d.nodes.where(F.col("dag_id") == name), d.edges.where(F.col("dag_id") == name))  # noqa: B023, E731
        assert M.same(one(two), one(back)).count() == 0
    contents = spark.read.format("binaryFile").load(path).collect()
    assert len(contents) == 2 and all(bytes(r.content).endswith(b"z\0") for r in contents)


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    """Each batch has a sink of its own, and one is run twice; a stream with a new checkpoint follows the last version."""
    from arbora.streaming.trees import MergedStream, next_version, read_version

    samples = spark.createDataFrame([("a", "AC"), ("b", "AT"), ("c", "GC"), ("d", "GT")], "sample_id string, sequence string")
    path = str(tmp_path / "out")
    assert next_version(spark, path) == 0
    batches = [spark.createDataFrame([(f"t{k}", text)], "dag_id string, newick string") for k, text in enumerate(["((a,b),(c,d));", "((a,c),(b,d));", "((a,d),(b,c));"])]
    for n, first in ((0, 0), (1, 0), (1, 0)):
        MergedStream(spark, path, samples, "AA", first)(batches[n], n)
    assert next_version(spark, path) == 2
    MergedStream(spark, path, samples, "AA", next_version(spark, path))(batches[2], 0)
    trees = [W.at_root(d, W.tree_counts(d)).first()["weight"] for d in (read_version(spark, path, v, "AA") for v in range(3))]
    assert trees == sorted(trees) and len(set(trees)) == 3


@pytest.mark.parametrize("text", ["((a,b)x],(c,d));", "((a,b)", "(a,b));", "a,b;", "(a,b); (c,d);", "(a,b)c(d,e);", "(a[,b);"])
def test_no_newick(text):
    with pytest.raises(ValueError, match="Newick"):
        list(newick.parse(text))


def test_cycles_have_no_ancestors(spark, dag):
    edges = dag.edges.unionByName(dag.edges.where("child_id = 7").select("dag_id", F.lit(99).cast("bigint").alias("edge_id"), F.lit(1).cast("bigint").alias("parent_id"), F.lit(8).cast("bigint").alias("child_id"), F.lit(0).alias("clade")))
    with pytest.raises(ValueError, match="cycle"):
        graph.ancestors(dag.replace(edges=edges))
