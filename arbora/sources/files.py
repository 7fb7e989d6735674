"""Which format a file has, and reading and writing DAGs in all of them.

Parquet (three tables) is the native store; appending writes the rows that are not there yet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions import genomes as G
from arbora.model import EDGES, NODES, Dag
from arbora.operators import graph, labels
from arbora.operators.weights import mutations
from arbora.sources import protobuf

#: Name parts of files, and the format they stand for.
EXTENSIONS = {
    "parquet": "parquet", "protobuf": "protobuf", "pb": "protobuf", "dag-pb": "dag-pb", "pb_dag": "dag-pb", "tree-pb": "tree-pb", "pb_tree": "tree-pb",
    "json": "json", "dag-json": "json", "json_dag": "json",
}


def infer_format(path: str) -> str:
    """The last known part of the file's name, from right to left."""
    for part in reversed(path.rstrip("/").rsplit("/", 1)[-1].split(".")):
        if part in EXTENSIONS:
            return EXTENSIONS[part]
    raise ValueError(f"cannot tell the format of {path}")


def read(spark: SparkSession, path: str, kind: str | None = None, reference: str | None = None) -> Dag:
    kind = kind or infer_format(path)
    if kind == "parquet":
        return read_tables(spark, path)
    if kind == "json":
        return read_json(spark, path)
    if kind == "dag-pb":
        return protobuf.read_dags(spark, path)
    if kind == "tree-pb":
        if reference is None:
            raise ValueError("a tree file needs a reference sequence")
        return protobuf.read_trees(spark, path, reference)
    raise ValueError("a protobuf file is dag-pb or tree-pb: say which")


def write(dag: Dag, path: str, kind: str | None = None, append: bool = False) -> None:
    kind = kind or infer_format(path)
    if kind == "parquet":
        (append_tables if append else write_tables)(dag, path)
    elif kind in ("dag-pb", "tree-pb"):
        protobuf.write(protobuf.encode_dags(dag) if kind == "dag-pb" else protobuf.encode_trees(dag), path)
    else:
        raise ValueError(f"{kind} is not written")


def write_tables(dag: Dag, path: str) -> None:
    dag.nodes.write.parquet(f"{path}/nodes")
    dag.edges.write.parquet(f"{path}/edges")
    dag.spark.createDataFrame([(dag.reference,)], "reference_seq string").write.parquet(f"{path}/meta")


def append_tables(dag: Dag, path: str) -> None:
    old = read_tables(dag.spark, path)
    dag.nodes.join(old.nodes.select(*graph.KEY), graph.KEY, "left_anti").select(*dag.nodes.columns).write.mode("append").parquet(f"{path}/nodes")
    dag.edges.join(old.edges.select("dag_id", "edge_id"), ["dag_id", "edge_id"], "left_anti").select(*dag.edges.columns).write.mode("append").parquet(f"{path}/edges")


def read_tables(spark: SparkSession, path: str) -> Dag:
    return Dag(spark.read.schema(NODES).parquet(f"{path}/nodes"), spark.read.schema(EDGES).parquet(f"{path}/edges"), spark.read.parquet(f"{path}/meta").first()[0])


JSON = "refseq array<string>, compact_genomes array<array<string>>, nodes array<array<string>>, edges array<array<bigint>>"


def read_json(spark: SparkSession, path: str) -> Dag:
    """refseq [id, sequence], compact_genomes [[[pos, [old, new]], ...], ...], nodes [[genome, clades], ...], edges [[parent, child, clade], ...]."""
    rows = spark.read.schema(JSON).option("multiLine", True).json(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("dag_id"), "*")
    reference = rows.select(F.col("refseq")[1]).first()[0]
    entry = lambda x: F.from_json(x, "array<string>")
    genomes = rows.select("dag_id", F.posexplode("compact_genomes").alias("genome_id", "g")).select("dag_id", "genome_id", F.transform("g", lambda x: G.entry(entry(x)[0].cast("int"), F.from_json(entry(x)[1], "array<string>")[1])).alias("genome"))
    nodes = rows.select("dag_id", F.posexplode("nodes").alias("node_id", "n")).select("dag_id", F.col("node_id").cast("bigint").alias("node_id"), F.col("n")[0].cast("int").alias("genome_id"))
    nodes = nodes.join(genomes, ["dag_id", "genome_id"]).select("dag_id", "node_id", F.lit(None).cast("string").alias("sample_id"), F.array_sort("genome").cast(G.GENOME).alias("genome"))
    edges = rows.select("dag_id", F.posexplode("edges").alias("edge_id", "e")).select("dag_id", F.col("edge_id").cast("bigint").alias("edge_id"), F.col("e")[0].alias("parent_id"), F.col("e")[1].alias("child_id"), F.col("e")[2].cast("int").alias("clade"))
    return labels.sample_ids(Dag(nodes, edges, reference))


def dot(dag: Dag) -> DataFrame:
    """dag_id, at, value: the lines of a DOT graph; sort by at within dag_id. Mutations stand on edges, three to a line."""
    name = lambda i: F.concat(F.lit("n"), F.col(i).cast("string"))
    m = F.transform("muts", lambda x: F.concat(x["par"], x["pos"].cast("string"), x["mut"]))
    lines = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("muts") / 3).cast("int") - 1, F.lit(0))), lambda k: F.array_join(F.slice(m, k * 3 + 1, 3), " "))
    edges = mutations(dag).select("dag_id", F.struct(F.lit(2).alias("a"), F.col("edge_id").alias("b")).alias("at"), F.format_string('  "%s" -> "%s"[ label="%s" ]', name("parent_id"), name("child_id"), F.array_join(lines, "\\n")).alias("value"))
    nodes = dag.nodes.select("dag_id", F.struct(F.lit(1).alias("a"), F.col("node_id").alias("b")).alias("at"), F.format_string('  "%s"[ label="%s" ]', name("node_id"), F.coalesce("sample_id", F.col("node_id").cast("string"))).alias("value"))
    ends = dag.nodes.select("dag_id").distinct().select("dag_id", F.explode(F.array(F.struct(F.lit(0).alias("a"), F.lit("digraph {").alias("v")), F.struct(F.lit(3).alias("a"), F.lit("}").alias("v")))).alias("x"))
    return ends.select("dag_id", F.struct(F.col("x.a").alias("a"), F.lit(0).cast("bigint").alias("b")).alias("at"), F.col("x.v").alias("value")).unionByName(nodes).unionByName(edges)


#: The columns of a search's log, and where a row of statistics has them.
LOG = {
    "Iteration": "iteration", "NTrees": "trees", "NNodes": "nodes", "NEdges": "edges", "MaxParsimony": "least_parsimony", "NTreesMaxParsimony": "least_parsimony_trees", "WorstParsimony": "most_parsimony",
    "MinSumRFDistance": "least_sum_rf", "MaxSumRFDistance": "most_sum_rf", "MinSumRFCount": "least_sum_rf_trees", "MaxSumRFCount": "most_sum_rf_trees", "SecondsElapsed": "seconds",
}


def append_log(spark: SparkSession, rows: list[dict], path: str) -> None:
    """A search's statistics, tab-separated, one row for each iteration: the columns of LOG if the rows hold them all, else what they hold."""
    if rows and all(k in rows[0] for k in LOG.values()):
        rows = [{name: str(r[k]) for name, k in LOG.items()} for r in rows]
        frame = spark.createDataFrame(rows, ", ".join(f"{name} string" for name in LOG))
    else:
        frame = spark.createDataFrame(rows)
    frame.coalesce(1).write.mode("append").option("sep", "\t").option("header", True).csv(path)
