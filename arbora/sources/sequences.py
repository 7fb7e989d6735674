"""FASTA, reference sequences, VCF genotypes and PCP tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions import bases as B
from arbora.functions import genomes as G
from arbora.model import Dag
from arbora.operators import graph


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, sequence: the id ends at the first blank; sequence lines are joined; of records of one id the last of a file counts.

    Records are the reader's rows (lines end at >), so one file is read by many tasks; gzip by extension.
    """
    rows = spark.read.option("lineSep", ">").text(path).select("value", F.monotonically_increasing_id().alias("at"))
    return fasta_records(rows.where(F.trim("value") != ""))


def fasta_records(rows: DataFrame) -> DataFrame:
    """rows: value (a record without its >), at (order)."""
    lines = F.split("value", "\r?\n")
    head = F.element_at(F.split(lines[0], r"[ \t]"), 1)
    body = F.upper(F.array_join(F.transform(F.slice(lines, 2, F.size(lines)), lambda x: F.regexp_replace(x, r"\s", "")), ""))
    return rows.select(head.alias("sample_id"), body.alias("sequence"), "at").groupBy("sample_id").agg(F.max_by("sequence", "at").alias("sequence"))


def reference(spark: SparkSession, path: str) -> str:
    """The last word of the file (a plain sequence, or the last line of a FASTA record)."""
    whole = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.trim("value"), r"\s+"), -1)).first()
    return whole[0]


def tree_with_sequences(trees: DataFrame, sequences: DataFrame, reference: str) -> Dag:
    """trees: newick.NODES. Nodes are named by their labels; one without a sequence has the reference's. A UA is put above each root."""
    ua = trees.groupBy("dag_id").agg((F.max("node_id") + 1).alias("ua"))
    t = trees.join(ua, "dag_id")
    named = t.join(sequences, t["label"] == sequences["sample_id"], "left")
    leaf = F.col("_leaf")
    kids = t.where("parent_id is not null").select("dag_id", F.col("parent_id").alias("node_id")).distinct().withColumn("_inner", F.lit(True))
    nodes = named.join(kids, ["dag_id", "node_id"], "left").withColumn("_leaf", F.col("_inner").isNull())
    genome = G.from_sequence(F.coalesce("sequence", F.lit(reference)), F.lit(reference))
    nodes = nodes.select("dag_id", "node_id", F.when(leaf, F.col("label")).alias("sample_id"), genome.cast(G.GENOME).alias("genome"))
    nodes = nodes.unionByName(ua.select("dag_id", F.col("ua").alias("node_id"), F.lit(None).cast("string").alias("sample_id"), G.empty().alias("genome")))
    edges = t.select("dag_id", F.col("node_id").alias("edge_id"), F.coalesce("parent_id", "ua").alias("parent_id"), F.col("node_id").alias("child_id"), "clade")
    return Dag(nodes, edges, reference)


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, pos, base of every genotype that is not the reference's; `.` is N. SNPs only: the first letter of each allele counts."""
    return vcf_lines(spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at")))


def vcf_lines(lines: DataFrame) -> DataFrame:
    """lines: value. The header line names the samples."""
    head = lines.where(F.col("value").startswith("#CHROM")).select(F.slice(F.split("value", "\t"), 10, 1 << 20).alias("samples")).limit(1)
    rows = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split("value", "\t").alias("f")).crossJoin(F.broadcast(head))  # one row of column names
    call = rows.select(F.col("f")[1].cast("int").alias("pos"), F.col("f")[3].alias("ref"), F.split(F.col("f")[4], ",").alias("alt"), F.explode(F.arrays_zip("samples", F.slice("f", 10, F.size("samples")).alias("calls"))).alias("g"))
    call = call.select("pos", "ref", "alt", F.col("g.samples").alias("sample_id"), F.regexp_extract("g.calls", r"^([^:/|]*)", 1).alias("c"))
    at = F.expr("try_cast(c as int)")
    base = F.when(at.isNull(), "N").when(at == 0, F.substring("ref", 1, 1)).otherwise(F.coalesce(F.substring(F.get("alt", at - 1), 1, 1), F.lit("N")))
    return call.select("sample_id", "pos", F.upper(base).alias("base")).where(F.col("base") != F.upper(F.substring(call["ref"], 1, 1)))


def with_variants(dag: Dag, variants: DataFrame) -> Dag:
    """Leaves take the bases of variants (sample_id, pos, base) in place of what they had there."""
    own = variants.groupBy("sample_id").agg(F.array_sort(F.collect_list(G.entry(F.col("pos"), F.col("base")))).alias("_v"))
    nodes = dag.nodes.join(own, "sample_id", "left")
    new = G.without_reference(G.upsert(F.col("genome"), F.col("_v")), dag.reference_column())
    return dag.replace(nodes.select("dag_id", "node_id", "sample_id", F.when(F.col("_v").isNotNull(), new).otherwise(F.col("genome")).alias("genome")))


def unmatched(dag: Dag, variants: DataFrame) -> DataFrame:
    """sample_id, side: samples that only the leaves or only the variants have."""
    a, b = graph.leaves(dag).select("sample_id").distinct(), variants.select("sample_id").distinct()
    return a.join(b, "sample_id", "left_anti").withColumn("side", F.lit("leaf")).unionByName(b.join(a, "sample_id", "left_anti").withColumn("side", F.lit("variants")))


def pcp(spark: SparkSession, path: str) -> DataFrame:
    """Parent-child pairs: CSV with a header, gzip by extension; all columns as text."""
    return spark.read.option("header", True).csv(path)


def consensus(sequences: DataFrame) -> DataFrame:
    """sequence: of the most frequent base at each place, ties to the first letter."""
    each = sequences.select(F.posexplode(F.split("sequence", "")).alias("pos", "base")).where("base <> ''")
    best = each.groupBy("pos", "base").count().groupBy("pos").agg(F.max_by("base", F.struct("count", -F.ascii("base"))).alias("base"))
    return best.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"]), "").alias("sequence"))


def base_masks(sequences: DataFrame) -> DataFrame:
    """sample_id, pos, mask of every place of every sequence."""
    each = sequences.select("sample_id", F.posexplode(F.split("sequence", "")).alias("pos", "base")).where("base <> ''")
    return each.select("sample_id", (F.col("pos") + 1).alias("pos"), B.mask(F.col("base")).alias("mask"))
