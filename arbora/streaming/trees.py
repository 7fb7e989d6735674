"""A stream of trees merged into a stored DAG, one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.model import Dag
from arbora.operators import merge
from arbora.sources import newick, sequences


class MergedStream:
    """foreachBatch sink: rows of dag_id, newick become trees and are merged into what is there.

    Batch n is merged into version first + n - 1 as it is stored, and writes version first + n and nothing else. So nothing is held in the driver: a
    batch that is run again, also by another driver after a restart, gives the same. A stream with a new checkpoint
    goes on from an old path with first = next_version(spark, path).
    """

    def __init__(self, spark: SparkSession, path: str, samples: DataFrame, reference: str, first: int = 0):
        """samples: sample_id, sequence."""
        self.spark, self.path, self.samples, self.reference, self.first = spark, path, samples, reference, first

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        version = self.first + batch_id
        trees = newick.read(batch.select("dag_id", "newick"))
        dag = sequences.tree_with_sequences(trees, self.samples, self.reference).persisted("batch")
        have = merge.add(read_merged(self.spark, self.path, version - 1, self.reference), dag) if version else merge.merge(dag)
        have.dag.nodes.join(have.labels, "node_id").write.mode("overwrite").parquet(f"{self.path}/v{version}/labels")
        have.dag.edges.write.mode("overwrite").parquet(f"{self.path}/v{version}/edges")

    def start(self, trees: DataFrame, checkpoint: str):
        return trees.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)


def next_version(spark: SparkSession, path: str) -> int:
    """One more than the last whole version of a path."""
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v*/edges/_SUCCESS")
    found = files.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(files) or []
    return max((int(f.getPath().getParent().getParent().getName()[1:]) + 1 for f in found), default=0)


def read_merged(spark: SparkSession, path: str, version: int, reference: str) -> merge.Merged:
    labels = spark.read.parquet(f"{path}/v{version}/labels")
    return merge.Merged(read_version(spark, path, version, reference), labels.select("node_id", "label_key", "leafset_key", "n_leaves"))


def read_version(spark: SparkSession, path: str, version: int, reference: str) -> Dag:
    nodes = spark.read.parquet(f"{path}/v{version}/labels").select(F.lit("merged").alias("dag_id"), "node_id", "sample_id", "genome")
    return Dag(nodes, spark.read.parquet(f"{path}/v{version}/edges"), reference)


