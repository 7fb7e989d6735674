"""A collection of history DAGs in three tables.

nodes      dag_id string, node_id bigint, sample_id string, genome array<struct<pos,base>>
edges      dag_id string, edge_id bigint, parent_id bigint, child_id bigint, clade int
mutations  dag_id string, edge_id bigint, pos int, par string, mut string        (made from the others where wanted)

The node without a parent is the universal ancestor (UA): it has the reference sequence, an empty genome, and one clade. Children that
share a clade are alternatives; a tree takes one child of each clade. All DAGs of a collection share one reference.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions import genomes as G
from arbora.session import persisted

NODES = "dag_id string, node_id bigint, sample_id string, genome array<struct<pos:int,base:string>>"
EDGES = "dag_id string, edge_id bigint, parent_id bigint, child_id bigint, clade int"


@dataclass(frozen=True)
class Dag:
    nodes: DataFrame
    edges: DataFrame
    reference: str

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def replace(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> Dag:
        return Dag(self.nodes if nodes is None else nodes, self.edges if edges is None else edges, self.reference)

    def persisted(self, name: str) -> Dag:
        return self.replace(persisted(self.nodes, f"{name}-nodes"), persisted(self.edges, f"{name}-edges"))

    def union(self, *others: Dag) -> Dag:
        nodes, edges = self.nodes, self.edges
        for o in others:
            if o.reference != self.reference:
                raise ValueError("DAGs of one collection share their reference")
            nodes, edges = nodes.unionByName(o.nodes), edges.unionByName(o.edges)
        return self.replace(nodes, edges)

    def only(self, dag_id: str) -> Dag:
        return self.replace(self.nodes.where(F.col("dag_id") == dag_id), self.edges.where(F.col("dag_id") == dag_id))

    def reference_column(self):
        return F.lit(self.reference)


def from_rows(spark: SparkSession, reference: str, edges: Sequence[tuple[int, int, int]], sequences: Mapping[int, str] | None = None, samples: Mapping[int, str] | None = None, dag_id: str = "dag") -> Dag:
    """A small DAG from (parent, child, clade) triples; leaves without a sample id take their node's number."""
    ids = sorted({x for p, c, _ in edges for x in (p, c)})
    parents = {p for p, _, _ in edges}
    rows = [(dag_id, i, (samples or {}).get(i, str(i)) if i not in parents else None, (sequences or {}).get(i, reference)) for i in ids]
    nodes = spark.createDataFrame(rows, "dag_id string, node_id bigint, sample_id string, sequence string")
    nodes = nodes.select("dag_id", "node_id", "sample_id", G.from_sequence(F.col("sequence"), F.lit(reference)).cast(G.GENOME).alias("genome"))
    return Dag(nodes, spark.createDataFrame([(dag_id, k, p, c, x) for k, (p, c, x) in enumerate(edges)], EDGES), reference)
