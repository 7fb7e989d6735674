"""Protobuf files of DAGs (edges with mutations) and of trees (Newick with mutations in preorder), gzip or not.

Messages are read field by field; a file is one message, so one task reads it and many files are read in parallel.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions import genomes as G
from arbora.model import Dag
from arbora.operators import graph, labels
from arbora.operators.weights import mutations
from arbora.sources import newick

LETTERS = "ACGT"


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a message: ints of kinds 0, 1 and 5, bytes of kind 2."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < end:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = 8 if kind == 1 else 4
            yield tag >> 3, int.from_bytes(data[at : at + n], "little")
            at += n


def _ints(value: int | bytes) -> list[int]:
    """A repeated int, packed or not."""
    if isinstance(value, int):
        return [value]
    out, x, shift = [], 0, 0
    for b in value:
        x |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(x)
            x = shift = 0
    return out


def _varint(x: int) -> bytes:
    x &= (1 << 64) - 1
    out = bytearray()
    while x > 127:
        out.append(x & 127 | 128)
        x >>= 7
    out.append(x)
    return bytes(out)


def field(number: int, value: int | bytes | str) -> bytes:
    """One field; an int of 0 is left out, as it is the default."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value) if value else b""
    raw = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mutation(data: bytes, at: tuple[int, int, int]) -> tuple[int, str, str]:
    pos = par = 0
    mut: list[int] = []
    for n, v in fields(data):
        if n == at[0]:
            pos = v
        elif n == at[1]:
            par = v
        elif n == at[2]:
            mut += _ints(v)
    return pos, LETTERS[par], LETTERS[mut[0] if mut else 0]


def _plain(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


ROWS = "kind string, dag_id string, a bigint, b bigint, c bigint, pos int, par string, mut string, text string"


def _rows(kind, dag_id, a=None, b=None, c=None, pos=None, par=None, mut=None, text=None):
    return kind, dag_id, a, b, c, pos, par, mut, text


def decode_dag(dag_id: str, data: bytes) -> Iterator[tuple]:
    edge = 0
    for n, v in fields(_plain(data)):
        if n == 1:
            e = {1: 0, 2: 0, 3: 0, 4: 0}
            muts = []
            for k, x in fields(v):
                if k == 5:
                    muts.append(_mutation(x, (1, 2, 3)))
                elif k in e:
                    e[k] = _signed(x)
            yield _rows("edge", dag_id, edge, e[2], e[4], pos=e[3])
            for p, x, y in muts:
                yield _rows("mutation", dag_id, edge, pos=p, par=x, mut=y)
            edge += 1
        elif n == 2:
            node, names = 0, []
            for k, x in fields(v):
                if k == 1:
                    node = _signed(x)
                else:
                    names.append(x.decode())
            yield _rows("name", dag_id, node, text=names[0] if names else None)
        elif n == 4:
            yield _rows("reference", dag_id, text=v.decode())


def decode_tree(dag_id: str, data: bytes) -> Iterator[tuple]:
    text, lists, condensed = "", [], {}
    for n, v in fields(_plain(data)):
        if n == 1:
            text = v.decode()
        elif n == 2:
            lists.append([_mutation(x, (1, 3, 4)) for k, x in fields(v) if k == 1])
        elif n == 3:
            name, members = "", []
            for k, x in fields(v):
                if k == 1:
                    name = x.decode()
                else:
                    members.append(x.decode())
            condensed[name] = members
    nodes = list(newick.parse(text))
    kids: dict = {}
    for node, up, k, label, _ in nodes:
        kids.setdefault(up, []).append((k, node, label))
    ua = len(nodes)
    extra = ua + 1
    order, stack = [], [(None, *x) for x in sorted(kids.get(None, []), reverse=True)]
    while stack:
        up, k, node, label = stack.pop()
        order.append((up, k, node, label))
        stack += [(node, *x) for x in sorted(kids.get(node, []), reverse=True)]
    for at, (up, k, node, label) in enumerate(order):
        own = lists[at] if at < len(lists) else []
        members = condensed.get(label) if node not in kids else None
        siblings = [(node, label)] if not members else [(node, members[0])]
        for m in (members or [])[1:]:
            siblings.append((extra, m))
            extra += 1
        for j, (i, name) in enumerate(siblings):
            yield _rows("edge", dag_id, i, ua if up is None else up, i, pos=k if j == 0 else 1_000_000 + i)
            if node not in kids:
                yield _rows("name", dag_id, i, text=name)
            for p, x, y in own:
                yield _rows("mutation", dag_id, i, pos=p, par=x, mut=y)


#: Stands behind each written message: its field 15, empty, which readers pass over. Spark's text writer ends every row, and this end is valid.
NOTHING = "z\u0000"


def write(messages: DataFrame, path: str) -> None:
    """messages: dag_id, content. A folder for each DAG with one file, which holds its message."""
    rows = messages.select("dag_id", F.col("content").cast("string").alias("value"))
    rows.write.partitionBy("dag_id").option("lineSep", NOTHING).mode("overwrite").text(path)


def _named(path: str) -> str:
    """A DAG's id: that of its folder, if it was written by write(), else the file's name."""
    *_, folder, name = ["", *path.split("/")]
    return unquote(folder[7:]) if folder.startswith("dag_id=") else name


def _read(spark: SparkSession, path: str, decode) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                out = pd.DataFrame(list(decode(_named(name), content)), columns=["kind", "dag_id", "a", "b", "c", "pos", "par", "mut", "text"])
                for c in ("a", "b", "c", "pos"):
                    out[c] = out[c].astype("Int64")
                yield out

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, ROWS)


def _dag(rows: DataFrame, reference: str) -> Dag:
    edges = rows.where("kind = 'edge'").select("dag_id", F.col("a").alias("edge_id"), F.col("b").alias("parent_id"), F.col("c").alias("child_id"), F.col("pos").alias("clade"))
    muts = rows.where("kind = 'mutation'").select("dag_id", F.col("a").alias("edge_id"), "pos", "par", "mut")
    names = rows.where("kind = 'name'").select("dag_id", F.col("a").alias("node_id"), F.col("text").alias("sample_id"))
    ids = edges.select("dag_id", F.col("parent_id").alias("node_id")).union(edges.select("dag_id", "child_id")).distinct()
    nodes = ids.join(names, ["dag_id", "node_id"], "left").select("dag_id", "node_id", "sample_id", G.empty().alias("genome"))
    dag = Dag(nodes, graph.renumbered(edges), reference).persisted("protobuf")
    return labels.sample_ids(labels.recomputed_genomes(dag, muts))


def read_dags(spark: SparkSession, path: str) -> Dag:
    from arbora.session import persisted

    rows = persisted(_read(spark, path, decode_dag), "protobuf")
    return _dag(rows, rows.where("kind = 'reference'").first()["text"])


def read_trees(spark: SparkSession, path: str, reference: str) -> Dag:
    from arbora.session import persisted

    return _dag(persisted(_read(spark, path, decode_tree), "protobuf"), reference)


def encode_dags(dag: Dag, reference_id: str = "reference") -> DataFrame:
    """dag_id, content: one message for each DAG, put together by one task from its encoded edges."""
    mut = lambda m: field(1, m["pos"]) + field(2, LETTERS.index(m["par"])) + field(3, _varint(LETTERS.index(m["mut"])))

    @F.pandas_udf("binary")
    def edge(e: pd.Series, p: pd.Series, k: pd.Series, c: pd.Series, muts: pd.Series) -> pd.Series:
        return pd.Series([field(1, field(1, int(a)) + field(2, int(b)) + field(3, int(x)) + field(4, int(y)) + b"".join(field(5, mut(m)) for m in ms)) for a, b, x, y, ms in zip(e, p, k, c, muts, strict=True)])

    @F.pandas_udf("binary")
    def name(i: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([field(2, field(1, int(a)) + field(2, b)) for a, b in zip(i, s, strict=True)])

    parts = mutations(dag).select("dag_id", F.lit(0).alias("o"), F.col("edge_id").alias("i"), edge("edge_id", "parent_id", "clade", "child_id", "muts").alias("part"))
    parts = parts.unionByName(graph.leaves(dag).select("dag_id", F.lit(1).alias("o"), F.col("node_id").alias("i"), name("node_id", "sample_id").alias("part")))
    tail = field(3, reference_id) + field(4, dag.reference)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dag_id": [pdf["dag_id"].iloc[0]], "content": [b"".join(pdf.sort_values(["o", "i"])["part"]) + tail]})

    return parts.groupBy("dag_id").applyInPandas(whole, "dag_id string, content binary")


def encode_trees(dag: Dag) -> DataFrame:
    """dag_id, content: Newick and mutation lists in preorder of each tree; inner nodes are named inner_<id>."""
    ua = graph.roots(dag).select("dag_id", F.col("node_id").alias("_ua"))
    m = mutations(dag).select("dag_id", F.col("child_id").alias("node_id"), "parent_id", "clade", "muts").join(ua, "dag_id")
    own = m.join(dag.nodes.select("dag_id", "node_id", "sample_id"), ["dag_id", "node_id"])
    rows = own.select("dag_id", "node_id", F.when(F.col("parent_id") != F.col("_ua"), F.col("parent_id")).alias("parent_id"), "clade", F.coalesce("sample_id", F.concat(F.lit("inner_"), "node_id")).alias("label"), F.lit(None).cast("double").alias("length"))
    texts = newick.write(rows)
    order = graph.preorder(dag).select("dag_id", "node_id", "enter")
    lists = own.join(order, ["dag_id", "node_id"]).select("dag_id", "enter", "muts")

    def whole(key, pdf: pd.DataFrame, text: pd.DataFrame) -> pd.DataFrame:
        mut = lambda x: field(1, x["pos"]) + field(3, LETTERS.index(x["par"])) + field(4, _varint(LETTERS.index(x["mut"])))
        body = b"".join(field(2, b"".join(field(1, mut(x)) for x in ms)) for ms in pdf.sort_values("enter")["muts"])
        return pd.DataFrame({"dag_id": [key[0]], "content": [field(1, text["newick"].iloc[0]) + body]})

    return lists.groupBy("dag_id").cogroup(texts.groupBy("dag_id")).applyInPandas(whole, "dag_id string, content binary")
