"""Newick trees: each text becomes rows of nodes, many trees in parallel."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.session import persisted

NODES = "dag_id string, node_id bigint, parent_id bigint, clade int, label string, length double"
TOKEN = re.compile(r"\s*(?:([(),;])|'((?:[^']|'')*)'|(\[[^\]]*\])|([^\s(),;:\[\]']+)|(:\s*[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?))")


def parse(text: str) -> Iterator[tuple[int, int | None, int, str, float | None]]:
    """(node, parent, clade, label, length) of each node; ids in postorder, the root's parent is None. Numbers may have signs and exponents.

    The end mark may be missing. Raises ValueError at what is no Newick: a character out of place, brackets that don't match, a second tree.
    """
    ids = 0
    children: list[list[int]] = [[]]  # of the open nodes
    label: dict[int, str] = {}
    length: dict[int, float] = {}
    parent: dict[int, tuple[int, int]] = {}
    waiting: list[int] | None = None  # children of a node whose ) was just read
    name, size = "", None

    def close() -> None:
        nonlocal ids, waiting, name, size
        node = ids
        ids += 1
        for k, c in enumerate(waiting or []):
            parent[c] = (node, k)
        label[node], waiting = name, None
        if size is not None:
            length[node] = size
        children[-1].append(node)
        name, size = "", None

    def wrong(what: str) -> ValueError:
        return ValueError(f"Newick: {what} at character {at} of {text[:60]!r}")

    at, end = 0, len(text.rstrip())
    while at < end:
        if not (m := TOKEN.match(text, at)):
            raise wrong("unexpected text")
        mark, quoted, _, plain, number = m.groups()
        if mark == "(":
            if name or waiting is not None or size is not None:
                raise wrong("a bracket behind a node")
            children.append([])
        elif mark == ",":
            if len(children) == 1:
                raise wrong("a second root")
            close()
        elif mark == ")":
            if len(children) == 1:
                raise wrong("a bracket that was not opened")
            close()
            waiting = children.pop()
        elif mark == ";":
            if m.end() < end:
                raise wrong("text behind the end")
            break
        elif quoted is not None:
            name = quoted.replace("''", "'")
        elif plain is not None:
            name = plain
        elif number is not None:
            size = float(number[1:])
        at = m.end()
    if len(children) > 1:
        raise wrong("a bracket that was not closed")
    if name or waiting or not ids:
        close()
    for node in range(ids):
        up, k = parent.get(node, (None, 0))
        yield node, up, k, label[node], length.get(node)


def read(texts: DataFrame) -> DataFrame:
    """texts: dag_id, newick. Returns NODES."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dag_id, text in zip(pdf["dag_id"], pdf["newick"], strict=True):
                if text and text.strip():
                    rows = pd.DataFrame(list(parse(text)), columns=["node_id", "parent_id", "clade", "label", "length"])
                    rows["parent_id"] = rows["parent_id"].astype("Int64")
                    yield rows.assign(dag_id=dag_id)[["dag_id", "node_id", "parent_id", "clade", "label", "length"]]

    return texts.select("dag_id", "newick").mapInPandas(run, NODES)


def write(nodes: DataFrame) -> DataFrame:
    """nodes (NODES, of trees). Returns dag_id, newick: each tree is put together by one task, from its rows."""

    def text(pdf: pd.DataFrame) -> pd.DataFrame:
        kids: dict = {}
        for r in pdf.sort_values(["clade", "node_id"]).itertuples():
            kids.setdefault(None if pd.isna(r.parent_id) else int(r.parent_id), []).append(r)
        out: list[str] = []
        stack: list = [("open", r) for r in reversed(kids.get(None, []))]
        while stack:
            what, r = stack.pop()
            if what == "text":
                out.append(r)
                continue
            end = (r.label or "") + ("" if pd.isna(r.length) else f":{r.length:.10g}")
            own = kids.get(int(r.node_id), [])
            if not own:
                out.append(end)
                continue
            out.append("(")
            stack.append(("text", ")" + end))
            for k, c in enumerate(reversed(own)):
                stack.append(("open", c))
                if k < len(own) - 1:
                    stack.append(("text", ","))
        return pd.DataFrame({"dag_id": [pdf["dag_id"].iloc[0]], "newick": ["".join(out) + ";"]})

    return nodes.groupBy("dag_id").applyInPandas(text, "dag_id string, newick string")


def read_files(spark, path: str) -> DataFrame:
    """One tree for each file, named by its path."""
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("dag_id"), F.col("value").alias("newick"))
    return read(files)


def rerooted(trees: DataFrame, outgroup: DataFrame) -> DataFrame:
    """trees: NODES. outgroup: dag_id, label of one leaf of each. The trees hung up at that leaf, which names the root above its old neighbour and is no leaf any more.

    The edges from there up to the old root are turned round, with their lengths; the leaf's own length is the root's. An old root that is left with one
    child goes, and the lengths beside it are added; left with none, it goes with its edge. All trees at once. Raises ValueError if a tree has no such leaf.
    """
    from arbora.functions import genomes as G
    from arbora.model import Dag
    from arbora.operators import index

    nodes = trees.select("dag_id", "node_id", F.lit(None).cast("string").alias("sample_id"), G.empty().alias("genome"))
    edges = trees.where("parent_id is not null").select("dag_id", F.col("node_id").alias("edge_id"), "parent_id", F.col("node_id").alias("child_id"), "clade")
    found = index.build(Dag(persisted(nodes, "nodes"), persisted(edges, "edges"), "")).nodes.select("dag_id", "node_id", "enter", "leave")
    inner = trees.select("dag_id", F.col("parent_id").alias("node_id")).distinct()
    out = trees.join(outgroup, ["dag_id", "label"]).join(inner, ["dag_id", "node_id"], "left_anti").where("parent_id is not null")
    out = persisted(out.join(found, ["dag_id", "node_id"]).select("dag_id", F.col("node_id").alias("_leaf"), F.col("parent_id").alias("_top"), F.col("enter").alias("_at"), F.col("label").alias("_name"), F.col("length").alias("_length")), "outgroup")
    if outgroup.select("dag_id").join(out, "dag_id", "left_anti").take(1):
        raise ValueError("a tree lacks its outgroup")
    rows = trees.join(found, ["dag_id", "node_id"]).join(out, "dag_id").where(F.col("node_id") != F.col("_leaf"))
    rows = persisted(rows.withColumn("_turns", F.col("_at").between(F.col("enter"), F.col("leave"))), "turned")
    lower = rows.where("_turns").select("dag_id", F.col("parent_id").alias("node_id"), F.col("node_id").alias("_child"), F.col("length").alias("_up"))
    rows = rows.join(lower.where("node_id is not null"), ["dag_id", "node_id"], "left")
    top = F.col("node_id") == F.col("_top")
    rows = rows.select(
        "dag_id", "node_id", F.when(top, None).when(F.col("_turns"), F.col("_child")).otherwise(F.col("parent_id")).alias("parent_id"), F.when(F.col("_turns"), F.lit(1 << 30)).otherwise(F.col("clade")).alias("clade"),
        F.when(top, F.col("_name")).otherwise(F.col("label")).alias("label"), F.when(top, F.col("_length")).when(F.col("_turns"), F.col("_up")).otherwise(F.col("length")).alias("length"), (F.col("parent_id").isNull() & ~top).alias("_old"),
    )
    rows = persisted(rows, "turned")
    kids = rows.groupBy("dag_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("_k"))
    goes = rows.where("_old").join(kids, ["dag_id", "node_id"], "left").where("coalesce(_k, 0) < 2").select("dag_id", F.col("node_id").alias("_gone"), F.col("parent_id").alias("_to"), F.col("length").alias("_more"))
    met = rows.join(goes, "dag_id", "left").where(F.col("_gone").isNull() | (F.col("node_id") != F.col("_gone")))
    child = F.col("parent_id").eqNullSafe(F.col("_gone")) & F.col("_gone").isNotNull()
    met = met.select("dag_id", "node_id", F.when(child, F.col("_to")).otherwise(F.col("parent_id")).alias("parent_id"), F.when(child, F.lit(1 << 30)).otherwise(F.col("clade")).alias("clade"), "label", F.when(child, F.col("length") + F.col("_more")).otherwise(F.col("length")).alias("length"))
    order = Window.partitionBy("dag_id", "parent_id").orderBy("clade", "node_id")
    return met.withColumn("clade", (F.row_number().over(order) - 1).cast("int")).select("dag_id", "node_id", "parent_id", "clade", "label", "length")
