"""Scores of tree moves as tables: what a move changes, followed upwards until nothing changes.

Of every inner node and site it is known how many children hold each base. A move takes a child from one node and gives another node a changed child:
signed differences of these counts. Where they change a node's set of bases, the difference of its own set goes on to its parent, and so on. The
two ways up meet where they reach the same node: differences are keyed by (move, node, site) and summed, and a move's rows are dealt with in order of their
distance from its lowest changed node, so that both have arrived. Most sites stop after a step or two; no tree is ever copied or held in one place.

What a site adds to a move depends on where the move's ends hang and on their bases there. So the leaves of a node are scored as one (move_ranges): once for
each site and base that they have, whatever their number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.functions import bases as B
from arbora.model import Dag
from arbora.operators import graph, sankoff
from arbora.operators import index as I
from arbora.operators.weights import parsimony_weights
from arbora.session import persisted

KEY = graph.KEY
MOVE = ["dag_id", "src", "dst"]
#: Sites in a row of a node's profile.
BLOCK = 256
COUNTS = [f"n{b}" for b in range(4)]
DELTAS = [f"d{b}" for b in range(4)]


def scores(dag: Dag) -> DataFrame:
    """dag_id, score: the number of mutations of each tree."""
    return parsimony_weights(dag).groupBy("dag_id").agg(F.sum("edge").alias("score"))


def _bit(mask: Column, b: int) -> Column:
    return F.shiftright(mask, b).bitwiseAND(F.lit(1))


def _most(n: list[Column]) -> Column:
    return F.greatest(*n)


def _majority(n: list[Column]) -> Column:
    """The bases that most children hold."""
    return reduce(lambda a, b: a + b, [F.when(x == _most(n), 1 << b).otherwise(0) for b, x in enumerate(n)])


def _pair(a: Column, b: Column) -> Column:
    """Set of a node of two children."""
    both = a.bitwiseAND(b)
    return F.when(both != 0, both).otherwise(a.bitwiseOR(b))


def _apart(a: Column, b: Column) -> Column:
    return (a.bitwiseAND(b) == 0).cast("int")


def site_counts(dag: Dag, sets: DataFrame) -> DataFrame:
    """dag_id, node_id, pos, n0..n3 (children that hold each base), k (children), mask, and ref, the reference's base, at the UA alone.

    A row of sets stands for n children, if it has that column.
    """
    child = sets.select("dag_id", F.col("node_id").alias("child_id"), "pos", "mask", (F.col("n") if "n" in sets.columns else F.lit(1)).alias("n"))
    n = [F.sum(_bit(F.col("mask"), b) * F.col("n")).cast("int").alias(f"n{b}") for b in range(4)]
    counted = dag.edges.join(child, ["dag_id", "child_id"]).groupBy("dag_id", F.col("parent_id").alias("node_id"), "pos").agg(*n, F.sum("n").cast("int").alias("k"))
    top = graph.roots(dag).select(*KEY, F.lit(True).alias("_top"))
    reference = B.mask(F.substring(dag.reference_column(), F.col("pos"), F.lit(1)))
    return counted.join(sets.select(*KEY, "pos", "mask"), [*KEY, "pos"]).join(top, KEY, "left").withColumn("ref", F.when(F.col("_top"), reference)).drop("_top")


def fitch_scores(dag: Dag, sets: DataFrame) -> DataFrame:
    """dag_id, fitch: the fewest mutations of each tree, the one from the reference included."""
    reference = B.mask(F.substring(dag.reference_column(), F.col("pos"), F.lit(1)))
    top = graph.roots(dag).select(*KEY).join(sets, KEY)
    return top.groupBy("dag_id").agg(F.sum(F.col("steps") + _apart(F.col("mask"), reference)).alias("fitch"))


def _profile(rows: DataFrame, node: str, fields: list[str]) -> DataFrame:
    """dag_id, <node>, block, <node>_sites: the fields of a node by site, in order, in blocks of BLOCK sites."""
    by = [F.col("node_id").alias(node), F.floor(F.col("pos") / BLOCK).alias("block")]
    return rows.groupBy("dag_id", *by).agg(F.array_sort(F.collect_list(F.struct("pos", *fields))).alias(f"{node}_sites"))


HEAD = [*MOVE, "p", "q", "p_up", "q_up", "p_depth", "q_depth", "dst_depth", "above", "same", "p_waits", "q_waits", "low"]


def _placed(index: I.TreeIndex, moves: DataFrame) -> DataFrame:
    """A row for each move: how src, dst and their parents p and q lie to each other.

    above: dst is above src. p_waits (q_waits): p (q) is above the other parent, whose change may reach it. low: the depth of the lower parent.
    """
    m = moves.select(*MOVE).join(index.side("src", "parent_id", "enter"), ["dag_id", "src"]).join(index.side("dst", "parent_id", "enter", "leave", "depth"), ["dag_id", "dst"])
    m = m.withColumnRenamed("src_parent_id", "p").withColumnRenamed("dst_parent_id", "q")
    for side in "pq":
        m = m.join(index.side(side, "parent_id", "enter", "leave", "depth"), ["dag_id", side])
    above = I.over("dst", "src")
    return m.select(
        *MOVE, "p", "q", F.col("p_parent_id").alias("p_up"), F.col("q_parent_id").alias("q_up"), "p_depth", "q_depth", "dst_depth", above.alias("above"), (F.col("p") == F.col("q")).alias("same"),
        (~above & I.over("p", "q")).alias("p_waits"), (~above & I.over("q", "p")).alias("q_waits"), F.when(above, F.col("p_depth")).otherwise(F.greatest("p_depth", "q_depth")).alias("low"),
    )


def _met(index: I.TreeIndex, moves: DataFrame, sets: DataFrame, counts: DataFrame) -> DataFrame:
    """A row for each move and block of sites: _placed(), and what the four nodes are at each site."""
    m = _placed(index, moves)
    m = m.join(_profile(sets, "src", ["mask"]), ["dag_id", "src"])
    for node, table, fields in (("dst", sets, ["mask"]), ("p", counts, ["mask", "k", *COUNTS]), ("q", counts, ["mask", "k", *COUNTS])):
        m = m.join(_profile(table, node, fields), ["dag_id", node, "block"])
    return m


def _row(node: Column, deltas: list[Column], gone: int, moving: Column, rel: Column) -> Column:
    return F.struct(node.alias("node_id"), *[d.cast("int").alias(f"d{b}") for b, d in enumerate(deltas)], F.lit(gone).alias("dk"), moving.cast("int").alias("moving"), rel.cast("int").alias("rel"))


def _by_site(met: DataFrame) -> DataFrame:
    """_met() by site: HEAD, pos, and the masks and counts of the four nodes there."""
    sides = ["src", "dst", "p", "q"]
    s = met.select(*HEAD, F.inline(F.arrays_zip(*[f"{x}_sites" for x in sides])))
    fields = {f"{x}_mask": F.col(f"{x}_sites.mask") for x in sides} | {f"{x}_{f}": F.col(f"{x}_sites.{f}") for x in "pq" for f in ("k", *COUNTS)}
    return s.select(*HEAD, F.col("src_sites.pos").alias("pos"), *[c.alias(n) for n, c in fields.items()])


def _first(s: DataFrame, key: list[str]) -> DataFrame:
    """key, pos, delta (of the score, at this site, as far as it is certain), up: the differences that arrive at further nodes. s: as _by_site() makes it."""
    col, none = F.col, F.lit(None).cast("int")
    s = s.withColumn("pair", _pair(col("src_mask"), col("dst_mask")))
    swap = [_bit(col("pair"), b) - _bit(col("dst_mask"), b) for b in range(4)]
    left = [-_bit(col("src_mask"), b) for b in range(4)]
    s = s.withColumns({f"p_m{b}": col(f"p_n{b}") + left[b] + F.when(col("same"), swap[b]).otherwise(0) for b in range(4)} | {f"q_m{b}": col(f"q_n{b}") + swap[b] for b in range(4)})
    new = {x: [col(f"{x}_m{b}") for b in range(4)] for x in "pq"}
    old = {x: [col(f"{x}_n{b}") for b in range(4)] for x in "pq"}
    s = s.withColumns({f"{x}_new": _majority(new[x]) for x in "pq"} | {f"{x}_delta": _most(old[x]) - _most(new[x]) - (1 if x == "p" else 0) for x in "pq"})
    on_q = ~col("above") & ~col("same")
    delta = F.when(col("above"), 0).otherwise(_apart(col("src_mask"), col("dst_mask"))) + F.when(col("p_waits"), 0).otherwise(col("p_delta")) + F.when(on_q & ~col("q_waits"), col("q_delta")).otherwise(0)
    changes = {x: col(f"{x}_new") != col(f"{x}_mask") for x in "pq"}
    onward = {x: [_bit(col(f"{x}_new"), b) - _bit(col(f"{x}_mask"), b) for b in range(4)] for x in "pq"}
    zero = [F.lit(0)] * 4
    of_p = F.when(col("p_waits"), F.when(changes["p"] | (col("p_delta") != 0) | changes["q"], _row(col("p"), left, -1, none, col("low") - col("p_depth")))).when(
        changes["p"] & col("p_up").isNotNull(), _row(col("p_up"), onward["p"], 0, none, col("low") - col("p_depth") + 1)
    )
    of_q = (
        F.when(col("above"), F.when(changes["p"] | (col("src_mask") != col("dst_mask")), _row(col("dst"), zero, 0, col("src_mask"), col("low") - col("dst_depth"))))
        .when(col("same"), F.lit(None))
        .when(col("q_waits"), F.when(col("pair") != col("dst_mask"), _row(col("q"), swap, 0, none, col("low") - col("q_depth"))))
        .when(changes["q"] & col("q_up").isNotNull(), _row(col("q_up"), onward["q"], 0, none, col("low") - col("q_depth") + 1))
    )
    return s.select(*key, "pos", delta.alias("delta"), F.array_compact(F.array(of_p, of_q)).alias("up"))


def _next(rows: DataFrame, counts: DataFrame, rel: int, key: list[str]) -> DataFrame:
    """One step up: rows of one key (a move), node and site are summed. key, delta, and the row for the parent: node_id (null where nothing changes further), pos, d0..d3, dk, moving, rel."""
    col = F.col
    arrived = rows.groupBy(*key, "node_id", "pos").agg(*[F.sum(d).alias(d) for d in (*DELTAS, "dk")], F.max("moving").alias("moving"))
    met = arrived.join(counts, [*KEY, "pos"]).withColumns({f"m{b}": col(f"n{b}") + col(f"d{b}") for b in range(4)})
    new, old = [col(f"m{b}") for b in range(4)], [col(f"n{b}") for b in range(4)]
    met = met.withColumns({"set": _majority(new), "delta": col("dk") + _most(old) - _most(new)})
    # src joins dst, which is above it, now that the set of dst is known.
    met = met.withColumn("out", F.when(col("moving").isNull(), col("set")).otherwise(_pair(col("moving"), col("set"))))
    joined = F.when(col("moving").isNull(), 0).otherwise(_apart(col("moving"), col("set")))
    first = F.when(col("ref").isNull(), 0).otherwise(_apart(col("set"), col("ref")) - _apart(col("mask"), col("ref")))
    onward = [(_bit(col("out"), b) - _bit(col("mask"), b)).cast("int").alias(f"d{b}") for b in range(4)]
    node = F.when(col("out") != col("mask"), col("parent_id")).alias("node_id")
    return met.select(*key, (col("delta") + joined + first).alias("delta"), node, "pos", *onward, F.lit(0).alias("dk"), F.lit(None).cast("int").alias("moving"), F.lit(rel + 1).alias("rel"))


def _followed(first: DataFrame, counts: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """by, delta: what is certain at first, and what the differences add on their ways up."""
    total = lambda df: df.groupBy(*by).agg(F.sum("delta").alias("delta"))
    deltas = persisted(total(first), "delta")
    start = persisted(first.select(*key, "pos", F.explode("up").alias("u")).select(*key, "pos", "u.*"), "differences")
    last, rel, carried = start.agg(F.max("rel")).first()[0] or 0, 1, None
    while rel <= last or (carried is not None and carried.take(1)):
        rows = start.where(F.col("rel") == rel)
        if carried is not None:
            rows = rows.unionByName(carried)
        done = persisted(_next(rows, counts, rel, key), "differences")
        deltas = deltas.unionByName(total(done))
        carried, rel = done.where("node_id is not null").drop("delta"), rel + 1
    return total(deltas)


def move_changes(dag: Dag, moves: DataFrame, index: I.TreeIndex | None = None) -> DataFrame:
    """moves (dag_id, src, dst, distance; as proposals() makes them) with change: what each adds to its tree's score if all genomes are made the best.

    The trees have no node of one child but the UA. An ambiguous base counts as any of its bases.
    """
    index = I.build(dag) if index is None else index
    sets = persisted(sankoff.fitch_sets(dag, persisted(sankoff.variable_sites(dag), "sites")), "sets")
    parents = index.nodes.select(*KEY, "parent_id")
    counts = persisted(site_counts(dag, sets).join(parents, KEY), "site-counts")
    met = persisted(_met(index, moves, sets, counts), "met")
    deltas = _followed(_first(_by_site(met), MOVE), counts, MOVE, MOVE)
    base = fitch_scores(dag, sets).join(scores(dag), "dag_id").select("dag_id", (F.col("fitch") - F.col("score")).alias("base"))
    out = moves.select(*MOVE, "distance").join(deltas, MOVE, "left").join(F.broadcast(base) if base.count() <= 100_000 else base, "dag_id")
    return persisted(out.select(*MOVE, "distance", (F.col("base") + F.coalesce("delta", F.lit(0))).cast("bigint").alias("change")), "changes")
