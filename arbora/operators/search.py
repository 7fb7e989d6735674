"""Tree search by subtree prune and regraft (SPR) moves.

A move takes the subtree at `src` and makes it the sibling of `dst` under a new node. Moves are proposed as rows, scored in tables (scoring.py), and
those that do not touch one another are made together, as deltas of the edge table.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions import bases as B
from arbora.functions import genomes as G
from arbora.model import Dag
from arbora.operators import graph, labels, merge, sampling, sankoff
from arbora.operators import index as I
from arbora.operators.scoring import MOVE, move_changes, scores
from arbora.operators.weights import mutations, optimum, parsimony_weights, trim
from arbora.session import persisted

KEY = graph.KEY


def proposals(dag: Dag, radius: int, index: I.TreeIndex | None = None, most_for_each: int | None = None, seed: int = 0, children: DataFrame | None = None) -> DataFrame:
    """dag_id, src, dst, distance: moves that change the tree, between nodes at most `radius` edges apart.

    Left out: src or dst the UA, src the tree's root, dst below src, src = dst, dst the parent of src, siblings of a binary node. Pairs meet at their
    common ancestors, at most `radius` above both, so the pairs are those within the radius, not all.
    most_for_each: a random choice of that many targets for each src, as the random proposer makes.
    children: dag_id, node_id, n (children), where edges hold a part of them only.
    """
    index = I.build(dag) if index is None else index
    near = persisted(graph.ancestors(dag, radius), "near")
    a = near.select("dag_id", F.col("node_id").alias("src"), "ancestor_id", F.col("distance").alias("d"))
    b = near.select("dag_id", F.col("node_id").alias("dst"), "ancestor_id", F.col("distance").alias("e"))
    pairs = a.where("d > 0").join(b, ["dag_id", "ancestor_id"]).where((F.col("d") + F.col("e") <= radius) & (F.col("src") != F.col("dst")))
    pairs = pairs.groupBy("dag_id", "src", "dst").agg(F.min(F.col("d") + F.col("e")).cast("int").alias("distance"))
    if children is None:
        children = dag.edges.groupBy("dag_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n"))
    n = children.select("dag_id", F.col("node_id").alias("src_parent_id"), F.col("n").alias("_n"))
    out = pairs.join(index.side("src", "parent_id", "enter", "leave", "depth"), ["dag_id", "src"]).join(index.side("dst", "parent_id", "enter", "depth"), ["dag_id", "dst"])
    out = out.where((F.col("src_depth") > 1) & (F.col("dst_depth") > 0) & ~I.over("src", "dst") & (F.col("dst") != F.col("src_parent_id")))
    out = out.join(n, ["dag_id", "src_parent_id"]).where(~((F.col("src_parent_id") == F.col("dst_parent_id")) & (F.col("_n") == 2))).select("dag_id", "src", "dst", "distance")
    if most_for_each is None:
        return out
    turn = Window.partitionBy("dag_id", "src").orderBy(F.xxhash64(F.lit(seed), "src", "dst"), "dst")
    return out.withColumn("_t", F.row_number().over(turn)).where(F.col("_t") <= most_for_each).drop("_t")


def applied(dag: Dag, moves: DataFrame) -> Dag:
    """moves: dag_id, src, dst, copy. The trees named `copy`, each with all moves of that name made at once; moves of one copy touch none of the same nodes.

    The new node's id has the bits of src turned over; a node left with one child is replaced by it.
    """
    copies = moves.select("dag_id", "copy").distinct()
    nodes = dag.nodes.join(copies, "dag_id").select(F.col("copy").alias("dag_id"), "node_id", "sample_id", "genome")
    new = F.bitwise_not("src")
    kept = dag.edges.join(copies, "dag_id").join(moves.select("dag_id", "copy", F.col("src").alias("child_id")), ["dag_id", "copy", "child_id"], "left_anti")
    onto = moves.select("dag_id", "copy", F.col("dst").alias("child_id"), new.alias("_new"))
    edges = kept.join(onto, ["dag_id", "copy", "child_id"], "left").select(F.col("copy").alias("dag_id"), "edge_id", "parent_id", F.coalesce("_new", "child_id").alias("child_id"), "clade")
    two = F.array(F.struct(F.xxhash64("src", F.lit(1)).alias("e"), F.col("dst").alias("c"), F.lit(0).alias("k")), F.struct(F.xxhash64("src", F.lit(2)).alias("e"), F.col("src").alias("c"), F.lit(1).alias("k")))
    added = moves.select(F.col("copy").alias("dag_id"), F.explode(two).alias("x"), new.alias("parent_id"))
    edges = edges.unionByName(added.select("dag_id", F.col("x.e").alias("edge_id"), "parent_id", F.col("x.c").alias("child_id"), F.col("x.k").alias("clade")))
    own = moves.join(dag.nodes.select("dag_id", F.col("node_id").alias("dst"), "genome"), ["dag_id", "dst"]).select(F.col("copy").alias("dag_id"), new.alias("node_id"), F.lit(None).cast("string").alias("sample_id"), "genome")
    out = Dag(nodes.unionByName(own), graph.renumbered(edges), dag.reference)
    return graph.suppressed(out.persisted("moved"))


def moved(dag: Dag, moves: DataFrame) -> Dag:
    """A moved tree for each row of moves (dag_id, src, dst), named dag_id|src|dst: for a few moves, or to try a score of one's own."""
    return applied(dag, moves.select("dag_id", "src", "dst", F.concat_ws("|", "dag_id", "src", "dst").alias("copy")))


def touched(dag: Dag, index: I.TreeIndex, moves: DataFrame, radius: int) -> DataFrame:
    """dag_id, src, dst, node_id, of: the nodes on the way from src (of: src) and from dst (of: dst) up to their common ancestor (of: top); its ends included.

    moves: as proposals() makes them with this radius.
    """
    found = I.lca(index, moves.select("dag_id", F.col("src").alias("a"), F.col("dst").alias("b"))).select("dag_id", F.col("a").alias("src"), F.col("b").alias("dst"), "lca")
    found = found.join(index.side("lca", "depth"), ["dag_id", "lca"])
    near = persisted(graph.ancestors(dag, radius), "near")
    depth = index.nodes.select("dag_id", F.col("node_id").alias("ancestor_id"), "depth")
    near = near.join(depth, ["dag_id", "ancestor_id"])
    ways = [found.join(near.withColumnRenamed("node_id", end), ["dag_id", end]).where(F.col("depth") > F.col("lca_depth")).select("dag_id", "src", "dst", F.col("ancestor_id").alias("node_id"), F.lit(end).alias("of")) for end in ("src", "dst")]
    return ways[0].unionByName(ways[1]).unionByName(found.select("dag_id", "src", "dst", F.col("lca").alias("node_id"), F.lit("top").alias("of")))


def independent(ways: DataFrame, scored: DataFrame, copies: int = 4, rounds: int = 3) -> DataFrame:
    """dag_id, src, dst, copy: moves of scored (dag_id, src, dst, rank; the smallest first) such that those of one copy have no node of ways in common.

    In each round the moves that are first at all of their nodes are taken, and those that share a node with one of them wait for the next copy.
    """
    rank = F.struct("rank", F.xxhash64("src", "dst").alias("h"), "src", "dst")
    left = persisted(ways.select(*MOVE, "node_id").join(scored.select(*MOVE, rank.alias("rank")), MOVE), "ways")
    out = None
    for copy in range(copies):
        open_ = left
        for _ in range(rounds):
            first = open_.groupBy("dag_id", "node_id").agg(F.min("rank").alias("first"))
            won = open_.join(first, KEY).groupBy(*MOVE).agg(F.every(F.col("rank") == F.col("first")).alias("won")).where("won")
            won = persisted(won.select(*MOVE), "won")
            if not won.take(1):
                break
            taken = won.withColumn("copy", F.concat_ws("|", "dag_id", F.lit(str(copy))))
            out = taken if out is None else out.unionByName(taken)
            nodes = open_.join(won, MOVE, "left_semi").select(*KEY).distinct()
            hit = open_.join(nodes, KEY, "left_semi").select(*MOVE).distinct()
            open_ = persisted(open_.join(hit, MOVE, "left_anti"), "ways")
        if out is None:
            return scored.select(*MOVE, F.lit("").alias("copy")).limit(0)
        left = persisted(left.join(out.select(*MOVE), MOVE, "left_anti"), "ways")
        if not left.take(1):
            break
    return out


def novel_sets(dag: Dag, ways: DataFrame, known: DataFrame) -> DataFrame:
    """dag_id, src, dst, novel: how many leaf sets of the moved tree known (leafset_key) lacks. Keys of sets are sums, so that nodes on the way lose or gain src's."""
    keys = persisted(labels.leaf_keys(dag), "keys")
    own = lambda name, node: keys.select("dag_id", F.col("node_id").alias(node), F.col("key").alias(name))
    met = ways.join(own("key", "node_id"), KEY).join(own("_src", "src"), ["dag_id", "src"])
    top_is_dst = (F.col("of") == "top") & (F.col("node_id") == F.col("dst"))
    loses = (F.col("of") == "src") & (F.col("node_id") != F.col("src")) | top_is_dst
    sign = F.when(loses, -1).when(F.col("of") == "dst", 1)
    key = F.struct((F.col("key.n") + sign * F.col("_src.n")).alias("n"), F.col("key.x").bitwiseXOR(F.col("_src.x")).alias("x"), F.col("key.y").bitwiseXOR(F.col("_src.y")).alias("y"))
    new = met.where(sign.isNotNull()).select(*MOVE, labels.key_text(key).alias("leafset_key")).distinct()
    return new.join(known.select("leafset_key").distinct(), "leafset_key", "left_anti").groupBy(*MOVE).agg(F.count("*").alias("novel"))


def rescored(dag: Dag) -> Dag:
    """Inner genomes of trees by Fitch's method: the fewest mutations for the leaves' genomes."""
    sites = persisted(sankoff.variable_sites(dag), "sites")
    states = sankoff.fitch_states(dag, sankoff.fitch_sets(dag, sites))
    return sankoff.with_states(dag, states.select(*KEY, "pos", B.letter(F.col("mask")).alias("base")))


def changed_nodes(old: Dag, new: Dag) -> DataFrame:
    """dag_id, node_id of moved trees (dag_id|src|dst) whose genome or children are not what they were."""
    kids = lambda d, i: d.edges.groupBy("dag_id", "parent_id").agg(F.array_sort(F.collect_set("child_id")).alias(i)).withColumnRenamed("parent_id", "node_id")
    before = old.nodes.join(kids(old, "k"), KEY, "left").select(F.col("dag_id").alias("_of"), "node_id", G.text(F.col("genome")).alias("_g"), F.col("k").alias("_k"))
    after = new.nodes.join(kids(new, "k"), KEY, "left").select("dag_id", F.regexp_replace("dag_id", r"\|[^|]*\|[^|]*$", "").alias("_of"), "node_id", G.text(F.col("genome")).alias("g"), "k")
    met = after.join(before, ["_of", "node_id"], "left")
    return met.where(~(F.col("g").eqNullSafe(F.col("_g")) & F.col("k").eqNullSafe(F.col("_k")))).select(*KEY)


def collapsed(dag: Dag, keep: DataFrame | None = None) -> Dag:
    """Inner nodes with their parent's genome are dropped and their children go to the parent; leaves, the UA's children and `keep` stay."""
    empty = mutations(dag).where("size(muts) = 0").select("dag_id", F.col("child_id").alias("node_id"))
    stay = graph.kinds(dag).where("is_leaf or is_tree_root or is_ua").select(*KEY)
    gone = empty.join(stay, KEY, "left_anti")
    if keep is not None:
        gone = gone.join(keep, KEY, "left_anti")
    gone = persisted(gone.distinct(), "empty")
    up = persisted(dag.edges.join(gone.withColumnRenamed("node_id", "child_id"), ["dag_id", "child_id"], "left_semi").select("dag_id", F.col("child_id").alias("node_id"), F.col("parent_id").alias("up")), "up")
    edges = dag.edges.join(gone.withColumnRenamed("node_id", "child_id"), ["dag_id", "child_id"], "left_anti")
    while True:
        met = edges.join(up.withColumnRenamed("node_id", "parent_id"), ["dag_id", "parent_id"], "left")
        if not met.where("up is not null").take(1):
            break
        edges = persisted(met.select("dag_id", "edge_id", F.coalesce("up", "parent_id").alias("parent_id"), "child_id", "clade"), "collapsed")
    order = Window.partitionBy("dag_id", "parent_id").orderBy("clade", "child_id")
    edges = edges.withColumn("clade", (F.row_number().over(order) - 1).cast("int")).select(*dag.edges.columns)
    return dag.replace(dag.nodes.join(gone, KEY, "left_anti"), edges)


def move_fragment(old: Dag, new: Dag) -> Dag:
    """Of each moved tree the changed nodes and those one edge from them: what a merge has to see."""
    core = persisted(changed_nodes(old, new), "changed")
    out = core
    for a, b in (("parent_id", "child_id"), ("child_id", "parent_id")):
        out = out.unionByName(new.edges.join(core.withColumnRenamed("node_id", a), ["dag_id", a], "left_semi").select("dag_id", F.col(b).alias("node_id")))
    return graph.fragment(new, out.distinct())


@dataclass(frozen=True)
class Policy:
    """Which scored moves are merged, and which is applied to the tree; `all`: every move, `best`: none worse than the tree's,
    `coefficients`: by parsimony_coefficient * change - node_coefficient * (novel leaf sets)."""

    kind: str = "best"
    parsimony_coefficient: int = 1
    node_coefficient: int = 1

    def score(self) -> Column:
        if self.kind == "coefficients":
            return self.parsimony_coefficient * F.col("change") - self.node_coefficient * F.col("novel")
        return F.col("change")

    def accepted(self) -> Column:
        return F.lit(True) if self.kind == "all" else self.score() <= 0


def scored_moves(dag: Dag, moves: DataFrame, known: DataFrame | None = None, score: Callable[[Dag], DataFrame] = scores) -> tuple[DataFrame, Dag]:
    """moves with change (of the score) and novel (leaf sets that known, leafset_key, lacks); and the moved trees, rescored."""
    trees = rescored(moved(dag, moves)).persisted("moves")
    new = score(trees).withColumnRenamed("score", "_new").withColumnRenamed("dag_id", "_id")
    named = moves.withColumn("_id", F.concat_ws("|", "dag_id", "src", "dst")).join(new, "_id").join(score(dag).withColumnRenamed("score", "_old"), "dag_id")
    out = named.withColumn("change", F.col("_new") - F.col("_old"))
    if known is None:
        out = out.withColumn("novel", F.lit(0).cast("bigint"))
    else:
        sets = labels.leaf_sets(trees)
        fresh = labels.novel_leafsets(sets, known).groupBy(F.col("dag_id").alias("_id")).agg(F.countDistinct("leafset_key").alias("_novel"))
        out = out.join(fresh, "_id", "left").withColumn("novel", F.coalesce("_novel", F.lit(0)).cast("bigint"))
    return persisted(out.select("dag_id", "src", "dst", "distance", F.col("_id").alias("moved_id"), "change", "novel"), "scored"), trees


def optimise(dag: Dag, rounds: int = 3, radius: int = 4, seed: int = 0, policy: Policy | None = None, moves_for_each: int | None = 4, patience: int = 2, trim_at_end: bool = False, on_round: Callable[[dict], None] | None = None, copies: int = 4, statistics: Callable[[Dag], dict] | None = None) -> tuple[merge.Merged, list[dict]]:
    """Sample a best tree, propose and score moves, merge trees with those accepted, again and again. Returns the DAG and a row of statistics for each round.

    Moves are scored in tables, without moved trees. Those accepted are made together, best first, in `copies` trees, each with moves that
    do not touch one another; these trees are given their best genomes, collapsed and merged.
    dag: a collection of trees (merged first). on_round sees each row as it is made. statistics: more of a row, from the merged DAG.
    """
    policy = policy or Policy()
    began = time.time()
    have = merge.merge(dag)
    log, still, best = [], 0, None
    for k in range(rounds):
        weights = persisted(parsimony_weights(have.dag), "weights")
        tree = sampling.best_sample_tree(have.dag, weights, seed + k).persisted("sampled")
        tree = graph.suppressed(tree)
        tree = tree.replace(edges=persisted(graph.renumbered(tree.edges), "sampled"))
        index = I.build(tree)
        moves = persisted(proposals(tree, radius, index, moves_for_each, seed + k), "proposals")
        scored = move_changes(tree, moves, index)
        ways = persisted(touched(tree, index, moves, radius), "touched")
        novel = novel_sets(tree, ways, have.labels) if policy.kind == "coefficients" else None
        scored = scored.withColumn("novel", F.lit(0).cast("bigint")) if novel is None else scored.join(novel, MOVE, "left").fillna(0, "novel")
        accepted = persisted(scored.where(policy.accepted()).withColumn("rank", policy.score()), "accepted")
        chosen = persisted(independent(ways.join(accepted.select(*MOVE), MOVE, "left_semi"), accepted, copies), "chosen")
        if chosen.take(1):
            have = merge.add(have, collapsed(rescored(applied(tree, chosen)).persisted("applied")).persisted("chosen"))
        low = graph.roots(have.dag).select(*KEY).join(optimum(have.dag, persisted(parsimony_weights(have.dag), "weights")), KEY).first()["weight"]
        row = {"iteration": k + 1, "nodes": have.dag.nodes.count(), "edges": have.dag.edges.count(), "moves": scored.count(), "accepted": accepted.count(), "applied": chosen.count(), "parsimony": int(low), **(statistics(have.dag) if statistics else {}), "seconds": round(time.time() - began, 1)}
        log.append(row)
        if on_round:
            on_round(row)
        still = still + 1 if best is not None and low >= best else 0
        best = low if best is None else min(best, low)
        if still >= patience:
            break
    if trim_at_end:
        have = merge.merge(trim(have.dag, persisted(parsimony_weights(have.dag), "weights")))
    return have, log
