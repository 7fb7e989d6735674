"""Weighted (Sankoff) and unit (Fitch) parsimony of a tree, site by site, with ancestral states.

A row is a (node, site); its four costs are columns, so that a level of the tree is one join and one sum. Only sites at which
some mutation occurs are looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions import bases as B
from arbora.model import Dag
from arbora.operators import graph
from arbora.operators.weights import mutation_rows
from arbora.session import persisted

KEY = graph.KEY
BASES = "ACGT"
INFINITE = float("inf")
#: Sites that are broadcast to the leaves; parts that a DAG's leaves are dealt out over where there are more.
FEW_SITES, SALTS = 200_000, 64


def uniform() -> list[list[float]]:
    return [[float(i != j) for j in range(4)] for i in range(4)]


def variable_sites(dag: Dag) -> DataFrame:
    """dag_id, pos."""
    return mutation_rows(dag).select("dag_id", "pos").distinct()


def cost_table(spark: SparkSession, sites: DataFrame, matrix: list[list[float]] | None = None, by_site: dict[int, list[list[float]]] | None = None) -> DataFrame:
    """dag_id, pos, m (16 costs, row by row): one matrix for all sites, or the site's own, or 0 and 1."""
    flat = lambda m: F.array(*[F.lit(float(x)) for row in m for x in row])
    if matrix is not None or not by_site:
        return sites.select("dag_id", "pos", flat(matrix or uniform()).alias("m"))
    own = spark.createDataFrame([(p, [float(x) for row in m for x in row]) for p, m in by_site.items()], "pos int, own array<double>")
    return sites.join(F.broadcast(own), "pos", "left").select("dag_id", "pos", F.coalesce("own", flat(uniform())).alias("m"))


def _leaf_states(dag: Dag, sites: DataFrame) -> DataFrame:
    """dag_id, node_id, pos, mask of each leaf at each variable site."""
    leaf = graph.leaves(dag)
    own = leaf.select(*KEY, F.explode("genome").alias("g")).select(*KEY, "g.pos", "g.base")
    base = F.coalesce("base", F.substring(dag.reference_column(), F.col("pos"), F.lit(1)))
    # A DAG is one key: its sites go to every task if they are few, and else to as many parts as its leaves are dealt out over.
    if sites.count() <= FEW_SITES:
        met = leaf.select(*KEY).join(F.broadcast(sites), "dag_id")
    else:
        part = F.pmod(F.xxhash64("node_id"), F.lit(SALTS)).cast("int")
        met = leaf.select(*KEY, part.alias("_part")).join(sites.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["dag_id", "_part"])
    return met.join(own, [*KEY, "pos"], "left").select(*KEY, "pos", B.mask(base).alias("mask"))


def _least(costs: list[Column]) -> Column:
    return F.least(*costs)


def costs(dag: Dag, sites: DataFrame, table: DataFrame) -> DataFrame:
    """dag_id, node_id, pos, c0..c3: the least cost below the node if it has A, C, G, T. The DAG must hold trees only."""
    if graph.is_tree(dag).where("not is_tree").take(1):
        raise ValueError("Sankoff costs are defined on trees")
    high = persisted(graph.heights(dag), "heights")
    edges = persisted(dag.edges.select("dag_id", "parent_id", "child_id").join(high.select("dag_id", F.col("node_id").alias("parent_id"), "height"), ["dag_id", "parent_id"]), "by-height")
    leaf = _leaf_states(dag, sites).select(*KEY, "pos", *[F.when(F.col("mask").bitwiseAND(1 << b) != 0, 0.0).otherwise(INFINITE).alias(f"c{b}") for b in range(4)])
    done = persisted(leaf, "costs0")
    for h in range(1, (high.agg(F.max("height")).first()[0] or 0) + 1):
        met = edges.where(F.col("height") == h).join(done.withColumnRenamed("node_id", "child_id"), ["dag_id", "child_id"]).join(table, ["dag_id", "pos"])
        up = [F.sum(_least([F.col("m")[4 * p + b] + F.col(f"c{b}") for b in range(4)])).alias(f"c{p}") for p in range(4)]
        done = done.unionByName(persisted(met.groupBy("dag_id", F.col("parent_id").alias("node_id"), "pos").agg(*up), f"costs{h}"))
    return done


def site_scores(dag: Dag, below: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """dag_id, pos, score: the least cost at the UA; sites without a finite one are left out."""
    top = graph.roots(dag).select(*KEY).join(below, KEY)
    return top.select("dag_id", "pos", _least([F.col(f"c{b}") for b in range(4)]).alias("score")).where(F.col("score") < INFINITE)


def reconstruction(dag: Dag, below: DataFrame, table: DataFrame) -> DataFrame:
    """dag_id, node_id, pos, base: states of least cost, top-down; of equal ones the first of A, C, G, T."""

    def first(cost: list[Column]) -> Column:
        return reduce(lambda rest, b: F.when(cost[b] == _least(cost), b).otherwise(rest), reversed(range(4)), F.lit(3))

    high = persisted(graph.heights(dag), "heights")
    own = [F.col(f"c{b}") for b in range(4)]
    done = persisted(graph.roots(dag).select(*KEY).join(below, KEY).select(*KEY, "pos", first(own).alias("state")), "states")
    out = done
    edges = dag.edges.select("dag_id", "parent_id", "child_id")
    for _ in range(high.agg(F.max("height")).first()[0] or 0):
        met = done.withColumnRenamed("node_id", "parent_id").join(edges, ["dag_id", "parent_id"]).join(below.withColumnRenamed("node_id", "child_id"), ["dag_id", "child_id", "pos"]).join(table, ["dag_id", "pos"])
        move = [F.element_at("m", F.col("state") * 4 + b + 1) + own[b] for b in range(4)]
        done = persisted(met.select("dag_id", F.col("child_id").alias("node_id"), "pos", first(move).alias("state")), "states")
        out = out.unionByName(done)
    return out.select(*KEY, "pos", B.decode(F.col("state")).alias("base"))


def fitch_sets(dag: Dag, sites: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """dag_id, node_id, pos, mask, steps: the bases that most children's sets hold (all of them: the intersection), and the changes below.

    For two children this is the intersection, or the union where there is none; for more the majority rule.
    states: dag_id, node_id, pos, mask, n of the leaves, if known; a row stands for n leaves, and so the result has n too.
    """
    high = persisted(graph.heights(dag), "heights")
    edges = persisted(dag.edges.select("dag_id", "parent_id", "child_id").join(high.select("dag_id", F.col("node_id").alias("parent_id"), "height"), ["dag_id", "parent_id"]), "by-height")
    leaf = _leaf_states(dag, sites) if states is None else states
    done = persisted(leaf.withColumn("steps", F.lit(0).cast("bigint")), "fitch0")
    one, own = (F.lit(1), []) if states is None else (F.col("n"), [F.lit(1).cast("bigint").alias("n")])
    for h in range(1, (high.agg(F.max("height")).first()[0] or 0) + 1):
        met = edges.where(F.col("height") == h).join(done.withColumnRenamed("node_id", "child_id"), ["dag_id", "child_id"])
        n = [F.sum((F.col("mask").bitwiseAND(1 << b) != 0).cast("bigint") * one).alias(f"n{b}") for b in range(4)]
        counted = met.groupBy("dag_id", F.col("parent_id").alias("node_id"), "pos").agg(*n, F.sum(one).alias("k"), F.sum("steps").alias("steps"))
        most = F.greatest(*[F.col(f"n{b}") for b in range(4)])
        bits = reduce(lambda a, b: a + b, [F.when(F.col(f"n{b}") == most, 1 << b).otherwise(0) for b in range(4)])
        done = done.unionByName(persisted(counted.select(*KEY, "pos", bits.cast("int").alias("mask"), *own, (F.col("steps") + F.col("k") - most).alias("steps")), f"fitch{h}"))
    return done


def fitch_choice(mask: Column, parent: Column, old: Column | None = None) -> Column:
    """A base of the set: the parent's if it is in it, else the old one, else the first."""
    out = B.first_base(mask)
    if old is not None:
        out = F.when(mask.bitwiseAND(old) != 0, mask.bitwiseAND(old)).otherwise(out)
    return F.when(mask.bitwiseAND(parent) != 0, parent).otherwise(out)


def fitch_states(dag: Dag, sets: DataFrame) -> DataFrame:
    """dag_id, node_id, pos, mask: one base for each node, top-down by fitch_choice; the UA has the reference's."""
    base = B.mask(F.substring(dag.reference_column(), F.col("pos"), F.lit(1)))
    done = persisted(graph.roots(dag).select(*KEY).join(sets, KEY).select(*KEY, "pos", base.alias("mask")), "fitch-states")
    out = done
    while True:
        met = done.select("dag_id", F.col("node_id").alias("parent_id"), "pos", F.col("mask").alias("_p")).join(dag.edges, ["dag_id", "parent_id"]).join(sets.select("dag_id", F.col("node_id").alias("child_id"), "pos", "mask"), ["dag_id", "child_id", "pos"])
        done = persisted(met.select("dag_id", F.col("child_id").alias("node_id"), "pos", fitch_choice(F.col("mask"), F.col("_p")).alias("mask")), "fitch-states")
        if not done.take(1):
            return out
        out = out.unionByName(done)


def with_states(dag: Dag, states: DataFrame) -> Dag:
    """Genomes of inner nodes replaced by states (dag_id, node_id, pos, base); leaves and sites without a state stay."""
    inner = dag.edges.select("dag_id", F.col("parent_id").alias("node_id")).distinct().withColumn("_inner", F.lit(True))
    found = states.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("pos", "base"))).alias("_s"))
    from arbora.functions import genomes as G

    new = G.without_reference(G.upsert(F.col("genome"), F.col("_s")), dag.reference_column())
    nodes = dag.nodes.join(inner, KEY, "left").join(found, KEY, "left")
    return dag.replace(nodes.select("dag_id", "node_id", "sample_id", F.when(F.col("_inner") & F.col("_s").isNotNull(), new).otherwise(F.col("genome")).alias("genome")))


# Sparse: of sites at which most leaves have the reference's base only the nodes that differ are rows.


def _above(dag: Dag, heights: DataFrame) -> DataFrame:
    """dag_id, node_id, height; parent_id, its height (up) and number of children (k), of nodes that have a parent."""
    k = dag.edges.groupBy("dag_id", "parent_id").agg(F.count("*").cast("int").alias("k"))
    up = heights.where("height > 0").select("dag_id", F.col("node_id").alias("parent_id"), F.col("height").alias("up"))
    own = dag.edges.select("dag_id", "parent_id", F.col("child_id").alias("node_id"))
    return persisted(heights.hint("merge").join(own.join(k, ["dag_id", "parent_id"]).join(up, ["dag_id", "parent_id"]).hint("merge"), KEY, "left"), "above")


def _called(dag: Dag, variants: DataFrame, above: DataFrame) -> DataFrame:
    """The leaves' rows of above with pos and base, of the variants. By a merge: there are many rows a sample, which Spark takes for as few bytes as those that they were made of."""
    leaf = dag.nodes.select(*KEY, "sample_id").join(above.where("height = 0").hint("merge"), KEY)
    return persisted(leaf.join(variants.select("sample_id", "pos", F.upper("base").alias("base")).hint("merge"), "sample_id").drop("sample_id"), "called")


def sparse_sets(dag: Dag, variants: DataFrame, heights: DataFrame | None = None, above: DataFrame | None = None, called: DataFrame | None = None) -> DataFrame:
    """dag_id, node_id, height, pos, mask, steps: Fitch sets of trees whose leaves have the reference's base but for variants (sample_id, pos, base, ambiguous ones too).

    A row is a node whose set is not the reference's base alone, or that has changes of its own (steps); the children of a node that have no row count as
    so many with the reference's base. So a site costs the nodes above its variants, not the tree. A row knows its parent, so that a level reads its children alone.
    """
    high = persisted(graph.heights(dag), "heights") if heights is None else heights
    reference = B.mask(F.substring(dag.reference_column(), F.col("pos"), F.lit(1)))
    above = _above(dag, high) if above is None else above
    called = _called(dag, variants, above) if called is None else called
    own = ["parent_id", "up", "k"]
    done = called.select(*KEY, "height", "pos", B.mask(F.col("base")).alias("mask"), F.lit(0).alias("steps"), *own).where(F.col("mask") != reference)
    for h in range(1, (high.agg(F.max("height")).first()[0] or 0) + 1):
        met = done.where((F.col("up") == h) & (F.col("mask") != reference))
        n = [F.sum((F.col("mask").bitwiseAND(1 << b) != 0).cast("int")).alias(f"n{b}") for b in range(4)]
        counted = met.groupBy("dag_id", F.col("parent_id").alias("node_id"), "pos").agg(*n, F.count("*").alias("met"), F.first("k").alias("_k"))
        rest = F.col("_k") - F.col("met")
        counted = counted.withColumns({f"n{b}": F.col(f"n{b}") + F.when(reference.bitwiseAND(1 << b) != 0, rest).otherwise(0) for b in range(4)})
        most = F.greatest(*[F.col(f"n{b}") for b in range(4)])
        bits = reduce(lambda a, b: a + b, [F.when(F.col(f"n{b}") == most, 1 << b).otherwise(0) for b in range(4)])
        level = counted.select(*KEY, "pos", bits.cast("int").alias("mask"), (F.col("_k") - most).cast("int").alias("steps")).where((F.col("mask") != reference) | (F.col("steps") > 0))
        done = done.unionByName(persisted(level.join(above.where(F.col("height") == h), KEY), f"sparse{h}"))
    return done.drop(*own)


def sparse_states(dag: Dag, sets: DataFrame) -> DataFrame:
    """dag_id, node_id, pos, mask: the base of each node that is not the reference's, top-down by fitch_choice; leaves of ambiguous bases included."""
    reference = B.mask(F.substring(dag.reference_column(), F.col("pos"), F.lit(1)))
    ua = graph.roots(dag).select(*KEY)
    open_ = persisted(sets.where(F.col("mask") != reference).join(ua, KEY, "left_anti").join(dag.edges.select("dag_id", F.col("child_id").alias("node_id"), "parent_id").hint("merge"), KEY), "open")
    out = None
    for h in range(open_.agg(F.max("height")).first()[0] if open_.take(1) else -1, -1, -1):
        met = open_.where(F.col("height") == h)
        parent = F.col("_p")
        if out is None:
            met = met.withColumn("_p", reference)
        else:
            met = met.join(out.select("dag_id", F.col("node_id").alias("parent_id"), "pos", F.col("mask").alias("_p")), ["dag_id", "parent_id", "pos"], "left").withColumn("_p", F.coalesce("_p", reference))
        level = met.select(*KEY, "pos", fitch_choice(F.col("mask"), parent).cast("int").alias("mask")).where(F.col("mask") != reference)
        level = persisted(level, "sparse-states")
        out = level if out is None else out.unionByName(level)
    return sets.select(*KEY, "pos", "mask").limit(0) if out is None else out


def variant_genomes(dag: Dag, variants: DataFrame, resolved: bool = False) -> tuple[Dag, DataFrame]:
    """The trees with the genomes of variants (sample_id, pos, base) at their leaves and the fewest mutations above; and dag_id, pos, steps of every site with changes.

    resolved: leaves of ambiguous bases take the base that fits their parent, if any does, instead of keeping theirs.
    """
    from arbora.functions import genomes as G

    heights = persisted(graph.heights(dag), "heights")
    above = _above(dag, heights)
    called = _called(dag, variants, above)
    sets = sparse_sets(dag, variants, heights, above, called)
    inner = sets.where("height > 0")
    states = sparse_states(dag, sets if resolved else inner)
    found = states.select(*KEY, "pos", B.letter(F.col("mask")).alias("base"))
    if not resolved:
        found = found.unionByName(called.select(*KEY, "pos", "base").where(F.col("base") != F.substring(dag.reference_column(), F.col("pos"), F.lit(1))))
    genomes = found.groupBy(*KEY).agg(F.array_sort(F.collect_list(G.entry(F.col("pos"), F.col("base")))).alias("_g"))
    nodes = dag.nodes.join(genomes.hint("merge"), KEY, "left").select("dag_id", "node_id", "sample_id", F.coalesce("_g", G.empty()).alias("genome"))
    reference = B.mask(F.substring(dag.reference_column(), F.col("pos"), F.lit(1)))
    top = graph.roots(dag).select(*KEY, F.lit(True).alias("_top"))
    changes = inner.join(top, KEY, "left").withColumn("n", F.col("steps") + F.when(F.col("_top") & (F.col("mask").bitwiseAND(reference) == 0), 1).otherwise(0))
    return dag.replace(nodes), changes.groupBy("dag_id", "pos").agg(F.sum("n").alias("steps")).where("steps > 0")
