"""Every registered query over the adapter's DAGs, and the SQL it must agree with, written from the base tables alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.functions import bases as B
from arbora.functions import genomes as G
from arbora.functions import likelihood as J
from arbora.functions import numbers as N
from arbora.model import Dag
from arbora.operators import distances, graph, index, labels, ranges, sampling, sankoff, search
from arbora.operators import merge as M
from arbora.operators import weights as W
from arbora.plans import adapter
from arbora.session import load, persisted
from arbora.sources import newick, sequences

TRANSITIONS = [[0, 2, 1, 2], [2, 0, 2, 1], [1, 2, 0, 2], [2, 1, 2, 0]]


class Case:
    """The merged DAG of a folder and what several queries need of it, each written once."""

    def __init__(self, spark: SparkSession, sf_dir: str, where: str | None = None):
        self.key = (sf_dir, where)
        self.spark = spark
        self.merged = adapter.merged(spark, sf_dir, where)
        self.dag = self.merged.dag

    def _once(self, name: str, make) -> DataFrame:
        return adapter._once(self.spark, (name, *self.key), lambda: persisted(make(), name))

    @property
    def heights(self) -> DataFrame:
        return self._once("heights", lambda: graph.heights(self.dag))

    @property
    def parsimony(self) -> DataFrame:
        return self._once("parsimony", lambda: W.parsimony_weights(self.dag))

    @property
    def sets(self) -> DataFrame:
        return self.merged.labels.select(F.lit("merged").alias("dag_id"), "node_id", "leafset_key", "n_leaves")

    @property
    def counts(self) -> DataFrame:
        return self._once("counts", lambda: distances.leafset_counts(self.dag, self.sets, self.heights))

    def root(self, weights: DataFrame) -> DataFrame:
        return W.at_root(self.dag, weights)

    def n_trees(self) -> int:
        return int(self.root(W.tree_counts(self.dag, heights=self.heights)).first()["weight"])


def tree_count(spark, d):
    c = Case(spark, d)
    return c.root(W.tree_counts(c.dag, heights=c.heights)).select(F.col("weight").cast("string").alias("trees"))


def tree_count_exact(spark, d):
    c = Case(spark, d)
    return c.root(W.tree_counts(c.dag, exact=True, heights=c.heights)).select(F.col("weight").alias("trees"))


def _kind(df: DataFrame) -> DataFrame:
    return df.withColumn("kind", F.when(F.col("is_ua"), "ua").when(F.col("is_leaf"), "leaf").when(F.col("is_tree_root"), "root").otherwise("inner"))


def dag_nodes_by_kind(spark, d):
    return _kind(graph.kinds(Case(spark, d).dag)).groupBy("kind").agg(F.count("*").alias("n"))


def dag_edges_by_kind(spark, d):
    c = Case(spark, d)
    kinds = _kind(graph.kinds(c.dag)).select("dag_id", F.col("node_id").alias("parent_id"), "kind")
    return c.dag.edges.join(kinds, ["dag_id", "parent_id"]).groupBy("kind").agg(F.count("*").alias("n"))


def multi_parent_nodes(spark, d):
    e = Case(spark, d).dag.edges
    return e.groupBy("child_id").count().where("count > 1").agg(F.count("*").alias("n"))


def incremental_merge(spark, d):
    trees = adapter.all_trees(spark, d)
    part = lambda ids: trees.replace(trees.nodes.where(F.col("dag_id").isin(ids)), trees.edges.where(F.col("dag_id").isin(ids)))
    have = M.add(M.merge(part(["A", "B"])), part(["C", "D"]))
    return have.dag.nodes.agg(F.count("*").alias("nodes")).crossJoin(have.dag.edges.agg(F.count("*").alias("edges")))


def parsimony_min(spark, d):
    c = Case(spark, d)
    return c.root(W.optimum(c.dag, c.parsimony, heights=c.heights)).select(F.col("weight").alias("parsimony"))


def parsimony_max(spark, d):
    c = Case(spark, d)
    return c.root(W.optimum(c.dag, c.parsimony, W.parsimony(F.max), c.heights)).select(F.col("weight").alias("parsimony"))


def parsimony_ua_free(spark, d):
    c = Case(spark, d)
    w = persisted(W.parsimony_weights(c.dag, ua_free=True), "ua-free")
    return c.root(W.optimum(c.dag, w, heights=c.heights)).select(F.col("weight").alias("parsimony"))


def optimal_tree_count(spark, d):
    c = Case(spark, d)
    return c.root(W.optimal_tree_counts(c.dag, c.parsimony, heights=c.heights)).select(F.col("weight").cast("string").alias("trees"))


def _parsimonies(spark, d) -> DataFrame:
    """weight, n (a number of any size): how many trees of the whole DAG have each parsimony score."""
    c = Case(spark, d)
    return adapter._once(spark, ("parsimonies", d), lambda: persisted(W.distribution(c.dag, c.parsimony, heights=c.heights).join(graph.roots(c.dag).select(*graph.KEY), graph.KEY).select("weight", "n"), "parsimonies"))


def parsimony_histogram(spark, d):
    return _parsimonies(spark, d).select(F.col("weight").alias("parsimony"), N.text(F.col("n")).alias("trees"))


def trimmed_edges(spark, d):
    c = Case(spark, d)
    t = W.trim(c.dag, c.parsimony)
    return t.edges.agg(F.count("*").alias("edges")).crossJoin(t.nodes.agg(F.count("*").alias("nodes")))


def leafset_frequency(spark, d):
    c = Case(spark, d)
    return c.counts.groupBy("n_leaves", F.col("count").cast("string").alias("trees")).agg(F.count("*").alias("n_sets"))


def _sum_rf(most: bool):
    def run(spark, d):
        c = Case(spark, d)
        return distances.sum_rf(c.dag, c.sets, c.counts, c.n_trees(), most, c.heights).select(F.col("weight").cast("string").alias("sum_rf"))

    return run


def dag_info(spark, d):
    h = _parsimonies(spark, d)
    ends = h.agg(F.min("weight").alias("least"), N.text(F.min_by("n", "weight")).alias("n_least"), F.max("weight").alias("most"), N.text(F.max_by("n", "weight")).alias("n_most"))
    return N.add_up(h, [], "n").select(N.text(F.col("n")).alias("trees")).crossJoin(ends)


def leaf_set_sizes(spark, d):
    return Case(spark, d).merged.labels.groupBy("n_leaves").agg(F.count("*").alias("n_nodes"), F.countDistinct("leafset_key").alias("n_sets"))


def novel_leafsets(spark, d):
    trees = adapter.all_trees(spark, d)
    a, b = (labels.leaf_sets(trees.only(x)) for x in "AB")
    return labels.novel_leafsets(b, a).groupBy("n_leaves").agg(F.count("*").alias("n"))


def completed_edges(spark, d):
    c = Case(spark, d)
    return labels.completed(c.dag, c.sets).edges.agg(F.count("*").alias("edges"))


def validation_violations(spark, d):
    return graph.violations(Case(spark, d).dag).unionByName(graph.violations(adapter.all_trees(spark, d), False)).groupBy("rule").agg(F.count("*").alias("n"))


def leaf_genome(spark, d):
    leaf = graph.leaves(Case(spark, d).dag)
    return leaf.select("sample_id", G.text(F.col("genome")).alias("genome"), F.size("genome").cast("bigint").alias("n_sites"))


def leaf_sequence(spark, d):
    c = Case(spark, d)
    ref = c.dag.reference_column()
    return graph.leaves(c.dag).select("sample_id", G.to_sequence(F.col("genome"), ref).alias("sequence"), G.base_at(F.col("genome"), F.lit(7), ref).alias("base7"), G.has_position(F.col("genome"), F.lit(7)).alias("has7"))


def _pairs(spark, d) -> DataFrame:
    """ck, g, h: the genomes of each customer and the next."""
    rows = adapter.customers(spark, d).select("ck", adapter.sequence(F.col("ck")).alias("s"))
    # Sequences meet, not genomes, and by a merge: Spark knows the size of the file alone, takes few MB of it for all rows made of it, and would send these through the driver.
    both = rows.join(rows.select((F.col("ck") - 1).alias("ck"), F.col("s").alias("t")).hint("merge"), "ck")
    genome = lambda x: G.from_sequence(F.col(x), F.lit(adapter.REFERENCE))
    return both.select("ck", genome("s").alias("g"), genome("t").alias("h"))


def genome_pairs(spark, d):
    ref = F.lit(adapter.REFERENCE)
    m = G.mutations_between(F.col("g"), F.col("h"), ref)
    back = G.text(G.apply_mutations(F.col("g"), m, ref)) == G.text(F.col("h"))
    return _pairs(spark, d).select("ck", F.size(G.differing_sites(F.col("g"), F.col("h"))).cast("bigint").alias("n_sites"), G.mutations_text(m).alias("mutations"), G.is_compatible(F.col("g"), F.col("h"), ref).alias("compatible"), back.alias("round_trip"))


def edge_mutation_counts(spark, d):
    t = adapter.all_trees(spark, d).only("C")
    return W.mutations(t).groupBy(F.size("muts").cast("bigint").alias("mutations")).agg(F.count("*").alias("edges"))


def recomputed_genomes(spark, d):
    """Genomes made again from edge mutations alone: how many nodes differ."""
    t = adapter.all_trees(spark, d).only("A")
    again = labels.recomputed_genomes(t, W.mutation_rows(t))
    g = lambda dag, n: dag.nodes.select(*graph.KEY, G.text(F.col("genome")).alias(n))
    both = g(t, "a").join(g(again, "b"), graph.KEY)
    bad = labels.inconsistent_mutations(t, W.mutation_rows(t)).agg(F.count("*").alias("inconsistent"))
    return both.agg(F.count("*").alias("nodes"), F.sum((F.col("a") != F.col("b")).cast("bigint")).alias("different")).crossJoin(bad)


def _tree_c(spark, d) -> Dag:
    return adapter.tree(spark, d, "C")


def _site_costs(matrix):
    def run(spark, d):
        t = _tree_c(spark, d)
        sites = persisted(sankoff.variable_sites(t), "sites")
        below = sankoff.costs(t, sites, sankoff.cost_table(spark, sites, matrix))
        return sankoff.site_scores(t, below).where("score > 0").select(F.col("pos").cast("bigint").alias("pos"), "score")

    return run


def sankoff_score(spark, d):
    return _site_costs(None)(spark, d).agg(F.sum("score").alias("score"))


def sankoff_reconstruction(spark, d):
    """The score of the reconstructed states, counted as mutations of the tree that has them."""
    t = _tree_c(spark, d)
    sites = persisted(sankoff.variable_sites(t), "sites")
    table = sankoff.cost_table(spark, sites)
    again = sankoff.with_states(t, sankoff.reconstruction(t, sankoff.costs(t, sites, table), table)).persisted("again")
    ua = graph.roots(t).select("dag_id", F.col("node_id").alias("parent_id"))
    return W.mutations(again).join(ua, ["dag_id", "parent_id"], "left_anti").agg(F.sum(F.size("muts")).cast("double").alias("score"))


def fitch_steps(spark, d):
    t = _tree_c(spark, d)
    sites = persisted(sankoff.variable_sites(t), "sites")
    top = graph.roots(t).select(*graph.KEY).join(sankoff.fitch_sets(t, sites), graph.KEY)
    return top.where("steps > 0").select(F.col("pos").cast("bigint").alias("pos"), "steps")


def ancestor_closure(spark, d):
    return graph.ancestors(adapter.all_trees(spark, d).only("A")).groupBy(F.col("distance").cast("bigint").alias("distance")).agg(F.count("*").alias("pairs"))


def _index(spark, d, tree: str):
    return adapter._once(spark, ("index", d, tree), lambda: index.build(adapter.all_trees(spark, d).only(tree)))


def lca_pairs(spark, d):
    t = adapter.all_trees(spark, d).only("A")
    leaf = graph.leaves(t).select("dag_id", "node_id", F.col("sample_id").cast("bigint").alias("ck"))
    nxt = leaf.select("dag_id", F.col("node_id").alias("b"), (F.col("ck") - 1).alias("ck"))
    pairs = leaf.withColumnRenamed("node_id", "a").join(nxt, ["dag_id", "ck"])
    return index.lca(_index(spark, d, "A"), pairs).select("ck", F.col("distance").cast("bigint").alias("distance"))


def nodes_by_depth(spark, d):
    nodes = _index(spark, d, "A").nodes
    return nodes.groupBy(F.col("depth").cast("bigint").alias("depth")).agg(F.count("*").alias("nodes"), F.countDistinct("enter").alias("paths"))


def _leaves_below(where: str | None):
    def run(spark, d):
        t = adapter.trees(adapter.customers(spark, d, where), {"C": ("n",)})
        return graph.leaves_below(t).select(F.size("leaves").cast("bigint").alias("n"), F.array_join("leaves", ",").alias("leaves"))

    return run


def _sampled(make):
    def run(spark, d):
        c = Case(spark, d)
        t = make(c)
        return graph.leaves(t).agg(F.count("*").alias("leaves")).crossJoin(graph.is_tree(t).select("is_tree"))

    return run


def best_sample_score(spark, d):
    c = Case(spark, d)
    return search.scores(sampling.best_sample_tree(c.dag, c.parsimony, 5)).select(F.col("score").alias("parsimony"))


def _vcf_unpivot(where: str):
    def run(spark, d):
        part = load(spark, d, "part").where(where).select(F.col("p_partkey").alias("k"))
        call = F.array(*[F.when((F.col("k") * i) % 4 == 3, ".").otherwise(((F.col("k") * i) % 4 % 3).cast("string")) for i in range(1, 6)])
        letter = lambda x: F.substring(F.lit("ACGT"), ((F.col("k") + x) % 4).cast("int") + 1, F.lit(1))
        line = F.concat_ws("\t", F.lit("chr"), F.col("k").cast("string"), F.lit("."), letter(0), F.concat(letter(1), F.lit(","), letter(2)), F.lit("."), F.lit("."), F.lit("."), F.lit("GT"), call)
        head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(f"S{i}" for i in range(1, 6))
        lines = part.select(line.alias("value")).unionByName(spark.range(1).select(F.lit(head).alias("value"))).unionByName(spark.range(1).select(F.lit("##source=parts").alias("value")))
        return sequences.vcf_lines(lines).select("sample_id", F.col("pos").cast("bigint").alias("pos"), "base")

    return run


def fasta_records(spark, d):
    s = load(spark, d, "supplier")
    seq = adapter.sequence(F.col("s_suppkey"))
    rows = s.select(F.concat(F.lit("supplier"), F.col("s_suppkey"), F.lit(" some words\n"), F.substring(seq, 1, 20), F.lit("\n"), F.lower(F.substring(seq, 21, 12)), F.lit("\n")).alias("value"), F.col("s_suppkey").alias("at"))
    return sequences.fasta_records(rows)


def newick_nodes(spark, d):
    rows = newick.read(_newicks(spark, d))
    return rows.groupBy("dag_id").agg(F.count("*").alias("nodes"), F.sum(F.col("label").startswith("l").cast("bigint")).alias("leaves"), F.round(F.sum("length"), 6).alias("length"))


def base_operations(spark, d):
    """Operations on the sets of bases that two customers' numbers stand for, and how many customers have each pair."""
    k = load(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    m = k.select((F.col("k") % 15 + 1).cast("int").alias("a"), (F.floor(F.col("k") / 15) % 15 + 1).cast("int").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    a, b = F.col("a"), F.col("b")
    out = m.select("a", "b", "n", B.is_compatible(a, b).alias("compatible"), B.is_ambiguous(a).alias("ambiguous"), B.first_base(a).alias("first"), B.common_bases(a, b).alias("common"), B.complement(a).alias("complement"), B.shown(a).alias("shown"), B.mask(B.letter(a)).alias("again"))
    return out.select(*[F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in out.dtypes])


def node_neighbours(spark, d):
    """How many parents and clades the nodes of the tree of nations have, and alternatives in a clade at most."""
    near = graph.neighbours(_tree_c(spark, d))
    widest = F.coalesce(F.array_max(F.transform("clades", F.size)), F.lit(0))
    return near.groupBy(F.size("parents").cast("bigint").alias("parents"), F.size("clades").cast("bigint").alias("clades"), widest.cast("bigint").alias("widest")).agg(F.count("*").alias("nodes"))


def nodes_of_leafsets(spark, d):
    """Of the merged DAG: how many leaf sets have one, two or more nodes."""
    return labels.leafset_nodes(Case(spark, d).sets).groupBy(F.size("nodes").cast("bigint").alias("nodes")).agg(F.count("*").alias("n_sets"))


def kmer_counts(spark, d):
    s = adapter.customers(spark, d).select(adapter.sequence(F.col("ck")).alias("s"))
    return s.select(F.explode(J.encoded(F.col("s"), 3)).alias("k")).groupBy(F.col("k").cast("bigint").alias("kmer")).agg(F.count("*").alias("n"), F.first(J.kmer_text(F.col("k"), 3)).alias("text"))


def edge_likelihood(spark, d):
    rows = adapter.customers(spark, d).select("ck", adapter.sequence(F.col("ck")).alias("p"))
    both = rows.join(rows.select((F.col("ck") - 1).alias("ck"), F.col("p").alias("c")), "ck")
    sites = both.select("ck", F.posexplode(F.arrays_zip(J.base_codes(F.col("p")).alias("parent"), J.base_codes(F.col("c")).alias("child"))).alias("site", "x"))
    csp = F.array(*[F.when(F.col("parent") == b, 0.0).otherwise(1 / 3) for b in range(4)])
    sites = sites.select("ck", "site", F.col("x.parent").alias("parent"), F.col("x.child").alias("child")).where("parent < 4").withColumn("rate", 1.0 + F.col("site") % 3).withColumn("csp", csp)
    return J.edge_log_likelihood(sites, ["ck"]).select("ck", F.round("log_likelihood", 6).alias("log_likelihood"))


def consensus(spark, d):
    s = adapter.customers(spark, d).select(F.col("ck").cast("string").alias("sample_id"), adapter.sequence(F.col("ck")).alias("sequence"))
    return sequences.consensus(s)


def variant_overlay(spark, d):
    """Leaves whose first site is set to N: how many edges to leaves lose or keep a mutation there."""
    t = _tree_c(spark, d)
    v = graph.leaves(t).select("sample_id", F.lit(1).alias("pos"), F.lit("N").alias("base"))
    leaf = graph.leaves(t).select("dag_id", F.col("node_id").alias("child_id"))
    at = lambda dag: W.mutations(dag).join(leaf, ["dag_id", "child_id"]).where(F.exists("muts", lambda m: m["pos"] == 1)).agg(F.count("*").alias("n"))
    before, after = at(t).select(F.col("n").alias("before")), at(sequences.with_variants(t, v)).select(F.col("n").alias("after"))
    return before.crossJoin(after).crossJoin(sequences.unmatched(t, v).agg(F.count("*").alias("unmatched")))


def _calls(spark, d) -> DataFrame:
    """The customers' bases as variants; every seventh is not known."""
    each = adapter.customers(spark, d).select("ck", F.posexplode(F.split(adapter.sequence(F.col("ck")), "")).alias("at", "base")).where("base <> ''").withColumn("pos", F.col("at") + 1)
    base = F.when((F.col("ck") + F.col("pos")) % 7 == 0, "N").otherwise(F.col("base"))
    return each.select(F.col("ck").cast("string").alias("sample_id"), "pos", base.alias("base")).where(F.col("base") != F.substring(F.lit(adapter.REFERENCE), F.col("pos"), F.lit(1)))


def vcf_fitch_sankoff(spark, d):
    """Genomes of a whole tree from calls with unknown bases: by site the changes of the sets, the mutations of the genomes, and those of inner nodes below the root."""
    t = _tree_c(spark, d)
    made, steps = sankoff.variant_genomes(t, _calls(spark, d))
    inner = graph.kinds(t).where("not is_leaf and not is_tree_root and not is_ua").select("dag_id", F.col("node_id").alias("child_id"), F.lit(1).alias("_inner"))
    each = W.mutations(made.persisted("variant-genomes")).join(inner, ["dag_id", "child_id"], "left").select("_inner", F.explode("muts.pos").alias("pos"))
    found = each.groupBy("pos").agg(F.count("*").alias("mutations"), F.count("_inner").alias("inner_mutations"))
    return steps.select(F.col("pos").cast("bigint").alias("pos"), "steps").join(found.withColumn("pos", F.col("pos").cast("bigint")), "pos")


def merge_below(spark, d):
    """The tree of nations, with one nation's subtree of the tree of nations and segments merged in below."""
    trees = adapter.all_trees(spark, d)
    cells = adapter.customers(spark, d).groupBy("n").agg(F.countDistinct("c").alias("m"), F.count("*").alias("k")).where("m > 1 and m < k")
    one = cells.agg(F.min("n").alias("n")).select(F.lit("A").alias("dag_id"), F.xxhash64(F.lit("A"), "n").alias("node_id"))
    have = M.add_below(M.merge(trees.only("C")), trees.only("A"), persisted(one, "one"))
    n = W.at_root(have.dag, W.tree_counts(have.dag)).select(F.col("weight").cast("bigint").alias("trees"))
    return have.dag.nodes.agg(F.count("*").alias("nodes")).crossJoin(have.dag.edges.agg(F.count("*").alias("edges"))).crossJoin(n)


def _newicks(spark, d) -> DataFrame:
    c = adapter.customers(spark, d)
    cells = c.groupBy("n", "s").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("l"), F.col("ck"), F.lit(":0.5")))), ",").alias("t"))
    texts = cells.groupBy("n").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("("), "t", F.lit(")'"), "s", F.lit("':1e-1")))), ",").alias("t"))
    return texts.select(F.col("n").alias("dag_id"), F.concat(F.lit("("), "t", F.lit(")root;")).alias("newick"))


def rerooted_newick(spark, d):
    """Each nation's tree hung up at its first customer."""
    first = adapter.customers(spark, d).groupBy(F.col("n").alias("dag_id")).agg(F.concat(F.lit("l"), F.min("ck")).alias("label"))
    rows = newick.rerooted(persisted(newick.read(_newicks(spark, d)), "newicks"), persisted(first, "outgroups"))
    top = F.max(F.when(F.col("parent_id").isNull(), F.col("label"))).alias("root")
    return rows.groupBy("dag_id").agg(F.count("*").alias("nodes"), F.sum(F.col("label").startswith("l").cast("bigint")).alias("leaves"), top, F.round(F.sum("length"), 6).alias("length"))


def condensed_leaves(spark, d):
    """Leaves with equal genomes stand for one another: parts by their name's words."""
    p = load(spark, d, "part")
    g = p.select("p_partkey", F.translate(F.substring(F.md5("p_brand"), 1, 12), "0123456789abcdef", "ACGT" * 4).alias("s"))
    return g.groupBy("s").agg(F.min("p_partkey").alias("stands_for"), F.count("*").alias("members")).select("stands_for", "members")


def spr_moves(spark, d):
    t = adapter.trees(adapter.customers(spark, d), {"A": ("s",)})
    return ranges.move_ranges(t, 3).select(F.col("distance").cast("bigint").alias("distance"), "moves", "best", "worst")


def first_of_each(spark, d):
    """Leaf genomes of which the first tree's counts, by event type: events as samples of users."""
    e = load(spark, d, "events").select("user_id", "event_type", "event_id")
    w = Window.partitionBy("user_id").orderBy("event_id")
    return e.withColumn("r", F.row_number().over(w)).where("r = 1").groupBy("event_type").agg(F.count("*").alias("users"))


# --- SQL ---

CUSTOMERS = """
cu AS (SELECT c_custkey AS ck, 'n:' || c_nationkey AS n, 's:' || c_mktsegment AS s, 'c:' || c_nationkey || '|' || c_mktsegment AS c,
    translate(md5(CAST(c_custkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS g FROM customer WHERE {where}),
ref AS (SELECT translate(md5('0'), '0123456789abcdef', 'ACGTACGTACGTACGT') AS r),
cell AS (SELECT c, min(n) AS n, min(s) AS s, count(*) AS kc, arg_min(g, ck) AS gc FROM cu GROUP BY c),
nat AS (SELECT n AS q, count(*) AS k, count(DISTINCT c) AS m, arg_min(g, ck) AS gq FROM cu GROUP BY n),
seg AS (SELECT s AS q, count(*) AS k, count(DISTINCT c) AS m, arg_min(g, ck) AS gq FROM cu GROUP BY s),
top AS (SELECT arg_min(g, ck) AS gr, count(*) AS leaves FROM cu),
grp AS (SELECT 1 AS side, *, CASE WHEN 1 < m AND m < k THEN 2 ELSE 1 END AS alt FROM nat UNION ALL SELECT 2, *, CASE WHEN 1 < m AND m < k THEN 2 ELSE 1 END FROM seg),
mem AS (SELECT 1 AS side, n AS q, * FROM cell UNION ALL SELECT 2, s, * FROM cell),
"""
COSTS = """
flat AS (SELECT side, q, sum(hamming(gq, g)) AS w FROM (SELECT 1 AS side, n AS q, g FROM cu UNION ALL SELECT 2, s, g FROM cu) JOIN grp USING (side, q) GROUP BY side, q),
inside AS (SELECT c, sum(hamming(gc, g)) AS w FROM cu JOIN cell USING (c) GROUP BY c),
deep AS (SELECT side, q, sum(hamming(gq, gc) + i.w) AS w FROM mem JOIN grp USING (side, q) JOIN inside i USING (c) GROUP BY side, q),
opt AS (SELECT g.*, hamming(gr, gq) + f.w AS wc, hamming(gr, gq) + d.w AS wa FROM grp g JOIN flat f USING (side, q) JOIN deep d USING (side, q), top),
side AS (SELECT side, hamming(r, gr) + sum(CASE WHEN alt = 2 THEN least(wc, wa) ELSE wc END) AS lo, hamming(r, gr) + sum(CASE WHEN alt = 2 THEN greatest(wc, wa) ELSE wc END) AS hi,
    CAST(product(CASE WHEN alt = 2 AND wc = wa THEN 2 ELSE 1 END) AS BIGINT) AS ties, hamming(r, gr) AS up FROM opt, top, ref GROUP BY side, r, gr),
"""
# The groups of a side choose apart from one another: their weights are convolved, one group after another.
CONVOLVED = """
turn AS (SELECT side, row_number() OVER (PARTITION BY side ORDER BY q) AS i, alt, wc, wa FROM opt),
choice AS (SELECT side, i, wc AS w FROM turn UNION ALL SELECT side, i, wa FROM turn WHERE alt = 2),
conv(side, i, w, n) AS (SELECT DISTINCT side, CAST(0 AS BIGINT), CAST(hamming(r, gr) AS HUGEINT), CAST(1 AS HUGEINT) FROM opt, top, ref
    UNION ALL SELECT side, i, CAST(w AS HUGEINT), CAST(sum(n) AS HUGEINT) FROM (SELECT c.side, c.i + 1 AS i, c.w + x.w AS w, c.n FROM conv c JOIN choice x ON x.side = c.side AND x.i = c.i + 1) GROUP BY side, i, w),
histogram AS (SELECT w, CAST(sum(n) AS HUGEINT) AS n FROM conv JOIN (SELECT side, max(i) AS i FROM turn GROUP BY side) USING (side, i) GROUP BY w),
"""
FREQUENCIES = """
tot AS (SELECT CAST(max(CASE WHEN side = 1 THEN p END) AS BIGINT) AS t1, CAST(max(CASE WHEN side = 2 THEN p END) AS BIGINT) AS t2 FROM (SELECT side, product(alt) AS p FROM grp GROUP BY side)),
cells AS (SELECT c, kc, CAST(sum(CASE WHEN m = 1 THEN CASE WHEN side = 1 THEN t1 ELSE t2 END ELSE (CASE WHEN side = 1 THEN t1 ELSE t2 END) // 2 END) AS BIGINT) AS cnt FROM mem JOIN grp USING (side, q), tot WHERE kc > 1 GROUP BY c, kc),
sets AS (SELECT 1 AS n_leaves, t1 + t2 AS cnt FROM cu, tot UNION ALL SELECT leaves, t1 + t2 FROM top, tot UNION ALL SELECT kc, cnt FROM cells
    UNION ALL SELECT k, CASE WHEN side = 1 THEN t1 ELSE t2 END FROM grp, tot WHERE m > 1),
"""


def _sql(body: str, *parts: str, where: str = "TRUE") -> str:
    return "WITH " + (CUSTOMERS.format(where=where) + "".join(parts)).strip().rstrip(",") + "\n" + body


EDGES = "(SELECT 2 + (SELECT sum(alt) FROM grp) + (SELECT coalesce(sum(kc), 0) FROM cell WHERE kc > 1) + (SELECT coalesce(sum(k), 0) FROM grp WHERE m > 1) + (SELECT coalesce(sum(m), 0) FROM grp WHERE alt = 2))"
NODES = "(SELECT 3 + (SELECT count(*) FROM cu) + (SELECT count(*) FROM cell WHERE kc > 1) + (SELECT count(*) FROM grp WHERE m > 1) + (SELECT count(*) FROM grp WHERE alt = 2))"
SITES = """
leaf AS (SELECT n, pos, substr(g, CAST(pos AS INTEGER), 1) AS b FROM cu, (SELECT unnest(range(1, 33)) AS pos)),
abc AS (SELECT unnest(['A', 'C', 'G', 'T']) AS x, unnest(range(4)) AS xi),
low AS (SELECT n, pos, x, xi, sum({leaf}) AS c FROM leaf l JOIN abc ON TRUE JOIN abc y ON y.x = l.b GROUP BY ALL),
"""
SANKOFF = """
mid AS (SELECT n, pos, a.x, a.xi, min(low.c + {between}) AS c FROM low, abc a GROUP BY n, pos, a.x, a.xi),
sites AS (SELECT pos, min(c) AS score FROM (SELECT pos, x, sum(c) AS c FROM mid GROUP BY pos, x) GROUP BY pos),
"""
UNIT = {"leaf": "CASE WHEN abc.x = l.b THEN 0 ELSE 1 END", "between": "CASE WHEN low.x = a.x THEN 0 ELSE 1 END"}
MATRIX = "[" + ", ".join(str(x) for row in TRANSITIONS for x in row) + "]"
WEIGHTED = {"leaf": f"{MATRIX}[abc.xi * 4 + y.xi + 1]", "between": f"{MATRIX}[a.xi * 4 + low.xi + 1]"}


def _sankoff(kind: dict) -> str:
    return (SITES + SANKOFF).replace("abc ON TRUE", "abc ON TRUE").format(**kind).replace("SELECT n, pos, x, xi, sum", "SELECT n, pos, abc.x, abc.xi, sum")


DEPTHS = """
dep AS (SELECT 0 AS d, 1 AS n UNION ALL SELECT 1, 1 UNION ALL SELECT 2, count(*) FROM nat WHERE m > 1
    UNION ALL SELECT 2 + CAST(m > 1 AS INTEGER), count(*) FROM cell JOIN nat ON q = n WHERE kc > 1 GROUP BY 1
    UNION ALL SELECT 2 + CAST(m > 1 AS INTEGER) + CAST(kc > 1 AS INTEGER), count(*) FROM cu JOIN cell USING (c) JOIN nat ON q = cu.n GROUP BY 1),
"""
SPLIT = "(SELECT ck, unnest(range(1, 33)) AS i, r, g FROM cu, ref)"
SAMPLED = "SELECT count(*) AS leaves, TRUE AS is_tree FROM customer"
RF = """
adds AS (SELECT side, q, sum(CASE WHEN kc > 1 THEN t1 + t2 - 2 * cnt ELSE 0 END) AS w FROM mem LEFT JOIN (SELECT c, cnt FROM cells) USING (c), tot GROUP BY side, q),
own AS (SELECT g.side, g.q, alt, CASE WHEN k = 1 THEN 0 WHEN m > 1 THEN t1 + t2 - 2 * (CASE WHEN side = 1 THEN t1 ELSE t2 END) ELSE w END AS base, w FROM grp g JOIN adds USING (side, q), tot),
rf AS (SELECT side, sum(base + CASE WHEN alt = 2 THEN least(0, w) ELSE 0 END) AS lo, sum(base + CASE WHEN alt = 2 THEN greatest(0, w) ELSE 0 END) AS hi FROM own GROUP BY side),
"""
RF_SUM = "CAST(CAST({f}({c}) + (SELECT sum(cnt) FROM sets) - (SELECT (t1 + t2) * (leaves + 1) FROM tot, top) AS HUGEINT) AS VARCHAR)"



def _variants_sql() -> str:
    """Sets of nations and of the root over calls of which every seventh is any base; states from the root down."""
    has = lambda mask, b: f"(({mask} >> {b}) & 1)"
    counts = lambda mask, x: ", ".join(f"CAST(sum({has(mask, b)}) AS INT) AS {x}{b}" for b in range(4))
    most = lambda x: f"greatest({x}0, {x}1, {x}2, {x}3)"
    majority = lambda x: " + ".join(f"{1 << b} * CAST({x}{b} = {most(x)} AS INT)" for b in range(4))
    chosen = lambda mask, parent: f"CASE WHEN {mask} & {parent} <> 0 THEN {parent} ELSE {mask} & -{mask} END"
    parts = f"""
    call AS (SELECT n, ck, pos, CAST(CASE WHEN (ck + pos) % 7 = 0 THEN 15 ELSE 1 << (instr('ACGT', substr(g, CAST(pos AS INT), 1)) - 1) END AS INT) AS x FROM cu, (SELECT unnest(range(1, 33)) AS pos)),
    lowc AS (SELECT n, pos, {counts('x', 'c')}, CAST(count(*) AS INT) AS k FROM call GROUP BY n, pos),
    lows AS (SELECT n, pos, k, {majority('c')} AS m, k - {most('c')} AS steps FROM lowc),
    topc AS (SELECT pos, {counts('m', 'r')}, CAST(count(*) AS INT) AS k, sum(steps) AS below FROM lows GROUP BY pos),
    tops AS (SELECT pos, below + k - {most('r')} AS steps, {majority('r')} AS m, CAST(1 << (instr('ACGT', substr(r, CAST(pos AS INT), 1)) - 1) AS INT) AS ref FROM topc, ref),
    root AS (SELECT pos, steps + CAST(m & ref = 0 AS INT) AS steps, ref, {chosen('m', 'ref')} AS st FROM tops),
    nation AS (SELECT n, pos, k, st AS up, CASE WHEN k = 1 THEN st ELSE {chosen('m', 'st')} END AS st FROM lows JOIN root USING (pos)),
    tips AS (SELECT pos, sum(CAST(x & st = 0 AS INT)) AS n FROM call JOIN nation USING (n, pos) GROUP BY pos),
    inn AS (SELECT pos, sum(CAST(st <> up AS INT)) AS n FROM nation GROUP BY pos),
    """
    return _sql("SELECT CAST(pos AS BIGINT) AS pos, CAST(steps AS BIGINT) AS steps, CAST(tips.n + inn.n + CAST(st <> ref AS INT) AS BIGINT) AS mutations, CAST(inn.n AS BIGINT) AS inner_mutations FROM root JOIN tips USING (pos) JOIN inn USING (pos) WHERE steps > 0", parts)


def _moves_sql() -> str:
    """Moves of the tree of segments by their five kinds: a leaf to a sibling, to the root, to another segment; a segment to another, to a leaf of another.

    What a site adds depends on the bases and sets that meet there, so each kind has a table by them. Segments have two leaves at least, and there are three or more.
    """
    bits = (1, 2, 4, 8)
    four = lambda f: [f(b) for b in range(4)]
    most = lambda n: f"greatest({', '.join(n)})"
    majority = lambda n: " + ".join(f"{bit} * CAST({x} = {most(n)} AS INT)" for bit, x in zip(bits, n, strict=True))
    has = lambda mask, b: f"(({mask} >> {b}) & 1)"
    pair = lambda a, b: f"CASE WHEN {a} & {b} <> 0 THEN {a} & {b} ELSE {a} | {b} END"
    apart = lambda a, b: f"CAST({a} & {b} = 0 AS INT)"
    column = lambda prefix: four(lambda b: f"{prefix}{b}")

    def counted(name: str, source: str, keep: str, changed: list[str], k: str) -> str:
        """CTE: the rows of source with the new counts, their set and cost."""
        return f"{name} AS (SELECT {keep}, {majority(column('z'))} AS zmask, zk - {most(column('z'))} AS zcost FROM (SELECT {keep}, {', '.join(f'{c} AS z{b}' for b, c in enumerate(changed))}, {k} AS zk FROM ({source})))"

    less = four(lambda b: f"c{b} - {has('x', b)}")
    top = lambda plus, k: (four(lambda b: f"r{b} + {plus.replace('#', str(b))}"), k)
    parts = [
        "bit AS (SELECT s, pos, CAST(1 << (instr('ACGT', substr(g, CAST(pos AS INT), 1)) - 1) AS INT) AS x, ck FROM cu, (SELECT unnest(range(1, 33)) AS pos))",
        f"cnt AS (SELECT s, pos, {', '.join(f'CAST(sum({has('x', b)}) AS INT) AS c{b}' for b in range(4))}, CAST(count(*) AS INT) AS k FROM bit GROUP BY s, pos)",
        f"sg AS (SELECT *, {majority(column('c'))} AS m, k - {most(column('c'))} AS cost FROM cnt)",
        f"rt AS (SELECT pos, {', '.join(f'CAST(sum({has('m', b)}) AS INT) AS r{b}' for b in range(4))}, CAST(count(*) AS INT) AS segs FROM sg GROUP BY pos)",
        f"rt2 AS (SELECT rt.*, {majority(column('r'))} AS rm, segs - {most(column('r'))} AS rcost, CAST(1 << (instr('ACGT', substr(r, CAST(pos AS INT), 1)) - 1) AS INT) AS ref FROM rt, ref)",
        "kind AS (SELECT DISTINCT s, pos, x FROM bit)",
        # A leaf of base x leaves segment s.
        counted("gone", "SELECT * FROM kind JOIN sg USING (s, pos)", "s, pos, x, m, cost", less, "k - 1"),
        # 1: to a sibling of the same base (of another base nothing changes).
        counted("t1", "SELECT s, pos, x, m, cost, zmask AS n, zcost AS ncost, r0, r1, r2, r3, segs, rm, rcost, ref FROM gone JOIN rt2 USING (pos)", "s, pos, x, m, cost, n, ncost, rm, rcost, ref", *top(f"{has('n', '#')} - {has('m', '#')}", "segs")),
        f"d1 AS (SELECT s, pos, x, ncost - cost + zcost - rcost + {apart('zmask', 'ref')} - {apart('rm', 'ref')} AS d FROM t1)",
        f"d2 AS (SELECT s, pos, x, ncost - cost + zcost - rcost + {apart('zmask', 'x')} + {apart(f'({pair('zmask', 'x')})', 'ref')} - {apart('rm', 'ref')} AS d FROM t1)",
        # 3: to another segment, t.
        counted("t3", f"SELECT g.s, t.s AS t, pos, x, g.m, g.cost, g.zmask AS n, g.zcost AS ncost, t.m AS tm, {pair('x', 't.m')} AS tn, r0, r1, r2, r3, segs, rm, rcost, ref FROM gone g JOIN sg t USING (pos) JOIN rt2 USING (pos) WHERE t.s <> g.s", "s, t, pos, x, m, cost, n, ncost, tm, rm, rcost, ref", *top(f"{has('n', '#')} - {has('m', '#')} + {has('tn', '#')} - {has('tm', '#')}", "segs")),
        f"d3 AS (SELECT s, t, pos, x, ncost - cost + {apart('x', 'tm')} + zcost - rcost + {apart('zmask', 'ref')} - {apart('rm', 'ref')} AS d FROM t3)",
        # 4: a segment to another.
        counted("t4", f"SELECT a.s, b.s AS t, pos, a.m, b.m AS tm, {pair('a.m', 'b.m')} AS tn, r0, r1, r2, r3, segs, rm, rcost, ref FROM sg a JOIN sg b USING (pos) JOIN rt2 USING (pos) WHERE a.s <> b.s", "s, t, pos, m, tm, rm, rcost, ref", *top(f"{has('tn', '#')} - {has('m', '#')} - {has('tm', '#')}", "segs - 1")),
        f"d4 AS (SELECT s, t, pos, {apart('m', 'tm')} + zcost - rcost + {apart('zmask', 'ref')} - {apart('rm', 'ref')} AS d FROM t4)",
        # 5: a segment to a leaf of base x in another, t.
        counted("t5a", f"SELECT a.s, k.s AS t, pos, x, a.m, b.m AS tm, b.cost, b.k, c0, c1, c2, c3, n FROM kind k JOIN (SELECT s, pos, m, cost, k, c0, c1, c2, c3 FROM sg) b ON b.s = k.s AND b.pos = k.pos JOIN (SELECT s, pos AS _p, m FROM sg) a ON a._p = k.pos AND a.s <> k.s, LATERAL (SELECT {pair('a.m', 'k.x')} AS n)".replace("SELECT a.s, k.s AS t, pos, x", "SELECT a.s, k.s AS t, k.pos, x"), "s, t, pos, x, m, tm, cost", four(lambda b: f"c{b} - {has('x', b)} + {has('n', b)}"), "k"),
        counted("t5", "SELECT s, t, pos, x, m, tm, cost, zmask AS tn, zcost AS tcost, r0, r1, r2, r3, segs, rm, rcost, ref FROM t5a JOIN rt2 USING (pos)", "s, t, pos, x, m, tm, cost, tcost, rm, rcost, ref", *top(f"{has('tn', '#')} - {has('m', '#')} - {has('tm', '#')}", "segs - 1")),
        f"d5 AS (SELECT s, t, pos, x, {apart('m', 'x')} + tcost - cost + zcost - rcost + {apart('zmask', 'ref')} - {apart('rm', 'ref')} AS d FROM t5)",
        f"old AS (SELECT (SELECT sum(rcost + {apart('rm', 'ref')}) FROM rt2) + (SELECT sum(cost) FROM sg) - (SELECT hamming(r, gr) FROM ref, top) - (SELECT sum(hamming(gr, gq)) FROM seg, top) - (SELECT sum(hamming(gq, g)) FROM cu JOIN seg ON q = s) AS base)",
        # Bases by leaf at the sites where a leaf's own base counts, as pairs that agree.
        "moves AS (SELECT 2 AS distance, coalesce(sum(d) FILTER (WHERE a.x = b.x), 0) AS d FROM bit a JOIN bit b ON a.s = b.s AND a.pos = b.pos AND a.ck <> b.ck JOIN d1 ON d1.s = a.s AND d1.pos = a.pos AND d1.x = a.x WHERE a.s IN (SELECT q FROM seg WHERE k > 2) GROUP BY a.ck, b.ck"
        " UNION ALL SELECT 2, sum(d) FROM bit JOIN d2 USING (s, pos, x) GROUP BY ck"
        " UNION ALL SELECT 3, sum(d) FROM bit JOIN d3 USING (s, pos, x) GROUP BY ck, t"
        " UNION ALL SELECT 2, sum(d) FROM d4 GROUP BY s, t"
        " UNION ALL SELECT 3, sum(d) FROM bit b JOIN d5 ON d5.t = b.s AND d5.pos = b.pos AND d5.x = b.x GROUP BY ck, d5.s)",
    ]
    body = "SELECT CAST(distance AS BIGINT) AS distance, count(*) AS moves, CAST(min(d) + base AS BIGINT) AS best, CAST(max(d) + base AS BIGINT) AS worst FROM moves, old GROUP BY distance, base"
    return _sql(body, ",\n".join(parts) + ",")


QUERIES = {
    "tree_count": (tree_count, _sql("SELECT CAST(t1 + t2 AS VARCHAR) AS trees FROM tot", FREQUENCIES)),
    "tree_count_exact": (tree_count_exact, _sql("SELECT CAST(t1 + t2 AS VARCHAR) AS trees FROM tot", FREQUENCIES)),
    "dag_nodes_by_kind": (dag_nodes_by_kind, _sql(f"SELECT 'ua' AS kind, 1::BIGINT AS n UNION ALL SELECT 'root', 2 UNION ALL SELECT 'leaf', count(*) FROM cu UNION ALL SELECT 'inner', {NODES} - 3 - (SELECT count(*) FROM cu)")),
    "dag_edges_by_kind": (dag_edges_by_kind, _sql(f"SELECT 'ua' AS kind, 2::BIGINT AS n UNION ALL SELECT 'root', CAST(sum(alt) AS BIGINT) FROM grp UNION ALL SELECT 'inner', CAST({EDGES} - 2 - (SELECT sum(alt) FROM grp) AS BIGINT)")),
    "multi_parent_nodes": (multi_parent_nodes, _sql("""SELECT (SELECT count(*) FROM cu) + count(*) AS n FROM cell JOIN nat ON nat.q = n JOIN seg ON seg.q = s WHERE kc > 1""")),
    "incremental_merge": (incremental_merge, _sql(f"SELECT CAST({NODES} AS BIGINT) AS nodes, CAST({EDGES} AS BIGINT) AS edges")),
    "parsimony_min": (parsimony_min, _sql("SELECT CAST(min(lo) AS BIGINT) AS parsimony FROM side", COSTS)),
    "parsimony_max": (parsimony_max, _sql("SELECT CAST(max(hi) AS BIGINT) AS parsimony FROM side", COSTS)),
    "parsimony_ua_free": (parsimony_ua_free, _sql("SELECT CAST(min(lo - up) AS BIGINT) AS parsimony FROM side", COSTS)),
    "optimal_tree_count": (optimal_tree_count, _sql("SELECT CAST(CAST(sum(ties) AS BIGINT) AS VARCHAR) AS trees FROM side WHERE lo = (SELECT min(lo) FROM side)", COSTS)),
    "parsimony_histogram": (parsimony_histogram, _sql("SELECT CAST(w AS BIGINT) AS parsimony, CAST(n AS VARCHAR) AS trees FROM histogram", COSTS, CONVOLVED).replace("WITH", "WITH RECURSIVE", 1)),
    "dag_info": (dag_info, _sql("SELECT CAST(sum(n) AS VARCHAR) AS trees, CAST(min(w) AS BIGINT) AS least, CAST(arg_min(n, w) AS VARCHAR) AS n_least, CAST(max(w) AS BIGINT) AS most, CAST(arg_max(n, w) AS VARCHAR) AS n_most FROM histogram", COSTS, CONVOLVED).replace("WITH", "WITH RECURSIVE", 1)),
    "trimmed_edges": (trimmed_edges, _sql("""SELECT CAST(count(*) AS BIGINT) AS edges, CAST(count(DISTINCT c) + 1 AS BIGINT) AS nodes FROM (
        SELECT 'UA' AS p, 'root' || side AS c FROM good UNION ALL SELECT 'root' || side, CASE WHEN k = 1 THEN 'leaf' || (SELECT min(ck) FROM cu WHERE n = q OR s = q) WHEN m = 1 THEN (SELECT min(c) FROM mem WHERE mem.q = o.q AND mem.side = o.side) ELSE q || 'flat' END FROM o WHERE flat
        UNION ALL SELECT 'root' || side, q || 'deep' FROM o WHERE deep
        UNION SELECT CASE WHEN m = 1 THEN c ELSE q || 'flat' END, 'leaf' || ck FROM o JOIN (SELECT 1 AS side, n AS q, c, ck FROM cu UNION ALL SELECT 2, s, c, ck FROM cu) USING (side, q) WHERE flat AND k > 1
        UNION SELECT q || 'deep', CASE WHEN kc > 1 THEN c ELSE 'leaf' || (SELECT min(ck) FROM cu WHERE cu.c = mem.c) END FROM o JOIN mem USING (side, q) WHERE deep
        UNION SELECT c, 'leaf' || ck FROM o JOIN mem USING (side, q) JOIN (SELECT c, ck FROM cu) USING (c) WHERE deep AND kc > 1)""", COSTS, """
        good AS (SELECT side FROM side WHERE lo = (SELECT min(lo) FROM side)),
        o AS (SELECT *, (alt = 1 OR wc <= wa) AS flat, (alt = 2 AND wa <= wc) AS deep FROM opt JOIN good USING (side)),""")),
    "leafset_frequency": (leafset_frequency, _sql("SELECT CAST(n_leaves AS BIGINT) AS n_leaves, CAST(cnt AS VARCHAR) AS trees, count(*) AS n_sets FROM sets GROUP BY ALL", FREQUENCIES)),
    "sum_rf_min": (_sum_rf(False), _sql(f"SELECT {RF_SUM.format(f='min', c='lo')} AS sum_rf FROM rf", FREQUENCIES, RF)),
    "sum_rf_max": (_sum_rf(True), _sql(f"SELECT {RF_SUM.format(f='max', c='hi')} AS sum_rf FROM rf", FREQUENCIES, RF)),
    "leaf_set_sizes": (leaf_set_sizes, _sql("SELECT CAST(n_leaves AS BIGINT) AS n_leaves, CAST(sum(x) AS BIGINT) AS n_nodes, count(*) AS n_sets FROM (SELECT 1 AS n_leaves, 1 AS x FROM cu UNION ALL SELECT leaves, 3 FROM top UNION ALL SELECT kc, 1 FROM cell WHERE kc > 1 UNION ALL SELECT k, alt FROM grp WHERE m > 1) GROUP BY ALL")),
    "novel_leafsets": (novel_leafsets, _sql("SELECT CAST(k AS BIGINT) AS n_leaves, count(*) AS n FROM seg WHERE m > 1 GROUP BY ALL")),
    "completed_edges": (completed_edges, _sql(f"SELECT CAST({EDGES} AS BIGINT) AS edges")),
    "validation_violations": (validation_violations, "SELECT CAST('' AS VARCHAR) AS rule, CAST(0 AS BIGINT) AS n FROM customer WHERE c_custkey <> c_custkey"),
    "leaf_genome": (leaf_genome, _sql(f"SELECT CAST(ck AS VARCHAR) AS sample_id, '<' || coalesce(string_agg(i || substr(g, CAST(i AS INTEGER), 1) || ',', '' ORDER BY i) FILTER (WHERE substr(g, CAST(i AS INTEGER), 1) <> substr(r, CAST(i AS INTEGER), 1)), '') || '>' AS genome, count(*) FILTER (WHERE substr(g, CAST(i AS INTEGER), 1) <> substr(r, CAST(i AS INTEGER), 1)) AS n_sites FROM {SPLIT} GROUP BY ck")),
    "leaf_sequence": (leaf_sequence, _sql("SELECT CAST(ck AS VARCHAR) AS sample_id, g AS sequence, substr(g, 7, 1) AS base7, substr(g, 7, 1) <> substr(r, 7, 1) AS has7 FROM cu, ref")),
    "genome_pairs": (genome_pairs, _sql("SELECT ck, count(*) FILTER (WHERE x <> y) AS n_sites, '<' || coalesce(string_agg(x || i || y || ',', '' ORDER BY i) FILTER (WHERE x <> y), '') || '>' AS mutations, bool_and(x = y) AS compatible, TRUE AS round_trip FROM (SELECT a.ck, i, substr(a.g, CAST(i AS INTEGER), 1) AS x, substr(b.g, CAST(i AS INTEGER), 1) AS y FROM cu a JOIN cu b ON b.ck = a.ck + 1, (SELECT unnest(range(1, 33)) AS i)) GROUP BY ck")),
    "edge_mutation_counts": (edge_mutation_counts, _sql("SELECT CAST(w AS BIGINT) AS mutations, count(*) AS edges FROM (SELECT hamming(r, gr) AS w FROM ref, top UNION ALL SELECT hamming(gr, gq) FROM nat, top UNION ALL SELECT hamming(gq, g) FROM cu JOIN nat ON q = n WHERE k > 1) GROUP BY w")),
    "recomputed_genomes": (recomputed_genomes, _sql("SELECT CAST(sum(n) AS BIGINT) AS nodes, 0::BIGINT AS different, 0::BIGINT AS inconsistent FROM dep", DEPTHS)),
    "sankoff_site_costs": (_site_costs(None), _sql("SELECT CAST(pos AS BIGINT) AS pos, CAST(score AS DOUBLE) AS score FROM sites WHERE score > 0", _sankoff(UNIT))),
    "sankoff_weighted_costs": (_site_costs(TRANSITIONS), _sql("SELECT CAST(pos AS BIGINT) AS pos, CAST(score AS DOUBLE) AS score FROM sites WHERE score > 0", _sankoff(WEIGHTED))),
    "sankoff_score": (sankoff_score, _sql("SELECT CAST(sum(score) AS DOUBLE) AS score FROM sites", _sankoff(UNIT))),
    "sankoff_reconstruction": (sankoff_reconstruction, _sql("SELECT CAST(sum(score) AS DOUBLE) AS score FROM sites", _sankoff(UNIT))),
    "fitch_steps": (fitch_steps, _sql("SELECT CAST(pos AS BIGINT) AS pos, CAST(sum(w) AS BIGINT) AS steps FROM (SELECT pos, k - most AS w FROM fit UNION ALL SELECT pos, count(DISTINCT n) - max(h) FROM (SELECT pos, n, x, sum(hit) OVER (PARTITION BY pos, x) AS h FROM fitx) GROUP BY pos) GROUP BY pos HAVING sum(w) > 0", SITES.format(**UNIT).replace("SELECT n, pos, x, xi, sum", "SELECT n, pos, abc.x, abc.xi, sum"), """
        cnt AS (SELECT n, pos, x, count(*) FILTER (WHERE b = x) AS hits, count(*) AS k FROM leaf, abc GROUP BY n, pos, x),
        fit AS (SELECT n, pos, max(hits) AS most, max(k) AS k FROM cnt GROUP BY n, pos),
        fitx AS (SELECT cnt.n, cnt.pos, x, CAST(hits = most AS INTEGER) AS hit FROM cnt JOIN fit USING (n, pos)),""")),
    "ancestor_closure": (ancestor_closure, _sql("SELECT CAST(distance AS BIGINT) AS distance, CAST(sum(n) AS BIGINT) AS pairs FROM (SELECT n, unnest(range(d + 1)) AS distance FROM dep) WHERE n > 0 GROUP BY distance", DEPTHS)),
    "nodes_by_depth": (nodes_by_depth, _sql("SELECT CAST(d AS BIGINT) AS depth, CAST(sum(n) AS BIGINT) AS nodes, CAST(sum(n) AS BIGINT) AS paths FROM dep WHERE n > 0 GROUP BY d", DEPTHS)),
    "lca_pairs": (lca_pairs, _sql("SELECT a.ck, CAST(a.d + b.d - 2 * CASE WHEN a.c = b.c THEN a.d - 1 WHEN a.n = b.n THEN 2 ELSE 1 END AS BIGINT) AS distance FROM lv a JOIN lv b ON b.ck = a.ck + 1", "lv AS (SELECT ck, cu.c, cu.n, 2 + CAST(m > 1 AS INTEGER) + CAST(kc > 1 AS INTEGER) AS d FROM cu JOIN cell USING (c) JOIN nat ON q = cu.n),")),
    "leaves_below": (_leaves_below(None), _sql("SELECT CAST(count(*) AS BIGINT) AS n, string_agg(CAST(ck AS VARCHAR), ',' ORDER BY CAST(ck AS VARCHAR)) AS leaves FROM (SELECT ck, CAST(ck AS VARCHAR) AS node FROM cu UNION ALL SELECT ck, n FROM cu JOIN nat ON q = n WHERE k > 1 UNION ALL SELECT ck, 'root' FROM cu UNION ALL SELECT ck, 'UA' FROM cu) GROUP BY node")),
    "sampled_tree": (_sampled(lambda c: sampling.sample_tree(c.dag, 1)), SAMPLED),
    "sampled_tree_uniform": (_sampled(lambda c: sampling.uniform_sample_tree(c.dag, 2)), SAMPLED),
    "sampled_tree_best": (_sampled(lambda c: sampling.best_sample_tree(c.dag, c.parsimony, 3)), SAMPLED),
    "sampled_tree_best_uniform": (_sampled(lambda c: sampling.best_uniform_sample_tree(c.dag, c.parsimony, 4)), SAMPLED),
    "best_sample_score": (best_sample_score, _sql("SELECT CAST(min(lo) AS BIGINT) AS parsimony FROM side", COSTS)),
    "vcf_unpivot": (_vcf_unpivot("true"), "SELECT 'S' || i AS sample_id, p_partkey AS pos, CASE WHEN p_partkey * i % 4 = 3 THEN 'N' ELSE substr('ACGT', CAST((p_partkey + p_partkey * i % 4 % 3) % 4 + 1 AS INTEGER), 1) END AS base FROM part, (SELECT unnest(range(1, 6)) AS i) WHERE p_partkey * i % 4 <> 0"),
    "fasta_records": (fasta_records, "SELECT 'supplier' || s_suppkey AS sample_id, translate(md5(CAST(s_suppkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS sequence FROM supplier"),
    "newick_nodes": (newick_nodes, _sql("SELECT n AS dag_id, 1 + count(DISTINCT s) + count(*) AS nodes, count(*) AS leaves, round(0.5 * count(*) + 0.1 * count(DISTINCT s), 6)::DOUBLE AS length FROM cu GROUP BY n")),
    "base_operations": (base_operations, "SELECT a, b, count(*) AS n, a & b <> 0 AS compatible, bit_count(a) <> 1 AS ambiguous, a & -a AS first, CASE WHEN a & b <> 0 THEN a & b END AS common, ((a & 1) << 3) | ((a & 2) << 1) | ((a & 4) >> 1) | ((a & 8) >> 3) AS complement, CASE a WHEN 1 THEN 'A' WHEN 2 THEN 'C' WHEN 4 THEN 'G' WHEN 8 THEN 'T' ELSE 'N' END AS shown, a AS again FROM (SELECT CAST(c_custkey % 15 + 1 AS BIGINT) AS a, CAST(c_custkey // 15 % 15 + 1 AS BIGINT) AS b FROM customer) GROUP BY a, b"),
    "node_neighbours": (node_neighbours, _sql("SELECT CAST(p AS BIGINT) AS parents, CAST(c AS BIGINT) AS clades, CAST(c > 0 AS BIGINT) AS widest, count(*) AS nodes FROM (SELECT 0 AS p, 1 AS c UNION ALL SELECT 1, count(*) FROM nat UNION ALL SELECT 1, k FROM nat WHERE k > 1 UNION ALL SELECT 1, 0 FROM cu) GROUP BY ALL")),
    "nodes_of_leafsets": (nodes_of_leafsets, _sql("SELECT CAST(x AS BIGINT) AS nodes, count(*) AS n_sets FROM (SELECT 1 AS x FROM cu UNION ALL SELECT 3 FROM top UNION ALL SELECT 1 FROM cell WHERE kc > 1 UNION ALL SELECT alt FROM grp WHERE m > 1) GROUP BY x")),
    "kmer_counts": (kmer_counts, _sql("SELECT CAST(CASE WHEN k LIKE '%N%' THEN 64 ELSE 16 * (instr('ACGT', k[1]) - 1) + 4 * (instr('ACGT', k[2]) - 1) + instr('ACGT', k[3]) - 1 END AS BIGINT) AS kmer, count(*) AS n, min(CASE WHEN k LIKE '%N%' THEN 'N' ELSE k END) AS text FROM (SELECT substr('N' || g || 'N', CAST(i AS INTEGER), 3) AS k FROM cu, (SELECT unnest(range(1, 33)) AS i)) GROUP BY 1")),
    "edge_likelihood": (edge_likelihood, _sql("SELECT ck, round(CASE WHEN n = 0 THEN 0 ELSE s + n * ln(n / r) - n END, 6) AS log_likelihood FROM (SELECT ck, sum(CASE WHEN x <> y THEN ln(q / 3) END) AS s, CAST(count(*) FILTER (WHERE x <> y) AS DOUBLE) AS n, sum(q) AS r FROM (SELECT a.ck, 1.0::DOUBLE + (i - 1) % 3 AS q, substr(a.g, CAST(i AS INTEGER), 1) AS x, substr(b.g, CAST(i AS INTEGER), 1) AS y FROM cu a JOIN cu b ON b.ck = a.ck + 1, (SELECT unnest(range(1, 33)) AS i)) GROUP BY ck)")),
    "consensus": (consensus, _sql("SELECT string_agg(b, '' ORDER BY i) AS sequence FROM (SELECT i, arg_max(b, k * 1000 - ascii(b)) AS b FROM (SELECT i, substr(g, CAST(i AS INTEGER), 1) AS b, count(*) AS k FROM cu, (SELECT unnest(range(1, 33)) AS i) GROUP BY ALL) GROUP BY i)")),
    "variant_overlay": (variant_overlay, _sql("SELECT (SELECT count(*) FROM cu JOIN nat ON q = n, top WHERE substr(g, 1, 1) <> substr(CASE WHEN k > 1 THEN gq ELSE gr END, 1, 1)) AS before, 0::BIGINT AS after, 0::BIGINT AS unmatched")),
    "condensed_leaves": (condensed_leaves, "SELECT min(p_partkey) AS stands_for, count(*) AS members FROM part GROUP BY translate(substr(md5(p_brand), 1, 12), '0123456789abcdef', 'ACGTACGTACGTACGT')"),
    "first_of_each": (first_of_each, "SELECT event_type, count(*) AS users FROM (SELECT user_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id) GROUP BY event_type"),
    "vcf_fitch_sankoff": (vcf_fitch_sankoff, _variants_sql()),
    "merge_below": (merge_below, _sql("SELECT CAST(3 + (SELECT count(*) FROM nat WHERE k > 1) + (SELECT count(*) FROM cu) + (SELECT count(*) FROM cell WHERE cell.n = one.q AND kc > 1) AS BIGINT) AS nodes, CAST(2 + (SELECT count(*) FROM nat) + (SELECT sum(k) FROM nat WHERE k > 1) + (SELECT sum(1 + CASE WHEN kc > 1 THEN kc ELSE 0 END) FROM cell WHERE cell.n = one.q) AS BIGINT) AS edges, 2::BIGINT AS trees FROM one", "one AS (SELECT min(q) AS q FROM nat WHERE m > 1 AND m < k),")),
    "rerooted_newick": (rerooted_newick, _sql("SELECT n AS dag_id, 1 + count(DISTINCT s) + count(*) - 1 - CASE WHEN count(DISTINCT s) < 3 THEN 1 ELSE 0 END AS nodes, count(*) AS leaves, 'l' || min(ck) AS root, round(0.5 * count(*) + 0.1 * (count(DISTINCT s) - CASE WHEN count(DISTINCT s) = 1 THEN 1 ELSE 0 END), 6)::DOUBLE AS length FROM cu GROUP BY n")),
    "spr_moves": (spr_moves, _moves_sql()),
}


def queries() -> dict:
    return {name: query for name, (query, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
