"""python -m arbora COMMAND ...: the operators on files.

    merge      merge DAG and tree files; overlay variants, trim, sample, complete, store
    info       number of trees, parsimony and sums of distances, with how many trees have them
    dot        a DAG as DOT text
    sequences  trees (Newick) and sequences (FASTA) merged into one DAG
    optimise   search for better trees
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from arbora.model import Dag
from arbora.operators import distances, graph, labels, merge, sampling, search
from arbora.operators import weights as W
from arbora.session import persisted, ship
from arbora.sources import files, newick, sequences


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="arbora", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, inputs: bool = True) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        if inputs:
            p.add_argument("inputs", nargs="+")
            p.add_argument("--format", help="of the inputs, where their names don't tell")
        p.add_argument("--reference", help="file with the reference sequence")
        p.add_argument("--output")
        return p

    m = command("merge")
    m.add_argument("--vcf")
    m.add_argument("--trim", action="store_true", help="keep the trees of least parsimony")
    m.add_argument("--sample", choices=["natural", "uniform", "best", "best-uniform"])
    m.add_argument("--complete", action="store_true")
    m.add_argument("--seed", type=int, default=0)
    i = command("info")
    i.add_argument("--histogram", action="store_true")
    i.add_argument("--distances", "--print-rf", "--sum-rf-distance", action="store_true")
    command("dot")
    s = command("sequences", inputs=False)
    s.add_argument("--trees", required=True)
    s.add_argument("--fasta", required=True)
    o = command("optimise")
    o.add_argument("--rounds", type=int, default=3)
    o.add_argument("--radius", type=int, default=4)
    o.add_argument("--moves", type=int, default=4, help="targets tried for each subtree")
    o.add_argument("--policy", choices=["best", "all", "coefficients"], default="best")
    o.add_argument("--parsimony-coefficient", type=int, default=1)
    o.add_argument("--node-coefficient", type=int, default=1)
    o.add_argument("--patience", type=int, default=2)
    o.add_argument("--trim", action="store_true")
    o.add_argument("--seed", type=int, default=0)
    o.add_argument("--log")
    o.add_argument("--statistics", action="store_true", help="trees, scores and distances of the DAG in each row of the log")
    return parser


def _load(spark: SparkSession, args) -> Dag:
    reference = sequences.reference(spark, args.reference) if args.reference else None
    first, *rest = [files.read(spark, path, args.format, reference) for path in args.inputs]
    return first.union(*rest)


def info(dag: Dag, histogram: bool = False, rf: bool = False) -> dict:
    """Statistics of a merged DAG."""
    high = persisted(graph.heights(dag), "heights")
    n = int(W.at_root(dag, W.tree_counts(dag, exact=True, heights=high)).first()["weight"])
    w = persisted(W.parsimony_weights(dag), "weights")
    out = {"trees": n, "nodes": dag.nodes.count(), "edges": dag.edges.count()}
    for name, best in (("least", F.min), ("most", F.max)):
        ops = W.parsimony(best)
        out[f"{name}_parsimony"] = int(W.at_root(dag, W.optimum(dag, w, ops, high)).first()["weight"])
        out[f"{name}_parsimony_trees"] = int(W.at_root(dag, W.optimal_tree_counts(dag, w, ops, exact=True, heights=high)).first()["weight"])
    if histogram:
        top = graph.roots(dag).select(*graph.KEY)
        out["parsimony"] = {int(r.weight): int(r.n) for r in W.histogram(dag, w, high).join(top, graph.KEY).orderBy("weight").collect()}
    if rf:
        sets = persisted(labels.leaf_sets(dag, high), "sets")
        counts = persisted(distances.leafset_counts(dag, sets, high, exact=True), "counts")
        for name, most in (("least", False), ("most", True)):
            out[f"{name}_sum_rf"] = int(distances.sum_rf(dag, sets, counts, n, most, high, exact=True).first()["weight"])
            out[f"{name}_sum_rf_trees"] = int(distances.sum_rf_trees(dag, sets, counts, n, most, high).first()["weight"])
    return out


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = ship(SparkSession.builder.appName(f"arbora {args.command}").getOrCreate())
    if args.command == "sequences":
        reference = sequences.reference(spark, args.reference)
        dag = sequences.tree_with_sequences(newick.read_files(spark, args.trees), sequences.fasta(spark, args.fasta), reference).persisted("trees")
        dag = merge.merge(dag).dag
    elif args.command == "dot":
        files.dot(_load(spark, args)).orderBy("dag_id", "at").select("value").write.text(args.output)
        return
    elif args.command == "optimise":
        policy = search.Policy(args.policy, args.parsimony_coefficient, args.node_coefficient)
        have, log = search.optimise(_load(spark, args), args.rounds, args.radius, args.seed, policy, args.moves, args.patience, args.trim, on_round=lambda row: print(json.dumps(row)), statistics=(lambda dag: info(dag, rf=True)) if args.statistics else None)
        if args.log:
            files.append_log(spark, log, args.log)
        dag = have.dag
    else:
        dag = _load(spark, args)
        if getattr(args, "vcf", None):
            dag = sequences.with_variants(dag, sequences.vcf(spark, args.vcf)).persisted("variants")
        dag = merge.merge(dag).dag
        if args.command == "info":
            print(json.dumps(info(dag, args.histogram, args.distances)))
            return
        weights = persisted(W.parsimony_weights(dag), "weights") if args.trim or args.sample else None
        if args.trim:
            dag = W.trim(dag, weights)
        if args.sample:
            make = {"natural": lambda: sampling.sample_tree(dag, args.seed), "uniform": lambda: sampling.uniform_sample_tree(dag, args.seed), "best": lambda: sampling.best_sample_tree(dag, weights, args.seed), "best-uniform": lambda: sampling.best_uniform_sample_tree(dag, weights, args.seed)}
            dag = make[args.sample]()
        if args.complete:
            dag = labels.completed(dag, labels.leaf_sets(dag))
    if args.output:
        files.write(dag, args.output)


if __name__ == "__main__":
    main()
