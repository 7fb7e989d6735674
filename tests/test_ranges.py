"""Moves of leaves scored as one: against the moves' own rows, and sums over pairs by brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.model import from_rows
from arbora.operators import ranges, search
from arbora.plans import adapter, catalog


def rows(df):
    return sorted(tuple(r) for r in df.select("dag_id", "distance", "moves", "best", "worst").collect())


@pytest.mark.parametrize("seed", range(4))
def test_spans_of_all_pairs(seed):
    draw = np.random.default_rng(seed)
    cells = draw.integers(-3, 3, (5, 16, 16)) * (draw.random((5, 16, 16)) < 0.4)
    a, b = draw.choice([1, 2, 4, 8, 15], (300, 5)).astype(np.uint8), draw.choice([1, 2, 4, 9], (200, 5)).astype(np.uint8)
    all_pairs = lambda a, b: cells[np.arange(5), a[:, None], b[None]].sum(2)
    want = all_pairs(a, b)
    assert ranges.spans(cells, a, b) == (want.min(), want.max())
    one = np.arange(0, 300, 2)
    want = all_pairs(a, a).astype(float)
    want[one, one] = np.nan
    assert ranges.spans(cells, a, a, one) == (np.nanmin(want), np.nanmax(want))
    assert ranges.spans(cells, a[:1], a[:1], np.array([0])) is None


def random_trees(spark, n):
    letters, dags = "ACGTN", []
    for seed in range(n):
        draw = np.random.default_rng(seed)
        edges, open_, size = [(0, 1, 0)], [1], 2
        while open_ and size < 40:
            node = open_.pop(int(draw.integers(len(open_))))
            kids = range(size, size := size + int(draw.integers(2, 9)))
            edges += [(node, c, k) for k, c in enumerate(kids)]
            open_ += [c for c in kids if draw.random() < 0.4]
        # Some leaves are copies; inner genomes are not the best ones.
        texts = ["".join(letters[x] for x in draw.choice(5, 6, p=[0.3, 0.25, 0.2, 0.2, 0.05])) for _ in range(size)]
        inner = {p for p, _, _ in edges}
        own = {i: (texts[i].replace("N", "C") if i in inner else texts[i // 2 if seed % 2 else i]) for i in range(1, size)}
        dags.append(from_rows(spark, "ACGTAC", edges, own, dag_id=str(seed)))
    return dags[0].union(*dags[1:]).persisted("random")


@pytest.mark.parametrize(("radius", "block"), [(3, 2), (5, 3)])
def test_ranges_are_those_of_the_moves(spark, radius, block):
    dag = random_trees(spark, 5)
    each = search.move_changes(dag, search.proposals(dag, radius))
    want = rows(each.groupBy("dag_id", "distance").agg(F.count("*").alias("moves"), F.min("change").alias("best"), F.max("change").alias("worst")))
    assert rows(ranges.move_ranges(dag, radius, block)) == want and len(want) >= 10


def test_many_moves_are_few_rows(spark, tmp_path):
    """A node's leaves are scored as one: twice the leaves have four times the moves, and no more rows of them."""
    made, keep = {}, ranges.persisted
    for n in (300, 600):
        sizes = []
        ranges.persisted = lambda df, name, sizes=sizes: (out := keep(df, name), sizes.append(out.count()) if name == "classes-of-moves" else None)[0]
        try:
            t = adapter.trees(adapter.customers(spark, "/root/testdata/sf0.01", f"c_custkey <= {n}"), {"A": ("s",)})
            made[n] = (sum(r.moves for r in ranges.move_ranges(t, 3).collect()), *sizes)
        finally:
            ranges.persisted = keep
    assert made[300][1] == made[600][1] < 100 and made[600][0] > 3 * made[300][0]


def test_no_customers_no_moves(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/customer.parquet").limit(0).write.parquet(str(tmp_path / "customer.parquet"))
    assert catalog.queries()["spr_moves"](spark, str(tmp_path)).collect() == []
