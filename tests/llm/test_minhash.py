import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from arbora.llm import minhash as M
from arbora.llm import textops as T
from tests.llm.conftest import words
from tests.llm.test_decontaminate import split


def weights(text):
    w = split(text)
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    """By the definition, over all pairs of elements; of weights that are all 1 it is the plain one."""
    if set(a.values()) | set(b.values()) == {1}:
        return len(a.keys() & b.keys()) / len(a.keys() | b.keys())
    total = 0.0
    for d in a.keys() & b.keys():
        total += 1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a.keys() | b.keys())
    return total


def classes(rows):
    """Class of each row, as (doc_id, text), and how many other texts it is linked with."""
    bags = {r: weights(r[1]) for r in rows}
    sequences = {r: tuple(split(r[1])) for r in rows}
    parent, links = {r: r for r in rows}, {r: set() for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(r for r in rows if bags[r]), 2):
        if sequences[a] == sequences[b] or jaccard(bags[a], bags[b]) >= 0.8:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
            if sequences[a] != sequences[b]:
                links[a].add(sequences[b])
                links[b].add(sequences[a])
    return {r: (find(r)[0], len(links[r])) for r in rows}


def edited(text, *places):
    w = text.split()
    for p in places:
        w[p] = "changed"
    return " ".join(w)


def test_exact_similarity_is_the_definition():
    draw = np.random.default_rng(1)
    for _ in range(50):
        a, b = (Counter(draw.integers(0, 30, 40).tolist()) for _ in "ab")
        cells = [np.array(x) for bag in (a, b) for x in zip(*sorted(bag.items()), strict=True)]
        assert M.probability_jaccard(*cells) == pytest.approx(jaccard(a, b))


def test_registers_estimate_the_similarity():
    a, b = words(1, 300, 60), words(1, 240, 60)
    (t,) = T.slices(pa.array([a, b]))
    row, h, weight, _ = M.weighted(t)
    z = M.probminhash(row, h, weight, 2, 4000)
    assert (z[0] == z[1]).mean() == pytest.approx(jaccard(weights(a), weights(b)), abs=0.04)
    assert (M.probminhash(row, h, weight * 3, 2, 64) == M.probminhash(row, h, weight, 2, 64)).all()  # only proportions matter


def test_blocks_decide_as_the_definition_does():
    draw = np.random.default_rng(4)
    base = words(8, 60, 40).split()
    texts = []
    for _ in range(60):
        w = list(base)
        for p in draw.integers(0, 60, draw.integers(0, 4)):
            w[p] = f"x{draw.integers(9)}"
        texts.append(" ".join(w * int(draw.integers(1, 3))) if draw.random() < 0.5 else " ".join(w))
    (t,) = T.slices(pa.array(texts))
    row, h, weight, _ = M.weighted(t)
    cells = [(h[row == k], weight[row == k]) for k in range(60)]
    i, j = M.linked(cells, cells[:50], 0.8)
    bags = [weights(x) for x in texts]
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b) for a in range(60) for b in range(50) if jaccard(bags[a], bags[b]) >= 0.8 - 1e-12}


@pytest.mark.parametrize("options", [{}, {"all_pairs": 5, "block": 16}, {"all_pairs": 10**6}])
def test_agrees_with_brute_force(spark, options):
    base = words(10, 200)
    rows = [(1, base), (2, base.upper()), (3, edited(base, 50)), (4, edited(base, 20, 90)), (5, edited(base, 10, 30, 60, 90, 120, 150, 180)), (6, words(11, 200)), (7, "a b c"), (8, "A, B, C!"), (9, "a b d"), (10, None), (11, ""), (12, "...")]
    rows += [(100 + k, edited(base, k)) for k in range(60)] + [(200, words(12, 90)), (200, edited(base, 7)), (200, words(13, 90)), (201, words(13, 90)), (3, edited(base, 60, 61))]
    rows += [(300 + k, edited(base, k, (k * 37 + 11) % 200, (k * 53 + 7) % 200)) for k in range(40)]  # some linked with each other, some not
    got = M.near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), **options)
    assert got.count() == len(rows)
    want = classes([(i, t or "") for i, t in rows])
    told = {}
    for r in got.join(spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "xxhash64(text) as text_hash"), ["doc_id", "text_hash"]).collect():
        told[r.doc_id, r.text or ""] = r.class_id, r.n_links
    assert told == want
    by = {r.doc_id: r for r in got.collect()}
    assert by[2].copy_of == 1 and by[8].class_id == 7 and by[10].kept and by[11].kept and by[12].kept
    kept = {(r.doc_id, r.text) for r in M.one_of_each(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), **options).collect()}
    assert {(200, words(12, 90)), (200, words(13, 90)), (1, base)} <= kept and not kept & {(200, edited(base, 7)), (201, words(13, 90)), (2, base.upper())}


def test_every_link_of_a_large_cluster_counts(spark):
    """300 texts, all pairs of which are links."""
    base = words(14, 250)
    rows = [(k, edited(base, k % 250, *([120] if k >= 250 else []))) for k in range(300)]
    got = M.near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), block=64)
    assert {r.n_links for r in got.collect()} == {299} and {r.class_id for r in got.collect()} == {0}


def test_odd_rows(spark, odd, none):
    got = M.near_duplicates(spark, odd)
    assert got.count() == odd.count()
    assert {r.doc_id: r.class_id for r in got.where("doc_id in (7, 8)").collect()} == {7: 7, 8: 7}
    kept = M.one_of_each(spark, odd)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == odd.columns and ids.count(9) == 1 and ids.count(10) == 2 and 8 not in ids and None in ids
    assert M.near_duplicates(spark, none).collect() == [] and M.one_of_each(spark, none).collect() == []
