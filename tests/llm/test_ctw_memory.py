"""What context-tree weighting holds in memory while it counts and scores, and that its counts are whole."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arbora.llm import ctw
from arbora.llm import textops as T


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(texts), pa.array([k % 3 > 0 for k in range(len(texts))])], names=["text", "learnt"])


def random_texts(n, size):
    draw = np.random.default_rng(5)
    return ["".join(map(chr, draw.integers(97, 123, size))) for _ in range(n)]


def test_counting_holds_little_beside_its_sums(monkeypatch):
    """Some 800,000 distinct grams are held at most, 16 bytes each; before, merging them took 76 bytes in all, and one row of each was handed on."""
    monkeypatch.setattr(T.slices, "__defaults__", (1 << 16,))
    monkeypatch.setattr(ctw, "SUMMED", 400_000)
    data = batch(random_texts(160, 10_000))
    list(ctw._counted(6)(iter([data.slice(0, 1)])))  # tables that are made once
    rows = 0
    tracemalloc.start()
    for out in ctw._counted(6)(iter([data])):
        rows += len(out)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 * 800_000
    assert rows <= 2 * ctw.SHARES * 5


@pytest.mark.parametrize("summed, shares", [(1_000_000, 2048), (50, 4), (3, 1)])
def test_counts_by_share_are_whole(summed, shares, monkeypatch):
    """Also where a share is cut by batches, or has more keys than are summed at once; a word and a gram of one key stay apart."""
    monkeypatch.setattr(ctw, "SUMMED", summed)
    monkeypatch.setattr(ctw, "SHARES", shares)
    texts = [*random_texts(6, 50), "ab ab  AB\ncd", None, "", "ab cd"]
    rows = pa.Table.from_batches([*ctw._counted(2)(iter([batch(texts[:5])])), *ctw._counted(2)(iter([batch(texts[5:])]))]).sort_by("share")
    got = Counter()
    for out in ctw._summed(iter(rows.to_batches(max_chunksize=3))):
        for r in out.to_pylist():
            assert (r["word"], r["key"]) not in got
            got[r["word"], r["key"]] = r["n"]
    want = Counter()
    for part in (texts[:5], texts[5:]):
        for k, text in enumerate(part):
            (t,) = T.slices(pa.array([text], pa.string()))
            ((_, w, gram, _),) = ctw.coded(t, 2)
            for word, keys in ((True, w.hash), (False, gram)):
                for key in keys.view(np.int64).tolist():
                    want[word, key] += k % 3 > 0
    assert got == want and set(got) == set(want)
    same = np.array([7], np.uint64), np.array([2])
    both = [*ctw.dealt(*same, True), *ctw.dealt(*same, False)]
    both.insert(1, both[0].slice(0, 0))
    assert [r for b in ctw._summed(iter(both)) for r in b.to_pylist()] == [{"word": True, "key": 7, "n": 2}, {"word": False, "key": 7, "n": 2}]


def test_batches_are_bounded_by_bytes(spark, monkeypatch):
    """While documents are scored; the session's setting stays as it was, and a bound of its own counts."""
    monkeypatch.setattr(ctw, "BATCH_BYTES", 1 << 16)
    seen = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["size"]) for b in batches)
    docs = spark.createDataFrame([(k, "some words " * 200) for k in range(400)], "doc_id bigint, text string").coalesce(1)
    largest = lambda: docs.mapInArrow(seen, "size bigint").agg(F.max("size")).first()[0]
    sizes, before = [], spark.conf.get(ctw.BOUND, None)
    monkeypatch.setattr(ctw, "_score_documents", lambda *_: sizes.append(largest()))
    ctw.score_documents(spark, docs, F.lit(True))
    assert sizes[0] < 1 << 17 < largest() and spark.conf.get(ctw.BOUND, None) == before
    spark.conf.set(ctw.BOUND, str(1 << 18))
    try:
        ctw.score_documents(spark, docs, F.lit(True))
        assert 1 << 17 < sizes[1] < 1 << 19 and spark.conf.get(ctw.BOUND) == str(1 << 18)
    finally:
        spark.conf.unset(ctw.BOUND)
