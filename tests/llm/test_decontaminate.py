import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arbora.llm import decontaminate as D
from arbora.llm import textops as T
from tests.llm.conftest import words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = split(t)
        n = min(10, len(w))
        if i is not None and n:
            for k in range(len(w) - n + 1):
                windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[x]
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def run(spark, docs, items, **options):
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in D.decontaminate(spark, docs, items, **options).collect()), key=str)


def test_agrees_with_brute_force(spark):
    passage = words(5, 40, 50)
    items = [(1, passage), (2, words(6, 25, 50)), (3, "short item of five"), (3, "another one"), (4, "w1"), (5, None), (6, "--"), (None, passage), (7, passage)]
    docs = [(0, words(7, 300, 50)), (1, f"Begin {passage} end"), (2, passage[20:]), (3, "A Short, item... OF five!"), (4, None), (5, ""), (6, "w1 w2"), (7, " ".join(passage.split()[:9])), (8, " ".join(passage.split()[3:13]).upper()), (8, "w1")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert run(spark, df, items_of(spark, items)) == brute(docs, items)
    kept = D.without_leaks(spark, df, items_of(spark, items)).collect()
    assert sorted(map(str, kept)) == sorted(str(r) for r in df.collect() if not brute([(r.doc_id, r.text)], items)[0][2])


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    items = [(1, words(3, 120)), (2, "one")]
    assert run(spark, odd, items_of(spark, items)) == brute(rows, items)
    assert all(r[2] == 0 for r in run(spark, odd, items_of(spark, [])))
    assert run(spark, none, items_of(spark, items)) == []
    kept = D.without_leaks(spark, odd, items_of(spark, items))
    assert kept.columns == odd.columns and kept.count() == 11


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(0, 45))
def test_every_window_has_a_common_fingerprint(tail, at):
    a = [f"v{x}" for x in tail] + ["q", "r", "s"]
    b = a[at : at + 10]
    (t,) = T.slices(pa.array([" ".join(a), " ".join(b)]))
    w = T.words(t)
    place, prints = D.fingerprints(w, 10, 5)
    mine, theirs = ({int(h) for h, d in zip(prints, w.doc[place], strict=True) if d == k} for k in (0, 1))
    assert len(b) < 10 or mine & theirs
    inside = {int(h) for p, h in zip(place, prints, strict=True) if w.doc[p] == 0 and at <= p <= at + 5}
    assert len(b) < 10 or inside & theirs
