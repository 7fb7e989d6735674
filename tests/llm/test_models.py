"""Quality classifier, language identification and context-tree weighting."""

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arbora.llm import ctw, language, quality
from arbora.llm import textops as T
from tests.llm.conftest import words

SF = "/root/testdata/sf0.001"


def test_isotonic_is_monotone_and_keeps_the_mean():
    draw = np.random.default_rng(3)
    n = draw.integers(1, 9, 40)
    hits = draw.binomial(n, 0.5)
    at, rate = quality.isotonic(np.arange(40.0), n, hits)
    assert (np.diff(rate) > 0).all() and (np.diff(at) > 0).all()
    assert quality.isotonic(np.arange(3.0), np.ones(3, int), np.array([0, 1, 0]))[1].tolist() == [0.0, 0.5]


def test_statistics_by_hand():
    (t,) = T.slices(pa.array(["Ab ab!! ab\nx1", "", "é"]))
    x = quality.statistics(t)
    assert x[0, 0] == pytest.approx(math.log1p(13)) and x[0, 1] == pytest.approx(math.log1p(4)) and x[0, 3] == pytest.approx(3 / 4)
    assert x[0, 10] == pytest.approx(4 * 2 / 13) and (x[1] == 0).all() and x[2, 6] == 1.0


def test_quality_learns_and_takes_odd_rows(spark, odd, none):
    docs = spark.createDataFrame([(i, words(i, 60) if i % 3 else "SPAM!! SPAM!! " * 20) for i in range(120)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 120) if i % 2] + [(None, 1), (1, None)], "doc_id bigint, quality int")
    model = quality.learn(spark, docs, labels)
    held = quality.scored(spark, docs.where("doc_id % 2 = 0"), model).select("doc_id", "score").collect()
    assert all((r.score >= 0.5) == (r.doc_id % 3 > 0) and 0 <= r.score <= 1 for r in held)
    got = quality.scored(spark, odd, model)
    assert got.count() == odd.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    assert quality.accepted(spark, odd, labels).columns == odd.columns
    unlabelled = quality.learn(spark, docs, labels.limit(0))
    assert {r.score for r in quality.scored(spark, odd, unlabelled).collect()} == {0.5}
    assert quality.scored(spark, none, model).count() == 0


def ppm(counts, text):
    """Bits of a text by the definition, byte by byte."""
    data = bytes([10] * language.ORDER) + bytes(T.LOWER[np.frombuffer(text.encode(), np.uint8)])
    total = 0.0
    for i in range(language.ORDER, len(data)):
        for k in range(language.ORDER, -1, -1):
            seen = counts.get(data[i - k : i], {})
            n, u = sum(seen.values()), len(seen)
            if data[i] in seen:
                total -= math.log2(seen[data[i]] / (n + u))
                break
            if n:
                total -= math.log2(u / (n + u))
        else:
            total += 8
    return total


def test_code_lengths_are_the_definition(spark, odd, none):
    texts = {"aa": ["the cat and the hat", "a cat"], "bb": ["le chat et le chapeau", "É un"]}
    rows = spark.createDataFrame([(t, k) for k, ts in texts.items() for t in ts] + [("x", None), (None, "aa"), ("", "bb")], "text string, lang string")
    model = language.learn(rows)
    assert model.langs == ["aa", "bb"]
    probe = ["the chat", "zzz é", "a", "Le Chapeau et la"]
    (t,) = T.slices(pa.array(probe))
    bits = model.bits(t)
    for j, k in enumerate(model.langs):
        counts = defaultdict(lambda: defaultdict(int))
        for text in texts[k]:
            data = bytes([10] * language.ORDER) + bytes(T.LOWER[np.frombuffer(text.encode(), np.uint8)])
            for i in range(language.ORDER, len(data)):
                for o in range(language.ORDER + 1):
                    counts[data[i - o : i]][data[i]] += 1
        assert bits[:, j] == pytest.approx([ppm(counts, p) for p in probe], rel=1e-5)
    got = {r.doc_id: r.lang_pred for r in language.identify(spark, odd, model).collect()}
    assert got[2] == got[3] == got[4] == got[5] == "und" and got[1] == "aa" and got[11] in ("aa", "bb")
    assert language.identify(spark, none, model).count() == 0
    assert {r.lang_pred for r in language.identify(spark, odd, language.learn(rows.limit(0))).collect()} == {"und"}


def test_every_language_is_learnt_from_a_small_sample(spark):
    """A language of one long text, and one of a single word, among others of many texts."""
    rows = [("xx", " ".join(f"ab{k % 7}" for k in range(4000))), ("yy", "zu")] + [("zz", f"qrs tuv {k}") for k in range(500)]
    model = language.learn(spark.createDataFrame(rows, "lang string, text string"), sample_bytes=1_000, piece=200)
    assert model.langs == ["xx", "yy", "zz"]


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = language.query(spark, SF).join(docs, "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


class Tree:
    """Context-tree weighting node by node."""

    def __init__(self, texts, depth):
        self.depth, self.n, self.kids, self.weight, self.share = depth, defaultdict(lambda: [0, 0]), defaultdict(list), {}, {}
        for words in texts:
            for h, s in self.stream(words):
                u = 1
                for t in range(7, -1, -1):
                    for d in range(len(h) + 1):
                        self.n[h[len(h) - d :], u][s >> t & 1] += 1
                    u = u * 2 + (s >> t & 1)
        for h, u in self.n:
            if h:
                self.kids[h[1:], u].append((h, u))
        for k in sorted(self.n, key=lambda k: -len(k[0])):
            a, b = self.n[k]
            own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
            if self.kids[k]:
                below = sum(self.weight[x] for x in self.kids[k])
                self.weight[k] = math.log(0.5) + max(own, below) + math.log1p(math.exp(-abs(own - below)))
                self.share[k] = math.exp(math.log(0.5) + own - self.weight[k])
            else:
                self.weight[k], self.share[k] = own, 1.0

    def stream(self, words):
        h = (10,) * self.depth
        for s in [*b"".join(w + b" " for w in words), 10]:
            yield h, s
            h = (*h, s)[-self.depth :]

    def score(self, words):
        total = 0.0
        for h, s in self.stream(words):
            u = 1
            for t in range(7, -1, -1):
                mixed, left, one = 0.0, 1.0, 0.5
                for d in range(len(h) + 1):
                    if sum(self.n.get(k := (h[len(h) - d :], u), (0, 0))) == 0:
                        break
                    a, b = self.n[k]
                    kt = (b + 0.5) / (a + b + 1)
                    one = mixed + left * kt
                    mixed, left = mixed + left * self.share[k] * kt, left * (1 - self.share[k])
                bit = s >> t & 1
                total += math.log10(one if bit else 1 - one)
                u = u * 2 + bit
        return total


@pytest.mark.parametrize("held, depth, split", [(250_000, 3, 4), (3, 3, 1), (3, 5, 2), (10, 6, 4)])
def test_ctw_agrees_with_the_tree(spark, held, depth, split, monkeypatch):
    monkeypatch.setattr(ctw.byte_chances, "__defaults__", (ctw.DEPTH, split))
    texts = [(1, "the cat the hat"), (2, "The  cat\n"), (3, "a caté xyz"), (4, None), (5, ""), (6, "the unseen caté cat"), (None, "other"), (7, "caté")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = {r.doc_id: r for r in ctw.score_documents(spark, docs, F.col("doc_id") <= 5, depth=depth, held=held).collect()}
    token = lambda s: [*bytes(T.LOWER[np.frombuffer((s or "").encode(), np.uint8)]).split(), None]
    counts: dict = defaultdict(int)
    for i, t in texts[:5]:
        for w in token(t):
            counts[w] += 1
    tree, total, kinds = Tree([token(t)[:-1] for _, t in texts[:5]], depth), sum(counts.values()), len(counts)
    for i, t in texts:
        w = token(t)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts.get(x, 0) > 0 for x in w), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts.get(x, 0) + 0.5) / (total + 0.5 * (kinds + 1))) for x in w))
        assert r.score == pytest.approx(tree.score(w[:-1]), rel=1e-9)
        assert r.n_bytes == sum(len(x) + 1 for x in w[:-1]) + 1 and r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / r.n_bytes)


def test_ctw_odd_rows(spark, odd, none):
    got = ctw.score_documents(spark, odd, F.col("doc_id") != 7)
    assert got.count() == odd.count() and got.where("score is null or score >= 0 or isnan(score)").count() == 0
    assert ctw.score_documents(spark, none, F.lit(True)).count() == 0


def test_ctw_scores_better_than_the_base_and_knows_repeats(spark, monkeypatch):
    """On held-out texts of this kind, whose words are made of syllables; what was learnt takes fewer bits, also in pieces."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = ctw.query(spark, SF)
    fold = got.groupBy("held_out").agg((F.sum("score") / F.sum("n_tokens")).alias("own"), (F.sum("base_score") / F.sum("n_tokens")).alias("base"), (-F.sum("score") * math.log2(10) / F.sum("n_bytes")).alias("bits"))
    of = {r.held_out: r for r in fold.collect()}
    assert got.count() == docs.count() and of[False].bits < of[True].bits
    monkeypatch.setattr(ctw, "SUMMED", 1000)
    again = {r.doc_id: r.score for r in ctw.query(spark, SF).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score) for r in got.collect())
