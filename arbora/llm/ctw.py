"""Language-model scores of documents by context-tree weighting (CTW) over bytes.

A text is a row of tokens: its words (runs of bytes other than white space, A-Z lower-cased), each closed by a space, and
one end. A byte is predicted from the DEPTH bytes before it, across words; before the text stand ends.
It is coded as eight binary decisions, most significant bit first; each decision has a context tree of its own,
in every node of which a Krichevsky-Trofimov (KT) estimate counts what followed. Weighting mixes the
estimates of all depths: bottom-up, a node's probability is half its own estimate's and half the product of its children's;
top-down, with the counts frozen, these give the weight of each depth along a context. A context that the
training texts lack ends the mixture at its longest suffix that they have, so a decision's two chances always add up to 1.

A byte's chance depends on its context and itself only, which together are a gram. So counts go from texts to distinct grams, summed
within tasks first (and sent on as arrays, a row for each of SHARES shares of the keys), from these to tree nodes, and scores come back the same way: in tasks of whole contexts below depth SPLIT, and by
joins level by level above it. The grams (and words, for the base) that occur most are looked up in a broadcast table of at most HELD entries; all
others are joined.

Words are known by a 64-bit hash. Defined cases: a null text is empty, that is one end token; rows with a null doc_id
are scored but not learnt from; with nothing to learn from, every decision has chance 1/2 and base counts are 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm import textops as T
from arbora.session import persisted

DEPTH = 6
#: Depth of the contexts below which a task works out all.
SPLIT = 4
HELD = 2_000_000
#: Distinct grams that a task sums up before it hands them on.
SUMMED = 2_000_000
#: Shares by hash that grams, and words, are dealt into to be summed; a share's distinct keys are in memory together.
SHARES = 2048
SPACE, END = 0x20, 0x0A
#: Bytes of the batches that go to and from a worker, unless the session has a bound of its own; several are in memory together.
BATCH_BYTES, BOUND = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Texts that are coded together: their number has a byte beside a gram of 7 bytes.
TEXTS = 256


def streams(t: T.Texts, w: T.Words) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts as they are coded, and where each text's begin (with the end as last); w: their words."""
    size = w.end - w.start
    at = np.append(0, np.cumsum(np.bincount(w.doc, weights=size + 1, minlength=len(t)).astype(np.int64) + 1))
    out = np.full(at[-1], SPACE, np.uint8)
    out[at[1:] - 1] = END
    place = np.cumsum(size + 1) - size - 1 + w.doc  # each text before has an end
    kept = np.flatnonzero(~T.BLANK_BYTES[t.data])
    out[np.repeat(place - np.cumsum(size) + size, size) + np.arange(len(kept))] = T.LOWER[t.data[kept]]
    return out, at


def text_grams(stream: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """context << 8 | byte of each byte; the last byte of a context is its lowest."""
    gram, shifted = stream.astype(np.uint64), stream
    for k in range(1, depth + 1):
        shifted = np.concatenate([np.full(1, END, np.uint8), shifted[:-1]])
        shifted[at[:-1]] = END
        gram |= shifted.astype(np.uint64) << np.uint64(8 * k)
    return gram


def coded(texts: T.Texts, depth: int) -> Iterator[tuple[T.Texts, T.Words, np.ndarray, np.ndarray]]:
    """Runs of at most TEXTS texts: themselves, their words, their grams and where each text's begin."""
    for lo in range(0, len(texts), TEXTS):
        hi = min(lo + TEXTS, len(texts))
        at = texts.at[lo : hi + 1]
        t = T.Texts(texts.lo + lo, texts.lo + hi, texts.data[at[0] : at[-1]], at - at[0])
        w = T.words(t, ~T.BLANK_BYTES)
        stream, begin = streams(t, w)
        yield t, w, text_grams(stream, begin, depth), begin


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of at most BATCH_BYTES for what is run meanwhile."""
    if spark.conf.get(BOUND, None) is not None:
        yield
        return
    spark.conf.set(BOUND, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(BOUND)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, and the sum of its counts. Empties `parts`: they needn't be in memory beside the result."""
    key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    order = np.argsort(key)
    key = key[order]
    n = n[order]
    del order
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[begin], np.add.reduceat(n, begin) if len(key) else n


def dealt(key: np.ndarray, n: np.ndarray, word: bool) -> Iterator[pa.RecordBatch]:
    """Rows of a share (words' before grams'), its keys and their counts."""
    share = np.empty(len(key), np.uint16)
    for lo in range(0, len(key), 1 << 16):
        share[lo : lo + (1 << 16)] = T.mix(key[lo : lo + (1 << 16)]) % np.uint64(SHARES)
    cut = np.append(0, np.cumsum(np.bincount(share, minlength=SHARES)))
    order = np.argsort(share, kind="stable")
    key = key[order].view(np.int64)
    n = n[order]
    del order, share
    for lo in range(0, SHARES, 64):
        at = cut[lo : lo + 65]
        lists = [pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), pa.array(x[at[0] : at[-1]])) for x in (key, n)]
        if len(lists[0].values):
            rows = pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + len(at) - 1, dtype=np.int32) + (0 if word else SHARES)), *lists], names=["share", "keys", "times"])
            yield rows.filter(pa.array(np.diff(at) > 0))


class Sums:
    """Counts by key, of few enough keys at a time."""

    def __init__(self, word: bool):
        self.word, self.parts, self.size = word, [], 0

    def add(self, key: np.ndarray, learnt: np.ndarray) -> None:
        """One occurrence of each key, counted if learnt."""
        both = np.sort(key[learnt]), np.sort(key[~learnt])
        for k, counts in zip(both, (True, False), strict=True):
            begin = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
            self.parts.append((k[begin], np.diff(np.append(begin, len(k))) * counts))
            self.size += len(begin)

    def batches(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        """What is to be handed on: all at the end, before it only if the keys have become too many."""
        if self.parts and (last or self.size > 2 * SUMMED):
            self.parts.append(merged(self.parts))
            self.size = len(self.parts[0][0])
            if last or self.size > SUMMED:
                self.size = 0
                yield from dealt(*self.parts.pop(), self.word)


def _counted(depth: int):
    """Words by hash, and grams, and how often each occurs in training texts, by share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams = Sums(True), Sums(False)
        for batch in batches:
            learnt = batch.column("learnt").to_numpy(zero_copy_only=False)
            for texts in T.slices(batch.column("text")):
                for t, w, gram, at in coded(texts, depth):
                    own = learnt[t.lo : t.hi]
                    words.add(w.hash, own[w.doc])
                    grams.add(gram, np.repeat(own, np.diff(at)))
                for sums in (words, grams):
                    yield from sums.batches()
        for sums in (words, grams):
            yield from sums.batches(True)
        T.release()

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _counted in order of share: each key once."""
    parts, size, most, now = [], 0, 2 * SUMMED, None
    ready: list[pa.RecordBatch] = []

    def closed() -> pa.RecordBatch:
        key, n = merged(parts)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), now < SHARES)), pa.array(key), pa.array(n)], names=["word", "key", "n"])

    for batch in batches:
        share = batch.column("share").to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], share[1:] != share[:-1], [True]])) if len(share) else np.zeros(1, np.int64)
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if share[lo] != now:
                if parts:
                    ready.append(closed())
                size, most, now = 0, 2 * SUMMED, share[lo]
            key, n = (batch.column(c).slice(lo, hi - lo).flatten().to_numpy() for c in ("keys", "times"))
            parts.append((key, n))
            size += len(key)
            if size > most:
                parts.append(merged(parts))
                size = len(parts[0][0])
                most = 2 * max(size, SUMMED)
        if sum(map(len, ready)) >= 1 << 16:
            yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
            ready = []
    if parts:
        ready.append(closed())
    if ready:
        yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
    T.release()


def log_gamma(z, log=np.log):
    """Stirling's series six places up, brought back down; of columns with F.log."""
    y = z + 6
    low = reduce(lambda p, k: p * (z + k), range(1, 6), z)
    return (y - 0.5) * log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - 1 / (1680 * y * y * y * y * y * y * y) - log(low)


def estimated(a, b, log=np.log):
    """Log of the KT estimate of a zeros and b ones."""
    return log_gamma(a + 0.5, log) + log_gamma(b + 0.5, log) - log_gamma(a + b + 1, log) - math.log(math.pi)


def _mask(d: int) -> int:
    return (1 << 8 * (d + 1)) - 1


class Subtrees:
    """The nodes from depth `split` down of all contexts that are suffixed by some of that depth, of all these contexts' grams.

    A node is context << 8 | bits so far (after a leading 1).
    """

    def __init__(self, gram: np.ndarray, n: np.ndarray, split: int, depth: int):
        """gram: distinct."""
        t = np.arange(8)
        byte = (gram & 255)[:, None]
        path = ((gram >> 8) << 8)[:, None] | (1 << t) | (byte >> (8 - t))
        self.bit = (byte >> (7 - t)) & 1
        node, self.at = np.unique(path.ravel(), return_inverse=True)
        n, bit = np.repeat(n, 8).astype(float), self.bit.ravel()
        a, b = (np.bincount(self.at, weights=n * (bit == k), minlength=len(node)) for k in (0, 1))
        weighted = estimated(a, b)
        # By depth, the deepest first: zeros, ones, share of the own estimate, and which node of the next depth stands above.
        self.levels, share = [], np.ones(len(node))
        for d in range(depth - 1, split - 1, -1):
            node, up = np.unique(node & _mask(d), return_inverse=True)
            self.levels.append((a, b, share, up))
            a, b, below = (np.bincount(up, weights=x, minlength=len(node)) for x in (a, b, weighted))
            own = estimated(a, b)
            weighted = math.log(0.5) + np.logaddexp(own, below)
            share = np.exp(math.log(0.5) + own - weighted)
        self.node, self.a, self.b, self.weighted = node, a, b, weighted

    def chances(self, mixed: np.ndarray, left: np.ndarray, one: np.ndarray) -> np.ndarray:
        """log10 of each gram's chance, given what the nodes of depth `split` have."""
        for a, b, share, up in reversed(self.levels):
            kt = (b + 0.5) / (a + b + 1)
            mixed, left, one = mixed[up], left[up], one[up]
            one = np.where(a + b > 0, mixed + left * kt, one)
            mixed, left = mixed + left * share * kt, left * (1 - share)
        one = one[self.at].reshape(self.bit.shape)
        return np.log10(np.where(self.bit == 1, one, 1 - one)).sum(1)


def _grouped(batches: Iterator[pa.RecordBatch], least: int = 100_000) -> Iterator[pa.Table]:
    """Rows in order of `context`: tables of whole contexts, of `least` rows or more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= least:
            table = pa.Table.from_batches(held).combine_chunks()
            context = table["context"].to_numpy()
            cut = int(np.searchsorted(context, context[-1]))
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
    if sum(map(len, held)):
        yield pa.Table.from_batches(held).combine_chunks()


def _up(split: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches):
            t = Subtrees(table["key"].to_numpy(), table["n"].to_numpy(), split, depth)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (t.node, t.a, t.b, t.weighted)], names=["node", "a", "b", "weighted"])
        T.release()

    return run


def _down(split: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches):
            top = table["n"].is_null().to_numpy()
            key, n = table["key"].to_numpy()[~top], table["n"].drop_null().to_numpy()
            t = Subtrees(key, n, split, depth)
            order = np.argsort(table["key"].to_numpy()[top])  # the nodes of Subtrees are in order, too
            chance = t.chances(*(table[c].to_numpy()[top][order] for c in ("mixed", "left", "one")))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(chance)], names=["gram", "n", "chance"])
        T.release()

    return run


def byte_chances(grams: DataFrame, depth: int = DEPTH, split: int = SPLIT) -> DataFrame:
    """grams: gram, n; distinct. Returns gram, n, chance: log10 of the byte's probability after its context.

    What lies deeper than `split` is worked out in tasks of whole contexts of that depth, twice: up to their root, and down
    again once these have been brought together up to depth 0 and down by joins.
    """
    split = min(split, depth)
    context = F.shiftright("gram", 8).bitwiseAND(_mask(split - 1))
    rows = grams.select(context.alias("context"), F.col("gram").alias("key"), "n")
    a, b = F.col("a"), F.col("b")
    kt = (b + 0.5) / (a + b + 1)
    last = rows.repartition("context").sortWithinPartitions("context").mapInArrow(_up(split, depth), "node bigint, a double, b double, weighted double")
    share = F.lit(1.0) if split == depth else F.exp(math.log(0.5) + estimated(a, b, F.log) - F.col("weighted"))
    levels = [persisted(last.withColumn("share", share), f"level{split}")]
    for d in range(split - 1, -1, -1):
        here = levels[-1].groupBy(F.col("node").bitwiseAND(_mask(d)).alias("node")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("weighted").alias("below"))
        here = here.withColumn("own", estimated(a, b, F.log))
        low, high = F.least("own", "below"), F.greatest("own", "below")
        here = here.withColumn("weighted", math.log(0.5) + high + F.log1p(F.exp(low - high)))
        levels.append(persisted(here.select("node", "a", "b", "weighted", F.exp(math.log(0.5) + F.col("own") - F.col("weighted")).alias("share")), f"level{d}"))
    upper = None
    for d, here in enumerate(reversed(levels)):
        if upper is None:
            here = here.select("*", F.lit(0.0).alias("mixed"), F.lit(1.0).alias("left"), F.lit(0.5).alias("upper"))
        else:
            here = here.join(upper, here["node"].bitwiseAND(_mask(d - 1)) == upper["above"]).drop("above")
        one = F.when(a + b > 0, F.col("mixed") + F.col("left") * kt).otherwise(F.col("upper"))
        here = persisted(here.select("node", one.alias("one"), (F.col("mixed") + F.col("left") * F.col("share") * kt).alias("mixed"), (F.col("left") * (1 - F.col("share"))).alias("left")), f"down{d}")
        upper = here.select(F.col("node").alias("above"), "mixed", "left", F.col("one").alias("upper"))
    nothing = F.lit(None).cast("double")
    top = here.select(F.shiftright("node", 8).alias("context"), F.col("node").alias("key"), F.lit(None).cast("bigint").alias("n"), "mixed", "left", "one")
    both = rows.select("*", nothing.alias("mixed"), nothing.alias("left"), nothing.alias("one")).unionByName(top)
    return both.repartition("context").sortWithinPartitions("context").mapInArrow(_down(split, depth), "gram bigint, n bigint, chance double")


def _most(df: DataFrame, held: int) -> tuple[DataFrame, bool]:
    """The rows of largest n, at most `held` of them, and whether these are all."""
    steps = df.groupBy(F.floor(F.log2(F.col("n") + 1.0) * 8).cast("int").alias("step")).count().collect()
    total, least = 0, None
    for step, count in sorted(steps, reverse=True):
        if total + count > held:
            break
        total, least = total + count, step
    if least is None:
        return df.limit(0), not steps
    return df.where(F.floor(F.log2(F.col("n") + 1.0) * 8) >= least), total == sum(c for _, c in steps)


def _table(df: DataFrame, key: str, *values: str) -> tuple[np.ndarray, ...]:
    """Arrays in order of key."""
    table = df.select(key, *values).toArrow()
    order = np.argsort(table[key].to_numpy())
    return tuple(table[c].to_numpy()[order] for c in (key, *values))


def _scored(known_words, known_grams, depth: int):
    def looked_up(key: np.ndarray, row: np.ndarray, rows: int, table: np.ndarray, values: list[np.ndarray]):
        """Sums of the values over each row's known keys; and the unknown ones, with how often each occurs, as lists."""
        own, at = np.unique(key, return_inverse=True)
        i, known = T.member(own, table)
        i, found = i[at], known[at]
        sums = [np.bincount(row[found], weights=v[i[found]], minlength=rows).astype(float) for v in values]
        rest, owner = key[~found], row[~found]
        order = np.lexsort((rest, owner))
        rest, owner = rest[order], owner[order]
        begin = np.flatnonzero(np.append(True, (rest[1:] != rest[:-1]) | (owner[1:] != owner[:-1]))) if len(rest) else np.zeros(0, np.int64)
        cut = pa.array(np.searchsorted(owner[begin], np.arange(rows + 1)).astype(np.int32))
        times = np.diff(np.append(begin, len(rest))).astype(np.int32)
        return sums, [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (rest[begin], times)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, base = known_words.value
        grams, chance = known_grams.value
        for batch in batches:
            for texts in T.slices(batch.column("text")):
                for t, w, gram, at in coded(texts, depth):
                    rows = len(t)
                    (n_known, base_score), more_words = looked_up(w.hash.view(np.int64), w.doc, rows, words, [seen, base])
                    # In order of gram, which spares searching far in the table; of the row within it.
                    own = np.sort(gram << np.uint64(8) | np.repeat(np.arange(rows, dtype=np.uint64), np.diff(at)))
                    begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))  # a text has its end at least
                    times = np.diff(np.append(begin, len(own)))
                    row, key = (own[begin] & np.uint64(255)).astype(np.uint8), (own[begin] >> np.uint64(8)).view(np.int64)
                    i, found = T.member(key, grams)
                    score = np.bincount(row[found], weights=times[found] * chance[i[found]], minlength=rows).astype(float)
                    rest = np.flatnonzero(~found)
                    rest = rest[np.argsort(row[rest], kind="stable")]
                    cut = pa.array(np.searchsorted(row[rest], np.arange(rows + 1)).astype(np.int32))
                    more_grams = [pa.ListArray.from_arrays(cut, pa.array(x[rest])) for x in (key, times.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(c).slice(t.lo, rows) for c in ("row", "doc_id")] + [pa.array(w.counts + 1), pa.array(np.diff(at)), pa.array(n_known.astype(np.int64)), pa.array(base_score), pa.array(score), *more_words, *more_grams],
                        names=["row", "doc_id", "n_tokens", "n_bytes", "n_known", "base_score", "score", "words", "word_times", "grams", "gram_times"],
                    )

    return run


SCORED = "row bigint, doc_id bigint, n_tokens bigint, n_bytes bigint, n_known bigint, base_score double, score double, words array<bigint>, word_times array<int>, grams array<bigint>, gram_times array<int>"


def score_documents(spark: SparkSession, docs: DataFrame, learnt: Column, depth: int = DEPTH, held: int = HELD) -> DataFrame:
    """Per document: row, doc_id, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte. `learnt`: which documents to learn from. depth: at most 6."""
    if not 0 <= depth <= 6:
        raise ValueError("a gram of more than 7 bytes does not fit beside the number of its text")
    with bounded_batches(spark):
        return _score_documents(spark, docs, learnt, depth, held)


def _score_documents(spark: SparkSession, docs: DataFrame, learnt: Column, depth: int, held: int) -> DataFrame:
    rows = docs.select("doc_id", "text", F.coalesce(learnt, F.lit(False)).alias("learnt"))
    shares = rows.select("text", "learnt").mapInArrow(_counted(depth), "share int, keys array<bigint>, times array<bigint>").repartition("share").sortWithinPartitions("share")
    counted = persisted(shares.mapInArrow(_summed, "word boolean, key bigint, n bigint"), "counted")
    words = counted.where("word").select(F.col("key").alias("word"), "n")
    texts = rows.where("learnt").count()
    sums = words.agg(F.sum("n").alias("n"), F.sum((F.col("n") > 0).cast("bigint")).alias("kinds")).first()
    total, kinds = (sums["n"] or 0) + texts, (sums["kinds"] or 0) + (texts > 0)
    grams = counted.where("not word").select(F.col("key").alias("gram"), "n")
    chances = persisted(byte_chances(grams, depth), "chances")
    base = F.log10((F.col("n") + 0.5) / (total + 0.5 * (kinds + 1)))
    end_base = math.log10((texts + 0.5) / (total + 0.5 * (kinds + 1)))
    words = words.select("word", (F.col("n") > 0).alias("seen"), base.alias("base"), "n")
    (top_words, all_words), (top_grams, all_grams) = _most(words, held), _most(chances, held)
    known = [spark.sparkContext.broadcast(x) for x in (_table(top_words, "word", "seen", "base"), _table(top_grams, "gram", "chance"))]
    out = persisted(rows.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_scored(*known, depth), SCORED), "scored")
    more = {c: F.col(c) for c in ("n_known", "base_score", "score")}
    if not (all_words and all_grams):
        zipped = lambda keys, times, name: out.select("row", F.explode(F.arrays_zip(keys, times)).alias("x")).select("row", F.col(f"x.{keys}").alias(name), F.col(f"x.{times}").alias("k"))
        rare = zipped("words", "word_times", "word").join(words, "word").select("row", F.when(F.col("seen"), F.col("k")).otherwise(0).alias("k"), (F.col("k") * F.col("base")).alias("b"), F.lit(0.0).alias("s"))
        rare = rare.unionAll(zipped("grams", "gram_times", "gram").join(chances, "gram").select("row", F.lit(0).alias("k"), F.lit(0.0).alias("b"), (F.col("k") * F.col("chance")).alias("s")))
        out = out.join(rare.groupBy("row").agg(F.sum("k").alias("k"), F.sum("b").alias("b"), F.sum("s").alias("s")), "row", "left")
        more = {c: F.col(c) + F.coalesce(F.col(x), F.lit(0)) for c, x in (("n_known", "k"), ("base_score", "b"), ("score", "s"))}
    score = more["score"].alias("score")
    out = out.select("row", "doc_id", "n_tokens", (more["n_known"] + F.lit(int(texts > 0))).alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"), (more["base_score"] + end_base).alias("base_score"), score, "n_bytes")
    return out.withColumn("bits_per_byte", -F.col("score") * math.log2(10) / F.col("n_bytes"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    return score_documents(spark, docs, fold != 1).select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")
