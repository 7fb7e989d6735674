import time
import zlib

import numpy as np
import pytest

from arbora.llm import boilerplate, embeddings, sharding
from tests.llm.conftest import words

LONG = "The text of the article is long enough to count as it has all of the words that we look for in it."


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        (f"<nav><a href=x>Home</a></nav><article><h1>Head &amp; more</h1><p>{LONG}<br>Next\n\n line<p>Short.</article><footer>{LONG}</footer>", f"Head & more\n{LONG}\nNext line\nShort."),
        (f"<body><header>{LONG}</header><main><p>{LONG}</p><aside><p>{LONG}</p></aside><div class='user-comments'><p>{LONG}</p></div><p>End.</p></main><script>var a='<p>{LONG}</p>'</script><!-- <p>{LONG} --></body>", f"{LONG}\nEnd."),
        (f"<article><p>One</p><p><b>Two</b> &lt;x&gt; &eacute;</p></article><form>{LONG}</form><div id=cookie-notice>{LONG}</div><div class=ad>{LONG}</div>", "One\nTwo <x> é"),
        (f"<div><p>{LONG} {LONG} {LONG}</p><p>Between.</p><p>{LONG} {LONG} {LONG}</p></div><ul><li><a href=a>{LONG}</a></li></ul>", f"{LONG} {LONG} {LONG}\nBetween.\n{LONG} {LONG} {LONG}"),
        (f"<ARTICLE><P CLASS=x>{LONG}</ARTICLE><STYLE>p{{}}</STYLE>", LONG),
    ],
)
def test_main_text(page, text):
    assert boilerplate.main_text(page) == text


def test_pages(spark):
    rows = [(1, "u", f"<article><p>{LONG}</article>", "t", 5), (1, "u", None, "t", 5), (None, None, "x" * 100_000, None, None)]
    got = boilerplate.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, rest int"))
    assert got.columns == ["page_id", "url", "rest", "text", "n_chars"]
    assert sorted((r.n_chars, r.text) for r in got.collect())[:2] == [(0, ""), (0, "")] and {r.n_chars for r in got.collect()} == {0, len(LONG)}
    assert boilerplate.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


@pytest.mark.parametrize("hot, text", [(0, ""), (400, "the same text again"), (60, words(1, 300)), (300, words(1, 300)), (400, "")])
def test_shards_are_even_and_slots_have_no_gaps(spark, hot, text):
    """A group lies in one shard, or in as few as its size needs."""
    texts = [words(i % 500, 5 + i % 80) for i in range(800)] + [text] * hot + [None, "", ""]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = sharding.shard(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), ranges=64).collect()
    size, slots, where = [0] * 8, [[] for _ in range(8)], {}
    for r in got:
        t = texts[r.doc_id] or ""
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t.encode()) + 1, zlib.crc32(t.encode()), "bytes", None)
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where.setdefault(t, set()).add(r.shard)
    assert len(got) == len(texts) and all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(size) - min(size) < 0.1 * sum(size) / 8
    assert all(len(s) == 1 for t, s in where.items() if t != text) and len(where[text]) <= max(1, -(-8 * hot * len(text) // sum(size)))


@pytest.mark.parametrize("sizes, total", [([], 80), ([20, 5], 80), ([10] * 8, 80), ([9] * 8, 80), ([30, 30, 20], 80), ([7, 7, 7], 25)])
def test_large_groups_are_dealt_whole_where_they_fit(sizes, total):
    pieces, room = sharding.dealt(sizes, 8, total)
    assert [sum(n for _, n in own) for own in pieces] == sizes and sum(room) == total - sum(sizes)
    assert all(len(own) <= -(-size * 8 // total) + 1 for size, own in zip(sizes, pieces, strict=True))


def test_shards_of_odd_rows(spark, odd, none):
    got = sharding.shard(spark, odd)
    assert got.count() == odd.count() and sharding.shard(spark, none).collect() == []


def test_vectors_agree_with_brute_force(spark):
    draw = np.random.default_rng(5)
    base = draw.normal(size=(40, 16))
    x = np.concatenate([base, base[:20] + 0.1 * draw.normal(size=(20, 16)), base[:5], np.repeat(base[:1], 60, 0) + 0.15 * draw.normal(size=(60, 16))]).astype(np.float32)
    label = [int(i % 2) for i in range(40)] + [int(i % 2) for i in range(20)] + [int(i % 2) for i in range(5)] + [0] * 60
    rows = [(i, v.tolist(), y) for i, (v, y) in enumerate(zip(x, label, strict=True))]
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, x[0].tolist(), None), (904, [None] * 16, 0), (905, x[0].tolist()[:8], 0), (906, [], 0), (907, (2 * x[0]).tolist(), 0), (None, x[0].tolist(), 0)]
    got = {r.vec_id: r for r in embeddings.near_vectors(spark, spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, label int")).collect()}
    ids = [*range(len(rows)), 907]
    v = np.concatenate([x, 2 * x[:1]]).astype(float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    y = np.array([*label, 0])
    near = (v @ v.T >= 0.93) & (y[:, None] == y[None])
    np.fill_diagonal(near, False)
    low = np.arange(len(ids))
    for _ in range(len(ids)):
        low = np.minimum(low, np.where(near, low[None], len(ids)).min(1))
    for k, i in enumerate(ids):
        assert (got[i].n_links, got[i].component_id) == (near[k].sum(), ids[low[k]]) and got[i].kept == (ids[low[k]] == i)
    assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903, 904, 905, 906, None))
    assert embeddings.near_vectors(spark, spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).collect() == []


@pytest.mark.parametrize("width, spread", [(4, 0.2), (12, 0.35), (32, 1.0)])
def test_every_list_that_can_hold_a_partner_is_probed(width, spread):
    """200 lists: without any bound on their number, the lists of all pairs near each other are probed from either side."""
    draw = np.random.default_rng(width)
    x = embeddings._unit(draw.normal(size=(40, width))[draw.integers(40, size=3000)] + spread * draw.normal(size=(3000, width)))
    x[1500:] = embeddings._unit(x[:1500] + 0.25 * draw.normal(size=(1500, width)) / np.sqrt(width))
    index = embeddings.Index.fit(x, 200)
    at = index.coded(x)[0]
    row, lists = index.probes(x, at, np.sqrt(2 - 2 * embeddings.COSINE))
    tried = np.zeros((len(x), 200), bool)
    tried[row, lists] = True
    i, j = np.nonzero(x @ x.T >= embeddings.COSINE)
    assert tried[i, at[j]].mean() > 0.999 and (at[i] != at[j]).any() and tried[np.arange(len(x)), at].all()


def test_vectors_of_many_lists_agree_with_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "LIST_SIZE", 2)
    draw = np.random.default_rng(9)
    x = (np.eye(16)[0] + 0.27 * draw.normal(size=(900, 16)) / 4).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(spark, spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()}
    v = embeddings._unit(x.astype(float))
    assert [got[i] for i in range(900)] == ((v @ v.T >= 0.93).sum(1) - 1).tolist()


def test_density_and_length_decide(monkeypatch):
    """Without any tag or class that is known, dense blocks stay and others go; short ones follow what stands around them."""
    for name in ("OUTER", "INNER"):
        monkeypatch.setattr(boilerplate, name, frozenset())
    codes = "xk7 qq0 zv19 " * 20
    page = f"<ul><li><a href=a>Home</a><li><a href=b>All of the things</a></ul><div><p>{LONG} {LONG} {LONG}</p><p>Short.</p><p>{LONG} {LONG} {LONG}</p></div><div>{codes}</div><p>Short too.</p><div>{codes}</div>"
    assert boilerplate.main_text(page) == f"{LONG} {LONG} {LONG}\nShort.\n{LONG} {LONG} {LONG}"
    monkeypatch.setattr(boilerplate, "ALL_STOP", frozenset())
    assert boilerplate.main_text(page) == ""


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<article><p>{LONG} <span class=ad>buy</span>and on</p></article>", f"{LONG} and on"),
        (f"<article><p><span class=ad>buy</span>{LONG}</p></article>", LONG),
        (f"<html data-x='{'y' * 5000}' lang=de><p>{LONG * 4}</p>", ""),  # of few words that are frequent in German
        (f"<article><p title='a > b'>{LONG}</p><p title=\"never closed>Here.</p></article>", f"{LONG}\nHere."),
        (f"<article><![CDATA[a < b]]><p>1 < 2 <3</p><!-- <p>no</p> --><p>{LONG}</article>", f"a < b\n1 < 2 <3\n{LONG}"),
    ],
)
def test_pieces_and_broken_tags(page, text):
    assert boilerplate.main_text(page) == text


@pytest.mark.parametrize("bad", ['<p title="x ', "<b><i><div>", "</span><div>", "<!-- ", "<a href='\"'", "<", "<html lang="])
def test_time_follows_the_length_of_a_page(bad):
    began = time.process_time()
    boilerplate.main_text(bad * (500_000 // len(bad)))
    assert time.process_time() - began < 5


@pytest.mark.parametrize("hot", [1.0, 0.1])
def test_recall_where_few_lists_are_probed(hot):
    """80 lists, of which a vector probes a part; codes of members rule out none of the partners."""
    draw = np.random.default_rng(12)
    x = embeddings._unit(draw.normal(size=(120, 24))[draw.integers(120, size=4000)] + hot * 0.3 * draw.normal(size=(4000, 24)))
    index, reach = embeddings.Index.fit(x, 80), np.sqrt(2 - 2 * embeddings.COSINE)
    at, codes, error = index.coded(x)
    row, lists = index.probes(x, at, reach)
    assert len(row) < 0.5 * 80 * len(x)
    found, near = 0, (x @ x.T >= embeddings.COSINE) & ~np.eye(len(x), dtype=bool)
    for k in range(80):
        asks, holds = row[lists == k], np.flatnonzero(at == k)
        close = index.distances(x[asks], k, codes[holds]) <= reach + error[holds] + 1e-6
        found += (close & near[np.ix_(asks, holds)]).sum()
    assert found > 0.999 * near.sum() > 0


def test_doubles_repeated_ids_and_other_columns(spark):
    rows = [(1, [1e39, 0.0], 0, "x", 1), (2, [2e39, 1e37], 0, "y", 2), (2, [0.0, 1.0], 0, "z", 3), (3, [0.1, 5.0], 0, None, None)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>, label bigint, same string, copies int")
    got = sorted((r.vec_id, r.n_links) for r in embeddings.near_vectors(spark, df).collect())
    assert got == [(1, 1), (2, 1), (2, 1), (3, 1)]


def _low_rank(draw, directions: int, width: int, n: int) -> np.ndarray:
    """Groups of four near vectors that lie near few directions."""
    basis = np.linalg.qr(draw.normal(size=(width, directions)))[0].T
    base = np.repeat(draw.normal(size=(n // 4, directions)), 4, 0)
    return embeddings._unit((base + 0.18 * draw.normal(size=base.shape)) @ basis + 1e-3 * draw.normal(size=(n, width)))


@pytest.mark.parametrize("directions, width, lists", [(4, 64, 200), (8, 256, 20), (12, 256, 200), (8, 768, 200)])
def test_no_link_is_lost_near_few_directions(directions, width, lists):
    x = _low_rank(np.random.default_rng(directions), directions, width, 4000)
    index = embeddings.Index.fit(x, lists)
    at = index.coded(x)[0]
    row, tried = index.probes(x, at, np.sqrt(2 - 2 * embeddings.COSINE))
    probed = np.zeros((len(x), len(index.lists)), bool)
    probed[row, tried] = True
    i, j = np.nonzero((x @ x.T >= embeddings.COSINE) & ~np.eye(len(x), dtype=bool))
    assert (probed[i, at[j]] | probed[j, at[i]]).mean() > 0.999 and (at[i] != at[j]).any()


@pytest.mark.parametrize("spread", [None, 0.05])
def test_degrees_are_equal_at_both_ends(spark, monkeypatch, spread):
    """spread=None loses nothing; where a narrow one lets one side alone find a link, it counts at both ends."""
    monkeypatch.setattr(embeddings, "LIST_SIZE", 30)
    x = _low_rank(np.random.default_rng(3), 6, 32, 900)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: r for r in embeddings.near_vectors(spark, df, spread=spread).collect()}
    near = (x @ x.T >= embeddings.COSINE) & ~np.eye(len(x), dtype=bool)
    links = np.array([got[i].n_links for i in range(len(x))])
    if spread is None:
        assert (links == near.sum(1)).all()
    else:
        index = embeddings.Index.fit(x, 30, spread=spread)
        assert links.sum() % 2 == 0 and (links <= near.sum(1)).all() and 0 < links.sum() < near.sum() and len(index.lists) == 30
