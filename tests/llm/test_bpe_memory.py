"""What a worker holds in memory while it encodes, and that what it remembers and how it merges changes no ids."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from arbora.llm import bpe
from tests.llm.test_bpe import PATH, RANKS, REAL

with open(PATH, "rb") as f:
    FILE = SimpleNamespace(value=f.read())


def random_texts(n, words):
    draw = np.random.default_rng(7)
    return [" ".join(map("".join, draw.choice(list("abcdefghijklmnopqrstuvwxyz"), (words, 8)))) for _ in range(n)]


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array([None] * len(texts), pa.int32())], names=["doc_id", "text", "rest"])


def test_a_worker_holds_little():
    """Some 200,000 distinct pre-tokens, each remembered once; before, with their decoded bytes too, 52 MB were held."""
    whole, data = bpe._whole(FILE, public_tokenizers.PATTERN, True), batch(random_texts(400, 500))
    list(whole(iter([data.slice(0, 1)])))  # the ranks
    rows = 0
    tracemalloc.start()
    for out in whole(iter([data])):
        rows += len(out)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    bpe._forget()
    assert rows == 400 and peak < 45e6


@pytest.mark.parametrize("remembered, short, ids", [(4, 32, 1 << 16), (4, 0, 3), (100, 6, 1)])
def test_what_is_remembered_and_how_merges_are_found_changes_no_ids(remembered, short, ids, monkeypatch):
    for name, value in (("REMEMBERED", remembered), ("SHORT", short), ("IDS", ids)):
        monkeypatch.setattr(bpe, name, value)
    codec, draw = bpe.Codec(RANKS, public_tokenizers.PATTERN), random.Random(5)
    for text in [*random_texts(2, 40), "", "aaaa" * 40, "an an an the an the", *("".join(draw.choice("aeth é字\n1'") for _ in range(draw.randrange(90))) for _ in range(200))]:
        pieces = codec.pattern.findall(text)
        decimal, raw, found = codec.encoded(pieces)
        assert found.tolist() == REAL.encode_ordinary(text) and raw == text.encode() and decimal == " ".join(map(str, found))
        assert len(codec.ids) + len(codec.ids.before) <= remembered and not any(len(p.encode()) > bpe.LONGEST for p in codec.ids)


def test_chunks_are_handed_on_by_few():
    parts = [f"chunk {k}" for k in range(50)]
    data = pa.RecordBatch.from_arrays([pa.array([1] * 50), pa.array(range(50), pa.int32()), pa.array(parts)], names=["key", "k", "part"])
    out = list(bpe._boundaries(FILE, public_tokenizers.PATTERN)(iter([data])))
    assert [r["part"] for b in out for r in b.to_pylist()] == parts and max(map(len, out)) <= bpe.CHUNKS
    assert all(r["begins"][-1] == len(r["part"]) for b in out for r in b.to_pylist())
