import base64
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from arbora.llm import bpe
from arbora.llm import textops as T

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
with open(PATH, "rb") as f:
    RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
REAL = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe.Codec(RANKS, public_tokenizers.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab '!1é字\n\t  　", max_size=80) | st.text(max_size=60), st.integers(1, 20), st.integers(1, 8))
def test_stitched_chunks_are_the_whole(text, chunk, overlap):
    parts = bpe.cut(text, chunk, overlap)
    pieces = bpe.stitched(CODEC, parts, [bpe.starts(CODEC, p) for p in parts], chunk)
    assert pieces == CODEC.pattern.findall(text)
    ids = [i for p in pieces for i in CODEC.merge(p.encode())]
    assert ids == REAL.encode_ordinary(text) and CODEC.decode(ids) == text.encode()


@pytest.mark.parametrize("chunk, overlap", [(32_768, 1_024), (1_000, 10)])
def test_rows_agree_with_the_library(spark, odd, chunk, overlap):
    draw = random.Random(3)
    texts = [(r.doc_id, r.text) for r in odd.collect()] + [(20, "<|endoftext|> " * 300), (21, "".join(draw.choice("ab \n'1é") for _ in range(5000))), (22, " " * 5000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id bigint, text string, key string, k int")
    got = bpe.encode(spark, df, PATH, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap).collect()
    want = []
    for i, t in texts:
        ids = REAL.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, list(r.ids)) for r in got), key=str) == sorted(want, key=str)


def test_empty_table(spark, none):
    assert bpe.encode(spark, none, PATH, public_tokenizers.PATTERN).collect() == []


def test_a_worker_forgets_pretokens_when_other_texts_are_read():
    with open(PATH, "rb") as f:
        codec = bpe._codec(f.read(), public_tokenizers.PATTERN)
    assert codec.encoded(["some", " words"])[1] == b"some words" and bpe._codec.cache_info().currsize == 1
    list(T.slices(pa.array(["a text", None])))
    assert bpe._codec.cache_info().currsize == 0
