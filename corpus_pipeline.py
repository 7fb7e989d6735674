"""A training corpus from raw documents, in five stages; each works on all that the stage before it kept.

    python corpus_pipeline.py SF_DIR OUT

Documents of low quality go, then all but one of each group of near-duplicates, then passages that an earlier document has
too, then documents that share a window of words with the benchmark; what is left is encoded.
"""

from __future__ import annotations

import functools
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm import bpe, decontaminate, minhash, passages, quality
from arbora.session import load, persisted, remove, ship, written

#: Bytes of text that go to a Python worker at once on average, and documents at most; several batches are in memory together.
BATCH_BYTES, BATCH = 8 << 20, 2_000
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def staged(stage):
    """The stage, with batches that fit its documents: it lowers the session's setting where that is higher. run() puts it back.

    What earlier stages wrote on their way, but for what docs still reads, is removed first: a stage's result is written before the next one begins.
    Of every stage: null and empty texts, repeated rows, rows with a null doc_id, very long texts and further columns of any name go through as
    its operator says; an empty table stays one.
    """

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        size = docs.agg(F.avg(F.octet_length("text"))).first()[0] or 1.0
        most, now = max(16, min(BATCH, int(BATCH_BYTES / size))), int(spark.conf.get(ROWS))
        if now <= 0 or now > most:
            spark.conf.set(ROWS, str(most))
        left = _LEFT.setdefault(spark.sparkContext.applicationId, [])
        read = {f.rsplit("/", 1)[0].split("://")[-1].removeprefix("file:") for f in docs.inputFiles()}
        gone = [p for p in left if p.split("://")[-1] not in read]
        remove(spark, gone)
        left[:] = [p for p in left if p not in gone]
        before = len(written(spark))
        out = stage(ship(spark), docs, sf_dir)
        left += written(spark)[before:]
        return out

    return run


#: By application, the folders that stages have written and that are still there.
_LEFT: dict[str, list[str]] = {}


@staged
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1, fitted on the labelled documents: what scores under 0.5 goes."""
    return quality.accepted(spark, docs, load(spark, sf_dir, "labels"))


@staged
def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each class of linked documents the one of smallest doc_id stays."""
    return minhash.one_of_each(spark, docs)


@staged
def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: passages of 50 words and more stay in the document of smallest doc_id only."""
    return passages.without_repeats(spark, docs)


@staged
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents in which a window of a benchmark item occurs go."""
    return decontaminate.without_leaks(spark, docs, load(spark, sf_dir, "benchmark"))


@staged
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: doc_id, lang and source with the token ids, and digests of the ids and of the bytes they decode to."""
    import public_tokenizers

    out = bpe.encode(spark, docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    kept = [F.col(f"rest.{c}").alias(c) for c in ("lang", "source") if c in docs.columns]
    return out.select("doc_id", *kept, "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_near_duplicates),
    ("repeated_passages", without_repeated_passages),
    ("decontamination", without_benchmark),
    ("byte_bpe", encoded),
]

#: SQL has neither the classifier, nor the similarity search, nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = spark.conf.get(ROWS)
    try:
        docs = load(spark, sf_dir, "documents")
        for name, stage in STAGES:
            docs = persisted(stage(spark, docs, sf_dir), f"stage-{name}")
        return docs
    finally:
        spark.conf.set(ROWS, before)


if __name__ == "__main__":
    session = SparkSession.builder.appName("corpus_pipeline").getOrCreate()
    run(session, sys.argv[1]).write.parquet(sys.argv[2])
