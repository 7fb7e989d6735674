from arbora.llm import queries
from tests.llm.conftest import words


def test_stages_take_effect(spark, tmp_path):
    import corpus_pipeline as pipeline

    passage, leak = words(1, 60), words(2, 30)
    docs = [(i, words(100 + i, 120)) for i in range(40)]
    docs += [(50, docs[3][1]), (51, f"{words(60, 60)} {passage}"), (52, f"{passage} {words(61, 60)}"), (53, f"{words(62, 50)} {leak} {words(63, 50)}"), (54, None), (55, "")]
    docs += [(70 + i, "SPAM!! NOW!! " * (20 + i)) for i in range(20)]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1.5) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint, score double")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(70 + i, 0, 0) for i in range(20)] + [(54, 1, 0), (55, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert set(range(40)) | {51, 52} <= set(got) and not {50, 53} & set(got) and not any(i >= 70 for i in got)
    kept = pipeline.without_repeated_passages(spark, frame.where("doc_id in (51, 52)"), str(tmp_path))
    assert kept.columns == frame.columns and {r.doc_id: r.text for r in kept.collect()} == {51: docs[41][1], 52: words(61, 60)}
    assert len(pipeline.STAGES) == 5 and pipeline.ORACLE_SQL is None


def test_stages_take_odd_rows_and_empty_tables(spark, odd, none, tmp_path):
    """Each stage by itself; after run() the session's batch size is as it was."""
    import corpus_pipeline as pipeline

    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in pipeline.STAGES:
        kept = stage(spark, odd, str(tmp_path))
        assert kept.count() == odd.count() - {"near_duplicates": 2, "repeated_passages": 1}.get(name, 0), name
        assert stage(spark, none, str(tmp_path)).count() == 0
        assert name == "byte_bpe" or kept.columns == odd.columns
    spark.conf.set(pipeline.ROWS, "777")
    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).collect() == [] and spark.conf.get(pipeline.ROWS) == "777"
    spark.conf.unset(pipeline.ROWS)


def test_every_operator_is_registered():
    names = queries.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
