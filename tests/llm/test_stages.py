"""The pipeline's stages on a small awkward table, on an empty one, and without labels or benchmark."""

import pytest

from tests.llm.test_text_operators import SCHEMA, _texts

KEPT = ["quality_classifier", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    texts = _texts()
    spark.createDataFrame([(i, int(i % 7 != 0), None) for i in range(60)] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, texts[5]), (2, ""), (None, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    rows = [(k, t, None, "s", None if k % 2 else len(t or ""), 1, "x", "n", 2, "c") for k, t in texts.items()] + [(None, None, None, None, None, None, None, None, None, None)] * 2
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    return f"file://{d}"


@pytest.mark.parametrize("rows", ["all", "none"])
def test_stages_keep_the_columns(spark, tables, rows):
    import corpus_pipeline

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    docs = docs if rows == "all" else docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        n = out.count()
        if name in KEPT:
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
            assert n <= docs.count()
            lengths = out.where("n_chars is not null and text is not null and n_chars <> length(text)")
            assert name in KEPT[:2] or lengths.count() == 0, name
        assert (n > 0) == (rows == "all"), name


def test_stages_do_what_they_say(spark, tables):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    one = {r["doc_id"] for r in stages["ngram_jaccard_join"](spark, docs, tables).collect()}
    assert 71 in one and 72 not in one and len(one & set(range(60, 70))) == 1 and {54, 55, 56, None} <= one
    cut = {r["doc_id"]: r["text"] for r in stages["substring_dedup"](spark, docs, tables).where("doc_id is not null").collect()}
    assert cut[51] == "x" and cut[5] == _texts()[5]
    clean = {r["doc_id"]: r["text"] for r in stages["benchmark_decontamination"](spark, docs, tables).where("doc_id is not null").collect()}
    assert clean[5].strip() == "" and clean[71] == "one two three"


def test_run_writes_and_rereads_every_stage(spark, tables):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, tables)
    assert out.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0
