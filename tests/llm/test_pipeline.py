"""The pipeline's stages on a small corpus, and the whole on the smallest tables."""

import pytest

SMALL = "/root/testdata/sf0.001"
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_the_columns_and_clean_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    total, docs_in = docs.count(), docs
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns
    kept = docs.count()
    assert 0.7 * total < kept < total
    assert docs.join(docs_in, "doc_id", "left_anti").count() == 0


ODD = [(1, None), (2, ""), (None, "a b c"), (3, " \n\t "), (4, "one line here"), (5, "one line here"), (5, "one line here"), (6, "w " * 3_000), (None, None)]


def test_run_on_odd_rows(spark, docs, tmp_path):
    """Nulls, empty texts, repeats and clashing columns through every stage."""
    rows = docs(*ODD)
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "no such words at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {1, 2, None, 3, 4, 6}
    whole = {}
    for r in got:
        whole.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    assert all(sorted(v)[0][0] == 0 for v in whole.values()) and all(r.offset + r.length <= 1024 for r in got)
    docs_in = rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_in = stage(spark, docs_in, str(tmp_path))
        assert docs_in.columns == rows.columns, name
        assert stage(spark, rows.limit(0), str(tmp_path)).count() == 0, name


def test_toxic_rows_go(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, SMALL)
    assert kept.columns == docs.columns and 0.7 * docs.count() < kept.count() <= docs.count()
