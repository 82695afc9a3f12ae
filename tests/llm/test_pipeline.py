"""The pipeline's stages on the small tables."""

import corpus_pipeline as cp


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, kept, folder)
        assert out.columns == docs.columns, name
        kept = cp.written(out, name)
        assert kept.count() == kept.select("doc_id").distinct().count()
    assert 0 < kept.count() < docs.count()
    last = cp.run(spark, folder)
    assert last.count() == kept.count()
    assert last.where("n_tokens <> size(ids)").count() == 0


def test_one_of_repeated_rows_stays(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(20)
    twice = docs.unionByName(docs)
    assert cp.drop_near_duplicates(spark, twice, folder).count() == cp.drop_near_duplicates(spark, docs, folder).count()
