"""The stages one after another on a small corpus."""

import corpus_pipeline
from breakweave.llm import copies, quality, substrings


def test_stages(spark, docs, tmp_path):
    plain = docs.select("doc_id", "text", "lang").selectExpr("doc_id", "text", "lang", "'s' as source", "cast(length(text) as bigint) as n_chars")
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    whole = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "simhash near-dedup", "substring dedup", "packing"]
    good = corpus_pipeline.quality_classifier(spark, whole, str(tmp_path))
    assert good.columns == whole.columns and good.count() == quality.kept(whole).count()
    one = corpus_pipeline.simhash_near_dedup(spark, good, str(tmp_path))
    assert one.columns == whole.columns
    ids = [r["doc_id"] for r in one.collect()]
    assert len(ids) == len(set(ids)) and 3 in ids and 40 not in ids and 41 not in ids
    cut = corpus_pipeline.substring_dedup(spark, one, str(tmp_path))
    assert cut.columns == whole.columns and cut.count() == len(ids)
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect() if r["text"] is not None)
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(out.doc_id.dropna()) == {i for i in ids if i is not None}
    assert substrings.MIN_BYTES and copies.SIMILARITY == 0.8


def test_no_documents(spark, docs, tmp_path):
    docs.select("doc_id", "text", "lang").selectExpr("doc_id", "text", "lang", "'s' as source", "cast(length(text) as bigint) as n_chars").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
