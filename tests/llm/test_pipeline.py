import corpus_pipeline
from pyspark.sql import functions as F

from tidelake.llm import langid, quality

from .test_packing import check
from .test_simhash import brute_components, brute_fingerprint


def test_stages_against_brute_force(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    labels = spark.read.parquet(f"{small_dir}/labels.parquet")
    kept = [r for r in docs.collect() if any(c.isalpha() for c in r.text or "")]
    passed = langid.recognised(docs)
    assert {r.doc_id for r in passed.collect()} == {r.doc_id for r in kept}
    chosen = {r.doc_id for r in quality.resample(passed, labels).where("kept").collect()}
    sampled = corpus_pipeline.quality_classifier(spark, passed, small_dir)
    assert sampled.columns == docs.columns and {r.doc_id for r in sampled.collect()} == chosen
    texts = {r.doc_id: r.text for r in kept if r.doc_id in chosen}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    left = {i: texts[i] for i, c in brute_components(prints).items() if i == c}
    deduped = corpus_pipeline.simhash_near_dedup(spark, sampled, small_dir)
    assert deduped.columns == docs.columns and {r.doc_id: r.text for r in deduped.collect()} == left
    rows = corpus_pipeline.run(spark, small_dir).collect()
    check(rows, left)


def test_edge_cases(spark, edge_docs, no_docs, small_dir):
    got = edge_docs.withColumn("lang", F.col("lang"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, got, small_dir)
        assert got.columns == edge_docs.columns
    ids = [r.doc_id for r in got.collect()]
    assert len(ids) == len(set(ids)) and not {1, 2, 3, 5, 6, 8} & set(ids)
    empty = no_docs
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, small_dir)
    assert empty.count() == 0


def test_ids_that_are_null_pass_dedup(spark, small_dir):
    docs = spark.createDataFrame([(None, "a b c d e"), (2, "a b c d e"), (3, "a b c d e")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in corpus_pipeline.simhash_near_dedup(spark, docs, small_dir).collect()) == ["2", "None"]
