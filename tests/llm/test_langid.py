import zlib

import numpy as np

from tidelake.llm import langid, queries

from .conftest import TEXTS


def test_edge_cases(edge_docs, no_docs):
    rows = langid.identify(edge_docs).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        text = TEXTS[r.doc_id] or ""
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text)) and 0 <= r.score <= 1
        assert r.lang_pred != "und" or r.score == 0
    assert langid.identify(no_docs).count() == 0


def test_nothing_learned(edge_docs):
    from pyspark.sql import functions as F

    rows = langid.identify(edge_docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in rows} == {"und"}


def test_recognised_keeps_rows_whole(edge_docs):
    got = langid.recognised(edge_docs)
    assert got.columns == edge_docs.columns
    assert {r.doc_id for r in got.collect()} == {0, 4, 5, 6, 7, 9, 10, 11}


def test_presence_is_the_set_of_all_ngrams(monkeypatch):
    text = "abcabcabd " * 30
    whole = langid.presence(text)
    raw = text.encode()
    assert whole.sum() <= sum(len({raw[k:k + n] for k in range(len(raw) - n + 1)}) for n in langid.ORDERS)
    monkeypatch.setattr(langid, "_PIECE", 7)
    assert (langid.presence(text) == whole).all()


def test_kernel_is_normalised():
    x = np.stack([langid.presence(t) for t in ("the cat and the dog", "le chat et le chien", "the cat and the dog")])
    model = langid.Model(np.packbits(x, axis=1), ["en", "fr", "en"])
    own = x[:, model.features].astype(np.float32)
    k = model.kernel(own)
    a, b = own[0].astype(bool), own[1].astype(bool)
    assert np.isclose(k.max(), 1, atol=1e-5)
    assert np.isclose(k[1].min(), (a & b).sum() / np.sqrt(a.sum() * b.sum()), atol=1e-5)


def test_sums_over_partitions_give_the_local_fit(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").repartition(5, "doc_id")
    model = langid.train(docs)
    rows = sorted(docs.where(~langid.held_out()).where("lang is not null and text is not null").select("doc_id", "lang", "text").collect())
    packed = np.stack([np.packbits(langid.presence(r.text)) for r in rows])
    local = langid.Model(packed, [r.lang for r in rows])
    assert model.langs == local.langs and (model.features == local.features).all() and (model.landmarks == local.landmarks).all()
    k = np.concatenate([model.kernel(x) for x in langid.unpacked(packed, model.features)])
    assert np.allclose(k @ model.weights, k @ local.weights, rtol=0, atol=1e-3)
    again = langid.train(docs.repartition(3, "text"))
    assert (model.weights == again.weights).all()


def test_prediction_is_the_landmarks_regression(spark, small_dir):
    """Scores of the query, worked out again from sets of n-grams."""
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    model = langid.train(docs)
    texts = dict(docs.select("doc_id", "text").collect())
    got = {r.doc_id: r for r in queries.op4_language_id(spark, small_dir).collect()}
    marks = [set(np.flatnonzero(m)) for m in model.landmarks]
    for i in sorted(texts)[:25]:
        own = set(np.flatnonzero(langid.presence(texts[i] or "")[model.features]))
        k = np.array([len(own & m) / np.sqrt(max(len(own), 1) * max(len(m), 1)) for m in marks])
        response = k @ model.weights.astype(float)
        if got[i].lang_pred != "und":
            assert abs(got[i].score - min(1, max(0, (response.max() + 1) / 2))) < 1e-3
            assert response[model.langs.index(got[i].lang_pred)] > response.max() - 1e-3


def test_many_languages(spark):
    """Three hundred languages: landmarks grow with them, and the driver holds no sample."""
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzäöüéèñçßøå"))
    rows, n = [], 300
    for lang in range(n):
        words = ["".join(rng.choice(letters, 5)) for _ in range(15)]
        rows += [(lang * 14 + k, " ".join(rng.choice(words, 12)), f"l{lang:03d}") for k in range(14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    model = langid.train(docs)
    assert len(model.langs) == n and len(model.landmarks) == langid.PER_LANGUAGE * n
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    held = [(got[i].lang_pred, lang) for i, _, lang in rows if got[i].held_out]
    assert len(held) > 500 and sum(a == b for a, b in held) / len(held) > 0.9


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect())
    rows = [r for r in queries.op4_language_id(spark, sf).collect() if r.held_out]
    assert len(rows) > 100 and sum(r.lang_pred == truth[r.doc_id] for r in rows) / len(rows) > 0.97


def test_label_of_held_out_rows_is_not_used(spark, small_dir):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    lied = docs.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    assert sorted(langid.identify(docs).collect()) == sorted(langid.identify(lied).collect())
