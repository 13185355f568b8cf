import struct

import numpy as np
import xxhash

from tidelake.llm import quality, queries

from .conftest import TEXTS


def test_kth_largest(spark):
    rng = np.random.default_rng(0)
    values = [*rng.standard_normal(500).tolist(), *[0.25] * 200, None]
    table = quality.stash(spark.createDataFrame([(v,) for v in values], "key double"), "test-keys")
    ranked = sorted((v for v in values if v is not None), reverse=True)
    for k in (1, 2, 37, 150, 400, 699, 700, 900):
        assert quality.kth_largest(table, "key", k, bins=8) == ranked[min(k, 700) - 1]
    assert quality.kth_largest(table, "key", 0) is None


def test_ngrams_do_not_depend_on_pieces(monkeypatch):
    text = "one two two three, four!! " * 50
    whole = sorted(quality.ngrams(text).tolist())
    monkeypatch.setattr(quality, "pieces", lambda t: (t[k:k + 26] for k in range(0, len(t), 26)))
    assert sorted(quality.ngrams(text).tolist()) == whole
    assert (quality.ngrams("a a a")[3:] == 0).all() and len(quality.ngrams("")) == 0


def test_edge_cases(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(0, 1, 0), (4, 1, None), (5, 1, 0), (6, 1, 0), (9, 0, 0), (None, 1, 0), (7, None, 1), (10, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    got = quality.resample(edge_docs, labels).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        assert (r.sample_key is None) == (r.n_features == 0)
        assert r.n_features or not r.kept
    assert len({r.kept for r in got if r.doc_id == 0}) == 1
    assert quality.resample(no_docs, labels).count() == 0
    none = quality.resample(edge_docs, labels.limit(0)).collect()
    assert all(r.kept == (r.n_features > 0) for r in none)


def test_weights_are_the_ratio_of_smoothed_models(spark):
    texts = {0: "good words here", 1: "good words again", 2: "bad stuff", 3: "bad bad"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sample = spark.createDataFrame([(0, True), (2, False)], "doc_id long, fits boolean")
    raw = np.full(quality.BUCKETS, quality.SMOOTH)
    for t in texts.values():
        np.add.at(raw, quality.ngrams(t), 1)
    target = np.full(quality.BUCKETS, quality.SMOOTH)
    np.add.at(target, quality.ngrams(texts[0]), 1)
    assert np.allclose(quality.ratios(docs, sample), np.log(target / target.sum()) - np.log(raw / raw.sum()))


def test_gumbel_top_k_is_exact(spark, small_dir):
    rows = queries.op10_quality_classifier(spark, small_dir).collect()
    keys = sorted((r.sample_key for r in rows if r.sample_key is not None), reverse=True)
    kept = [r for r in rows if r.kept]
    assert {r.sample_key for r in kept} == set(keys[:len(kept)]) and 0 < len(kept) < len(rows)


def brute(docs, sample, seed=0):
    """doc_id -> (log_weight, key, kept) by the dealt weight, for texts with words."""
    grams = {i: quality.ngrams(t or "") for i, t in docs.items()}
    raw, target = (np.full(quality.BUCKETS, quality.SMOOTH) for _ in range(2))
    for i, g in grams.items():
        np.add.at(raw, g, 1)
        if sample.get(i, (False, False))[1]:
            np.add.at(target, g, 1)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    weight = {i: ratio[g].sum() for i, g in grams.items() if len(g)}
    key = {}
    for i, w in weight.items():
        h = xxhash.xxh64_intdigest(f"gumbel-{seed}".encode(), seed=xxhash.xxh64_intdigest(struct.pack("<q", i), seed=42))
        key[i] = w - np.log(-np.log((h >> 11) / 2**53 * (1 - 2.0**-52) + 2.0**-54))
    shown = {i: good for i, (good, fits) in sample.items() if not fits and i in weight}
    good, bad = (np.array([weight[i] for i, g in shown.items() if g == want]) for want in (True, False))
    cut = sorted(key.values(), reverse=True)[sum(w >= quality.threshold(good, bad) for w in weight.values()) - 1]
    return {i: (weight[i], key[i], key[i] >= cut) for i in weight}


def test_whole_query_against_brute_force(spark, small_dir):
    docs = dict(spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect())
    sample = {r.doc_id: (r.good, r.fits) for r in quality.label_sample(spark.read.parquet(f"{small_dir}/labels.parquet")).collect()}
    want = brute(docs, sample)
    got = {r.doc_id: r for r in queries.op10_quality_classifier(spark, small_dir).collect()}
    assert set(got) == set(docs)
    for i, r in got.items():
        if i in want:
            weight, key, kept = want[i]
            assert abs(r.log_weight - weight) < 1e-6 and abs(r.sample_key - key) < 1e-6 and r.kept == kept
        else:
            assert r.n_features == 0 and not r.kept


def test_options_leave_the_plain_weight(spark, small_dir):
    docs, labels = (spark.read.parquet(f"{small_dir}/{t}.parquet") for t in ("documents", "labels"))
    plain = {r.doc_id: r for r in quality.resample(docs, labels).collect()}
    other = {r.doc_id: r for r in quality.resample(docs, labels, per_feature=True, temperature=0.01).collect()}
    for i, r in plain.items():
        if r.n_features:
            noise = r.sample_key - r.log_weight
            assert abs(r.mean_ratio - r.log_weight / (r.n_features + quality.PRIOR)) < 1e-9
            assert abs(other[i].sample_key - (r.mean_ratio / 0.01 + noise)) < 1e-6


def test_labelled_documents_fall_where_they_belong(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r.doc_id: r.kept for r in queries.op10_quality_classifier(spark, sf).collect()}
    good = [got[i] for i, q in truth.items() if q == 1 and i in got]
    bad = [got[i] for i, q in truth.items() if q == 0 and i in got]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.1
