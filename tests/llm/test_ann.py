import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelake.llm import ann, queries

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute(ids, x, queries_, k=10):
    out = {}
    for q in queries_:
        d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(1))
        out[q] = [(i, v) for v, i in sorted((v, i) for v, i in zip(d.tolist(), ids, strict=True) if i != q)][:k]
    return out


def search(df, **options):
    got = {}
    for r in ann.nearest_neighbours(df, F.col("vec_id") % 100 == 0, **options).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(v) for q, v in got.items()}


def test_edge_cases(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((6, 4)).astype(np.float32)
    rows = [(100 * k, x[k].tolist(), 1, "") for k in range(5)]
    rows += [(7, x[0].tolist(), 1, ""), (8, x[0].tolist(), 1, "")]
    rows += [(500, None, 1, ""), (600, [0.0] * 4, 1, ""), (700, [1.0, None, 0.0, 0.0], 1, ""), (800, [float("nan")] * 4, 1, ""),
             (900, [float("inf")] * 4, 1, ""), (1000, [], 1, ""), (1100, [1.0, 2.0], 1, ""), (None, x[1].tolist(), 1, "")]
    got = search(spark.createDataFrame(rows, SCHEMA), segment_rows=3)
    ids = [0, 100, 200, 300, 400, 7, 8]
    want = brute(ids, np.concatenate([x[:5], x[[0, 0]]]).astype(float), [0, 100, 200, 300, 400])
    assert set(got) == set(want)
    for q, found in got.items():
        assert [(r, i) for r, i, _ in found] == [(k + 1, i) for k, (i, _) in enumerate(want[q])]
        assert np.allclose([s for *_, s in found], [s for _, s in want[q]], rtol=0, atol=1e-12)
    assert [i for _, i, _ in got[0]][:2] == [7, 8]
    assert search(spark.createDataFrame([], SCHEMA)) == {} == search(spark.createDataFrame(rows[:1], SCHEMA))


def test_repeated_ids_are_rows_of_their_own(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((9, 4)).astype(np.float32)
    ids = [100, 7, 7, 8, 100, 7, 200, 9, 9]
    x[5] = x[1]  # one row twice
    df = spark.createDataFrame([(i, v.tolist(), 1, "") for i, v in zip(ids, x, strict=True)], SCHEMA).repartition(3, "score")
    for rows in (3, 100):
        got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9))
                     for r in ann.nearest_neighbours(df, F.col("vec_id") % 100 == 0, segment_rows=rows).collect())
        want = []
        for q in (0, 4, 6):
            d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
            near = sorted((v, ids[k]) for k, v in enumerate(d.tolist()) if k != q)
            want += [(ids[q], n + 1, i, round(v, 9)) for n, (v, i) in enumerate(near)]
        assert got == sorted(want)


def test_prefix_ranges_match_a_plain_scan():
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((300, 8)), rng.standard_normal((5, 8))
    normals = ann.planes(8)
    forest = ann.Forest(np.arange(300), np.arange(300), x, np.zeros(8), normals)
    c, qc = ann.codes(x, np.zeros(8), normals), ann.codes(q, np.zeros(8), normals)
    for level in (0, 3, 6, 32):
        low, high = forest._ranges(qc, np.full(5, level))
        for i in range(5):
            for t in range(ann.TREES):
                shift = np.uint64(ann.BITS - level)
                want = {k for k in range(300) if int(c[k, t]) >> int(shift) == int(qc[i, t]) >> int(shift)}
                assert set(forest.order[low[t, i]:high[t, i], t].tolist()) == want


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    want = brute(ids, x, [i for i in ids if i % 100 == 0])
    got = {}
    for r in queries.op5_hash_prefix_forest(spark, folder).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want) and all(sorted(r for r, *_ in v) == list(range(1, 11)) for v in got.values())
    hits = sum(len({i for i, _ in want[q]} & {i for _, i, _ in got[q]}) for q in want)
    assert hits / (10 * len(want)) >= 0.9
    at = {i: k for k, i in enumerate(ids)}
    for q, found in list(got.items())[:5]:
        for _, i, s in found:
            assert abs(s - np.sqrt(((x[at[q]] - x[at[i]]) ** 2).sum())) < 1e-12
