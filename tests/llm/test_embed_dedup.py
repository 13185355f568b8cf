import numpy as np
import pytest

from tidelake.llm import embed_dedup, queries

SCHEMA = "vec_id long, embedding array<float>, label int, kept string"


def brute(rows, least=0.93):
    """n_links and component of each row, by all pairs."""
    ok = [(i, np.array(v, float), c) for i, v, c in rows
          if i is not None and c is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: 0 for i, *_ in rows}
    root = {i: i for i, *_ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a, c) in enumerate(ok):
        for j, b, d in ok[k + 1:]:
            if c == d and len(a) == len(b) and (a @ b) / np.sqrt((a @ a) * (b @ b)) >= least:
                links[i] += 1
                links[j] += 1
                u, v = sorted((find(i), find(j)))
                root[v] = u
    return {i: (links[i], find(i)) for i in links}


def groups(rng, n, dim=32):
    rows, at = [], 0
    for g in range(n):
        base = rng.standard_normal(dim)
        for _ in range(int(rng.integers(1, 9))):
            v = base + rng.standard_normal(dim) * rng.choice([0.0, 0.05, 0.2])
            rows.append((at, (v * rng.uniform(0.5, 3)).astype(np.float32).tolist(), int(g % 3)))
            at += 1
    return rows


@pytest.mark.parametrize("block", [1024, 4])
def test_against_all_pairs(spark, block):
    rows = groups(np.random.default_rng(4), 60)
    got = {r.vec_id: (r.n_links, r.component_id) for r in
           embed_dedup.near_duplicates(spark.createDataFrame([(*r, "") for r in rows], SCHEMA), block=block, miss=1e-4).collect()}
    assert got == brute(rows)


def test_links_just_above_the_threshold_with_default_parameters(spark):
    """The registered parameters may miss a share MISS of links at the threshold; nothing false is linked."""
    rng = np.random.default_rng(9)
    rows, at = [], 0
    for g in range(500):
        base = rng.standard_normal(64)
        base /= np.linalg.norm(base)
        other = rng.standard_normal(64)
        other -= (other @ base) * base
        other /= np.linalg.norm(other)
        c = rng.uniform(0.9301, 0.945) if g % 5 else rng.uniform(0.9, 0.9299)
        for v in (base, c * base + np.sqrt(1 - c * c) * other, *([base] if g % 50 == 0 else [])):
            rows.append((at, (v * rng.uniform(0.5, 3)).astype(np.float32).tolist(), int(g % 4)))
            at += 1
    want = brute(rows)
    got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(spark.createDataFrame([(*r, "") for r in rows], SCHEMA)).collect()}
    assert all(got[i] <= n for i, (n, _) in want.items())
    found, there = sum(got.values()), sum(n for n, _ in want.values())
    assert there > 800 and found >= (1 - 1.5 * embed_dedup.MISS) * there


def test_edge_cases(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, 1), (3, [2.0, 4.0, 6.0], 1), (4, v, 2), (5, v, None), (6, None, 1), (7, [0.0] * 3, 1), (8, [float("nan"), 1.0, 1.0], 1),
            (9, [None, 1.0, 1.0], 1), (10, [1.0, 2.0], 1), (11, [], 1), (12, [float("inf"), 1.0, 1.0], 1)]
    got = embed_dedup.near_duplicates(spark.createDataFrame([(*r, "") for r in [*rows, (None, v, 1)]], SCHEMA)).collect()
    want = brute(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id is not None} == want and len(got) == len(rows) + 1
    assert want[1] == (2, 1) and all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert embed_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hashing_meets_its_aim():
    rng = np.random.default_rng(0)
    k, tables = embed_dedup.sizes(5000)
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal(a.shape)
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * side
    met = (embed_dedup.keys_of(a, k, tables) == embed_dedup.keys_of(b, k, tables)).any(1)
    assert met.mean() > 0.95
    chance = (embed_dedup.keys_of(a, k, tables)[:1000] == embed_dedup.keys_of(side, k, tables)[1000:]).mean()
    assert chance * 5000 < 5


def test_query(spark, small_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{small_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.op8_embedding_near_dedup(spark, small_dir).collect()}
    assert got == brute(rows)
