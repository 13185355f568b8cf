import random

from tidelake.llm.components import components


def test_random_graphs_chains_and_stars(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)]
    edges += [(1000 + k, 1001 + k) for k in range(70)] + [(5000, 2000 + k) for k in range(200)] + [(7, 7), (7, 7)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    want = {(i, find(i)) for i in list(root) if find(i) != i}
    got = [tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
