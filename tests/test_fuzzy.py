import random
from collections import defaultdict

from tidelake.operators import fuzzy


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def changed(rnd, text, n):
    for _ in range(n):
        at, what = rnd.randrange(len(text) + 1), rnd.choice("+-=")
        text = text[:at] + (rnd.choice("abcé漢😀 ") if what != "-" else "") + text[at + (what != "+"):]
    return text


def some_texts(seed):
    rnd = random.Random(seed)
    texts = {"", "a", "ab", "é", "漢字", " ", "aa", "aaa", "aaaa"}
    for length in (3, 6, 12, 30, 31, 32, 33, 34, 35, 40, 90):
        for _ in range(3):
            base = "".join(rnd.choice("abcdé") for _ in range(length))
            texts |= {base} | {changed(rnd, base, rnd.randint(1, 4)) for _ in range(6)}
    return sorted(texts)


def test_pairs_are_those_of_all_comparisons(spark):
    texts = some_texts(1)
    for limit in (1, 2):
        got = fuzzy.similar_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), limit).collect()
        want = {(i, j, d) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and (d := edits(a, b)) <= limit}
        assert len(got) == len(want) and {tuple(r) for r in got} == want
        assert any(len(texts[i]) > fuzzy.SHORT + limit for i, _, _ in want) and any(len(texts[i]) <= fuzzy.SHORT < len(texts[j]) for i, j, _ in want)


def test_every_variant_once(spark):
    row = spark.createDataFrame([("abca",), ("",)], "t string").select(fuzzy.left_out(fuzzy.F.col("t"), 2).alias("v")).collect()
    assert sorted(row[0].v) == sorted({"abca", "bca", "aca", "aba", "abc", "ca", "ba", "bc", "aa", "ac", "ab"}) and row[1].v == [""]


def test_neighbours_by_class(spark):
    rows = [(k, t) for k, t in enumerate(some_texts(2)[:60])] + [(1000 + k, "aa") for k in range(200)] + [(5000, None), (None, "only a null key"), (None, "aaa")]
    got = fuzzy.neighbours(spark.createDataFrame(rows, "k long, t string").repartition(4), "k", "t").collect()
    keys = defaultdict(list)
    for k, t in rows:
        if t is not None:
            keys[t].append(k)
    least = {t: min((k for k in ks if k is not None), default=None) for t, ks in keys.items()}
    want = []
    for k, t in rows:
        if t is None:
            want.append((k, None, 0, 0, None, None))
            continue
        near = sorted((edits(t, o), least[o]) for o in keys if o != t and None not in (least[o], least[t]) and edits(t, o) <= 2)
        want.append((k, least[t], len(keys[t]), len(near), *((near[0][1], near[0][0]) if near else (None, None))))
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))


def test_no_cross_join(spark):
    plan = fuzzy.neighbours(spark.createDataFrame([(1, "a")], "k long, t string"), "k", "t")._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan
