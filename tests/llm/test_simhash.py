import random

import xxhash

from tidelake.llm import queries, simhash

from .conftest import TEXTS


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    runs = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_edge_cases(edge_docs, no_docs):
    rows = simhash.near_duplicates(edge_docs).collect()
    assert len(rows) == len(TEXTS) + 1
    prints = {i: brute_fingerprint(t) for i, t in TEXTS.items()}
    classes = brute_components(prints)
    for r in rows:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == classes[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)
    assert {classes[i] for i in (1, 2, 3)} == {1} and classes[6] == classes[5] == 0
    assert simhash.near_duplicates(no_docs).count() == 0


def test_words_across_pieces(monkeypatch):
    text = " ".join(f"w{k % 7}x{k % 11}" for k in range(5000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_PIECE", 64)
    assert simhash.fingerprint(text) == whole == int.from_bytes(brute_fingerprint(text.decode()).to_bytes(8, "little"), "little", signed=True)


def test_links_find_every_pair(spark):
    rnd = random.Random(5)
    prints = []
    for _ in range(60):
        base = rnd.getrandbits(64)
        prints += [base] + [base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 6))) for _ in range(5)]
    prints = list(dict.fromkeys(prints))
    signed = [(k, p - (1 << 64) if p >> 63 else p) for k, p in enumerate(prints)]
    found = simhash.links(spark.createDataFrame(signed, "id long, fingerprint long")).collect()
    want = {(a, b) for a in range(len(prints)) for b in range(a + 1, len(prints)) if (prints[a] ^ prints[b]).bit_count() <= 3}
    assert len(found) == len(set(map(tuple, found))) and set(map(tuple, found)) == want


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (None, "only without an id")], "doc_id long, text string")
    rows = simhash.near_duplicates(docs).collect()
    assert [r.component_id for r in rows if r.doc_id == 3] == [3]
    assert sorted((r.component_id is None, r.kept) for r in rows if r.doc_id is None) == [(False, False), (True, False)]


def test_links_through_texts_without_an_id(spark):
    """Fingerprints 0, 7 and 63 in a chain whose middle has no id."""
    prints = spark.createDataFrame([(1, 0), (None, 7), (9, 63), (5, 0xffff00)], "doc_id long, fingerprint long")
    classes = simhash._components(prints, simhash.F.col("doc_id")).collect()
    assert {(r.fp, r.component, r.least) for r in classes} == {(0, 0, 1), (7, 0, None), (63, 0, 9), (0xffff00, 0xffff00, 5)}


def brute_kept(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    classes = brute_components(dict(enumerate(prints)))
    groups = {}
    for k, (i, t) in enumerate(rows):
        h = xxhash.xxh64_intdigest((t or "").encode())
        signed = prints[k] - (1 << 64) if prints[k] >> 63 else prints[k]
        groups.setdefault((classes[k], k if i is None else -1), []).append((i or 0, signed, h - (1 << 64) if h >> 63 else h, k))
    return sorted(repr(rows[min(g)[-1]]) for g in groups.values())


def test_one_row_of_each_group_stays(spark):
    a, u = "the cat sat on the mat and looked at the dog", "an other text of its own without any copy"
    rows = [(1, a), (5, a), (5, u), (5, u), (None, a), (None, "nameless and alone here"), (None, "nameless and alone here"),
            (7, None), (8, ""), (6, "THE cat sat on the mat and looked at the dog"), (9, "w " * 40000)]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, `a.b` int").repartition(3)
    out = simhash.deduplicated(df)
    assert out.columns == df.columns
    assert sorted(repr((r.doc_id, r.text)) for r in out.collect()) == brute_kept(rows)
    assert {(1, a), (5, u)} <= {(r.doc_id, r.text) for r in out.collect()}
    assert simhash.deduplicated(df.where("false")).count() == 0


def test_texts_are_not_shuffled(spark, small_dir):
    """Only bitmaps move, also where they are too many to broadcast."""
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = simhash.deduplicated(docs)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        rows = docs.select("doc_id", "text").collect()
        assert sorted(repr((r.doc_id, r.text)) for r in out.select("doc_id", "text").collect()) == brute_kept([tuple(r) for r in rows])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_query(spark, small_dir):
    texts = dict(spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect())
    rows = queries.op2_simhash_near_dedup(spark, small_dir).collect()
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    classes = brute_components(prints)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(i, f"{p:016x}", classes[i]) for i, p in prints.items()}
