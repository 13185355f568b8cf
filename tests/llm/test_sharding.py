import zlib

from tidelake.llm import queries, sharding

from .conftest import TEXTS


def check(rows, texts, shards=16):
    largest = max((len((t or "").encode()) + 1 for t in texts.values()), default=0)
    total = 0
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        total += r.size
    loads = [0] * shards
    for r in rows:
        loads[r.shard] += r.size
    assert all(abs(x - total / shards) <= largest for x in loads)
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_edge_cases(edge_docs, no_docs):
    rows = sharding.byte_shards(edge_docs).collect()
    assert len(rows) == len(TEXTS) + 1
    check(rows, TEXTS)
    assert sharding.byte_shards(no_docs).count() == 0


def test_hot_copies_are_spread(spark):
    texts = {i: "the same text" if i % 3 else f"text {i}" for i in range(900)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(sharding.byte_shards(docs).collect(), texts)


def test_native_plan(edge_docs):
    plan = sharding.byte_shards(edge_docs)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_query(spark, small_dir):
    texts = dict(spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect())
    rows = queries.op9_sharding(spark, small_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    check(rows, texts)
