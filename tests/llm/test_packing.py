import zlib

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from tidelake.llm import packing, queries

from .conftest import TEXTS


def check(rows, texts):
    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc, own in by_doc.items():
        ids = np.array([*library.encode(texts[doc] or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding / sum(r.length for r in rows)


def test_edge_cases(edge_docs, no_docs):
    check(packing.pack(edge_docs.dropDuplicates(["doc_id"])).collect(), TEXTS)
    assert packing.pack(no_docs).count() == 0
    twice = packing.pack(edge_docs).where("doc_id = 0").collect()
    assert len({(r.sequence_id, r.offset) for r in twice}) == len(twice) == 2


def test_ids_come_along(edge_docs):
    for r in packing.pack(edge_docs, with_ids=True).collect():
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length


@pytest.mark.parametrize("n", [1, 2, 5, 300])
def test_differencing(n):
    sizes = np.random.default_rng(n).integers(1, 257, n)
    dealt = packing.windows(sizes, 1024)
    loads = np.bincount(dealt, weights=sizes)
    assert len(dealt) == n and loads.max() <= 1024
    if n == 300:
        assert loads.min() > 0.95 * loads.max()


def test_window_count_rises_above_the_least():
    sizes = np.array([600, 600, 600, 200])  # 2000 tokens, but no two of the large ones fit together
    assert packing.windows(sizes, 1024).max() + 1 == 3


def test_differencing_is_karmarkar_karp_for_two():
    dealt, loads = packing.difference(np.array([8, 7, 6, 5, 4]), 2)
    assert sorted(loads.tolist()) == [14, 16]
    assert sorted(np.bincount(dealt, weights=[8, 7, 6, 5, 4]).tolist()) == [14, 16]


def test_query(spark, small_dir):
    texts = dict(spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect())
    assert check(queries.op7_packing(spark, small_dir).collect(), texts) < 0.02
