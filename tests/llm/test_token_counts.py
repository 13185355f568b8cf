import random

import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from tidelake.llm import bpe, queries, token_counts
from tidelake.llm.common import pieces

from .conftest import TEXTS


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(path(bpe.VOCABULARY))


def expected(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_edge_cases(edge_docs, no_docs, library):
    got = {r.doc_id: r for r in token_counts.token_counts(edge_docs).collect()}
    assert set(got) == set(TEXTS)
    for i, text in TEXTS.items():
        assert (got[i].n_tokens, got[i].n_bytes) == (expected(library, text), len((text or "").encode()))
        assert got[i].over_limit == (got[i].n_tokens > 1024)
    assert token_counts.token_counts(no_docs).count() == 0


def test_any_first_tier_gives_the_same(edge_docs):
    plain = sorted(token_counts.token_counts(edge_docs).collect())
    assert plain == sorted(token_counts.token_counts(edge_docs, table_size=3).collect())


def test_summary_keeps_heavy_pretokens(edge_docs):
    found = token_counts.frequent_pretokens(edge_docs, 8)
    assert len(found) <= 8 and " the" in found


def test_random_texts(library):
    rnd = random.Random(3)
    letters = ["a", "B", "é", " ", "  ", "\n", "'s", "'", "1", "½", "!", "漢", "՘", "​", "\x1c", "\xa0", "<|endoftext|>", "ǅ", "\U0001d6a6", "\r\n", "½", "Ⅳ", "_", "²", "\x85", "\u3000", "e\u0301"]
    counts = ids = bpe.Coder(bpe.VOCABULARY)
    for _ in range(1500):
        text = "".join(rnd.choices(letters, k=rnd.randint(0, 30)))
        want = library.encode(text, add_special_tokens=False).ids
        assert counts.count(text) == len(want)
        assert memoryview(ids.ids(text)).cast("I").tolist() == want


def test_long_texts_are_cut_between_pretokens(library):
    coder = bpe.Coder(bpe.VOCABULARY)
    for text in ("ab!\x1c\x1d " * 200_000, "don't  \n\n stop\u3000it\x85 " * 60_000, "x" * 1_100_000 + " y"):
        assert "".join(pieces(text)) == text and len(text) > 1 << 20
        want = library.encode(text, add_special_tokens=False).ids
        assert coder.count(text) == len(want) and memoryview(coder.ids(text)).cast("I").tolist() == want


def test_bounded_worker_cache(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 5)
    coder = bpe.Coder(bpe.VOCABULARY, {" the": 1})
    text = " ".join(f"word{k} the" for k in range(200))
    assert coder.count(text) == expected(library, text) and len(coder.table) <= 6


def test_query(spark, small_dir, library):
    texts = dict(spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect())
    got = queries.op1_token_counts(spark, small_dir).collect()
    assert len(got) == len(texts) and all(r.n_tokens == expected(library, texts[r.doc_id]) for r in got)
