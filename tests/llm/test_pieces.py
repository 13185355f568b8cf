import hashlib
import itertools
import random

import numpy as np
import pytest

from tidelake.llm import pieces, queries

from .conftest import TEXTS


@pytest.fixture(scope="module")
def own():
    return pieces.Processor(pieces.MODEL)


def test_edge_cases(edge_docs, no_docs, own):
    rows = pieces.encode(edge_docs).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        text = TEXTS[r.doc_id] or ""
        assert r.ids == own.library.encode(text) and r.decoded == text
    assert pieces.encode(no_docs).count() == 0


def test_random_texts_equal_the_library(own):
    rnd = random.Random(1)
    letters = "  \t\nabcdefthingsanoreé漢字的一😀▁aaa   ABC.,'<>/s0123\x00"
    texts = ["".join(rnd.choices(letters, k=rnd.randint(0, 60))) for _ in range(1500)]
    texts += [" " * k + "the" + " " * k + "\n" for k in range(50)] + ["a" * k for k in range(60)]
    assert [x.tolist() for x in own.encode_batch(texts)] == own.library.encode(texts)


def test_decode_equals_the_library(own):
    rnd = random.Random(2)
    for _ in range(1500):
        ids = [rnd.randrange(3, 259) if rnd.random() < 0.5 else rnd.randrange(3, 32000) for _ in range(10)]
        assert own.decode(ids) == own.library.decode(ids)


def test_bounded_cache(monkeypatch, own):
    monkeypatch.setattr(pieces, "CACHE_WORDS", 10)
    for text in ("one two three", "four five six seven eight nine", "one two three ten eleven"):
        assert own.encode_batch([text])[0].tolist() == own.library.encode(text)


def test_unigram_viterbi_is_the_best_segmentation():
    rnd = random.Random(3)
    words = ["<unk>", *"abc", *{"".join(rnd.choices("abc", k=rnd.randint(2, 4))) for _ in range(25)}]
    scores = [0.0, *[-rnd.uniform(1, 9) for _ in words[1:]]]
    lattice = pieces.Lattice(words, scores, [pieces.UNKNOWN, *[pieces.NORMAL] * (len(words) - 1)], pieces.UNIGRAM)
    score = dict(zip(words[1:], scores[1:], strict=True))
    texts = ["".join(rnd.choices("abc", k=rnd.randint(1, 8))) for _ in range(60)]
    got = lattice.encode_words(texts)
    for text in texts:
        best = -np.inf
        for cuts in itertools.product([0, 1], repeat=len(text) - 1):
            ends = [0, *[k + 1 for k, c in enumerate(cuts) if c], len(text)]
            parts = [text[a:b] for a, b in itertools.pairwise(ends)]
            best = max(best, sum(score.get(p, -np.inf) for p in parts))
        found = [words[i] for i in np.frombuffer(got[text], np.int32)]
        assert "".join(found) == text and np.isclose(sum(score[p] for p in found), best)


def test_query(spark, small_dir, own):
    texts = dict(spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect())
    rows = queries.op6_sentencepiece(spark, small_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = own.library.encode(texts[r.doc_id])
        assert r.ids == " ".join(map(str, ids)) and r.n_pieces == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
