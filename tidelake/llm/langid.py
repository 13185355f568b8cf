"""Language identification by a string kernel, Nyström landmarks and kernel ridge regression.

Kernel: blended-spectrum presence. A text is the set of its byte n-grams
(lower-cased, n in ORDERS, hashed to BUCKETS for each order, kept to a
vocabulary of FEATURES n-grams of the training sample); k(x, y) is the number
of n-grams in both, divided by the root of the product of the set sizes.

Training (a bounded sample: about PER_CLASS to twice that many documents of
each language, by a hash of the id): LANDMARKS texts of the sample, or
PER_LANGUAGE for each language where those are more, an equal share for each
language, span the Nyström approximation. One-versus-rest ridge regression
with targets +1 and -1 then solves (K' K + ridge * n * M) a = K' Y, with K the
kernel of the sample against the landmarks and M that of the landmarks. The
sample stays in a written table; the n-grams' counts and the normal equations
K' K and K' Y are summed where its rows are read, in whole numbers of 2**-40,
so that the model does not depend on how they are dealt. The driver holds the
landmarks and these sums, whose sizes depend on the number of languages only.

Scoring: each batch of texts is one 0/1 matrix; its product with the
landmarks' matrix gives the kernel values, a second product the responses.
The language of the highest response wins (ties: first in name order); the
score is that response, brought from [-1, 1] to [0, 1] and cut there.

A null text, or one without any letter, is ``und`` with score 0; so is every
text when nothing could be learned. A text with letters but none of the
vocabulary's n-grams has kernel 0 with all landmarks and gets the first
language with score 0.5. Repeated rows are scored each; very long texts are
worked through in pieces that overlap by the longest n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.llm.common import bounded_sample, prepare, stash, texts

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 14
FEATURES = 8192
PER_CLASS = 600
LANDMARKS = 256
PER_LANGUAGE = 4
RIDGE = 1e-4
UNKNOWN = "und"
#: Rows of one dense matrix.
_ROWS = 128
#: Rows of the sample whose normal equations are summed at once.
_BLOCK = 1024
_PIECE = 1 << 20


def presence(text: str) -> np.ndarray:
    """The set of a text's hashed n-grams as a 0/1 vector of all orders' buckets."""
    out = np.zeros(len(ORDERS) * BUCKETS, np.uint8)
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    for at in range(0, len(text), _PIECE):
        raw = np.frombuffer(text[at:at + _PIECE + max(ORDERS)].lower().encode("utf-8", "surrogatepass"), np.uint8)
        code = np.zeros(len(raw), np.uint64)
        for k, n in enumerate(range(1, max(ORDERS) + 1)):
            if len(raw) < n:
                break
            code = (code[:len(raw) - n + 1] << np.uint64(8)) | raw[n - 1:]
            if n in ORDERS:
                out[ORDERS.index(n) * BUCKETS + ((code * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)] = 1
    return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def chosen_features(ones: np.ndarray, n: int) -> np.ndarray:
    """The FEATURES n-grams of the widest spread, from the number of the n texts that hold each."""
    share = ones / n
    spread = share * (1 - share) + 1e-9 * share  # n-grams that all or none hold say nothing
    return np.sort(np.argsort(-spread, kind="stable")[:FEATURES])


def landmarks_each(languages: int) -> int:
    return max(PER_LANGUAGE, LANDMARKS // languages)


def unpacked(packed: np.ndarray, features: np.ndarray) -> Iterator[np.ndarray]:
    for k in range(0, len(packed), _ROWS):
        yield np.unpackbits(packed[k:k + _ROWS], axis=1)[:, features].astype(np.float32)


class Model:
    """Learned from presence vectors, packed eight n-grams to a byte, and their languages."""

    def __init__(self, packed: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        if not self.langs:
            return
        ones = sum(np.unpackbits(packed[k:k + _ROWS], axis=1).sum(0, dtype=np.int64) for k in range(0, len(packed), _ROWS))
        y = np.array([self.langs.index(v) for v in langs])
        chosen = np.concatenate([np.flatnonzero(y == c)[:landmarks_each(len(self.langs))] for c in range(len(self.langs))])
        self.span(chosen_features(ones, len(packed)), packed[chosen])
        self.solve(self.normal_sums(packed, y, np.bincount(y, minlength=len(self.langs))))

    def span(self, features: np.ndarray, landmarks: np.ndarray) -> None:
        """Set the vocabulary and the landmarks (packed)."""
        self.features = features
        self.landmarks = self._unit(np.concatenate(list(unpacked(landmarks, features))))

    def normal_sums(self, packed: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """K' K and K' Y side by side of some rows, languages counting alike, in 2**-40."""
        out = np.zeros((len(self.landmarks), len(self.landmarks) + len(self.langs)))
        for at, x in enumerate(unpacked(packed, self.features)):
            own = y[at * _ROWS:at * _ROWS + len(x)]
            weight = 1 / np.sqrt(sizes)[own][:, None]
            k = self.kernel(x).astype(np.float64) * weight
            targets = np.where(own[:, None] == np.arange(len(self.langs))[None], 1.0, -1.0) * weight
            out += k.T @ np.concatenate([k, targets], axis=1)
        return np.rint(out * 2.0**40).astype(np.int64)

    def solve(self, sums: np.ndarray) -> None:
        n, both = len(self.landmarks), sums / 2.0**40
        among = (self.landmarks @ self.landmarks.T).astype(np.float64)
        left = both[:, :n] + RIDGE * len(self.langs) * (among + 1e-6 * np.eye(n))
        self.weights = np.linalg.solve(left, both[:, n:]).astype(np.float32)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))

    def kernel(self, x: np.ndarray) -> np.ndarray:
        return self._unit(x) @ self.landmarks.T

    def predict(self, found: list[str]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(found), [0.0] * len(found)
        if self.langs:
            at = [i for i, t in enumerate(found) if has_letter(t)]
            for k in range(0, len(at), _ROWS):
                own = at[k:k + _ROWS]
                x = np.stack([presence(found[i])[self.features] for i in own]).astype(np.float32)
                response = self.kernel(x) @ self.weights
                best = response.argmax(1)
                for i, c, r in zip(own, best.tolist(), response.max(1).tolist(), strict=True):
                    names[i], scores[i] = self.langs[c], min(1.0, max(0.0, (r + 1) / 2))
        return names, scores


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> Model:
    """Learn from rows outside the held-out fifth that have a text and a language."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")) \
        .where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())

    def run(batches):
        for batch in batches:
            packed = [np.packbits(presence(t)).tobytes() for t in texts(batch)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang": batch.column("lang"),
                                              "seen": pa.array(packed, pa.binary())})

    sample = stash(bounded_sample(rows, "lang", "doc_id", per_class).mapInArrow(
        run, f"doc_id {dict(rows.dtypes)['doc_id']}, lang string, seen binary"), "langid-sample")
    sizes = {r[0]: r[1] for r in sample.groupBy("lang").count().collect()}  # one row for each language
    model = Model(np.zeros((0, 0), np.uint8), [])
    model.langs = sorted(sizes)
    if not sizes:
        return model

    def ones(batches):
        total = np.zeros(len(ORDERS) * BUCKETS, np.int64)
        for batch in batches:
            packed = _stacked(batch)
            for k in range(0, len(packed), _ROWS):
                total += np.unpackbits(packed[k:k + _ROWS], axis=1).sum(0, dtype=np.int64)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(met, pa.int64()), "n": pa.array(total[met], pa.int64())})

    counts = np.zeros(len(ORDERS) * BUCKETS, np.int64)
    for bucket, n in sample.mapInArrow(ones, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():  # at most all buckets
        counts[bucket] = n
    first = Window.partitionBy("lang").orderBy("doc_id", "seen")
    # At most LANDMARKS rows of 8 KB, or PER_LANGUAGE for each language.
    landmarks = sorted(sample.withColumn("at", F.row_number().over(first)).where(F.col("at") <= landmarks_each(len(sizes)))
                       .select("lang", "at", "seen").collect())
    model.span(chosen_features(counts, sum(sizes.values())), np.stack([np.frombuffer(r["seen"], np.uint8) for r in landmarks]))
    shared = sample.sparkSession.sparkContext.broadcast((model, np.array([sizes[v] for v in model.langs])))

    def sums(batches):
        learned, per_language = shared.value
        number = {v: c for c, v in enumerate(learned.langs)}
        total, block, held = 0, None, []

        def added():
            packed = np.stack([np.frombuffer(seen, np.uint8) for seen, _ in held])
            return learned.normal_sums(packed, np.array([c for _, c in held]), per_language)

        for batch in batches:
            for here, lang, seen in zip(*(batch.column(n).to_pylist() for n in ("block", "lang", "seen")), strict=True):
                if here != block and held:
                    total, held = total + added(), []
                block = here
                held.append((seen, number[lang]))
        if held:
            total = total + added()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int64()), pa.array(list(total), pa.list_(pa.int64()))], names=["row", "sums"])

    def add(batches):
        row, total = None, None
        out: list = []
        for batch in batches:
            for here, values in zip(batch.column("row").to_pylist(), batch.column("sums"), strict=True):
                if here != row:
                    if row is not None:
                        out.append((row, total))
                    row, total = here, 0
                total = total + values.values.to_numpy(zero_copy_only=False)
        if row is not None:
            out.append((row, total))
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int64()), pa.array([list(t) for _, t in out], pa.list_(pa.int64()))], names=["row", "sums"])

    # Blocks of rows are fixed by their hashes, so that each block's sum is the same wherever it is made.
    blocks = -(-sum(sizes.values()) // _BLOCK)
    dealt = (sample.withColumn("block", F.pmod(F.xxhash64("doc_id", "seen"), F.lit(blocks))).repartition("block")
             .sortWithinPartitions("block", "doc_id", "lang", "seen").select("block", "lang", "seen").mapInArrow(sums, "row long, sums array<long>"))
    got = dealt.repartition("row").sortWithinPartitions("row").mapInArrow(add, "row long, sums array<long>").collect()  # a row for each landmark
    model.solve(np.array([r["sums"] for r in sorted(got)], np.int64))
    return model


def _stacked(batch: pa.RecordBatch) -> np.ndarray:
    seen = batch.column("seen").to_pylist()
    return np.stack([np.frombuffer(x, np.uint8) for x in seen]) if seen else np.zeros((0, len(ORDERS) * BUCKETS // 8), np.uint8)


def recognised(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text",
               lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, with their own columns, whose language is not ``und``; texts are not shuffled."""
    spark = docs.sparkSession
    prepare(spark)
    learned = spark.sparkContext.broadcast(model or train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col))

    @F.pandas_udf("string")
    def predicted(column: pd.Series) -> pd.Series:
        return pd.Series(learned.value.predict([t or "" for t in column])[0], dtype=object)

    return docs.where(predicted(F.col(text_col)) != UNKNOWN)


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row; learns from ``docs`` when no model is given."""
    spark = docs.sparkSession
    prepare(spark)
    model = model or train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    learned = spark.sparkContext.broadcast(model)  # landmarks x FEATURES numbers

    def run(batches):
        for batch in batches:
            names, scores = learned.value.predict(texts(batch))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())})

    kind = dict(docs.dtypes)[id_col]
    return (docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"),
                        F.col(text_col).alias("text"))
            .mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double"))
