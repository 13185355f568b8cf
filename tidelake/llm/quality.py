"""Quality selection by importance resampling of hashed n-gram models.

Two generative models over hashed word n-grams (words and neighbouring word
pairs, BUCKETS buckets; a word followed by itself goes to one bucket of its
own, whatever the word): the target model from documents labelled good, the
raw model from every document. A document's importance weight is the product
over its n-grams of target / raw probability.

Sampling without replacement in proportion to the weights is Gumbel top-k: the
k largest values of log weight + Gumbel noise, the noise being a hash of the
id. k is the number of documents whose log weight reaches a threshold; the
threshold separates best the good and bad documents of a labelled sample that
the target model has not seen. The k-th largest key is found exactly, by
counting keys in ranges that close in on it.

Two options leave the plain weight: a ``temperature`` other than 1 divides the
log weight, and ``per_feature`` takes the mean log ratio (the log weight
divided by its number of n-grams plus PRIOR, which keeps short documents near
0) in its place.

The labelled sample is bounded (about PER_LABEL to twice that many documents
of each label, by a hash of the id); half of the good ones train the target
model, the others set the threshold. Raw counts, k and the sample cover all
documents.

Texts of any length are hashed whole, in pieces; an empty table gives no rows.
A null text or one without words has no weight and is never sampled. Repeated
rows have equal keys and share their fate, so ties at the k-th key are all
kept. Without good labels nothing can be told apart and everything that has
words is kept; without bad ones the threshold is the lowest good document's.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import bounded_sample, pieces, prepare, stash, texts, unit_hash
from tidelake.llm.rowkeys import keyed

BUCKETS = 1 << 15
PER_LABEL = 4000
PRIOR = 20
TEMPERATURE = 1.0
#: Pseudo-count of each bucket in both models.
SMOOTH = 1.0

_WORDS = regex.compile(r"\w+|[^\w\s]+")


def ngrams(text: str) -> np.ndarray:
    """The buckets of a text's words and word pairs, with repeats."""
    import xxhash

    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    out, last = [], None
    for piece in pieces(text):
        words = _WORDS.findall(piece.lower())
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        if not len(h):
            continue
        joined = h if last is None else np.concatenate([[last], h])
        pairs = (joined[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ joined[1:]
        pairs = np.where(joined[:-1] == joined[1:], np.uint64(0), pairs * np.uint64(0xC2B2AE3D27D4EB4F))
        out += [h >> shift, pairs >> shift]
        last = h[-1]
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def label_sample(labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """doc_id, good, fits (whether it trains the target model): a bounded sample
    of labelled ids. Good: quality 1 and not toxic. Ids with differing labels count as bad."""
    one = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
           .groupBy("doc_id").agg(F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")).alias("good"),
                                  F.max("quality").alias("quality"))
           .where((F.col("good") == 1) | (F.col("quality") == 0)))
    return (bounded_sample(one, "good", "doc_id", per_label)
            .select("doc_id", (F.col("good") == 1).alias("good"), (unit_hash("doc_id", F.lit("half")) < 0.5).alias("half"))
            .withColumn("fits", F.col("good") & F.col("half")).drop("half"))


def ratios(docs: DataFrame, sample: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """The log ratio of target to raw probability of each bucket."""

    def count(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text, fits in zip(texts(batch), batch.column("fits").to_pylist(), strict=True):
                got = np.bincount(ngrams(text), minlength=BUCKETS)
                raw += got
                if fits:
                    target += got
        met = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(met, pa.int64()), "raw": pa.array(raw[met], pa.int64()),
                                          "target": pa.array(target[met], pa.int64())})

    # sample has at most four times PER_LABEL rows
    flagged = (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
               .join(F.broadcast(sample.select("doc_id", "fits")), "doc_id", "left")
               .select("text", F.coalesce("fits", F.lit(False)).alias("fits")))
    sums = flagged.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket") \
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.full(BUCKETS, SMOOTH), np.full(BUCKETS, SMOOTH)
    for bucket, r, t in sums.collect():  # at most BUCKETS rows
        raw[bucket] += r
        target[bucket] += t
    if target.sum() == SMOOTH * BUCKETS:
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weigh(docs_text: Column, ratio) -> Column:
    """struct(n_features, log_weight) of a text column; ``ratio``: a broadcast of the buckets' log ratios."""

    @F.pandas_udf("n_features long, log_weight double")
    def run(column: pd.Series) -> pd.DataFrame:
        got = [ngrams(t or "") for t in column]
        return pd.DataFrame({"n_features": [len(g) for g in got],
                             "log_weight": [float(ratio.value[g].sum()) for g in got]})

    return run(docs_text)


def threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The cut with the greatest share of good at or above it less that of bad; of nearly equal ones the lowest."""
    if not len(good):
        return -np.inf
    if not len(bad):
        return float(good.min())
    cuts = np.sort(np.concatenate([good, bad]))
    gain = (1 - np.searchsorted(np.sort(good), cuts) / len(good)) - (1 - np.searchsorted(np.sort(bad), cuts) / len(bad))
    return float(cuts[np.flatnonzero(gain >= gain.max() - 1e-3)[0]])


def kth_largest(df: DataFrame, key: str, k: int, bins: int = 4096) -> float | None:
    """The exact k-th largest value of a written table's column, by ranges that close in on it."""
    if k <= 0:
        return None
    lo, hi, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if n <= k:
        return lo
    left, inside = k, df.where(F.col(key).isNotNull())
    while lo < hi:
        at = F.least(F.floor((F.col(key) - lo) / (hi - lo) * bins), F.lit(bins - 1))
        inside = df.where(F.col(key).between(lo, hi))
        for _, count, least, most in sorted(inside.groupBy(at.alias("bin")).agg(
                F.count(key), F.min(key), F.max(key)).collect(), reverse=True):  # at most ``bins`` rows
            if count >= left:
                lo, hi = least, most
                break
            left -= count
        if left == 1:
            return hi
    return lo


class Selection:
    """What fitting leaves: the buckets' ratios, the threshold, k and the k-th largest key."""

    def __init__(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 per_label: int = PER_LABEL, temperature: float = TEMPERATURE, per_feature: bool = False, seed: int = 0,
                 row: Column | None = None):
        spark = docs.sparkSession
        prepare(spark)
        sample = stash(label_sample(labels, per_label), "quality-labels")
        ratio = spark.sparkContext.broadcast(ratios(docs, sample, id_col, text_col))
        mean = F.when(F.col("n_features") > 0, F.col("log_weight") / (F.col("n_features") + PRIOR))
        weight = mean if per_feature else F.when(F.col("n_features") > 0, F.col("log_weight"))
        noise = -F.log(-F.log(unit_hash("doc_id", F.lit(f"gumbel-{seed}")) * (1 - 2.0**-52) + F.lit(2.0**-54)))
        self.scores = stash(
            docs.select(F.col(id_col).alias("doc_id"), (F.lit(None).cast("long") if row is None else row).alias("row"),
                        weigh(F.col(text_col), ratio).alias("w"))
            .select("doc_id", "row", "w.*").withColumns({"mean_ratio": mean, "weight": weight})
            .withColumn("sample_key", F.col("weight") / F.lit(temperature) + noise), "quality-scores")
        shown = (self.scores.join(F.broadcast(sample.where(~F.col("fits"))), "doc_id")
                 .where(F.col("weight").isNotNull()).groupBy("doc_id", "good").agg(F.min("weight").alias("m")).collect())
        self.threshold = threshold(np.array([r["m"] for r in shown if r["good"]]), np.array([r["m"] for r in shown if not r["good"]]))
        self.k = self.scores.where(F.col("weight") >= F.lit(self.threshold)).count()
        self.cut = kth_largest(self.scores, "sample_key", self.k)

    @property
    def _kept(self) -> Column:
        return F.coalesce(F.col("sample_key") >= F.lit(self.cut), F.lit(False)) if self.cut is not None else F.lit(False)

    def result(self) -> DataFrame:
        """doc_id, n_features, log_weight, mean_ratio, sample_key and kept of each row."""
        return self.scores.select("doc_id", "n_features", "log_weight", "mean_ratio", "sample_key", self._kept.alias("kept"))

    def rows(self) -> DataFrame:
        """The numbers of the rows that are sampled."""
        return self.scores.where(self._kept).select("row")


def sampled(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are sampled, with their own columns. Texts are hashed once for the models
    and once for the weights, and are not shuffled (``rowkeys``)."""
    numbered = keyed(docs)
    return numbered.only(Selection(numbered.table, labels, row=F.col(numbered.row), **options).rows())


def resample(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, n_features, log_weight, mean_ratio, sample_key and kept (whether sampled) of each row."""
    return Selection(docs, labels, **options).result()
