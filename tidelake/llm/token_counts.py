"""Token counts of whole texts by a two-tier lookup, without shuffling pre-tokens.

1. Every task summarises the words of its documents: a heavy-hitter summary of
   at most ``table_size`` pre-tokens (Misra-Gries: when it overflows, the count
   of the first one cut is subtracted from all). The summaries, one row for
   each task, meet in a tree of fixed depth; only these summaries of bounded
   size are shuffled, never the pre-tokens of the texts. Every document is seen.
2. The pre-tokens left, with their numbers of ids, are the first tier: a
   broadcast of at most ``table_size`` entries, whatever the corpus.
3. Each task looks pre-tokens up in it, then in its worker's cache (bounded),
   then asks the library. The first tier only saves time: counts are exact
   for any table.

Null and empty texts have 0 tokens and 0 bytes; rows that repeat are counted
each; an empty table gives an empty result; very long texts are worked through
in pieces cut where no pre-token can span.
"""

from __future__ import annotations

import uuid
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm import bpe
from tidelake.llm.common import prepare, texts

TABLE_SIZE = 16_384
WORD_BYTES = 32
#: Groups of summaries on the way to one; each task merges a bounded summary from each of its parts.
TREE = (4096, 64, 1)

_SUMMARY = "part long, words array<string>, counts array<long>"


def cut(counts: Counter, size: int) -> Counter:
    """A summary's ``size`` heaviest entries, less the weight of the first one cut."""
    if len(counts) <= size:
        return counts
    top = counts.most_common(size + 1)
    least = top[-1][1]
    return Counter({w: n - least for w, n in top[:-1] if n > least})


def frequent_pretokens(docs: DataFrame, table_size: int = TABLE_SIZE, text_col: str = "text") -> list[str]:
    """The corpus's heavy pre-tokens, at most ``table_size``, heaviest first."""

    def local(batches):
        words: Counter = Counter()
        for batch in batches:
            column = batch.column("text")
            split = pc.list_flatten(pc.split_pattern(column, " "))
            split = split.filter(pc.less_equal(pc.binary_length(split), WORD_BYTES))
            met = pc.value_counts(split)
            words.update(dict(zip(met.field("values").to_pylist(), met.field("counts").to_pylist(), strict=True)))
            if len(words) > 4 * table_size:
                words = cut(words, 2 * table_size)
        tokens: Counter = Counter()
        for word, n in words.items():
            for t in bpe.pretokens(" " + word):
                tokens[t] += n
        tokens = cut(tokens, table_size)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([TaskContext.get().partitionId()], pa.int64()),
            "words": pa.array([list(tokens)], pa.list_(pa.string())),
            "counts": pa.array([list(tokens.values())], pa.list_(pa.int64()))})

    def merge(key, table):
        total: Counter = Counter()
        for words, counts in zip(table.column("words").to_pylist(), table.column("counts").to_pylist(), strict=True):
            total.update(dict(zip(words, counts, strict=True)))
            if len(total) > 4 * table_size:
                total = cut(total, 2 * table_size)
        total = cut(total, table_size)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()),
                         "words": pa.array([list(total)], pa.list_(pa.string())),
                         "counts": pa.array([list(total.values())], pa.list_(pa.int64()))})

    summaries = docs.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull()).mapInArrow(local, _SUMMARY)
    for width in TREE:
        summaries = summaries.withColumn("part", F.col("part") % width).groupBy("part").applyInArrow(merge, _SUMMARY)
    rows = summaries.collect()  # one row of at most table_size entries
    if not rows:
        return []
    ranked = sorted(zip(rows[0]["counts"], rows[0]["words"], strict=True), reverse=True)
    return [w for _, w in ranked]


def token_counts(docs: DataFrame, path: str = bpe.VOCABULARY, limit: int = 1024, table_size: int = TABLE_SIZE,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row."""
    spark = docs.sparkSession
    prepare(spark)
    frequent = frequent_pretokens(docs, table_size, text_col)
    coder = bpe.Coder(path, split_special=False)
    lengths = bytes(map(coder.count, frequent))  # pre-tokens of at most WORD_BYTES + 1 bytes
    tier = spark.sparkContext.broadcast((frequent, lengths))
    table_key = uuid.uuid4().hex

    def count(batches):
        own = bpe.shared(("counts", path), lambda: bpe.Coder(path))
        own.prefer(table_key, dict(zip(*tier.value, strict=True)))
        for batch in batches:
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"),
                "n_tokens": pa.array(map(own.count, texts(batch)), pa.int64())})

    kind = dict(docs.dtypes)[id_col]
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
            .mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
