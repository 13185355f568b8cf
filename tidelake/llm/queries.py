"""The dealt operators as registered queries over whole tables, and the driver's SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from tidelake.llm import ann, chat, embed_dedup, langid, oracles, packing, pieces, quality, repair, sharding, simhash, token_counts, trie, urls
from tidelake.sources.tables import read_table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id", "kept")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold control strings."""
    table = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                   F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                   F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.read_back(chat.format_conversations(table.union(tricky)))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op5_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's ids, and whether they decode to its text."""
    docs = read_table(spark, sf_dir, "documents")
    return pieces.encode(docs).select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.array_join("ids", " ").alias("ids"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(read_table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(read_table(spark, sf_dir, "conversations"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read_table(spark, sf_dir, "pages"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damage_report(read_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_simhash_near_dedup, op3_chat_format, op4_language_id, op5_hash_prefix_forest, op6_sentencepiece,
    op7_packing, op8_embedding_near_dedup, op9_sharding, op10_quality_classifier,
    op11_conversation_trie, op12_url_filters, op13_conversation_repair)}

#: Results that SQL can say: what is read back from formatted chats, links by all pairs (whose components
#: are small here), the prefix trie, the URL models and the repair. Hashes, tokenizers and fitted models are beyond SQL; the tests
#: hold the other queries against brute force.
ORACLES: dict[str, str] = {
    "op3_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
escaped AS (
  SELECT *, length(regexp_replace(role, '([<\[])(\\*)(\|[A-Za-z0-9_]+\|>|/?s>|/?INST\])', '\1\\\2\3', 'g'))
          + length(regexp_replace(text, '([<\[])(\\*)(\|[A-Za-z0-9_]+\|>|/?s>|/?INST\])', '\1\\\2\3', 'g')) AS chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars + length('<|start|><|message|><|end|>')) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
""",
    "op8_embedding_near_dedup": """
WITH RECURSIVE
vectors AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM vectors a JOIN vectors b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
   AND list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.93),
reach (vec_id, r) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT reach.vec_id, links.w FROM reach JOIN links ON links.u = reach.r)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE u = e.vec_id) AS n_links,
       c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id) c ON c.vec_id = e.vec_id
""",
    "op11_conversation_trie": oracles.CONVERSATION_TRIE,
    "op12_url_filters": oracles.URL_FILTERS,
    "op13_conversation_repair": oracles.CONVERSATION_REPAIR,
}
