"""The queries of this subpackage: one opN_<name> for each operator, and their SQL.

Each query reads whole tables and applies its operator with production
parameters; digest columns are derived from the operator's real outputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bitsliced, chat, decontaminate, neardup, packing, pii, quality, substring, suffixdedup, tokens
from tessera.llm._session import cut, table

PROBE = "\\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.read_back(chat.format_chats(rows))


OP1_SQL = r"""
WITH given AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
steps AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    replace(replace(replace(text, '\', '\\'), '</turn>', '\</turn>'), '### ', '\### ') AS escaped
  FROM given)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ' || role || ': ' || escaped || '</turn>') + 1) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before IN ('system', 'assistant') THEN role = 'user' ELSE before = 'user' AND role = 'assistant' END) AS valid_order
FROM steps GROUP BY conv_id
"""


KEEP_FROM = 0.3


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(quality.vectors(table(spark, sf_dir, "documents")))
    model = quality.fit(rows, table(spark, sf_dir, "labels"))
    return quality.score(rows, model).select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.cluster(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.remove(table(spark, sf_dir, "documents")))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.digest(suffixdedup.remove(table(spark, sf_dir, "documents")))


TOP, QUERY_STEP = 20, 20


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = bitsliced.quantised(table(spark, sf_dir, "embeddings"))
    return bitsliced.top_k(vectors, vectors.where(F.col("vec_id") % QUERY_STEP == 0), TOP)


OP4_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS items
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.items, c.items), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
"""


PACKING_TOKENIZER, END_ID = "word_bpe_49k.json", 2


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


TOKEN_LIMIT = 1024


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens.count(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return rows.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(PACKING_TOKENIZER), END_ID)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_chat_format, op2_decontamination, op3_suffix_dedup, op4_topk_search, op5_neardup, op6_token_counts, op7_substring_dedup, op8_quality, op9_pii, op10_packing)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1_SQL, "op4_topk_search": OP4_SQL}
