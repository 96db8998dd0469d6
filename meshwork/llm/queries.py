"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.llm import chat_format, decontaminate, embedding_dedup, html_extract, language_id, minhash_dedup, packing, secret_scan, token_binary, token_counts
from meshwork.llm.common import read


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(read(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


MARKS = "<|im_end|><|im_start|>assistant ok"


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", MARKS), (-1, 1, "assistant", MARKS)], "conv_id bigint, turn bigint, role string, text string")
    return chat_format.read_back(chat_format.format_conversations(turns.unionByName(extra)))


def chat_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of ``conversations`` as JSON records of seven layouts, formatted and read back."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    role, text, ident = F.col("role"), F.col("text"), F.col("turn").alias("id")
    other = F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    message = F.struct(role, text.alias("content"))
    part = F.struct(F.lit("text").alias("type"), text)
    layouts = [
        F.to_json(F.struct(role, text)),
        F.to_json(F.struct(role, text.alias("content"), ident)),
        F.to_json(F.struct(F.array(message).alias("messages"), F.array().cast("array<string>").alias("tags"))),
        F.to_json(F.struct(F.array(F.struct(other.alias("from"), text.alias("value"))).alias("conversations"), ident)),
        F.to_json(F.struct(F.array(F.struct(role, F.array(part).alias("content"), F.lit("n").alias("name"))).alias("messages"))),
        F.to_json(F.array(message)),
        F.to_json(F.struct(F.struct(F.lit(1).alias("b")).alias("a"), role, text)),
    ]
    chosen = F.pmod(F.col("turn") + F.col("conv_id"), F.lit(len(layouts)))
    record = F.coalesce(*[F.when(chosen == i, x) for i, x in enumerate(layouts)])
    return chat_format.read_back(chat_format.format_records(turns.select("conv_id", "turn", record.alias("record")), "record", turn="turn"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, percent=85)


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(read(spark, sf_dir, "embeddings"), threshold=0.9)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~language_id.held_out("doc_id")))
    found = language_id.identify(docs, model)
    return found.select("doc_id", language_id.held_out("doc_id").alias("held_out"), "lang_pred", F.col("score"), "languages")


def op10_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary.round_trip(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_token_counts, op3_secret_scans, op4_best_fit_packing, op5_chat_formatting, chat_layouts, op6_minhash_near_dedup, op7_embedding_near_dedup, op8_decontamination, op9_language_id, op10_token_binary)}

_COMPONENTS = """, edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT {id} AS id, {id} AS other FROM {nodes} UNION SELECT r.id, e.b FROM reach r JOIN edges e ON r.other = e.a),
labels AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_CHAT = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  {more}
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length(role) + 1 + length(regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g')) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

ORACLES = {
    "op5_chat_formatting": _CHAT.format(more=f"UNION ALL SELECT -1, 0, 'user', '{MARKS}' UNION ALL SELECT -1, 1, 'assistant', '{MARKS}'"),
    "chat_layouts": _CHAT.format(more=""),
    "op6_minhash_near_dedup": f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^ \\t-\\r]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s
  FROM words),
size AS (SELECT doc_id, len(s) AS n FROM sets),
flat AS (SELECT doc_id, unnest(s) AS x FROM sets),
shared AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM flat p JOIN flat q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k))
{_COMPONENTS.format(id='doc_id', nodes='size')}
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM size JOIN labels ON id = doc_id
""",
    "op7_embedding_near_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id < q.vec_id
  WHERE list_cosine_similarity(p.e, q.e) >= 0.9),
ends AS (SELECT a AS id FROM links UNION ALL SELECT b FROM links),
degree AS (SELECT id, count(*) AS n FROM ends GROUP BY id)
{_COMPONENTS.format(id='vec_id', nodes='v')}
SELECT vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN labels l ON l.id = vec_id LEFT JOIN degree d ON d.id = vec_id
""",
    "op8_decontamination": f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS x
  FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS x FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(k)),
hits AS (SELECT doc_id, item_id, k, dw.n FROM dw JOIN iw ON dw.n = iw.n AND dw.x = iw.x),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(k, k + n)) AS t(p) GROUP BY doc_id),
found AS (SELECT doc_id, count(item_id) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
""",
}
