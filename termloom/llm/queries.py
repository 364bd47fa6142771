"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import derive_calls, digest_chats, format_chats
from .decontaminate import find_leaks
from .langid import identify
from .line_dedup import dedup_lines
from .lm_score import score_documents
from .simhash import near_duplicates
from .sketch import fingerprint_documents
from .token_codec import encode_documents
from .token_count import count_tokens
from .url_filter import host_of, judge_urls


def tokenizer_file(name: str) -> str:
    """Where the public tokenizer file lies: the one place that knows."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Least posterior probability at which a document's language is accepted.
ACCEPT = 0.5

#: Schemas of the tools that conversations may call.
TOOLS = {
    "search": {"type": "object", "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1}}, "required": ["query"], "additionalProperties": False},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"]},
}

#: The rules of the URL query, fixed values.
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``pages`` with host, path, winning rule and verdict."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS t(host, path, verdict)")
    return judge_urls(_table(spark, sf_dir, "pages"), rules)


_OP4_SQL = """
WITH p AS (
  SELECT page_id, row_number() OVER () AS rn,
    CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
r(rh, rp, v) AS (VALUES """ + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES) + """),
m AS (
  SELECT rn, rh || rp AS rule, v, row_number() OVER (PARTITION BY rn ORDER BY length(rh) + length(rp) DESC, length(rh) DESC, v DESC) AS k
  FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, m.rule AS rule, coalesce(m.v, 'allow') AS verdict
FROM p LEFT JOIN m ON p.rn = m.rn AND m.k = 1
"""

def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens and masked pseudo-log-likelihood."""
    return score_documents(_table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the component of fingerprints within two bits."""
    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, dropped lines and the digest of its cleaned text."""
    found = dedup_lines(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded: token count and digests."""
    return encode_documents(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by all evidence, its probability, and whether the document is accepted."""
    docs = _table(spark, sf_dir, "documents")
    found = identify(docs, F.col("lang"), F.col("source"), "lang", "doc_id")
    return found.select("doc_id", F.col("_language").alias("language"), F.col("_confidence").alias("confidence"), (F.col("_confidence") >= ACCEPT).alias("accepted"))


def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for web pages: markup language, address suffix and host, over the text between the tags."""
    pages = _table(spark, sf_dir, "pages")
    bare = F.regexp_replace(F.col("html"), r"(?s)<(script|style)[^>]*>.*?</\1>|<!--.*?-->|<[^>]*>|&[a-z]+;", " ")
    declared = F.regexp_extract(F.col("html"), r"(?i)<html[^>]*\slang=[\"']?([A-Za-z-]+)", 1)
    rows = pages.select("page_id", "url", bare.alias("text"), F.when(declared != "", F.lower(declared)).alias("lang"))
    found = identify(rows, F.col("lang"), host_of(F.col("url")), "lang", "page_id")
    return found.select("page_id", F.col("_language").alias("language"), F.col("_confidence").alias("confidence"))


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every whole text."""
    return count_tokens(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a test item that it holds, with score and overlaps."""
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sketch, its edited text's, and their likeness to each other and to the next document."""
    return fingerprint_documents(_table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message's place, links, error and the digest of its canonical JSON."""
    return digest_chats(format_chats(_table(spark, sf_dir, "conversations"), TOOLS))


def chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for conversations with calls: places, links and errors of every message, call and result. The table's own
    conversations hold no calls, so they are made from it by a fixed rule."""
    return format_chats(derive_calls(_table(spark, sf_dir, "conversations")), TOOLS, name="chat-calls").drop("json")


_CALLS_SQL = """
WITH u AS (SELECT conv_id, turn AS t, text FROM conversations WHERE role = 'user' AND turn IS NOT NULL)
SELECT conv_id, 3 * turn AS turn, role, 3 * turn AS order_turn, CAST(0 AS INTEGER) AS order_depth, CAST(NULL AS BIGINT) AS call_turn,
  CASE WHEN role = 'tool' THEN 'result without call id' END AS error FROM conversations
UNION ALL SELECT conv_id, 3 * t + 1, 'assistant', 3 * t + 1, 0, NULL, CASE WHEN coalesce(text, '') = '' THEN '$.query: too short' END FROM u
UNION ALL SELECT conv_id, CASE WHEN t % 2 = 0 THEN 3 * t - 1 ELSE 3 * t + 2 END, 'tool', CASE WHEN t % 2 = 0 THEN 3 * t + 1 ELSE 3 * t + 2 END,
  CASE WHEN t % 2 = 0 THEN 1 ELSE 0 END, 3 * t + 1, NULL FROM u
"""


QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_simhash": op2_simhash,
    "op3_line_dedup": op3_line_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_bpe_codec": op5_bpe_codec,
    "op6_language_id": op6_language_id,
    "op7_token_count": op7_token_count,
    "op8_decontaminate": op8_decontaminate,
    "op9_fingerprint": op9_fingerprint,
    "op10_chat_format": op10_chat_format,
    "chat_tool_calls": chat_tool_calls,
    "pages_language_id": pages_language_id,
}

ORACLES = {
    "op4_url_filter": _OP4_SQL,
    "chat_tool_calls": _CALLS_SQL,
}
