"""The registered queries of this subpackage: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import align, chat, decontam, htmltext, langid, lexical, merkle, packing, secrets, simhash, suffixdedup, urlgraph, warc
from .common import documents, pages

#: (host, path, verdict)
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(documents(spark, sf_dir))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("items", "longest")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.report(documents(spark, sf_dir))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(pages(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(documents(spark, sf_dir))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(documents(spark, sf_dir))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.report(pages(spark, sf_dir))


def op8_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(documents(spark, sf_dir))


def op9_url_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.judge(pages(spark, sf_dir), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(documents(spark, sf_dir))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, a row for each turn, and one record of another layout, whose texts hold control strings."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, [("user", said), ("assistant", said)])], "conv_id long, messages array<struct<role: string, content: string>>")
    return chat.report(spark.read.parquet(f"{sf_dir}/conversations.parquet").unionByName(extra, allowMissingColumns=True))


def op12_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.report(documents(spark, sf_dir))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {
    "op1_language": op1_language,
    "op2_decontaminate": op2_decontaminate,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_warc": op4_warc,
    "op5_packing": op5_packing,
    "op6_simhash": op6_simhash,
    "op7_html_text": op7_html_text,
    "op8_merkle": op8_merkle,
    "op9_url_graph": op9_url_graph,
    "op10_secrets": op10_secrets,
    "op11_chat_format": op11_chat_format,
    "op12_align_tokens": op12_align_tokens,
    "op13_lexical_search": op13_lexical_search,
}

#: DuckDB SQL where it can express a query; the others are held against brute force in the tests.
ORACLES: dict[str, str] = {
    "op2_decontaminate": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
il AS (SELECT item_id, ws, least(13, len(ws)) AS size FROM iw WHERE len(ws) > 0),
ig AS (SELECT DISTINCT item_id, size, array_to_string(ws[k : k + size - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(ws) - size + 2)) AS k FROM il)),
dg AS (SELECT doc_id, k, size, array_to_string(ws[k : k + size - 1], ' ') AS gram FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS k FROM dw, (SELECT DISTINCT size FROM ig))),
hit AS (SELECT doc_id, k, dg.size, item_id FROM dg JOIN ig USING (size, gram)),
n AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + size)) AS at FROM hit) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
SELECT dw.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN n ON dw.doc_id = n.doc_id LEFT JOIN i ON dw.doc_id = i.doc_id
""",
    "op4_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT *, list_aggregate(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * strpos('0123456789abcdef', substr(hex, i, 1)) - 3, 4)), 'string_agg', '') AS bits FROM p),
d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT) + 1 AS INT), 1)), 'string_agg', '') AS payload_digest,
  max(page_id) OVER (PARTITION BY body) AS first FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d
""",
    "op11_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, role = 'assistant' AS learned,
  CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 15 WHEN 'assistant' THEN 7 ELSE 25 + length(regexp_replace(role, '(<<|<|\[)(~*)(/?INST\]|/?s>|/?SYS>>|/?TURN>>|SAYS>>)', '\1~\2\3', 'g')) END
  + length(regexp_replace(text, '(<<|<|\[)(~*)(/?INST\]|/?s>|/?SYS>>|/?TURN>>|SAYS>>)', '\1~\2\3', 'g')) AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE learned), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE learned), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op13_lexical_search": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents WHERE text IS NOT NULL),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT count(*) AS docs, CAST(sum(len(ws)) AS BIGINT) AS length FROM d WHERE len(ws) > 0),
p AS (SELECT term, doc_id, any_value(n) AS n, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY term, doc_id),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term),
c AS (SELECT term, doc_id, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length))) AS c FROM p JOIN w USING (term), s),
r AS (SELECT item_id, doc_id, CAST(sum(c) AS BIGINT) AS score FROM c JOIN q USING (term) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
""",
}
