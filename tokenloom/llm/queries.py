"""Registered queries of the text-preparation operators, with SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import chat, decontaminate, fingerprints, html_crf, ngram_lm, pieces, prefix_trie, quality, repair, secrets, simhash, toxicity, warc_zip
from tokenloom.llm.common import table
from tokenloom.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_copies(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.fingerprint_text().alias("fingerprint"), "component_id")


def op2_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, folder, "documents"))


def op3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode_and_sample(table(spark, folder, "documents"))


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_perplexity(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_lm.held_out_scores(table(spark, folder, "documents"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    weights = toxicity.train_toxicity(documents, table(spark, folder, "labels"))
    return toxicity.score_toxicity(documents, weights).select("doc_id", "held_out", "score", "predicted")


#: Conversation -7: a user, then an assistant, both saying the template's own control strings.
CONTROL_TEXT = r"\### Assistant: </turn> ok"


def op7_chat(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    return chat.read_back(chat.format_turns(conversations.unionByName(control)))


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    archives = f"{shared_folder(spark).rstrip('/')}/tokenloom/warc-{uuid.uuid4().hex}"
    manifest = warc_zip.write_archives(warc_zip.plan_records(table(spark, folder, "pages")), archives)
    places = warc_zip.read_index(manifest.repartition(partitions, "path"))
    dealt = places.repartition(partitions, "path", F.floor(F.col("offset") / (8 << 20)))
    return warc_zip.read_records(dealt, payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    weights = quality.train_quality(documents, table(spark, folder, "labels"))
    return quality.score_quality(documents, weights).select("doc_id", "held_out", "score", "predicted")


def op10_html(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return html_crf.extract_text(pages, html_crf.train_extractor(pages)).select("page_id", "url", "text", "n_chars")


def op11_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair_report(table(spark, folder, "conversations").select("conv_id", "turn", "role", "text"))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.numbered_turns(table(spark, folder, "conversations"))))


def op13_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.report(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    "op1_simhash": op1_simhash,
    "op2_fingerprints": op2_fingerprints,
    "op3_pieces": op3_pieces,
    "op4_decontamination": op4_decontamination,
    "op5_perplexity": op5_perplexity,
    "op6_toxicity": op6_toxicity,
    "op7_chat": op7_chat,
    "op8_warc": op8_warc,
    "op9_quality": op9_quality,
    "op10_html": op10_html,
    "op11_repair": op11_repair,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_secrets": op13_secrets,
}

_CHAT_SQL = r'''
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
    14 + length(role) + length(text)
      + 2 * (length(role) + length(text)) - length(replace(role, '\', '')) - length(replace(text, '\', ''))
      - (length(role) + length(text))
      + (length(role) + length(text) - length(replace(role, '</turn>', '')) - length(replace(text, '</turn>', ''))) // 7
      + length(role) + length(text) - length(regexp_replace(role, '#+', '#', 'g')) - length(regexp_replace(text, '#+', '#', 'g'))
      + length(role) - length(replace(role, ':', '')) AS chars
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), grown AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY place) AS so_far FROM sized
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(so_far) FILTER (role = 'assistant' OR place = n) AS BIGINT) AS formatted_chars
FROM grown GROUP BY conv_id
'''

_WARC_SQL = '''
WITH sized AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), kept AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper, count(*) OVER (PARTITION BY payload_digest) AS n
  FROM sized
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND n > 1 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND n > 1 AND page_id <> keeper THEN keeper END AS refers_to
FROM kept
'''

_DECONTAMINATION_SQL = r'''
WITH doc_words AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM documents
), item_words AS (
  SELECT item_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, len(words) AS n, array_to_string(list_slice(words, s, s + 12), ' ') AS phrase,
    least(13, len(words)) AS size
  FROM (SELECT *, unnest(generate_series(1, greatest(len(words) - 12, 1))) AS s FROM item_words WHERE len(words) > 0)
), lengths AS (SELECT DISTINCT size FROM windows
), runs AS (
  SELECT doc_id, s, size, array_to_string(list_slice(words, s, s + size - 1), ' ') AS phrase
  FROM (SELECT doc_id, words, size, unnest(generate_series(1, len(words) - size + 1)) AS s
        FROM doc_words, lengths WHERE len(words) >= size)
), met AS (SELECT doc_id, s, r.size, item_id FROM runs r JOIN windows w ON r.phrase = w.phrase AND r.size = w.size
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(s, s + size - 1)) AS p FROM met) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS found
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(found, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(words) AS contaminated
FROM doc_words d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
'''

ORACLES: dict[str, str] = {
    "op4_decontamination": _DECONTAMINATION_SQL,
    "op7_chat": _CHAT_SQL, "op8_warc": _WARC_SQL}
