"""One named query per operator, over whole tables, and SQL where it can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farpoint.llm import (
    alignment,
    collision_ann,
    line_dedup,
    mixing,
    packing,
    perspectives,
    pseudonyms,
    quality,
    repair,
    simhash,
    sorted_passes,
    token_edits,
    warc,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_simhash_near_dedup(spark, sf):
    classes = simhash.simhash_classes(table(spark, sf, "documents"))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op2_quality_classifier(spark, sf):
    return quality.classify(table(spark, sf, "documents")).select("doc_id", "quality", "keep")


@query
def op3_pii_pseudonyms(spark, sf):
    return pseudonyms.pseudonymise(table(spark, sf, "documents")).select("doc_id", "text", "n_private")


@query
def op4_mix_sources(spark, sf):
    mixed = mixing.mix_sources(table(spark, sf, "documents"))
    return mixed.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_size") * F.col("_copies")).alias("taken"),
    )


# Cleaning edits: runs of equal symbols and long numbers go.
CLEANED = r"([#&$%*!=_~])\1+|[0-9]{5,}"


@query
def op5_token_counts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    edited = token_edits.edited_counts(token_edits.token_trees(token_edits.replacements(docs, CLEANED, "")))
    return edited.select("doc_id", "n_before", "n_after", "n_encoded")


@query
def op6_nearest_neighbours(spark, sf):
    rows = table(spark, sf, "embeddings")
    return collision_ann.nearest_by_collisions(rows, rows.where("vec_id % 20 = 0"))


@query
def op7_line_dedup(spark, sf):
    kept = line_dedup.dedup_lines(table(spark, sf, "documents"))
    return kept.select(
        "doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256")
    )


ORACLES["op7_line_dedup"] = """
WITH numbered AS (
  SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT doc_id, r, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM numbered
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), repeated AS (
  SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (owner <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (owner IS NULL OR owner = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN repeated USING (k)
GROUP BY r, doc_id
"""


@query
def op8_best_fit_packing(spark, sf):
    return packing.pack_documents(table(spark, sf, "documents"))


@query
def op9_embedding_near_dedup(spark, sf):
    return sorted_passes.near_duplicate_vectors(table(spark, sf, "embeddings"))


@query
def op10_chat_perspectives(spark, sf):
    return perspectives.rotate_perspectives(table(spark, sf, "conversations"))


ORACLES["op10_chat_perspectives"] = r"""
WITH messages AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS s, replace(coalesce(text, ''), '<|', '<||') AS x FROM conversations
), people AS (
  SELECT DISTINCT conv_id, s AS assistant FROM messages WHERE s <> 'system'
), pieces AS (
  SELECT m.conv_id, assistant, turn, s, x,
         CASE WHEN s = 'system' THEN '<|system|>' WHEN s = assistant THEN '<|assistant|>'
              ELSE '<|user name=' || s || '|>' END || chr(10) AS head
  FROM messages m JOIN people p ON m.conv_id = p.conv_id
), placed AS (
  SELECT *, head || x || '<|end|>' || chr(10) AS r,
         sum(length(head || x || '<|end|>' || chr(10))) OVER (PARTITION BY conv_id, assistant ORDER BY turn, s) AS e
  FROM pieces
), parts AS (
  SELECT *, CAST((e - length(r)) // 65536 AS BIGINT) AS part FROM placed
), spans AS (
  SELECT *, e - length(r) - min(e - length(r)) OVER (PARTITION BY conv_id, assistant, part) AS b FROM parts
)
SELECT conv_id, assistant, part, string_agg(r, '' ORDER BY b) AS rendered, count(*) AS n_messages,
       coalesce(list(CAST(b + length(head) AS BIGINT) ORDER BY b) FILTER (s = assistant), []) AS mask_starts,
       coalesce(list(CAST(b + length(r) AS BIGINT) ORDER BY b) FILTER (s = assistant), []) AS mask_ends
FROM spans GROUP BY conv_id, assistant, part
"""


@query
def op11_tokenizer_alignment(spark, sf):
    return alignment.align_documents(table(spark, sf, "documents"))


@query
def op12_warc_salvage(spark, sf):
    archives = warc.write_archives(table(spark, sf, "pages"))
    pages = warc.records(warc.read_archives(archives, payloads=False)).where("record_type IN ('response', 'revisit')")
    return pages.select(
        warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of("refers_to").alias("refers_to")
    )


ORACLES["op12_warc_salvage"] = """
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), firsts AS (SELECT h, min(page_id) AS first FROM hashed GROUP BY h)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (
         (((instr('0123456789abcdef', substr(h, CAST(5 * i // 4 + 1 AS BIGINT), 1)) - 1) * 16
           + instr('0123456789abcdef', substr(h, CAST(5 * i // 4 + 2 AS BIGINT), 1)) - 1) >> CAST(3 - 5 * i % 4 AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM hashed JOIN firsts USING (h)
"""


@query
def op13_conversation_repair(spark, sf):
    conversations = table(spark, sf, "conversations")
    return repair.with_all_conversations(repair.repair_conversations(repair.damage(conversations)), conversations)
