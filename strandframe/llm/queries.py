"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, chat, common, embed, langid, media, packing, pii, simhash, tokenstore, warc


def op1_chat(spark, sf_dir):
    own = spark.sql(
        "select * from values (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)"
    )
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    formatted, _ = common.save(chat.format_conversations(rows), "chat")
    return chat.digests(chat.read_back(formatted))


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\]', '', 'g')) + 2 * length(regexp_replace(text, '[^\[<]', '', 'g')) AS text_chars,
    length(role) + length(regexp_replace(role, '[^\\]', '', 'g')) + 2 * length(regexp_replace(role, '[^\[<]', '', 'g')) AS role_chars,
    CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS opens
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id,
  CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(text_chars) + sum(CASE WHEN opens = 1 THEN role_chars + 10 ELSE 3 END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op2_media(spark, sf_dir):
    return media.read(media.store(common.table(spark, sf_dir, "documents")))


def op3_langid(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op4_packing(spark, sf_dir):
    return packing.pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024)


def op5_simhash(spark, sf_dir):
    found = simhash.near_duplicates(common.table(spark, sf_dir, "documents"), radius=4, shingle=4)
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op6_bpe(spark, sf_dir):
    return bpe.encode_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_embeddings(spark, sf_dir):
    found = embed.near_duplicates(common.table(spark, sf_dir, "embeddings"), 0.95)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op8_warc(spark, sf_dir):
    return warc.read(warc.write(common.table(spark, sf_dir, "pages")))


def op9_tokens(spark, sf_dir):
    store = tokenstore.write(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return tokenstore.read_digests(store)


def op10_pii(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


QUERIES = {"op1_chat": op1_chat, "op2_media": op2_media, "op3_langid": op3_langid, "op4_packing": op4_packing, "op5_simhash": op5_simhash, "op6_bpe": op6_bpe, "op7_embeddings": op7_embeddings, "op8_warc": op8_warc, "op9_tokens": op9_tokens, "op10_pii": op10_pii}
ORACLE_SQL: dict[str, str] = {"op1_chat": OP1_SQL}
