"""A corpus pipeline over `documents`: from raw rows to packed training sequences.

STAGES run in order. Each takes (spark, docs, sf_dir), where docs is what the stage before kept, and its result is
written as Parquet and reread as the next one's docs. All but the last return the columns of documents.

1. language: documents without letters, or whose words neither share a language nor are each sure of one, go.
2. simhash: of each group of documents linked by similarity 0.8 of five-word shingles the one with the smallest doc_id
   stays. Groups of op5's index and cells of minima propose, whole shingle sets decide.
3. pii: personal data in the texts is replaced by its kind in brackets; n_chars follows.
4. packing: texts become token ids, cut and packed into sequences of 1024; the rows are the placed pieces
   with their ids (little-endian unsigned 32-bit integers).

Null texts go in the first stage (they have no letters). Rows are told apart by their texts, so rows that repeat a doc_id
with different texts stay; of near copies without doc_id one stays. Further columns, whatever their names, go along
to the last stage. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm import common, langid, packing, pii, similar

#: A document stays if its words speak for its language with this mean posterior at least.
MIN_SCORE = 0.4
#: Or if its words, taken one by one, are this certain of some language on average: code-switched text.
MIN_CERTAINTY = 0.8
#: Near copies have this Jaccard similarity of their sets of five-word shingles at least.
MIN_SIMILARITY = 0.8


def language_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = tuple(common.free(docs, n) for n in langid.ADDED)
    pred, score, certainty = (F.col(n) for n in names)
    clear = (score >= MIN_SCORE) | (certainty >= MIN_CERTAINTY)
    return langid.annotate(docs, langid.fit(docs), names=names).where((pred != langid.UNKNOWN) & clear).select(docs.columns)


def simhash_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.one_of_each(docs, MIN_SIMILARITY)


def pii_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, pii.fit(docs))


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024, keep_ids=True)


STAGES = [("language", language_stage), ("simhash", simhash_stage), ("pii", pii_stage), ("packing", packing_stage)]
#: SQL cannot express the first three stages; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = common.save(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
