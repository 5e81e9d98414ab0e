"""A training corpus from the documents table: language ID, exact dedup, near-dedup, PII, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactry.llm import exact_dedup as exact
from contactry.llm.common import NO_ID, fresh, store
from contactry.llm.language_id import keep_identified
from contactry.llm.minhash import near_duplicates
from contactry.llm.packing import pack
from contactry.llm.pii import redact_documents


#: Rows that go to Python at a time in stages that store their result; their bytes are bounded too.
BATCH_ROWS = 1000
#: Keys up to which the rows that go are broadcast: some 10 MB.
SMALL = 100_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go (no text, no letter in it, or too close between two); ``lang`` is the predicted one.

    Rows without an id and repeated rows are judged like others.
    """
    return store(keep_identified(docs), "language_id", BATCH_ROWS)


def _only(docs: DataFrame, result: DataFrame, name: str, mark) -> DataFrame:
    """The rows of ``docs`` that ``result`` keeps, by id and text mark; of rows with the same id and text one.

    Texts stay where they are: the few keys that go, or that have several rows, are taken out by an anti join, and
    only rows that share a key are brought together. Names inside are ones that ``docs`` does not have.
    """
    at, by, kept, rows = (fresh(docs, n) for n in ("at", "by", "kept_row", "rows_of_key"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    told = result.select(F.coalesce("doc_id", F.lit(NO_ID)).alias(at), F.col(name).alias(by), F.col("kept").alias(kept))
    told = store(told.groupBy(at, by).agg(F.bool_or(kept).alias(kept), F.count("*").alias(rows)).where(~F.col(kept) | (F.col(rows) > 1)), "odd")
    if told.count() <= SMALL:
        told = F.broadcast(told)
    own = docs.withColumns({at: key, by: mark})
    plain = own.join(told.select(at, by), [at, by], "left_anti")
    again = own.join(told.where(kept).select(at, by), [at, by], "left_semi").dropDuplicates([at, by])
    return plain.unionByName(again).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text the one with the largest doc_id stays.

    Null counts as empty text, a null id as smaller than all others; of repeated rows one stays.
    """
    return _only(docs, exact.exact_dedup(docs), "text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate documents the one with the smallest doc_id stays.

    A null id counts as smaller than all others; texts without words are alike to nothing; of repeated rows one stays.
    """
    return _only(docs, near_duplicates(docs), "text_hash", F.xxhash64(F.coalesce("text", F.lit("")).cast("binary")))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind in brackets; no row goes, null texts stay null."""
    return store(redact_documents(docs), "pii", BATCH_ROWS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return store(pack(docs), "packed", BATCH_ROWS)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]

#: Near-dedup and tokenizers are beyond SQL: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage in (exact_dedup, near_dedup):  # the others give a stored table
            docs = store(docs, name)
    return docs
