"""A corpus through language ID, near-dedup, decontamination, secret scan and BPE."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingrisk.llm import bpe, decontaminate, langid, neardup, secretscan
from filingrisk.llm.catalog import new_folder
from filingrisk.llm.common import free_name, prepare_session, read_table, text_or_empty


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model learns from those that are not held out.

    Null and empty texts and texts without letters go. Repeated rows are judged
    alike, so all stay or all go; an empty table stays empty. All columns are
    returned as they are, whatever their names and types.
    """
    prepare_session(spark)
    model = langid.fit(docs.where(~langid.held_out("doc_id")))
    return langid.keep_recognised(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id.

    Rows repeated under one doc_id leave one row for each of their texts; rows
    without doc_id stay unless a document with one has the same words. Texts
    without words, null ones too, are nobody's duplicates and stay.
    """
    prepare_session(spark)
    kept_id = free_name("kept_id", docs)
    kept = neardup.near_duplicates(docs.select("doc_id", "text"), k=5, percent=80).where("kept and doc_id is not null")
    kept = kept.select(F.col("doc_id").alias(kept_id)).distinct()
    named = docs.join(kept, F.col("doc_id") == F.col(kept_id), "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.where("doc_id is null"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; repeated rows stay or go together.
    """
    prepare_session(spark)
    key = free_name("text_key", docs)
    leaks = decontaminate.find_leaks(docs.select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    leaks = leaks.select(F.col("text_key").alias(key)).distinct()
    return docs.join(leaks, F.sha2(text_or_empty(), 256) == F.col(key), "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mask.

    Null texts stay null, repeated rows stay repeated, other columns as they
    are; n_chars, where there is one, is that of the masked text.
    """
    prepare_session(spark)
    return secretscan.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of what they decode to.

    A null text is empty and has no ids; every row gives a row, repeated ones
    and those without doc_id too. Other columns are not read.
    """
    prepare_session(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    made = bpe.encode_documents(docs.select("doc_id", "text"), path, decoded=True)
    return made.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secret_scan", mask_secrets),
    ("bpe", encode),
]

#: Language ID and BPE have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        at = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
