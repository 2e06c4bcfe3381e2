"""A corpus pipeline of five stages; each takes the documents that the stage before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeworks.llm import common, langid, lines, minhash, mixing
from fringeworks.llm.queries import bpe_digests

#: Below this score a text is no running text in any of the languages.
LEAST_SCORE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognised language. Columns stay as they are."""
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    net = langid.train(docs.where(remainder != 2))
    judged = langid.identify(docs, net)
    gone = judged.where((F.col("lang_pred") == "und") | (F.col("score") < LEAST_SCORE)).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; a document of which nothing is left goes."""
    done = lines.dedup_lines(docs)
    changed = (F.col("_n_exact") + F.col("_n_near")) > 0
    done = done.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return done.withColumn("n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words a shingle, a similarity of 0.8."""
    gone = minhash.near_duplicates(docs).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as often, and as far, as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in tokens: doc_id, n_tokens, ids_sha256, decoded_sha256 a row."""
    return bpe_digests(docs, str(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixture", mixture), ("tokens", tokens)]
#: SQL can't express the trained and hashed stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
