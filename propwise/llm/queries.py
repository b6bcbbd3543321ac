"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (conversations, exact_dedup, langid, lattice, licenses, mixing, packing, quality, sharding, simhash, token_counts,
               warc, whitening)
from .common import read_table

TOKENIZER = "word_bpe_49k.json"


SHARDS = 40


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"), carry=["doc_id"])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")), carry=["doc_id"])


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"), carry=["doc_id"])


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shuffle_to_shards(read_table(spark, sf_dir, "documents"), SHARDS)
    return shards.select(
        "doc_id", sharding.text_size(F.col("text")).alias("size"), sharding.text_crc32(F.col("text")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"), carry=["doc_id"])


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read_table(spark, sf_dir, "documents"))


def op8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(read_table(spark, sf_dir, "embeddings"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), carry=["doc_id"])


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_conversations(read_table(spark, sf_dir, "conversations"), damaged=True)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_embeddings(read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_licenses, op2_quality, op3_warc, op4_exact_dedup, op5_sharding, op6_language_id, op7_simhash, op8_lattice,
        op9_mixing, op10_packing, op11_token_counts, op12_conversations, op13_whitening)
}

SQL: dict[str, str] = {
    "op4_exact_dedup": r"""
        with d as (
            select doc_id, length(coalesce(text, '')) as n,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as s
            from documents
        ), g as (
            select doc_id, s, count(*) over (partition by s) as group_size,
                   first_value(doc_id) over (partition by s order by n desc, doc_id) as keep_id
            from d
        )
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, s as text_sha256 from g""",
}
