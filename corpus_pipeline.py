"""Training-corpus pipeline: language ID, exact dedup, SimHash near-dedup, mixing, packing.

Each stage takes what its predecessor kept, as a written table; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from propwise.llm import exact_dedup, langid, mixing, packing, simhash
from propwise.llm.common import read_table, stage
from propwise.llm.queries import TOKENIZER


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text is in no language (null, or without a letter)."""
    return langid.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked fingerprints stays."""
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them; the last row of a source's share is cut to its words."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences; a row that the mix repeats is packed as often."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language_id", language), ("exact_dedup", exact), ("simhash_near_dedup", near),
          ("mixing", mix), ("packing", pack)]

#: The stages learn a model, hash and tokenise: no SQL says the same.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
