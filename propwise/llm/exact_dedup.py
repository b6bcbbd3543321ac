"""Exact dedup (native): skew-safe combining in three steps, all in DataFrame expressions.

1. *Local*: the map-side half of the first aggregate merges equal texts of one task.
2. *Salted*: ``(digest, content, salt)`` groups merge, where the salt comes from the row's
   id, so a text held by a third of all rows meets in ``salts`` tasks.
3. *Global*: at most ``salts`` winners for each text combine into the one that stays.

The normalised content is a grouping key of every step: two texts are one group only if
their whole content is equal, whatever their digests.  Aggregate buffers hold one decimal
and two longs, so all three steps are hash aggregates.  The way back to the rows joins on
(digest, second digest, length, salt); neither texts nor lists of members travel there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SALTS, SPACE, explode_salts, salt_of

RESULT = ["keep_id", "group_size", "kept", "text_sha256"]
KEY = ["__sha", "__h", "__len"]


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def _rank() -> Column:
    """Orders rows by most code points, then smallest id (null ids last), as one decimal."""
    return F.expr("cast(__n as decimal(38,0)) * 36893488147419103232BD"
                  " + coalesce(9223372036854775808BD - cast(__id as decimal(20,0)), 0BD)").cast("decimal(38,0)")


def _rank_id(rank: str) -> Column:
    return F.expr(f"cast(9223372036854775808BD - nullif({rank} % 36893488147419103232BD, 0BD) as bigint)")


def classes(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row for each distinct content of ``rows (__id, __norm, __n, KEY)``."""
    salted = (rows.select("__norm", *KEY, salt_of(F.col("__id"), salts).alias("__salt"), _rank().alias("__rank"))
              .groupBy("__norm", *KEY, "__salt")
              .agg(F.max("__rank").alias("__rank"), F.count(F.lit(1)).alias("__cnt")))
    return (salted.groupBy("__norm", *KEY)
            .agg(F.max("__rank").alias("__rank"), F.sum("__cnt").alias("group_size"),
                 F.bit_or(F.expr("shiftleft(1L, __salt)")).alias("__salts"))
            .select(*KEY, "group_size", "__salts", _rank_id("__rank").alias("keep_id")))


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                carry: list[str] | None = None, salts: int = SALTS) -> DataFrame:
    """Rows of ``docs`` (columns ``carry``, default all) with ``RESULT`` appended.

    Texts are equal when identical after deleting ASCII white space.  Of equal texts the row
    with the most code points, then the smallest id, stays; null ids come last and ``keep_id``
    is null if a group has no other.  Rows alike in id and length: exactly one of them is kept
    (the smallest digest of the original text first).  Null texts equal empty ones.  Columns of
    the input that carry a result's name are replaced.  An empty table gives an empty result.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in RESULT]
    body = F.coalesce(F.col(text), F.lit(""))
    rows = (docs.select(*[F.col(c) for c in carry], F.col(doc_id).cast("bigint").alias("__id"),
                        normalised(F.col(text)).alias("__norm"), F.char_length(body).cast("bigint").alias("__n"),
                        F.xxhash64(body).alias("__orig"))
            .withColumns({"__sha": F.sha2(F.col("__norm").cast("binary"), 256), "__h": F.xxhash64("__norm"),
                          "__len": F.octet_length("__norm")}))
    found = classes(rows, salts).withColumn("__salt", explode_salts("__salts", salts)).drop("__salts")
    first = F.row_number().over(
        Window.partitionBy(*KEY, "__salt", "__id").orderBy(F.desc("__n"), "__orig"))
    return (rows.drop("__norm").withColumn("__salt", salt_of(F.col("__id"), salts))
            .join(found, [*KEY, "__salt"])
            .withColumn("__first", first)
            .select(*carry, "keep_id", "group_size",
                    (F.col("__id").eqNullSafe(F.col("keep_id")) & (F.col("__first") == 1)).alias("kept"),
                    F.col("__sha").alias("text_sha256")))


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows that stay, with the columns of ``docs`` as they were."""
    boxed = docs.select(F.col(doc_id).alias("__doc"), F.col(text).alias("__text"),
                        F.struct(*[docs[c] for c in docs.columns]).alias("__row"))
    return exact_dedup(boxed, "__text", "__doc", carry=["__row"]).where("kept").select("__row.*")
