"""Shared helpers of the training-data operators."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from propwise.session import ensure_checkpoint_dir

#: ASCII white space, as the contracts of these operators define it.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of one key are spread over this many salts before they meet (powers of two up to 32).
SALTS = 16


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return os.path.join(base, "llm", f"{name}-{uuid.uuid4().hex[:12]}")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back.

    Cuts the lineage: what follows reads the same rows however often it is computed
    again after a lost executor.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def salt_of(col: Column, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(salts)).cast("int")


def explode_salts(mask: str, salts: int = SALTS) -> Column:
    """One row for each salt whose bit is set in ``mask``."""
    return F.explode(F.expr(f"filter(sequence(0, {salts - 1}), s -> (shiftright(`{mask}`, s) & 1L) = 1L)"))


def smallest(df: DataFrame, by: str, order: list[str], n: int, ways: tuple[int, ...] = (32, 4, 1)) -> DataFrame:
    """The ``n`` first rows of each ``by``, in ``order``.

    A hot key is cut in 32 before its rows meet, then in 4, so a task gets ``8 * n`` of what was
    kept before at most.  Each number of ways must divide the one before it.
    """
    for w in ways:
        rank = F.row_number().over(Window.partitionBy(by, "__way").orderBy(*order))
        df = (df.withColumn("__way", F.pmod(F.xxhash64(*order), F.lit(w))).withColumn("__n", rank)
              .where(F.col("__n") <= n).drop("__way", "__n"))
    return df


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges (a long, b long)`` as ``(node, component)``.

    ``component`` is the smallest node reachable.  Alternates large-star and
    small-star steps until the edges stay the same; each round is a written table, so a
    lost executor costs a part of one round.  Nodes without an edge to another node do not
    appear.  An empty input gives an empty result.
    """
    cur = stage(edges.where("a <> b and a is not null and b is not null")
                .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def state(df: DataFrame) -> tuple:
        r = df.agg(F.count(F.lit(1)).alias("n"),
                   F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).collect()[0]
        return r["n"], r["h"]

    last = state(cur)
    for _ in range(max_rounds):
        if not last[0]:
            break
        # large star: neighbours above u point to the smallest neighbour of u, u included
        both = cur.union(cur.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = (both.where("b > a").join(low, F.col("a") == F.col("u"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        # small star: u and its neighbours below u point to the smallest of them
        large = stage(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        down = large.join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        cur = stage(down.union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct(),
                    "small")
        now = state(cur)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.groupBy("a").agg(F.min("b").alias("b")).select(
        F.col("a").alias("node"), F.col("b").alias("component")).union(
        cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
