"""SimHash near-dedup: pigeonhole blocks, joined on blocks, verified by Hamming distance.

Fingerprints are made in Arrow batches.  Equal fingerprints merge first (one row for each
distinct value, with its smallest id), so copies never meet each other again.  A distinct
fingerprint is then cut into ``b`` blocks; two that differ in at most ``k`` bits agree in at
least ``b - k`` whole blocks, so each lands in C(b, k) tables keyed by ``b - k`` blocks and
every linked pair shares a bucket.  Buckets are compared inside a task; a bucket returns a
spanning star of its linked members, never its pairs.  Buckets above ``max_bucket`` members
are dealt out as pairs of chunks, so no task holds more than about twice that and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SALTS, components, explode_salts, salt_of, stage

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
MAX_BUCKET = 4096
RESULT = ["fingerprint", "component_id"]


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64-bit SimHash of the whole text as a signed long; 0 if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    h, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= shingle_words:
        return int(np.uint64(h(joined, seed)).astype(np.int64))
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(words) - shingle_words + 1].tolist()
    ones, n = np.zeros(64, np.int64), len(start)
    end = end[shingle_words - 1:].tolist()
    for i in range(0, n, 65536):
        part = np.fromiter([h(joined[s:e], seed) for s, e in zip(start[i:i + 65536], end[i:i + 65536])], np.uint64)
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                 shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """``(doc_id, __h, __fp)`` for every row; a null text has no word and so fingerprint 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint(t, shingle_words, seed) for t in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("__h"), fp], ["doc_id", "__h", "__fp"])

    cols = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_digest(F.col(text)).alias("__h"),
                       F.col(text).cast("string").alias("text"))
    return cols.mapInArrow(run, "doc_id bigint, __h bigint, __fp bigint")


def text_digest(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def blocks_for(distinct: int, max_bits: int = MAX_BITS) -> int:
    """Blocks that leave a random fingerprint about one chance partner at most.

    Any number above ``max_bits`` gives the same links; this only sets how much work is done.
    """
    for b in range(max_bits + 2, max_bits + 6):
        if distinct * comb(b, max_bits) <= 2 ** (64 * (b - max_bits) / b):
            return b
    return max_bits + 5


def block_masks(blocks: int, max_bits: int = MAX_BITS) -> list[int]:
    """The bits that a table compares, as signed longs: all choices of ``blocks - max_bits`` blocks."""
    edge = [round(64 * i / blocks) for i in range(blocks + 1)]
    bits = [sum(1 << j for j in range(edge[i], edge[i + 1])) for i in range(blocks)]
    return [int(np.uint64(sum(bits[i] for i in keep)).astype(np.int64))
            for keep in combinations(range(blocks), blocks - max_bits)]


def _stars(group: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the links inside runs of equal ``group`` (sorted)."""
    n = len(fp)
    bits = fp.view(np.uint64)  # numpy counts the bits of a signed number's magnitude
    label = np.arange(n)
    left = np.arange(n)
    step = 1
    while True:
        left = left[left + step < n]
        left = left[group[left] == group[left + step]]  # a run shorter than the step has no more pairs
        if not len(left):
            break
        right = left + step
        near = np.bitwise_count(bits[left] ^ bits[right]) <= max_bits
        a, b = left[near], right[near]
        while len(a):
            a, b = label[a], label[b]
            differ = a != b
            a, b = a[differ], b[differ]
            if not len(a):
                break
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
        step += 1
    moved = np.flatnonzero(label != np.arange(n))
    return fp[moved], fp[label[moved]]


def link_stars(reps: DataFrame, max_bits: int = MAX_BITS, blocks: int | None = None,
               max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Links among distinct fingerprints ``reps (__fp)`` as stars ``(a, b)`` of fingerprints."""
    masks = block_masks(blocks or blocks_for(reps.count(), max_bits), max_bits)
    rows = reps.select("__fp", F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("__fp").bitwiseAND(F.lit(m)).alias("v")) for t, m in enumerate(masks)
    ])).alias("k")).select("__fp", "k.t", "k.v")
    crowd = rows.groupBy("t", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = rows.join(crowd, ["t", "v"])
    # a crowded bucket becomes m chunks, and each pair of chunks (i, j) a bucket of its own
    m = F.ceil(F.col("n") / F.lit(max_bucket)).cast("int")
    met = (met.withColumn("m", m).withColumn("c", F.pmod(F.xxhash64("__fp"), F.col("m")).cast("int"))
           .select("t", "v", "c", "__fp", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("o"))
           .select("t", "v", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "__fp"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            key = b[["t", "v", "i", "j"]].to_numpy()
            group = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]).any(axis=1))]) if len(b) else np.zeros(0, int)
            whole = group < group[-1] if len(b) else np.zeros(0, bool)
            held = b[~whole]
            fp = b["__fp"].to_numpy(np.int64)
            a, z = _stars(group[whole], fp[whole], max_bits)
            yield pd.DataFrame({"a": a, "b": z})
        if held is not None and len(held):
            a, z = _stars(np.zeros(len(held), int), held["__fp"].to_numpy(np.int64), max_bits)
            yield pd.DataFrame({"a": a, "b": z})

    keys = ["t", "v", "i", "j"]
    return met.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, "a bigint, b bigint")


def classify(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
             shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, seed: int = SEED,
             blocks: int | None = None, max_bucket: int = MAX_BUCKET, salts: int = SALTS) -> DataFrame:
    """``(doc_id, __h, __fp, __root, component_id)`` for every row; ``__h`` digests the original text."""
    fps = stage(fingerprints(docs, text, doc_id, shingle_words, seed), "simhash")
    reps = stage(fps.withColumn("__salt", salt_of(F.col("doc_id"), salts)).groupBy("__fp").agg(
        F.min("doc_id").alias("__rep"), F.bit_or(F.expr("shiftleft(1L, __salt)")).alias("__salts")), "simhash-reps")
    # components over fingerprints, then the smallest id of each
    comp = components(link_stars(reps.select("__fp"), max_bits, blocks, max_bucket))
    named = reps.join(comp, F.col("__fp") == F.col("node"), "left").withColumn(
        "__root", F.coalesce("component", "__fp"))
    lowest = named.groupBy("__root").agg(F.min("__rep").alias("component_id"))
    found = (named.select("__fp", "__root", "__salts").join(lowest, "__root")
             .select(F.col("__fp").alias("__key"), "__root", "component_id",
                     explode_salts("__salts", salts).alias("__s")))
    rows = fps.withColumn("__salt", salt_of(F.col("doc_id"), salts))
    return (rows.join(found, (F.col("__fp") == F.col("__key")) & (F.col("__salt") == F.col("__s")))
            .select("doc_id", "__h", "__fp", "__root", "component_id"))


def simhash_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row; ``how`` as for ``classify``.

    ``component_id`` is the smallest id reachable by links of at most ``max_bits`` differing
    bits, the row's own included; null ids are ignored unless a component has no other.  Rows
    repeated whole stay repeated.  Null and empty texts have fingerprint zero and link like any
    other.  Further columns play no part.  An empty table gives an empty result.
    """
    return classify(docs, text, doc_id, **how).select(
        "doc_id", F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """One row of each component, with the columns of ``docs`` as they were: the smallest id.

    Of rows that share that id, the one with the smallest digest of its text stays; of rows
    alike in both, any one.  A component whose ids are all null keeps one row.
    """
    win = (classify(docs, text, doc_id, **how).where("doc_id <=> component_id")
           .groupBy("__root", F.col("doc_id").alias("__win")).agg(F.min("__h").alias("__low"))
           .groupBy("__win", "__low").agg(F.count(F.lit(1)).alias("__roots")))
    boxed = docs.select(F.col(doc_id).cast("bigint").alias("__id"), text_digest(F.col(text)).alias("__h"),
                        F.struct(*[docs[c] for c in docs.columns]).alias("__row"))
    first = F.row_number().over(Window.partitionBy("__id", "__h").orderBy(F.lit(0)))
    return (boxed.join(win, F.col("__id").eqNullSafe(F.col("__win")) & (F.col("__h") == F.col("__low")))
            .withColumn("__first", first).where("__first = 1").select("__row.*"))
