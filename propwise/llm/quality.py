"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

A document's terms are its hashed words, hashed trigrams of its byte classes (letters by case,
digits, spaces, line ends, each kind of mark), both by square roots of counts, and how much its
words and lines repeat.  The terms of a bounded, balanced sample of labelled rows span the latent space (truncated SVD); the sample's
vectors and labels are broadcast.  Every document is projected in its task, its exact cosines
with all labelled vectors are one matrix product per block of rows, and its nearest labelled
vectors vote with a power of their similarity.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import smallest
from .langid import remainder

BUCKETS = 2048
#: Labelled rows used of each class: the bound of the sample and of what is broadcast.
SAMPLE_PER_CLASS = 1000
DIMENSIONS = 32
NEIGHBOURS = 15
POWER = 8
THRESHOLD = 0.3
BLOCK = 512
RESULT = ["held_out", "score", "predicted"]


def _byte_class(c: int) -> int:
    ch = chr(c)
    if c >= 128:
        return 1
    if ch.isalpha():
        return 2 + ch.isupper()
    if ch.isdigit():
        return 4
    if ch in "\n\r":
        return 5
    return 6 if ch.isspace() else c  # a mark is a class of its own


_CLASSES = bytes(map(_byte_class, range(256)))
_MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def _normed(counts: np.ndarray) -> np.ndarray:
    f = np.sqrt(counts.astype(np.float32))
    return f / max(float(np.linalg.norm(f)), 1e-9)


def terms(text: str | None) -> np.ndarray:
    """Term weights of a whole text: ``BUCKETS`` hashed words and as many hashed trigrams of byte classes, each of
    unit length, and three numbers from 0 to 1 (times two) of words and lines that repeat."""
    body = (text or "").encode("utf-8")
    a = np.frombuffer(b" " + body.translate(_CLASSES) + b" ", np.uint8).astype(np.uint32)
    h = a[:-2] * _MIX[0] ^ a[1:-1] * _MIX[1] ^ a[2:] * _MIX[2]
    h = (h ^ (h >> np.uint32(15))) * _MIX[1] >> np.uint32(21)
    words, lines = body.lower().split(), body.split(b"\n")
    n = len(words)
    code = np.fromiter((zlib.crc32(w) % BUCKETS for w in words), np.int64, n)
    repeat = ((sum(map(eq, words, words[1:])) / max(n, 1)) ** 0.5, 1 - math.log1p(len(set(words))) / math.log1p(max(n, 1)) if n else 0.0,
              1 - len(set(lines)) / len(lines))
    return np.concatenate([_normed(np.bincount(code, minlength=BUCKETS)), _normed(np.bincount(h, minlength=BUCKETS)),
                           2 * np.array(repeat, np.float32)])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class NeighbourVote:
    """Latent space of the sample's terms, its vectors there, and their labels."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS,
                 neighbours: int = NEIGHBOURS, power: float = POWER):
        _, _, vt = np.linalg.svd(x.astype(np.float64), full_matrices=False)
        self.space = vt[:dimensions].T.astype(np.float32)
        self.vectors, self.labels = _unit(x @ self.space).astype(np.float32), labels.astype(np.float32)
        self.neighbours, self.power = min(neighbours, len(x)), power

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Share of the neighbours' votes for label 1; 0.5 if no neighbour is similar at all."""
        v = _unit(np.stack([terms(t) for t in texts]) @ self.space)
        cosine = v @ self.vectors.T
        near = np.argpartition(-cosine, self.neighbours - 1, axis=1)[:, :self.neighbours]
        vote = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** self.power
        total = vote.sum(axis=1)
        return np.clip(np.where(total > 0, (vote * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-300), 0.5), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality",
        per_class: int = SAMPLE_PER_CLASS, held: int = 0, folds: int = 5) -> NeighbourVote | None:
    """Fit on at most ``per_class`` labelled rows of each class whose fold is not ``held``.

    The sampled ids (those with the smallest digests) are bounded by ``2 * per_class``, so they
    are broadcast to the rows of ``docs``.  None if no such row is found.
    """
    known = labels.select(F.col(doc_id).cast("bigint").alias("id"), F.col(label).cast("int").alias("y")).where(
        F.col("y").isin(0, 1) & (remainder(F.col("id"), folds) != held))
    picked = smallest(known.withColumn("h", F.xxhash64("id")), "y", ["h", "id"], per_class).select("id", "y")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).where(
        remainder(F.col("id"), folds) != held).join(F.broadcast(picked), "id").select("y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [terms(t).astype(np.float16).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(x, pa.binary())], ["y", "x"])

    # a repeated id could bring more rows than were picked: at most per_class rows of each class are kept
    got = rows.mapInArrow(run, "y int, x binary").withColumn("h", F.xxhash64("x"))
    got = smallest(got, "y", ["h", "x"], per_class).select("y", "x").toArrow()
    if not got.num_rows:
        return None
    pairs = sorted(zip(got.column("y").to_pylist(), got.column("x").to_pylist()))  # the same space on every run
    x = np.stack([np.frombuffer(b, np.float16) for _, b in pairs]).astype(np.float32)
    return NeighbourVote(x, np.array([y for y, _ in pairs]))


def classify(docs: DataFrame, model: NeighbourVote | None, text: str = "text", doc_id: str = "doc_id",
             carry: list[str] | None = None, threshold: float = THRESHOLD, held: int = 0, folds: int = 5) -> DataFrame:
    """Rows of ``docs`` (columns ``carry``, default all) with ``RESULT`` appended.

    Only the text decides; null counts as empty, and an empty text is scored like any other.
    Without a model (no labelled row) every score is 0.5.  A null id is not held out.  Rows alike
    get alike results.  Columns of the input that carry a result's name are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    carry = [c for c in (docs.columns if carry is None else carry) if c not in RESULT]
    rows = docs.select(*carry, F.coalesce(remainder(F.col(doc_id), folds) == held, F.lit(False)).alias("held_out"),
                       F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(i, BLOCK)
                texts = part.column(part.num_columns - 1).to_pylist()
                score = sent.value.score(texts) if sent.value else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(score, pa.float64()),
                     pa.array((score >= threshold).astype(np.int32), pa.int32())],
                    [*part.schema.names[:-1], "score", "predicted"])

    schema = StructType([*rows.schema.fields[:-1], StructField("score", DoubleType()),
                         StructField("predicted", IntegerType())])
    return rows.mapInArrow(run, schema)
