"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

How many rows of partition ``p`` go to each cell is one row of a random matrix with given
margins (partition sizes, cell sizes).  Cells are equal slices of the shards, small enough for
one task in rows and, at the mean size of a row, in bytes.  Every partition draws its own row: it walks a binary tree over the partitions from
the root, splitting the cells' remaining places between the halves by seeded hypergeometric
draws, so the matrix agrees everywhere without being gathered.  A partition then permutes its
row of labels locally, rows travel to their cells, and each cell is permuted again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BinaryType, IntegerType, LongType, MapType, StringType, StructField,
                               StructType)
from pyspark.sql.window import Window

from .common import stage

SEED = 40
MAX_CELL_ROWS = 250_000
MAX_CELL_BYTES = 64 << 20
#: Cells go to a task each up to this many, or up to the session's shuffle partitions if those are more.
MIN_TASKS = 256
#: numpy's own exact sampler refuses populations from here on.
NUMPY_LIMIT = 1_000_000_000


def log_ratio(x: int, y: int) -> float:
    """``log(x! / y!)`` to about 1e-9 for any whole numbers: no difference of two large logarithms."""
    if max(x, y) < 1000 or min(x, y) < 50:
        return math.lgamma(x + 1) - math.lgamma(y + 1)
    d = x - y
    tail = lambda k: 1 / (12 * k) - 1 / (360 * k ** 3)
    return (y + 0.5) * math.log1p(d / y) + d * (math.log(x) - 1) + tail(x) - tail(y)


def draw_large(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """An exact hypergeometric draw at any size, by the ratio of uniforms under a table mountain hat (Stadlober)."""
    total = good + bad
    small, m = min(good, bad), min(n, total - n)
    if m < 10:  # one by one
        hits, left = 0, small
        for k in range(m):
            took = int(rng.integers(total - k)) < left
            hits, left = hits + took, left - took
    else:
        share = small / total
        centre = m * share + 0.5
        width = math.sqrt((total - m) * (m / (total - 1)) * share * (1 - share) + 0.5)
        hat = 2 * math.sqrt(2 / math.e) * width + 3 - 2 * math.sqrt(3 / math.e)
        mode = (m + 1) * (small + 1) // (total + 2)
        while True:
            u, v = 1 - rng.random(), rng.random()
            w = centre + hat * (v - 0.5) / u
            if not 0 <= w < min(m, small) + 1:
                continue
            hits = int(w)
            # log of the probability of ``hits`` over that of the mode
            gain = -(log_ratio(hits, mode) + log_ratio(small - hits, small - mode) + log_ratio(m - hits, m - mode)
                     + log_ratio(total - small - m + hits, total - small - m + mode))
            if 2 * math.log(u) <= gain:
                break
    hits = hits if good <= bad else m - hits
    return hits if m == n else good - hits


def draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without return are among the ``good``: exact, whatever their number."""
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, n))
    return draw_large(rng, good, bad, n)


def split_places(places: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """``n`` of all ``places``, by cell (multivariate hypergeometric)."""
    out = np.zeros_like(places)
    left = int(places.sum())
    for i, k in enumerate(places.tolist()):
        if n <= 0:
            break
        left -= k
        out[i] = draw(rng, k, left, n)
        n -= int(out[i])
    return out


def matrix_row(sizes: np.ndarray, cells: np.ndarray, part: int, seed: int) -> np.ndarray:
    """Row ``part`` of the matrix whose margins are ``sizes`` (partitions) and ``cells``."""
    edge = np.concatenate([[0], np.cumsum(sizes)])
    places, lo, hi = cells.copy(), 0, len(sizes)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        first = split_places(places, int(edge[mid] - edge[lo]), np.random.default_rng([seed, lo, hi]))
        places, lo, hi = (first, lo, mid) if part < mid else (places - first, mid, hi)
    return places


def labels_of(sizes: np.ndarray, cells: np.ndarray, part: int, seed: int) -> np.ndarray:
    """The cell of each row of partition ``part``: its row of the matrix, permuted locally."""
    labels = np.repeat(np.arange(len(cells)), matrix_row(sizes, cells, part, seed))
    np.random.default_rng([seed, part]).shuffle(labels)
    return labels


def row_bytes(rows: DataFrame) -> Column:
    """Bytes of a row: of strings and binaries their own, 8 of other flat values, of nested ones their print."""
    size = F.lit(0).cast("bigint")
    for f in rows.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (StringType, BinaryType)):
            size += F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, (ArrayType, MapType, StructType)):
            size += F.coalesce(F.octet_length(c.cast("string")), F.lit(0))
        else:
            size += F.lit(8)
    return size


def cell_sizes(total: int, n_bytes: int, shards: int, max_rows: int, max_bytes: int) -> np.ndarray:
    """Rows of each cell, ``(shards, slices)``; a cell holds one row at least where its shard has as many."""
    per_shard = np.full(shards, total // shards) + (np.arange(shards) < total % shards)
    most = int(per_shard.max(initial=0))
    slices = max(1, -(-most // max_rows), min(most, -(-most * n_bytes // max(1, total * max_bytes))))
    return (per_shard[:, None] // slices + (np.arange(slices) < per_shard[:, None] % slices)).astype(np.int64)


def shuffle_to_shards(rows: DataFrame, shards: int, seed: int = SEED,
                      max_cell_rows: int = MAX_CELL_ROWS, max_cell_bytes: int = MAX_CELL_BYTES) -> DataFrame:
    """``rows`` with ``shard int`` and ``slot long`` (gapless from 0 in its shard) appended.

    Shard sizes are exact: they differ by one row at most.  Rows repeated whole and null values
    of any column are rows like any other.  Columns of the input named ``shard`` or ``slot`` are
    replaced.  An empty table gives an empty result.

    ``rows`` is written first: the draws need the place of each row in its partition to be the
    same on every attempt.  The driver holds one count and one sum of bytes for each written
    partition.
    """
    cols = [c for c in rows.columns if c not in ("shard", "slot")]
    fixed = stage(rows.select(*cols, F.spark_partition_id().alias("__part"),
                              F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__pos")), "shard-rows")
    counted = sorted(fixed.groupBy("__part").agg(
        F.count(F.lit(1)).alias("n"), F.sum(row_bytes(fixed)).alias("bytes")).collect())
    place = {r["__part"]: i for i, r in enumerate(counted)}
    sizes = np.array([r["n"] for r in counted], np.int64)
    total = int(sizes.sum())
    cells = cell_sizes(total, sum(r["bytes"] for r in counted), shards, max_cell_rows, max_cell_bytes)
    slices = cells.shape[1]
    base = (np.cumsum(cells, axis=1) - cells).ravel()
    cells = cells.ravel()
    sent = rows.sparkSession.sparkContext.broadcast((place, sizes, cells, base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sizes, cells, base = sent.value
        part, labels = None, None
        for b in batches:
            parts = b.column("__part").to_numpy()
            pos = b.column("__pos").to_numpy()
            label = np.empty(len(parts), np.int64)
            edge = np.concatenate([[0], np.flatnonzero(np.diff(parts)) + 1, [len(parts)]])
            for i, j in zip(edge[:-1], edge[1:]):
                if i == j:
                    continue
                if parts[i] != part:
                    part = parts[i]
                    labels = labels_of(sizes, cells, place[int(part)], seed)
                label[i:j] = labels[pos[i:j]]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(label // slices, pa.int32()), pa.array(base[label], pa.int64()),
                 pa.array(label * tasks // len(cells), pa.int32())],
                [*b.schema.names, "shard", "__base", "__task"])

    # cells are alike in size: as many neighbours to each task, none by the chance of a hash
    tasks = min(len(cells), max(MIN_TASKS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    schema = StructType([*fixed.schema.fields, StructField("shard", IntegerType()), StructField("__base", LongType()),
                         StructField("__task", IntegerType())])
    cell = Window.partitionBy("__task", "shard", "__base").orderBy(
        F.xxhash64(F.lit(seed), "__part", "__pos"), "__part", "__pos")
    return (fixed.mapInArrow(run, schema).repartitionById(tasks, F.col("__task"))
            .withColumn("slot", F.col("__base") + F.row_number().over(cell) - 1)
            .select(*cols, "shard", "slot"))


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) and 16 of overhead."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("bigint")


def text_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; a null text counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
