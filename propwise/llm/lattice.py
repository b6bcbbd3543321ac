"""Embedding near-dedup by lattice hashing.

Unit vectors are projected at random to blocks of eight dimensions and decoded to the nearest
point of the E8 lattice, in several tables.  A vector sits in its own cell of each table and
probes the neighbouring cells it is closest to.  Vectors that meet (one sits in a cell, the
other sits in or probes it) are compared by exact cosine in double precision.

Equal vectors merge first.  A bucket returns one row for each member: how many vectors it
links to there and the root of its spanning star, never its pairs.  Each link is counted in
one bucket only, the first in which the two meet; every member carries its cells, so a task
can tell.  Buckets above ``max_bucket`` members are dealt out as pairs of chunks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SALTS, components, explode_salts, salt_of, stage

THRESHOLD = 0.95
PROBES = 5
#: Part of the links at the threshold itself that the tables are to find; closer pairs are missed less.
RECALL = 0.99
SEED = 8
MAX_BUCKET = 2048
ROWS = 256
RESULT = ["n_links", "component_id", "kept"]


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: neighbours of the origin."""
    whole = [np.eye(8)[i] * a + np.eye(8)[j] * b for i, j in combinations(range(8), 2) for a, b in product((1, -1), repeat=2)]
    half = [np.array(s) / 2 for s in product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.array(whole + half)


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points whose coordinates have an even sum."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(axis=1) % 2)
    gap = x[odd] - r[odd]
    k = np.abs(gap).argmax(axis=1)
    r[odd, k] += np.where(gap[np.arange(len(odd)), k] >= 0, 1, -1)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points: integer points of even sum, or those moved by one half everywhere."""
    a, b = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def cells_for(rows: int) -> tuple[int, float]:
    """E8 blocks of a cell and what it measures in units of the projected vectors, for ``rows`` vectors.

    The share of all pairs that meet by chance falls about 4.5 times for each step of 0.2 with two blocks and 8
    times with three (measured on random pairs), so a vector meets a few dozen others up to some 1e9 vectors; from there on
    cells stay as they are, for finer ones would take ever more tables.
    """
    if rows <= 1 << 12:
        return 1, 1.2
    two = max(0, math.ceil(math.log(rows / (1 << 14)) / math.log(4.5)))
    if two <= 3:
        return 2, 2.0 - 0.2 * two
    return 3, max(1.4, 1.8 - 0.2 * max(0, math.ceil(math.log(rows / (1 << 26)) / math.log(8))))


def tables_for(blocks: int, scale: float, probes: int = PROBES, threshold: float = THRESHOLD, recall: float = RECALL,
               seed: int = SEED) -> int:
    """Tables that find ``recall`` of the pairs of cosine ``threshold``, by planting such pairs in cells of this kind.

    What a random projection does to a pair depends on its cosine alone, so the length of the planted
    vectors does not matter.
    """
    rng = np.random.default_rng([seed, blocks])
    a, b = rng.standard_normal((2, 2000, 16))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b *= (1 - threshold ** 2) ** 0.5 / np.linalg.norm(b, axis=1, keepdims=True)
    x, y = (Cells(16, 6, probes, blocks, scale, seed)(v) for v in (a, threshold * a + b))
    met = ((x[:, :, :1] == y) | (y[:, :, :1] == x)).any(axis=2).mean()
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(max(met, 1e-3), 0.999))))


class Cells:
    """Cells of vectors of one length: ``(rows, tables, 1 + probes)`` keys, the own cell first."""

    def __init__(self, length: int, tables: int, probes: int, blocks: int, scale: float, seed: int):
        rng = np.random.default_rng([seed, length])
        self.maps = rng.standard_normal((tables, length, 8 * blocks)) / scale
        self.mix = rng.integers(1, 2 ** 63, (tables, 8 * blocks), dtype=np.uint64) | np.uint64(1)
        self.tables, self.probes, self.blocks, self.near = tables, probes, blocks, roots()

    def __call__(self, unit: np.ndarray) -> np.ndarray:
        n = len(unit)
        out = np.empty((n, self.tables, 1 + self.probes), np.int64)
        for t in range(self.tables):
            y = unit @ self.maps[t]
            point = decode(y.reshape(-1, 8)).reshape(n, -1)
            gain = ((y - point).reshape(n, self.blocks, 8) @ self.near.T).reshape(n, -1)
            move = np.argsort(-gain, axis=1, kind="stable")[:, :self.probes]
            code = lambda p: ((2 * p).astype(np.int64).astype(np.uint64) * self.mix[t]).sum(axis=1, dtype=np.uint64)  # noqa: E731, B023
            out[:, t, 0] = code(point).view(np.int64)
            for k in range(self.probes):
                step = np.zeros((n, self.blocks, 8))
                step[np.arange(n), move[:, k] // 240] = self.near[move[:, k] % 240]
                out[:, t, 1 + k] = code(point + step.reshape(n, -1)).view(np.int64)
        return out


def _links(unit: np.ndarray, weight: np.ndarray, uid: np.ndarray, cells: np.ndarray, t: int, cell: int,
           chunk: np.ndarray, cross: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(member, root, links)`` of one bucket, for members with a link that counts here."""
    n = len(uid)
    count, label = np.zeros(n, np.int64), np.arange(n)
    own = cells[:, :, 0]
    for i in range(0, n, 512):
        a, b = np.nonzero(unit[i:i + 512] @ unit.T >= threshold)
        a = a + i
        go = a < b
        if cross:
            go &= chunk[a] != chunk[b]
        a, b = a[go], b[go]
        meets = lambda s: (own[a, s][:, None] == cells[b, s]).any(axis=1) | (own[b, s][:, None] == cells[a, s]).any(axis=1)  # noqa: E731, B023
        go = (own[a, t] == cell) | (own[b, t] == cell)
        for s in range(t):
            go &= ~meets(s)
        a, b = a[go], b[go]
        # within the table: each one's own cell, if the other sits in or probes it; the lower key counts
        first = np.where((own[a, t][:, None] == cells[b, t]).any(axis=1), own[a, t], np.iinfo(np.int64).max)
        second = np.where((own[b, t][:, None] == cells[a, t]).any(axis=1), own[b, t], np.iinfo(np.int64).max)
        go = np.minimum(first, second) == cell
        a, b = a[go], b[go]
        np.add.at(count, a, weight[b])
        np.add.at(count, b, weight[a])
        while len(a):
            a, b = label[a], label[b]
            go = a != b
            a, b = a[go], b[go]
            if not len(a):
                break
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
    hit = np.flatnonzero(count)
    return uid[hit], uid[label[hit]], count[hit]


def _valid(e: str) -> str:
    return (f"{e} is not null and forall({e}, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
            f" and exists({e}, x -> x <> 0)")


def vector_classes(vectors: DataFrame, threshold: float = THRESHOLD, probes: int = PROBES, recall: float = RECALL,
                   blocks: int | None = None, scale: float | None = None, tables: int | None = None, seed: int = SEED,
                   max_bucket: int = MAX_BUCKET, salts: int = SALTS) -> DataFrame:
    """``(__vec, __links, __root, __low, __salts)`` of each distinct valid vector of ``(__id, __vec)``.

    Cells follow the number of distinct vectors and tables the recall, unless they are given.
    """
    reps = stage(vectors.withColumn("__salt", salt_of(F.col("__id"), salts)).groupBy("__vec").agg(
        F.min("__id").alias("__rep"), F.count(F.lit(1)).alias("__n"),
        F.bit_or(F.expr("shiftleft(1L, __salt)")).alias("__salts")).withColumn(
            "__uid", F.monotonically_increasing_id()), "lattice-reps")
    if blocks is None or scale is None:
        blocks, scale = cells_for(reps.count())
    tables = tables or tables_for(blocks, scale, probes, threshold, recall)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Cells] = {}
        for b in batches:
            size = np.array([len(v) for v in b.column("__vec")])
            for length in np.unique(size):
                part = b.filter(pa.array(size == length))
                x = part.column("__vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                if length not in made:
                    made[length] = Cells(int(length), tables, probes, blocks, scale, seed)
                key = made[length](x)
                yield pa.RecordBatch.from_arrays(
                    [part.column("__uid"), part.column("__n"), pa.array([v.tobytes() for v in x], pa.binary()),
                     pa.array([v.tobytes() for v in key], pa.binary()),
                     pa.array(list(key.reshape(len(x), -1)), pa.list_(pa.int64()))],
                    ["uid", "n", "unit", "cells", "keys"])

    # each vector once with its cells; buckets get only narrow rows until they are known to have a meeting
    placed = stage(reps.select("__uid", "__n", "__vec").mapInArrow(
        place, "uid bigint, n bigint, unit binary, cells binary, keys array<bigint>"), "lattice-cells")
    seats = placed.select("uid", F.octet_length("unit").alias("len"), F.posexplode("keys").alias("p", "cell")).select(
        "uid", "len", F.floor(F.col("p") / (1 + probes)).cast("int").alias("t"), "cell",
        (F.col("p") % (1 + probes) == 0).cast("int").alias("sits"))
    crowd = seats.groupBy("len", "t", "cell").agg(F.count(F.lit(1)).alias("m"), F.sum("sits").alias("s")).where(
        "m > 1 and s > 0")
    parts = F.ceil(F.col("m") / F.lit(max_bucket)).cast("int")
    met = (seats.join(crowd, ["len", "t", "cell"]).withColumn("m", parts)
           .withColumn("c", F.pmod(F.xxhash64("uid"), F.col("m")).cast("int"))
           .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
           .select("uid", "len", "t", "cell", "c", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j")))
    met = met.join(placed.select("uid", "n", "unit", "cells"), "uid")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("uid", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])

        def done(rows: pa.Table) -> pa.RecordBatch:
            key = np.column_stack([rows.column(k).to_numpy() for k in ("len", "t", "cell", "i", "j")])
            edge = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)]])
            uid, n, c = (rows.column(k).to_numpy() for k in ("uid", "n", "c"))
            unit, cells = rows.column("unit").to_pylist(), rows.column("cells").to_pylist()
            found = []
            for i, j in zip(edge[:-1], edge[1:]):
                if j - i > 1:
                    _, t, cell, x, y = key[i]
                    found.append(_links(np.frombuffer(b"".join(unit[i:j])).reshape(j - i, -1), n[i:j], uid[i:j],
                                        np.frombuffer(b"".join(cells[i:j]), np.int64).reshape(j - i, tables, -1),
                                        int(t), int(cell), c[i:j], x != y, threshold))
            cols = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], schema=schema)

        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            names = ["len", "t", "cell", "i", "j"]
            last = np.array([b.column(k)[b.num_rows - 1].as_py() for k in names])
            key = np.column_stack([b.column(k).to_numpy() for k in names])
            cut = int(np.argmax((key == last).all(axis=1)))  # rows are sorted: the last bucket starts here
            if cut or (held and [held[-1].column(k)[0].as_py() for k in names] != last.tolist()):
                yield done(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            held.append(b.slice(cut))
        if held:
            yield done(pa.Table.from_batches(held))

    keys = ["len", "t", "cell", "i", "j"]
    seen = stage(met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
        compare, "uid bigint, root bigint, links bigint"), "lattice-links")
    links = seen.groupBy("uid").agg(F.sum("links").alias("__links"))
    comp = components(seen.select(F.col("uid").alias("a"), F.col("root").alias("b")))
    named = (reps.join(links, F.col("__uid") == F.col("uid"), "left").join(comp, F.col("__uid") == F.col("node"), "left")
             .withColumn("__root", F.coalesce("component", "__uid"))
             .withColumn("__links", F.coalesce("__links", F.lit(0)) + F.col("__n") - 1))
    low = named.groupBy("__root").agg(F.min("__rep").alias("__low"))
    return named.select("__vec", "__links", "__root", "__salts").join(low, "__root")


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
                 salts: int = SALTS, **how) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row; ``how`` as for ``vector_classes``.

    Vectors that are null, zero, or hold null or non-finite components link with nothing; vectors
    of different length never link.  Equal vectors link with each other, rows repeated whole too.
    ``component_id`` is the smallest id reachable; null ids are ignored unless a component has no
    other.  Further columns play no part.  An empty table gives an empty result.
    """
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("__id"),
                          F.col(embedding).cast("array<double>").alias("__vec"))
    rows = rows.withColumn("__ok", F.expr(f"coalesce({_valid('__vec')}, false)"))
    valid = rows.where("__ok").withColumn("__s", salt_of(F.col("__id"), salts))
    found = vector_classes(valid.select("__id", "__vec"), salts=salts, **how).select(
        "__vec", "__links", "__low", explode_salts("__salts", salts).alias("__s"))
    good = valid.join(found, ["__vec", "__s"]).select(
        F.col("__id").alias("vec_id"), F.col("__links").alias("n_links"), F.col("__low").alias("component_id"))
    bad = rows.where("not __ok").select(F.col("__id").alias("vec_id"), F.lit(0).cast("bigint").alias("n_links"),
                                        F.col("__id").alias("component_id"))
    return good.union(bad).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
