"""Embedding whitening by shifted CholeskyQR.

Entries become whole numbers ``floor(scale * c) + offset``; the fit list holds each distinct vector
once, as a written table.  With ``n`` vectors and their exact sums ``S`` every row is centred as
``(n * x - S) / n``, the subtraction in whole numbers, so the large offset costs no digit.

A Gram pass forms ``Q'Q`` of the rows as they stand: each task centres its rows, solves them
against the R factors found so far and returns one ``d x d`` matrix.  Its Cholesky factor, of the first
pass with a shift, is the next R factor.  Passes go on until the Gram matrix is the identity to
rounding, or for ``MAX_PASSES`` (directions without variance never become orthonormal); the square
root of the last one ends the product, so ``R'R = A'A`` holds for any rank.  The right singular vectors
of ``R`` are the components, its singular values give the variances, and no product ``A'A`` of raw rows
enters them.

What reaches the driver: ``S`` and matrices of ``d x d``, by the dimension and not by the rows.  Gram
passes run in ``TASKS_PER_CORE`` tasks a core at most, so what they shuffle does not grow with rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
MAX_PASSES = 6
TASKS_PER_CORE = 4
#: Rows centred and solved at once.
ROWS = 4096
EPS = np.finfo(float).eps
LONGEST = 2 ** 63 - 1

RESULT = ("component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


@dataclass
class Whitening:
    """A fitted whitening: all of it is bounded by the dimension."""

    n: int
    sums: list[int]
    factors: list[np.ndarray]  # upper triangular, first to last, and the square root of the last Gram matrix
    components: np.ndarray  # d x k, unit columns
    variances: np.ndarray  # k, falling
    total_variance: float
    identity_error: float = 0.0

    @property
    def dim(self) -> int:
        return len(self.sums)


def quantize(flat: np.ndarray, scale: int = SCALE, offset: int = OFFSET) -> np.ndarray:
    """``floor(scale * c) + offset`` as whole numbers; beyond the range of a long the nearest one."""
    f = np.floor(flat * scale)
    top = float(2 ** 62)
    return np.clip(f, -top, top).astype(np.int64) + offset


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S``, exact: longs where they hold it, Python's whole numbers otherwise."""
    most = max([abs(s) for s in sums] + [0]) + n * max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if most <= LONGEST:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def deviations(z: np.ndarray) -> list[int | None]:
    """Sum of squares of each row of ``centred``, exact; ``None`` where a long cannot hold it."""
    if z.dtype != object and z.size and int(np.abs(z).max()) ** 2 * z.shape[1] <= LONGEST:
        return (z * z).sum(axis=1).tolist()
    return [s if s <= LONGEST else None for s in (sum(int(v) ** 2 for v in row) for row in z)]


def solve_rows(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``rows @ inv(r)`` for an upper triangular ``r``, column after column."""
    q = np.empty_like(rows)
    for j in range(r.shape[0]):
        q[:, j] = (rows[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


def _blocks(batches: Iterable[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            yield _matrix(b.slice(i, ROWS).column("x"), dim)


def _sum_rows(parts: DataFrame, width: int) -> np.ndarray:
    """Sum matrices given as rows ``(i, v array<double>)``, one row of each task and place."""
    def add(key: tuple, t: pa.Table) -> pa.Table:
        total = _matrix(t.column("v"), width).sum(axis=0)
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([total], pa.list_(pa.float64()))})

    out = np.zeros((width, width))
    for r in parts.groupBy("i").applyInArrow(add, "i int, v array<double>").collect():
        out[r["i"]] = r["v"]
    return out


def _few(rows: DataFrame) -> DataFrame:
    """Without a shuffle, in so many tasks that their matrices stay few."""
    return rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism * TASKS_PER_CORE)


def exact_sums(fit_list: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of vectors and the sum of each dimension, in whole numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dim
        for x in _blocks(batches, dim):
            most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
            part = x.sum(axis=0) if most * len(x) <= LONGEST else x.astype(object).sum(axis=0)
            total = [a + int(b) for a, b in zip(total, part)]
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([0] * (dim + 1)), pa.array(list(range(dim + 1))),
                                          pa.array([str(v) for v in [*total, n]])], ["k", "i", "v"])

    got = (fit_list.mapInArrow(run, "k bigint, i bigint, v string").groupBy("i")
           .agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect())
    by = {r["i"]: int(r["v"]) for r in got}
    return by.get(dim, 0), [by.get(i, 0) for i in range(dim)]


def gram(fit_list: DataFrame, n: int, sums: list[int], factors: list[np.ndarray]) -> np.ndarray:
    """``Q'Q`` of the centred rows solved against ``factors`` in turn."""
    dim = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((dim, dim))
        for x in _blocks(batches, dim):
            q = centred(x, n, sums).astype(float) / n
            for r in factors:
                q = solve_rows(q, r)
            g += q.T @ q
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(list(g), pa.list_(pa.float64()))], ["i", "v"])

    return _sum_rows(_few(fit_list).mapInArrow(run, "i int, v array<double>"), dim)


def _cholesky(g: np.ndarray, rows: int, shift: bool) -> np.ndarray:
    """Upper triangular factor of ``g``; a shift above its rounding error where asked for or needed."""
    d = len(g)
    s = 11 * (rows * d + d * (d + 1)) * EPS * max(np.linalg.norm(g, 2), np.finfo(float).tiny) if shift else 0.0
    for _ in range(60):
        try:
            return np.linalg.cholesky(g + s * np.eye(d)).T
        except np.linalg.LinAlgError:
            s = max(s * 10, 11 * d * (d + 1) * EPS * max(np.linalg.norm(g, 2), np.finfo(float).tiny))
    raise ArithmeticError("no Cholesky factor: the Gram matrix is not finite")


def _root(g: np.ndarray) -> np.ndarray:
    e, v = np.linalg.eigh(g)
    return (v * np.sqrt(np.maximum(e, 0))) @ v.T


def orthogonalise(fit_list: DataFrame, n: int, sums: list[int]) -> list[np.ndarray]:
    """R factors whose product ``R`` (last factor leftmost) has ``R'R = A'A`` for the centred rows ``A``."""
    dim, factors = len(sums), []
    for step in range(MAX_PASSES):
        g = gram(fit_list, n, sums, factors)
        if step and np.abs(g - np.eye(dim)).max() <= 64 * dim * EPS:
            break
        if step == MAX_PASSES - 1 or not g.any():
            break
        # the shift keeps the first factor away from break-down; n * eps of it must stay small
        factors.append(_cholesky(g, min(n, 1 << 20), shift=not step))
    return [*factors, _root(g)]


def fit(fit_list: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening:
    """Fit on the rows ``x array<bigint>`` of ``fit_list``, all of length ``dim`` and distinct."""
    n, sums = exact_sums(fit_list, dim)
    if not n:
        return Whitening(0, [0] * dim, [], np.zeros((dim, 0)), np.zeros(0), 0.0)
    factors = orthogonalise(fit_list, n, sums)
    r = np.eye(dim)
    for f in factors:
        r = f @ r
    _, sigma, vt = np.linalg.svd(r)
    e = sigma ** 2 / n
    k = min(components, int((sigma > dim * EPS * sigma[:1].max(initial=0) * 16).sum()))
    fitted = Whitening(n, sums, factors, vt[:k].T.copy(), e[:k], float(e.sum()))
    fitted.identity_error = identity_error(fit_list, fitted)
    return fitted


def whiten(x: np.ndarray, w: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """Centred whole numbers of the rows, and the rows on the components over their deviations."""
    z = centred(x, w.n, w.sums)
    return z, (z.astype(float) / w.n) @ w.components / np.sqrt(w.variances)


def identity_error(fit_list: DataFrame, w: Whitening) -> float:
    """Largest entry of |covariance of the whitened fit list - identity|, centred before multiplying."""
    k, dim = len(w.variances), w.dim
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, c = 0, np.zeros(k), np.zeros((k, k))
        for x in _blocks(batches, dim):
            y = whiten(x, w)[1]
            m = y.mean(axis=0)
            gap, y = m - mean, y - m
            c += y.T @ y + np.outer(gap, gap) * (n * len(x) / (n + len(x)))
            mean += gap * (len(x) / (n + len(x)))
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean], pa.list_(pa.float64())),
                                              pa.array([c.ravel()], pa.list_(pa.float64()))], ["n", "m", "c"])

    parts = _few(fit_list).mapInArrow(run, "n bigint, m array<double>, c array<double>").collect()  # one row of k * k a task
    mean = sum(p["n"] * np.array(p["m"]) for p in parts) / w.n
    c = sum(np.array(p["c"]).reshape(k, k) + p["n"] * np.outer(g, g) for p in parts for g in [np.array(p["m"]) - mean])
    return float(np.abs(c / w.n - np.eye(k)).max())


def whole_vectors(rows: DataFrame, vector: str, scale: int, offset: int, carry: list[str]) -> DataFrame:
    """Rows whose vector is not null and has only finite entries, with ``x array<bigint>``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("__v")
            flat = pc.fill_null(v.flatten(), float("nan")).to_numpy(zero_copy_only=False)
            size = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(len(size)), size)
            ok = pc.is_valid(v).to_numpy(zero_copy_only=False).copy()
            ok[owner[~np.isfinite(flat)]] = False
            x = quantize(flat[ok[owner]], scale, offset)
            edge = np.concatenate([[0], np.cumsum(size[ok])])
            keep = b.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays(
                [*(keep.column(c) for c in carry), pa.LargeListArray.from_arrays(pa.array(edge), pa.array(x)).cast(pa.list_(pa.int64()))],
                [*carry, "x"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    cols = rows.select(*[F.col(c) for c in carry], F.col(vector).cast("array<double>").alias("__v"))
    return cols.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "x array<bigint>"]))


def whiten_embeddings(rows: DataFrame, vector: str = "embedding", carry: Iterable[str] = ("vec_id",),
                      components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """One row for each usable row and component: the columns ``carry`` and those of ``RESULT``.

    Rows with a null vector, or one with null or non-finite entries, go.  ``component`` counts from 1
    by falling variance, up to ``components`` and to the rank: a direction without variance cannot be
    whitened and is no component, so vectors that are all equal, one vector alone or an empty
    table give an empty result.  Equal variances have their components in the order the
    decomposition returns them.  ``deviation`` is null where a long cannot hold it.  Repeated rows
    come back as often as they occur but count once in the fit.  The vectors of the commonest length
    (of equally common ones the longest) are whitened; a usable row of another length comes back once
    with a null ``component`` and the ``n`` of the fit.  Columns not in ``carry`` play no part, and a
    carried column may have the name of a result: the result wins.
    """
    names = [r.split()[0] for r in RESULT.split(", ")]
    carry = [c for c in carry if c not in [*names, "x"]]
    fit_list = whole_vectors(rows, vector, scale, offset, []).groupBy("x").agg(F.count(F.lit(1)).alias("copies"))
    fit_list = stage(fit_list, "whitening-fit")
    sizes = fit_list.groupBy(F.size("x").alias("d")).agg(F.sum("copies").alias("n"))
    top = sizes.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    dim = top[0]["d"] if top else 0
    w = fit(fit_list.where(F.size("x") == dim).select("x"), dim, components)
    shared = rows.sparkSession.sparkContext.broadcast(w)  # d x d at most
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        k = len(w.variances)
        for b in batches:
            size = pc.list_value_length(b.column("x")).to_numpy(zero_copy_only=False)
            other = b.filter(pa.array(size != w.dim))
            if other.num_rows:
                m = other.num_rows
                yield pa.RecordBatch.from_arrays(
                    [*(other.column(c) for c in carry), pa.nulls(m, pa.int32()), pa.array([w.n] * m, pa.int64()),
                     pa.nulls(m, pa.int64()), *[pa.nulls(m, pa.float64())] * 2, pa.array([w.identity_error] * m)], [*carry, *names])
            b = b.filter(pa.array(size == w.dim))
            for i in range(0, b.num_rows if k else 0, ROWS):
                part = b.slice(i, ROWS)
                z, y = whiten(_matrix(part.column("x"), w.dim), w)
                m, at = len(z), np.repeat(np.arange(len(z)), k)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(pa.array(at)) for c in carry), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, w.n)), pa.array(deviations(z), pa.int64()).take(pa.array(at)), pa.array(y.ravel()),
                     pa.array(np.tile(w.variances / w.total_variance, m)), pa.array(np.full(m * k, w.identity_error))],
                    [*carry, *names])

    return whole_vectors(rows, vector, scale, offset, carry).mapInArrow(
        run, ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), RESULT]))
