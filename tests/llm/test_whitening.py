"""Whitening against a plain eigendecomposition, exact whole numbers and odd tables."""

import numpy as np
import pytest

from propwise.llm import whitening as W
from propwise.llm.queries import op13_whitening

from .test_text_operators import SF

SCHEMA = "vec_id bigint, embedding array<float>, label int, n int"


def brute(vectors, k=16):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    a = (n * fit - s) / n
    cov = a.T @ a / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(axis=1), ((n * x - s) / n) @ v / np.sqrt(e), e / np.trace(cov)


def check(got, ids, vectors, k=16, tol=1e-9):
    n, deviation, whitened, explained = brute(vectors, k)
    got = {(r.vec_id, r.component): r for r in got}
    assert len(got) == len(ids) * k
    y = np.array([[got[i, c].whitened for c in range(1, k + 1)] for i in ids])
    sign = np.sign((y * whitened).sum(axis=0))
    assert np.abs(y * sign - whitened).max() < tol
    assert [got[i, 1].deviation for i in ids] == deviation.tolist() and {r.n for r in got.values()} == {n}
    assert np.allclose([got[ids[0], c].explained for c in range(1, k + 1)], explained, rtol=1e-10)
    assert len({r.identity_error for r in got.values()}) == 1 and next(iter(got.values())).identity_error < 1e-9


def test_table_equals_plain_eigenvectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    check(op13_whitening(spark, SF).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_scales_far_apart_keep_their_digits(spark):
    # singular values over eight orders of magnitude: squared, they are beyond what a Gram matrix alone resolves
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    x = rng.normal(size=(400, 12)) * np.logspace(7, -1, 12) @ q
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(3)
    got = W.whiten_embeddings(df).toPandas()
    whole = np.floor(64 * x).astype(np.int64) + 1_000_000
    a = (len(x) * whole - whole.sum(axis=0)) / len(x)
    sigma = np.linalg.svd(a, compute_uv=False)
    found = got.groupby("component").explained.first().to_numpy()
    assert np.allclose(found, sigma ** 2 / (sigma ** 2).sum(), rtol=1e-7) and got.identity_error.max() < 1e-6


def test_copies_count_once_in_the_fit(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").limit(60).collect()
    vectors = [r.embedding for r in rows] + [rows[0].embedding] * 200
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in enumerate(vectors)], SCHEMA).repartition(5)
    check(W.whiten_embeddings(df).collect(), list(range(len(vectors))), vectors)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1., 2., 3.], 0, 1), (2, [1., 2., 3.], 0, 1), (3, None, 0, 1), (4, [1., None, 2.], 0, 1), (5, [nan, 1., 1.], 0, 1),
            (6, [5., 2., 1.], 0, 1), (6, [5., 2., 1.], 0, 1), (7, [5., 2.], 0, 1), (8, [], 0, 1), (9, [inf, 1., 1.], 0, 1),
            (None, [4., 7., 9.], 0, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = W.whiten_embeddings(df, carry=["vec_id", "n", "label"]).collect()
    assert [f.name for f in W.whiten_embeddings(df, carry=["vec_id", "n", "label"]).schema][:2] == ["vec_id", "label"]
    # three different vectors have two directions of variance; other lengths come back without a component
    assert sorted((str(r.vec_id), r.component or 0) for r in got) == sorted(
        [(i, c) for i in ("1", "2", "6", "6", "None") for c in (1, 2)] + [("7", 0), ("8", 0)])
    assert {r.n for r in got} == {3} and max(r.identity_error for r in got) < 1e-9
    for few in (df.limit(0), df.where("vec_id < 3"), df.where("vec_id in (3, 4, 5)")):
        assert W.whiten_embeddings(few).count() == 0


@pytest.mark.parametrize("big", [3_000_000, 2 ** 61])
def test_deviation_is_exact_or_null(big):
    x = np.array([[big, 1], [1, 5], [7, 7]], np.int64)
    sums = [int(v) for v in x.astype(object).sum(axis=0)]
    want = [sum((3 * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    assert W.deviations(W.centred(x, 3, sums)) == [w if w < 2 ** 63 else None for w in want]


def test_factors_compose_to_the_rows(spark):
    x = np.random.default_rng(1).integers(-50, 50, size=(300, 10)) + 1_000_000
    x[:, 3] = 7  # a direction without variance
    df = spark.createDataFrame([([int(c) for c in v],) for v in np.unique(x, axis=0)], "x array<bigint>").repartition(4)
    n, sums = W.exact_sums(df, 10)
    r = np.eye(10)
    for f in W.orthogonalise(df, n, sums):
        r = f @ r
    a = np.unique(x, axis=0) - np.array(sums) / n
    assert np.allclose(r.T @ r, a.T @ a, rtol=1e-12, atol=1e-6)
    assert len(W.fit(df, 10).variances) == 9
