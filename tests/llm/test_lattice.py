"""Lattice decoding, and links and components against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from propwise.llm import lattice

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, threshold=0.95):
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = np.zeros((len(rows), len(rows)), bool)
    for i in ok:
        for j in ok:
            if len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], np.float64) for k in (i, j))
                near[i, j] = i != j and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold
    label = list(range(len(rows)))
    for _ in rows:
        new = [min([label[i], *(label[j] for j in np.flatnonzero(near[i]))]) for i in range(len(rows))]
        if new == label:
            break
        label = new
    low = {}
    for (i, _), g in zip(rows, label):
        if i is not None:
            low[g] = min(low.get(g, i), i)
    return sorted(((i, int(near[k].sum()), low.get(label[k])) for k, (i, _) in enumerate(rows)), key=str)


def found(df):
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in df.collect()), key=str)


def clouds(seed=1, n=60, noise=0.02):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        centre = rng.standard_normal(32)
        centre /= np.linalg.norm(centre)
        for _ in range(int(rng.integers(1, 9))):
            out.append(centre + noise * rng.standard_normal(32))
    big = rng.standard_normal(32)
    big /= np.linalg.norm(big)
    out += [big + noise * rng.standard_normal(32) for _ in range(120)]
    out += out[:30]
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(out)]


def test_decode_finds_the_nearest_lattice_point():
    near = lattice.roots()
    assert near.shape == (240, 8) and np.allclose((near ** 2).sum(axis=1), 2)
    x = np.random.default_rng(0).standard_normal((500, 8)) * 3
    p = lattice.decode(x)
    twice = np.rint(2 * p).astype(int)
    assert ((twice % 2 == twice[:, :1] % 2).all(axis=1) & (twice.sum(axis=1) % 4 == 0)).all()
    gap = ((x - p) ** 2).sum(axis=1)
    assert (gap <= 1 + 1e-9).all()  # the covering radius is 1
    assert (((x[:, None] - p[:, None] - near[None]) ** 2).sum(axis=2) >= gap[:, None] - 1e-9).all()


@pytest.mark.parametrize("bucket", [2048, 16])
def test_links_and_components_equal_brute_force(spark, bucket):
    rows = clouds()
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    assert found(lattice.near_vectors(df, max_bucket=bucket)) == brute(rows)


def test_recall_near_the_threshold(spark):
    rows = clouds(seed=5, noise=0.027)  # cosines around 0.95 to 0.98
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    want = sum(r[1] for r in brute(rows))
    got = sum(r[1] for r in found(lattice.near_vectors(df)))
    assert 0.95 * want <= got <= want and want > 1000


def planted(n, pairs, low, high, dim, seed=0):
    """``n`` random unit vectors and ``pairs`` more, each at a cosine between ``low`` and ``high`` to one of them."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((pairs, dim))
    a = x[:pairs]
    z -= (a * z).sum(axis=1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    c = rng.uniform(low, high, (pairs, 1))
    return np.concatenate([x, c * a + (1 - c ** 2) ** 0.5 * z])


@pytest.mark.parametrize("n, dim", [(3_000, 64), (8_000, 64), (8_000, 512), (40_000, 64)])
def test_recall_of_planted_pairs(spark, n, dim):
    pairs = 1_500
    x = planted(n, pairs, 0.951, 0.96, dim)
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: r.component_id for r in lattice.near_vectors(rows).where("n_links > 0").collect()}
    met = sum(got.get(n + i) == i for i in range(pairs))
    assert met >= 0.95 * pairs and set(got) <= {*range(pairs), *range(n, n + pairs)}


def test_comparisons_for_each_vector_do_not_grow(spark):
    met = []
    for n in (4_000, 5_000, 50_000):
        x = planted(n, 0, 0.96, 0.97, 64)
        blocks, scale = lattice.cells_for(n)
        tables = lattice.tables_for(blocks, scale)
        cells = lattice.Cells(64, tables, lattice.PROBES, blocks, scale, lattice.SEED)(x)
        # members of every bucket that holds one that sits: what is compared there
        pairs = 0
        for t in range(tables):
            keys, owner = cells[:, t].ravel(), np.tile(np.arange(1 + lattice.PROBES) == 0, n)
            _, at, count = np.unique(keys, return_inverse=True, return_counts=True)
            sits = np.bincount(at, weights=owner, minlength=len(count))
            pairs += int((count * (count - 1) / 2)[sits > 0].sum())
        met.append(pairs / n)
    assert max(met) < 150 and met[2] < 2 * max(met[:2])


def test_finer_cells_for_more_vectors():
    kinds = [lattice.cells_for(10 ** k) for k in range(1, 13)]
    assert kinds == sorted(kinds, key=lambda k: (k[0], -k[1])) and kinds[0] == (1, 1.2) and kinds[-1][0] == 3
    assert [lattice.tables_for(*lattice.cells_for(n)) for n in (10 ** 4, 10 ** 6)] == sorted(
        lattice.tables_for(*lattice.cells_for(n)) for n in (10 ** 4, 10 ** 6))
    assert all(lattice.tables_for(*k) < 64 for k in set(kinds[:10]))


def test_links_of_the_table_are_true(spark):
    # this table holds no pair of cosine 0.95 (its closest are at 0.61): nothing may be linked
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = np.array([r.embedding for r in df.select("embedding").collect()], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.95).sum() - len(x)
    assert links == 0 and lattice.near_vectors(df).where("n_links > 0").count() == 0


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0]),
            (8, [2.0, 4.0]), (8, [2.0, 4.0]), (None, [1.0, 2.0]), (9, [1.0, 2.0, 0.0]), (10, [-1.0, -2.0]), (None, [5.0]),
            (11, [1e-30, 2e-30]), (12, [1e30, 2e30])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumn("kept", F.lit("x")).withColumn("uid", F.lit(1))
    got = lattice.near_vectors(df)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert found(got) == brute(rows)
    assert lattice.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
