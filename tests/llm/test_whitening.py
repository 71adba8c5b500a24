import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq

from riskloom.llm import whitening

SMALL = "/root/testdata/sf0.001"


def brute(vectors):
    x = np.floor(64 * np.array(vectors, dtype=np.float64)) + 1_000_000
    d = x - x.mean(axis=0)
    e, v = np.linalg.eigh(d.T @ d / len(x))
    return x, e[::-1], v[:, ::-1]


def check(out, vectors, k):
    x, e, v = brute(vectors)
    n = len(x)
    wide = out.pivot_table(index="vec_id", columns="component", values="whitened").to_numpy()
    assert len(out) == n * k and (out.n == n).all()
    s = x.astype(np.int64).sum(axis=0)
    dev = ((n * x.astype(np.int64) - s) ** 2).sum(axis=1)
    assert (out[out.component == 1].sort_values("vec_id").deviation.to_numpy() == dev).all()
    ours = (x - x.mean(axis=0)) @ v[:, :k] / np.sqrt(e[:k])
    signs = np.sign((ours * wide).sum(axis=0))
    assert np.abs(ours * signs - wide).max() < 1e-6
    assert np.allclose(out.groupby("component").explained.first(), e[:k] / e.sum(), rtol=1e-10)
    assert out.identity_error.nunique() == 1 and out.identity_error.iloc[0] < 1e-9
    assert np.abs(wide.T @ wide / n - np.eye(k)).max() < 1e-9


def test_table_equals_numpy(spark):
    rows = pq.read_table(f"{SMALL}/embeddings.parquet").to_pandas().sort_values("vec_id")
    check(whitening.op13_whitening(spark, SMALL).toPandas(), rows.embedding.tolist(), 32)


def test_refinement_reaches_double_precision_with_clusters():
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    for e in (np.geomspace(1, 1e-6, 40), np.r_[np.full(10, 3.0), 3 + 1e-9 * np.arange(10), 2 + 1e-5 * np.arange(10), np.linspace(0.1, 1, 10)], np.r_[5.0, np.zeros(39)]):
        a = (q * e) @ q.T
        a = (a + a.T) / 2
        found, x = whitening.eigen(a)
        assert np.abs(x.T @ x - np.eye(40)).max() < 1e-14
        assert np.abs(a @ x - x * found).max() < 2e-15 * np.abs(e).max() * 40**0.5
        assert np.abs(found - np.sort(e)[::-1]).max() < 1e-14 * e.max()
    far = np.diag([3.0, 2.0, 1.0]) + 0.1
    start = np.linalg.eigh(far)[1].astype(np.float32)
    assert np.abs(far @ start - start * np.diag(start.T @ far @ start)).max() > 1e-9  # what the steps mend


def test_exact_products_of_large_entries():
    rng = np.random.default_rng(1)
    z = rng.integers(-(2**41), 2**41, size=(300, 3))
    assert (whitening.exact_products(z) == z.astype(object).T @ z.astype(object)).all()


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = rng.normal(size=(50, 4)).round(3).tolist()
    odd = [None, [None, 1.0, 2.0, 3.0], [float("nan"), 1.0, 1.0, 1.0], [float("inf"), 1.0, 1.0, 1.0], [1.0, 2.0], []]
    rows = [(i if i != 3 else None, v, 7.0) for i, v in enumerate(good)] + [(100 + i, v, 1.0) for i, v in enumerate(odd)] + [(0, good[0], 2.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened double")
    out = whitening.whiten(df).toPandas()
    assert len(out) == 51 * 4 and out.vec_id.isna().sum() == 4 and (out.vec_id == 0).sum() == 8
    assert set(out.vec_id.dropna()) == set(range(50)) - {3}
    check(whitening.whiten(spark.createDataFrame([(i, v) for i, v in enumerate(good)], "vec_id long, embedding array<double>")).toPandas(), good, 4)


def test_equal_rows_large_entries_and_empty_tables(spark):
    kind = "vec_id long, embedding array<double>"
    same = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)], kind)).toPandas()
    assert len(same) == 6 and same.whitened.isna().all() and (same.deviation == 0).all() and same.identity_error.isna().all()
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 5.0]) for i in range(9)], kind)).toPandas()
    assert flat[flat.component == 2].whitened.isna().all() and abs(flat[flat.component == 1].whitened.std(ddof=0) - 1) < 1e-9 and flat.identity_error.iloc[0] < 1e-9
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0])], kind)).toPandas()
    assert len(huge) == 4 and huge.deviation.isna().all()
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], kind)).count() == 0


def test_vectors_of_a_large_cluster_are_orthogonal():
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(120, 120)))[0]
    a = (q * np.r_[5.0, np.zeros(119)]) @ q.T
    x = whitening.refined((a + a.T) / 2, np.linalg.eigh(((a + a.T) / 2).astype(np.float32))[1])[1]
    assert np.abs(x.T @ x - np.eye(120)).max() < 1e-17
