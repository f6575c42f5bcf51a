import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptmill.llm import whitening as w

SCHEMA = "vec_id long, embedding array<float>, x string, y string, whitened string"


def table(spark, tmp_path, rows):
    spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def brute(x):
    """(eigenvalues, vectors) of the covariance, from exact integers."""
    n = len(x)
    off = n * x.astype(object) - x.astype(object).sum(axis=0)
    v = np.array((off.T @ off), float) / float(n) ** 3
    values, vectors = np.linalg.eigh(v)
    return v, values[::-1], vectors[:, ::-1], off


def check(rows, x_of, components):
    ids = sorted(x_of)
    v, values, vectors, off = brute(np.array([x_of[i] for i in ids]))
    n = len(ids)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == n * components
    white = np.array([[got[i, c + 1].whitened for c in range(components)] for i in ids])
    assert abs(white.T @ white / n - np.eye(components)).max() < 1e-9
    want = np.array(off, float) / n @ vectors[:, :components] / np.sqrt(values[:components])
    signs = np.sign((white * want).sum(axis=0))
    assert np.allclose(white, want * signs, atol=1e-7)
    for i, own in zip(ids, off):
        assert got[i, 1].deviation == int((own * own).sum()) and got[i, 1].n == n
    assert np.allclose([got[ids[0], c + 1].explained for c in range(components)], values[:components] / np.trace(v), rtol=1e-9)
    assert max(r.identity_error for r in rows) < 1e-9


def test_query_equals_dense_eigenvectors(spark):
    folder = "/root/testdata/sf0.001"
    rows = w.op11_whitening(spark, folder).collect()
    table = spark.read.parquet(f"{folder}/embeddings.parquet").where("embedding is not null").collect()
    x_of = {r.vec_id: np.floor(64 * np.array(r.embedding, float)).astype(int) + 1_000_000 for r in table}
    check(rows, x_of, 32)


def test_larger_spaces_iterate():
    """More dimensions than the subspace holds, close eigenvalues, and a repeated one."""
    r = np.random.default_rng(3)
    values = np.sort(np.r_[r.uniform(0, 1, 280), 5.0, 5.0, 5.0001, 4.0, r.uniform(1, 4, 16)])[::-1]
    basis = np.linalg.qr(r.standard_normal((300, 300)))[0]
    a = basis * values @ basis.T
    passes = []
    found, vectors = w.jacobi_davidson(lambda u: passes.append(u.shape[1]) or a @ u, 300, 12)
    assert np.allclose(found, values[:12], rtol=1e-12)
    assert np.linalg.norm(a @ vectors - vectors * found, axis=0).max() < 1e-12
    assert abs(vectors.T @ vectors - np.eye(12)).max() < 1e-12
    assert len(passes) < 150


@pytest.mark.parametrize("d, k", [(1, 1), (2, 1), (7, 7), (64, 32), (64, 64)])
def test_small_spaces(d, k):
    r = np.random.default_rng(d)
    a = r.standard_normal((d, 2 * d))
    a = a @ a.T
    found, vectors = w.jacobi_davidson(lambda u: a @ u, d, k)
    assert np.allclose(found, np.linalg.eigvalsh(a)[::-1][:k], rtol=1e-11)
    assert np.linalg.norm(a @ vectors - vectors * found, axis=0).max() < 1e-11 * found[0]


def test_minres_solves_indefinite_systems(monkeypatch):
    monkeypatch.setattr(w, "STEPS", 40)
    monkeypatch.setattr(w, "REDUCED", 1e-13)
    a = np.diag([5.0, 3.0, -2.0, 1.0, -7.0])
    b = np.c_[np.arange(1.0, 6), [0, 0, 1.0, 0, 0], np.zeros(5)]
    assert np.allclose(a @ w.minres(lambda v: a @ v, b), b, atol=1e-9)


def test_odd_rows(spark, tmp_path):
    """Null ids, null, empty, short, non-finite and huge vectors, repeated rows, a direction without variance."""
    r = np.random.default_rng(1)
    good = [(i, [*map(float, r.standard_normal(3)), 0.25]) for i in range(20)]
    bad = [(50, None), (51, []), (52, [1.0]), (53, [1.0, None, 1.0, 1.0]), (54, [float("nan")] * 4),
           (55, [float("inf"), 0.0, 0.0, 0.0]), (56, [1e30, 0.0, 0.0, 0.0])]
    rows = w.op11_whitening(spark, table(spark, tmp_path, [*good, *bad])).collect()
    x_of = {i: np.floor(64 * np.float32(v).astype(float)).astype(int) + 1_000_000 for i, v in good}
    check(rows, x_of, 3)


def test_repeated_rows_and_null_ids(spark, tmp_path):
    folder = table(spark, tmp_path, [(None, [1.0, 0.0]), (1, [0.0, 2.0]), (1, [0.0, 2.0]), (2, [3.0, 1.0])])
    rows = w.op11_whitening(spark, folder)
    assert rows.count() == 8 and rows.where("vec_id is null").count() == 2 and rows.where("n = 4").count() == 8


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 3])
def test_nothing_varies(spark, tmp_path, vectors):
    rows = w.op11_whitening(spark, table(spark, tmp_path, list(enumerate(vectors))))
    assert rows.collect() == [] and len(rows.columns) == 7


def test_deviations_beyond_longs(spark):
    rows = spark.createDataFrame([(i, [i * 2**50, 5]) for i in range(9)], "k long, x array<long>")
    made = w.whitening(w.fit_list(rows, "x"), 1)
    got = made.rows(rows, "k", "x").orderBy("k").collect()
    assert [int(r.deviation) for r in got] == [(9 * i * 2**50 - 36 * 2**50) ** 2 for i in range(9)]


def test_products_move_sums_only(spark):
    fit = w.fit_list(spark.range(8).select(F.array("id", F.col("id") % 3).alias("x")), "x")
    assert np.allclose(fit.product(np.eye(2)), np.cov(np.array([[i, i % 3] for i in range(8)]).T, bias=True))
