import numpy as np

from lexiloom.operators import linalg
from lexiloom.sources import corpus


def cells(spark, a):
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(a)], "i int, j int, v double")


def dense(df, n, m):
    return linalg.small(df, n, m)


def test_products(spark):
    a = np.arange(12.0).reshape(4, 3) - 5
    x = cells(spark, a)
    assert np.allclose(dense(linalg.gram_columns(x), 3, 3), a.T @ a) and np.allclose(dense(linalg.gram_rows(x), 4, 4), a @ a.T)
    assert np.allclose(dense(linalg.multiply(x, linalg.transpose(x)), 4, 4), a @ a.T)
    assert np.allclose(dense(linalg.normalise_rows(x), 4, 3), a / (a * a).sum(1, keepdims=True))
    assert np.allclose(dense(linalg.swap_columns(x, 0, 2), 4, 3), a[:, [2, 1, 0]])


def test_svd(spark):
    x = corpus.random_matrix(spark, 9, 4, 5)
    _, sigma, v = linalg.svd(x)
    assert np.allclose(sigma, np.linalg.svd(dense(x, 9, 4))[1]) and np.allclose(v.T @ v, np.eye(4))
    assert linalg.reconstruction_error(x).first()["errors"] == 0
    assert all(abs(r.v) < 2 for r in x.collect())


def test_matrix_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("2 3\n1 2 3\n4.5 5 6 7\n")
    rows = {(r.i, r.j): r.v for r in corpus.read_matrix(spark, str(tmp_path / "a.txt")).collect()}
    assert rows == {(0, 0): 1, (0, 1): 2, (0, 2): 3, (1, 0): 4.5, (1, 1): 5, (1, 2): 6}


def test_rows_product_in_blocks(spark, monkeypatch):
    """Absent, repeated, null and infinite cells, over several blocks of rows and columns: as of the join, without its rows."""
    rng = np.random.default_rng(2)
    rows = [(int(i), int(j), float(v)) for i, j, v in zip(rng.integers(0, 40, 300), rng.integers(0, 30, 300), rng.integers(-9, 9, 300), strict=True)]
    x = spark.createDataFrame(rows + [(90, 1, None), (91, 77, 2.0), (92, 2, float("inf")), (93, 2, float("nan"))], "i int, j int, v double")
    monkeypatch.setattr(linalg, "BLOCK_ROWS", 10)
    got = linalg.gram_rows(x)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(repr, got.collect())) == sorted(map(repr, linalg.multiply(x, linalg.transpose(x)).collect()))
