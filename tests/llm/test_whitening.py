"""Whitening against a plain eigendecomposition."""

import numpy as np
import pytest

from granary.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def plain(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    c = x - x.mean(0)
    values, vectors = np.linalg.eigh(c.T @ c / len(x))
    return values[::-1][:k], vectors[:, ::-1][:, :k]


def check(rows: list, x: np.ndarray, k: int) -> None:
    """rows against the whole numbers x, in order of vec_id."""
    values, vectors = plain(x.astype("f8"), k)
    n, s = len(x), x.sum(0)
    got = np.full((n, k), np.nan)
    for r in rows:
        got[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["deviation"] == int(((n * x[r["vec_id"]] - s) ** 2).sum())
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / (x - x.mean(0)).var(0).sum(), rel=1e-9)
        assert r["identity_error"] < 1e-9
    cov = np.cov(got.T, bias=True).reshape(k, k)
    assert np.abs(cov - np.eye(k)).max() < 1e-9
    want = (x - x.mean(0)) @ vectors / np.sqrt(values)
    clear = [i for i in range(k) if min([abs(values[i] - values[j]) for j in range(k) if j != i] or [1]) > 1e-6 * values[0]]
    for i in clear:
        assert np.abs(np.abs(got[:, i]) - np.abs(want[:, i])).max() < 1e-8


def test_equals_eigendecomposition(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").selectExpr("vec_id", "slice(embedding, 1, 20) AS embedding")
    ids = [r["vec_id"] for r in df.select("vec_id").collect()]
    x = np.floor(1024 * np.array([r["embedding"] for r in df.collect()], "f8")).astype("i8") + 100_000
    place = {v: i for i, v in enumerate(ids)}
    rows = [r.asDict() | {"vec_id": place[r["vec_id"]]} for r in whitening.whitened(df).collect()]
    assert len(rows) == 8 * len(x)
    check(rows, x, 8)


def test_equal_variances_are_found_as_often_as_they_occur(spark):
    rows = [(2 * i + s, [float(4 * (1 - 2 * s)) if j == i else 0.0 for j in range(10)]) for i in range(10) for s in (0, 1)]
    x = np.array([r[1] for r in rows]) * 1024 + 100_000
    found = whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == 8 * 20
    got = np.zeros((20, 8))
    for r in found:
        got[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["explained"] == pytest.approx(0.1)
    assert np.abs(np.cov(got.T, bias=True) - np.eye(8)).max() < 1e-9 and len(x) == 20


def test_odd_rows_are_left_out(spark):
    good = [(i, [float(i % 3), float(i % 5), float(-i)]) for i in range(30)]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 0.0, 0.0]), (103, [float("inf"), 0.0, 0.0])]
    df = spark.createDataFrame(good + odd, SCHEMA)
    rows = [r.asDict() for r in whitening.whitened(df.selectExpr("vec_id", "embedding", "1 AS whitened", "2 AS n", "3 AS x0")).collect()]
    assert {r["vec_id"] for r in rows} == set(range(30))
    check(rows, np.array([[1024 * int(v) + 100_000 for v in r[1]] for r in good]), 3)


def test_small_tables(spark):
    assert whitening.whitened(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, [2.0, 3.0])] * 4, SCHEMA)).collect() == []  # no variance
    assert whitening.whitened(spark.createDataFrame([(1, [])], SCHEMA)).collect() == []
    two = whitening.whitened(spark.createDataFrame([(1, [0.0, 0.0]), (None, [3.0, 4.0]), (1, [0.0])], SCHEMA)).collect()
    assert sorted(str(r["vec_id"]) for r in two) == ["1", "1", "None"] and {r["component"] for r in two} == {1}


def test_deviation_is_exact_or_null(spark):
    big = [(i, [float(i % 7) * 1e6, 1.0]) for i in range(3000)]
    x = np.array([[int(v * 1024) + 100_000 for v in r[1]] for r in big], object)
    n, s = len(x), x.sum(0)
    for r in whitening.whitened(spark.createDataFrame(big, SCHEMA)).collect():
        want = int(((n * x[r["vec_id"]] - s) ** 2).sum())
        assert r["deviation"] == (want if want < 1 << 63 else None)


def test_transform_keeps_columns(spark):
    df = spark.createDataFrame([(i, [float(i), float(i * i % 11)], "a") for i in range(20)], "vec_id long, embedding array<float>, whitened string")
    out = whitening.transform(df, whitening.fit(df, k=2))
    assert out.columns == ["vec_id", "embedding", "whitened", "whitened_", "deviation"] and out.count() == 20
