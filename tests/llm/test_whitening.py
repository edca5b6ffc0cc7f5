import math

import numpy as np
import pytest

import __spark_entry__ as entry
from modelgate.llm import whitening
from tests.conftest import SF0001


def brute(vectors):
    """x-vectors, covariance and its eigenpairs in the plain way."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    centred = np.array([[n * r[i] - sums[i] for i in range(d)] for r in x], dtype=object)
    cov = (centred.T @ centred / n**3).astype(float)
    values, basis = np.linalg.eigh(cov)
    return n, (centred / n).astype(float), (centred**2).sum(axis=1), cov, values[::-1], basis[:, ::-1]


def check(spark, out, ids, vectors, number):
    n, centred, deviation, cov, values, basis = brute(vectors)
    got = out.collect()
    assert len(got) == len(vectors) * number
    assert {r["n"] for r in got} == {n}
    by = {(r["vec_id"], r["component"]): r for r in got}
    for j in range(number):
        column = np.array([by[i, j + 1]["whitened"] for i in ids])
        want = centred @ basis[:, j] / np.sqrt(values[j])
        sign = np.sign(column @ want)
        assert np.allclose(column, sign * want, rtol=1e-8, atol=1e-8)
        assert [by[i, j + 1]["explained"] for i in ids] == pytest.approx([values[j] / np.trace(cov)] * n, rel=1e-10)
    assert [by[i, 1]["deviation"] for i in ids] == [int(v) for v in deviation]
    assert got[0]["identity_error"] < 1e-8


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF0001}/embeddings.parquet").collect()
    rows = [r for r in rows if r["embedding"] is not None and all(c is not None and math.isfinite(c) for c in r["embedding"])]
    out = entry.queries()["op11_embedding_whitening"](spark, SF0001)
    check(spark, out, [r["vec_id"] for r in rows], [r["embedding"] for r in rows], 32)


def test_nulls_lengths_extra_columns(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(np.float32(c)) for c in rng.normal(size=5) * [9, 5, 3, 2, 1]], i) for i in range(40)]
    bad = [(50, None, 0), (51, [1.0, None, 2.0, 3.0, 4.0], 0), (52, [float("nan")] * 5, 0), (53, [float("inf")] + [0.0] * 4, 0),
           (54, [], 0), (55, [1.0, 2.0], 0), (56, [3e38, 1.0, 2.0, 3.0, 4.0], 0)]
    df = spark.createDataFrame(good + bad, "vec_id int, embedding array<float>, n int").repartition(3)
    out = whitening.whiten(df)
    assert out.columns == ["vec_id", "n", "component", "n_", "deviation", "whitened", "explained", "identity_error"]
    check(spark, out.drop("n").withColumnRenamed("n_", "n"), range(40), [g[1] for g in good], 5)


def test_no_variance_and_empty(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id int, embedding array<float>")
    got = whitening.whiten(df).collect()
    assert len(got) == 4 and all(r["whitened"] is None and r["deviation"] == 0 for r in got)
    assert whitening.whiten(df.limit(0)).count() == 0
    one_way = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(9)], "vec_id int, embedding array<double>")
    found = {r["component"]: r["whitened"] for r in whitening.whiten(one_way).collect()}
    assert found[1] is not None and found[2] is None and found[3] is None


def test_deviation_of_large_entries_is_exact(spark):
    rows = [(1, [1e13, 0.0]), (2, [-1e13, 1.0]), (3, [0.5, 0.25])]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    n, _, deviation, *_ = brute([r[1] for r in rows])
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(df).collect()}
    assert got == {i + 1: (int(v) if v < 2**63 else None) for i, v in enumerate(deviation)}


@pytest.mark.parametrize("kind", ["random", "tied", "indefinite", "close", "wilkinson"])
def test_inertia_counts_and_components(kind):
    rng = np.random.default_rng(11)
    n = 21
    a = rng.standard_normal((n, n))
    m = a @ a.T
    if kind == "tied":
        m = np.diag([5.0] * 4 + [3.0] * 8 + [1.0] * 9)
    elif kind == "indefinite":
        m = a + a.T
    elif kind == "close":
        q, _ = np.linalg.qr(a)
        m = q @ np.diag([1 + 1e-9 * i for i in range(n)]) @ q.T
        m = (m + m.T) / 2
    elif kind == "wilkinson":
        m = np.diag(np.abs(np.arange(n) - 10.0)) + np.diag(np.ones(n - 1), 1) + np.diag(np.ones(n - 1), -1)
    true = np.linalg.eigvalsh(m)[::-1]
    for shift in rng.uniform(true[-1] - 1, true[0] + 1, 60):
        assert whitening.above(m, shift) == (true > shift).sum()
    values, basis = whitening.Spectrum(m).leading(10)
    scale = np.abs(true).max()
    assert np.abs(values - true[:10]).max() <= 1e-12 * scale
    assert np.abs(basis.T @ basis - np.eye(10)).max() < 1e-12
    assert np.abs(m @ basis - basis * values).max() < 1e-8 * scale
