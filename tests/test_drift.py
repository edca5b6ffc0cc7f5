import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from modelgate.functions.stats import ks_pvalue
from modelgate.operators.drift import categorical_drift, drift_report, drift_summary, ks_statistics, numeric_drift


def frame(spark, col, values, dtype="string"):
    return spark.createDataFrame([(v,) for v in values], f"{col} {dtype}")


def psi_of(spark, ref, cur):
    r = categorical_drift(frame(spark, "town", ref), frame(spark, "town", cur), ["town"]).collect()
    assert len(r) == 1
    return r[0]


def test_psi_identical_is_zero(spark):
    vals = ["A", "B", "C"] * 100
    assert psi_of(spark, vals, vals)["statistic"] == pytest.approx(0.0, abs=1e-5)


def test_psi_shifted_positive_and_flip_drifts(spark):
    shifted = psi_of(spark, ["A"] * 50 + ["B"] * 30 + ["C"] * 20, ["A"] * 20 + ["B"] * 30 + ["C"] * 50)
    assert shifted["statistic"] > 0
    flip = psi_of(spark, ["A"] * 95 + ["B"] * 5, ["A"] * 5 + ["B"] * 95)
    assert flip["statistic"] > 0.2 and flip["is_drifted"]


def test_psi_floor_not_renormalised_and_symmetric(spark):
    a, b = ["A"] * 10, ["B"] * 10
    r = psi_of(spark, a, b)["statistic"]
    expected = 2 * (1 - 1e-4) * math.log(1 / 1e-4)
    assert r == pytest.approx(expected)
    assert psi_of(spark, b, a)["statistic"] == pytest.approx(r)


def test_psi_empty_side_is_zero_row(spark):
    r = psi_of(spark, ["A", "B"], [None, None])
    assert r["statistic"] == 0.0 and not r["is_drifted"]


def test_ks_same_and_shifted_normals(spark):
    rng = np.random.default_rng(42)
    a = rng.normal(100, 10, 1000).tolist()
    b = rng.normal(100, 10, 1000).tolist()
    c = rng.normal(200, 10, 1000).tolist()
    same = numeric_drift(frame(spark, "x", a, "double"), frame(spark, "x", b, "double"), ["x"]).first()
    assert not same["is_drifted"]
    shifted = numeric_drift(frame(spark, "x", a, "double"), frame(spark, "x", c, "double"), ["x"]).first()
    assert shifted["is_drifted"] and shifted["statistic"] == pytest.approx(1.0)
    assert shifted["threshold"] == 0.05


def brute_ks(a, b):
    a, b = np.sort(np.asarray(a)), np.sort(np.asarray(b))
    grid = np.union1d(a, b)
    return float(np.max(np.abs(np.searchsorted(a, grid, "right") / len(a) - np.searchsorted(b, grid, "right") / len(b))))


@settings(max_examples=15, deadline=None)
@given(
    st.lists(st.integers(-20, 20), min_size=1, max_size=60),
    st.lists(st.integers(-20, 20), min_size=1, max_size=60),
    st.sampled_from([2, 4, 256]),
)
def test_ks_equals_brute_force_ecdf(spark, a, b, buckets):
    ref = frame(spark, "x", [float(v) for v in a], "double")
    cur = frame(spark, "x", [float(v) for v in b], "double")
    got = ks_statistics(ref, cur, ["x"], buckets=buckets).first()["statistic"]
    assert got == pytest.approx(brute_ks(a, b), abs=1e-12)
    assert 0.0 <= got <= 1.0


def test_ks_hot_value_and_nan_dropped(spark):
    a = [5.0] * 300 + [1.0, 2.0, float("nan")]
    b = [5.0] * 10 + [7.0] * 20 + [None]
    got = ks_statistics(frame(spark, "x", a, "double"), frame(spark, "x", b, "double"), ["x"]).first()
    assert got["n_reference"] == 302 and got["n_current"] == 30
    assert got["statistic"] == pytest.approx(brute_ks(a[:302], b[:30]))


def test_ks_pvalue_series(spark):
    df = spark.createDataFrame([(0.012849440415222263, 10533, 2104), (0.0, 10, 10), (1.0, 1000, 1000)], "d double, n long, m long")
    p = [r[0] for r in df.select(ks_pvalue(df.d, df.n, df.m)).collect()]
    assert p[0] == pytest.approx(0.934264, abs=5e-3)  # the limit series without the finite-sample shift
    assert p[1] == 1.0
    assert p[2] == pytest.approx(0.0, abs=1e-12)


def test_combined_report_order_and_flag(spark):
    rows = [(t, float(100 + i % 7)) for i, t in enumerate(["A", "B", "C"] * 100)]
    df = spark.createDataFrame(rows, "town string, floor_area_sqm double")
    rep = drift_report(df, df, ["town", "missing_col"], ["floor_area_sqm"])
    got = rep.orderBy("ord").collect()
    assert [(r["column"], r["drift_type"]) for r in got] == [("town", "psi"), ("floor_area_sqm", "ks")]
    summary = drift_summary(rep).first()
    assert summary["overall_drift_detected"] is False
    assert [c["column"] for c in summary["column_results"]] == ["town", "floor_area_sqm"]


def _durbin_cdf(n, d):
    """Exact P(D_n < d), one-sample two-sided (Marsaglia, Tsang and Wang
    2003): n!/n^n times an entry of H^n, powered with log scaling."""
    import math

    import numpy as np

    k = int(math.floor(n * d)) + 1
    m = 2 * k - 1
    h = k - n * d
    lf = [math.lgamma(i + 1) for i in range(m + 2)]
    H = np.zeros((m, m))
    for i in range(m):
        for j in range(max(0, i - m), min(m, i + 2)):
            H[i, j] = math.exp(-lf[i - j + 1])
    for i in range(m):
        H[i, 0] -= h ** (i + 1) * math.exp(-lf[i + 1])
        H[m - 1, i] -= h ** (m - i) * math.exp(-lf[m - i])
    if 2 * h - 1 > 0:
        H[m - 1, 0] += (2 * h - 1) ** m * math.exp(-lf[m])
    result, rlog, base, blog, e = np.eye(m), 0.0, H, 0.0, n
    while e:
        if e & 1:
            result = result @ base
            s = np.abs(result).max()
            result, rlog = result / s, rlog + blog + math.log(s)
        e >>= 1
        if e:
            base = base @ base
            s = np.abs(base).max()
            base, blog = base / s, 2 * blog + math.log(s)
    return math.exp(math.lgamma(n + 1) - n * math.log(n) + rlog) * result[k - 1, k - 1]


def test_durbin_reference_value():
    # published example: K(10, 0.274) = 0.6284796154565043
    assert _durbin_cdf(10, 0.274) == pytest.approx(0.6284796154565043, abs=1e-12)


@pytest.mark.parametrize("n,tol", [(10, 5e-3), (20, 2e-3), (140, 3e-4), (2000, 3e-5), (6719, 1e-5)])
def test_pvalue_close_to_exact_distribution(spark, n, tol):
    """Two samples of 2n values each have the effective size n."""
    points = [z / math.sqrt(n) for z in (0.6, 0.9, 1.2, 1.45, 1.8, 2.5) if z / math.sqrt(n) < 0.75]
    df = spark.createDataFrame([(i, x, 2 * n, 2 * n) for i, x in enumerate(points)], "i int, d double, n long, m long")
    got = {r["i"]: r["p"] for r in df.select("i", ks_pvalue(df.d, df.n, df.m).alias("p")).collect()}
    for i, x in enumerate(points):
        assert got[i] == pytest.approx(1 - _durbin_cdf(n, x), abs=tol), (n, x)


def test_pvalue_has_no_size_switch(spark):
    """One formula: the same scaled statistic gives nearly the same p on both
    sides of any size, and a billion rows cost what ten rows cost."""
    sizes = [9_999, 10_000, 10_001, 10**6, 10**9, 10**12]
    df = spark.createDataFrame([(1.0 / math.sqrt(n / 2), n, n) for n in sizes], "d double, n long, m long")
    p = [r[0] for r in df.select(ks_pvalue(df.d, df.n, df.m)).collect()]
    assert all(abs(x - p[-1]) < 4e-3 for x in p)  # 1 / (6 sqrt(5000)) shifts p by 2.5e-3
    assert abs(p[0] - p[1]) < 1e-6 and abs(p[1] - p[2]) < 1e-6
    plan = df.select(ks_pvalue(df.d, df.n, df.m))._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_keyed_all_null_column_gives_zero_psi(spark):
    rows = [("m", "x", None), ("m", "y", None)]
    df = spark.createDataFrame(rows, "model_name string, a string, b string")
    got = {r["column"]: r["statistic"] for r in categorical_drift(df, df, ["a", "b"], keys=["model_name"]).collect()}
    assert got == {"a": 0.0, "b": 0.0}
