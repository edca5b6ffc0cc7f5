import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from modelgate.functions import parse as P
from modelgate.operators.features import feature_schema, prepare_features
from modelgate.schema import PREPARED_COLUMNS, RAW_SCHEMA


def one(spark, expr, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"x {dtype}")
    return df.select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("61 years 04 months", 61 + 4 / 12),
        ("72 years", 72.0),
        ("5 months", 5 / 12),
        ("61.5", 61.5),
        ("  61 YEARS 4 MONTHS ", 61 + 4 / 12),
        ("", None),
        (None, None),
        ("garbage", None),
        ("61YEARS", None),
        ("61.5d", None),
    ],
)
def test_lease_years(spark, text, expected):
    got = one(spark, P.lease_years, text)
    if expected is None:
        assert got is None
    else:
        assert got == pytest.approx(expected, abs=1e-10)


@pytest.mark.parametrize(
    "text,expected",
    [("04 TO 06", 5.0), ("07", 7.0), ("BASEMENT", None), ("", None), (None, None), ("4.5", 4.5), ("10 TO 12 TO 15", 11.0)],
)
def test_storey_midpoint(spark, text, expected):
    assert one(spark, P.storey_midpoint, text) == expected


@pytest.mark.parametrize(
    "text,expected",
    [("12", 12.0), (" 1e3 ", 1000.0), ("n/a", None), ("", None), ("61.5d", None), ("1f", None), ("-2.5", -2.5), (".5", 0.5)],
)
def test_to_number(spark, text, expected):
    assert one(spark, P.to_number, text) == expected


def test_to_number_nan_and_inf(spark):
    assert math.isnan(one(spark, P.to_number, "nan"))
    assert one(spark, P.to_number, "inf") == float("inf")


def test_parse_month_accepts_one_digit_month(spark):
    assert one(spark, P.parse_month, "2024-1") == dt.date(2024, 1, 1)
    assert one(spark, P.parse_month, "2024-12") == dt.date(2024, 12, 1)
    assert one(spark, P.parse_month, None) is None


def smoke_raw(spark):
    data = [
        ("2024-01", "ANG MO KIO", "4 ROOM", "Improved", "04 TO 06", "92.0", "2000", "75 years 00 months", "520000"),
        ("2024-02", "BEDOK", "5 ROOM", "Improved", "07 TO 09", "110.0", "1998", "71 years 10 months", "640000"),
    ]
    return spark.createDataFrame(data, RAW_SCHEMA)


def test_prepare_smoke_rows_and_column_order(spark):
    out = prepare_features(smoke_raw(spark))
    assert out.columns == PREPARED_COLUMNS
    rows = out.orderBy("sale_month").collect()
    assert len(rows) == 2
    first = rows[0]
    assert first["sale_month"] == dt.date(2024, 1, 1)
    assert first["flat_age_years"] == pytest.approx(24.0)
    assert first["remaining_lease_years"] == pytest.approx(75.0)
    assert first["storey_midpoint"] == 5.0
    assert rows[1]["flat_age_years"] == pytest.approx(2024 + 1 / 12 - 1998)
    assert rows[1]["remaining_lease_years"] == pytest.approx(71 + 10 / 12)


def test_missing_lease_filled_from_age_and_bad_rows_dropped(spark):
    data = [
        ("2024-01", "A", "4 ROOM", "M", "04 TO 06", "90", "2000", None, "500000"),
        ("2024-01", "A", "4 ROOM", "M", "04 TO 06", "90", "2000", "nan", "500000"),
        ("2024-01", "A", "4 ROOM", "M", "", "90", "2000", "70 years", "500000"),
        ("2024-01", "A", "4 ROOM", "M", "04 TO 06", "n/a", "2000", "70 years", "500000"),
        ("2024-01", "A", "4 ROOM", "M", "04 TO 06", "90", "2000", "70 years", "nan"),
        ("2024-01", None, "4 ROOM", "M", "04 TO 06", "90", "2000", "70 years", "500000"),
    ]
    out = prepare_features(spark.createDataFrame(data, RAW_SCHEMA)).collect()
    assert len(out) == 2
    for r in out:
        assert r["remaining_lease_years"] == pytest.approx(99.0 - 24.0)


def test_remaining_lease_column_may_be_absent(spark):
    raw = smoke_raw(spark).drop("remaining_lease")
    out = prepare_features(raw).orderBy("sale_month").collect()
    assert out[0]["remaining_lease_years"] == pytest.approx(99 - 24.0)


def test_missing_month_column_is_an_error(spark):
    with pytest.raises(KeyError):
        prepare_features(smoke_raw(spark).drop("month"))


def test_feature_schema_roles(spark):
    roles = {r["column"]: r["role"] for r in feature_schema(spark).collect()}
    assert roles["resale_price"] == "target"
    assert roles["sale_month"] == "date"
    assert roles["town"] == "categorical_feature"
    assert roles["storey_midpoint"] == "numeric_feature"


@pytest.mark.parametrize(
    "text,expected",
    [
        ("６１ years ０４ months", 61 + 4 / 12),
        ("61 years", 61.0),
        ("1_000", 1000.0),
        ("1__000", None),
        ("_1000", None),
    ],
)
def test_lease_years_unicode_and_underscores(spark, text, expected):
    got = one(spark, P.lease_years, text)
    if expected is None:
        assert got is None
    else:
        assert got == pytest.approx(expected)


def test_storey_unicode_digits_and_numbers_keep_pandas_rules(spark):
    assert one(spark, P.storey_midpoint, "０４ TO ０６") == 5.0
    assert one(spark, P.to_number, "1_000") is None


def test_python_number_formats(spark):
    from modelgate.functions import text as X

    vals = [1234567.5, 2.5, -0.4, 0.125, float("nan"), float("inf"), -1234.4, 0.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = df.select(X.thousands(F.col("x")), X.signed_thousands(F.col("x")), X.percent(F.col("x")),
                    X.signed_percent(F.col("x")), X.percent(F.col("x"), 0), X.fixed(F.col("x"), 4)).collect()
    for v, row in zip(vals, got):
        assert tuple(row) == (f"{v:,.0f}", f"{v:+,.0f}", f"{v:.1%}", f"{v:+.1%}", f"{v:.0%}", f"{v:.4f}"), v


def test_number_formats_match_python_on_random_doubles(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from modelgate.functions import text as X

    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.one_of(st.floats(-1e9, 1e9, allow_nan=False),
                              st.integers(-10**6, 10**6).map(lambda i: i / 8),
                              st.integers(-10**5, 10**5).map(lambda i: i / 1000 + 0.0005)), min_size=50, max_size=50))
    def check(vals):
        df = spark.createDataFrame([(float(v),) for v in vals], "x double")
        rows = df.select("x", X.thousands(F.col("x")), X.signed_thousands(F.col("x")), X.percent(F.col("x")),
                         X.signed_percent(F.col("x")), X.fixed(F.col("x"), 4)).collect()
        for r in rows:
            v = r[0]
            assert tuple(r[1:]) == (f"{v:,.0f}", f"{v:+,.0f}", f"{v:.1%}", f"{v:+.1%}", f"{v:.4f}")

    check()


def test_split_features_and_target(spark):
    from modelgate.operators.features import split_features_and_target
    from modelgate.schema import FEATURE_COLUMNS, TARGET_COLUMN

    df = spark.createDataFrame([tuple(str(i) for i in range(len(FEATURE_COLUMNS) + 2))], ["extra", TARGET_COLUMN, *FEATURE_COLUMNS])
    features, target = split_features_and_target(df)
    assert features.columns == list(FEATURE_COLUMNS) and target.columns == [TARGET_COLUMN]
    assert target.first()[0] == "1"


def test_each_pattern_of_a_text_is_evaluated_once(spark):
    import re

    from pyspark.sql import functions as F

    from modelgate.functions import parse as P

    lease, storey = (str(f(F.col("t"))).lower() for f in (P.lease_years_normalized, P.storey_midpoint_normalized))
    assert lease.count("regexp_extract") <= 3  # months stand beside the years and alone
    assert storey.count("regexp_extract") <= 3 and "regexp_extract_all" not in storey
    texts = [None, "", " ", "61 years 04 months", "72 years", "5 months", "0 months", "61.5", "6_1", "6__1", "_6", "year", "years 5",
             "5 year_ 3 monthly", "5\u00a0years", "4 months 2 years", "1e3", "inf", "nan", "x 7 years", "9" * 400 + " years", "3years", "month 3",
             "04 to 06", "04", "1 2 3", "a1b22c", "7 to", "1\n2", "to"]

    def years(t):
        if not t:
            return None
        y, m = (re.search(rf"([0-9]+)[\s]+{u}", t) for u in ("year", "month"))
        if y or m:
            return float(y[1] if y else 0) + float(m[1] if m else 0) / 12
        try:
            return float(t)
        except ValueError:
            return None

    def middle(t):
        found = [float(x) for x in re.findall("[0-9]+", t or "")]
        return (found[0] + found[1]) / 2 if len(found) > 1 else found[0] if found else None

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", P.lease_years_normalized(F.col("t")), P.storey_midpoint_normalized(F.col("t"))).collect()
    for t, a, b in got:
        assert str(a) == str(years(t)) and b == middle(t), (t, a, b)
