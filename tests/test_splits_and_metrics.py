import pytest

from modelgate.operators.evaluate import (
    evaluate_grouping_sets,
    overall_metrics,
    require_rows,
    segment_metrics,
    split_evaluation,
)
from modelgate.operators.splits import chrono_split, split_summary, split_summary_wide
from modelgate.schema import RAW_SCHEMA


def split48(spark):
    rows = []
    for i in range(48):
        y, m = 2021 + i // 12, i % 12 + 1
        rows.append((f"{y}-{m:02d}", "A", "4 ROOM", "M", "04 TO 06", "90", "2000", "70 years", str(450000 + y + m)))
    return spark.createDataFrame(rows, RAW_SCHEMA)


def test_chronological_split_48_months(spark):
    s = chrono_split(split48(spark))
    summary = {r["split"]: r for r in split_summary(s).collect()}
    assert summary["train"]["rows"] == 24
    assert summary["validation"]["rows"] == 12
    assert summary["test"]["rows"] == 12
    assert (summary["train"]["first_month"], summary["train"]["last_month"]) == ("2021-01", "2022-12")
    assert (summary["validation"]["first_month"], summary["validation"]["last_month"]) == ("2023-01", "2023-12")
    assert (summary["test"]["first_month"], summary["test"]["last_month"]) == ("2024-01", "2024-12")
    wide = split_summary_wide(s).collect()
    assert len(wide) == 1
    w = wide[0]
    assert (w["train_rows"], w["validation_rows"], w["test_rows"]) == (24, 12, 12)
    assert (w["validation_month_start"], w["validation_month_end"]) == ("2023-01", "2023-12")


def test_split_counts_observed_months_only(spark):
    raw = split48(spark).where("month NOT IN ('2021-03', '2021-04')")
    summary = {r["split"]: r["rows"] for r in split_summary(chrono_split(raw)).collect()}
    assert summary == {"train": 22, "validation": 12, "test": 12}


def test_split_needs_more_months_than_holdout(spark):
    with pytest.raises(ValueError, match="Need more than 24"):
        chrono_split(split48(spark).limit(24))
    with pytest.raises(ValueError):
        chrono_split(split48(spark), validation_months=0)


def test_split_is_disjoint_and_complete(spark):
    s = chrono_split(split48(spark))
    assert s.count() == 48
    assert s.select("month", "split").distinct().groupBy("month").count().where("count > 1").count() == 0


def scored(spark, data):
    return spark.createDataFrame(data, "model_name string, model_version string, town string, flat_type string, "
                                       "resale_price double, prediction double")


def test_overall_metrics_literals(spark):
    df = scored(spark, [("m", "1", "A", "x", a, p) for a, p in [(10.0, 12.0), (20.0, 18.0), (30.0, 33.0)]])
    r = require_rows(overall_metrics(df)).first()
    assert r["rmse"] == pytest.approx(2.3804761428, abs=1e-9)
    assert r["mae"] == pytest.approx(2.3333333333, abs=1e-9)


def test_empty_metrics_raise(spark):
    df = scored(spark, [])
    with pytest.raises(ValueError):
        require_rows(overall_metrics(df))


def test_segment_metrics_values_and_null_segments(spark):
    df = scored(spark, [
        ("m", "1", "ANG MO KIO", "x", 500000.0, 490000.0),
        ("m", "1", "ANG MO KIO", "x", 520000.0, 530000.0),
        ("m", "1", "BEDOK", "x", 610000.0, 620000.0),
        ("m", "1", None, "x", 1.0, 1000.0),
    ])
    seg = segment_metrics(df, "town").orderBy("rmse", "segment").collect()
    assert [r["segment"] for r in seg] == ["ANG MO KIO", "BEDOK"]
    assert [r["count"] for r in seg] == [2, 1]
    assert all(r["rmse"] == pytest.approx(10000.0) for r in seg)


def test_grouping_sets_equal_separate_passes(spark):
    data = [("m", v, t, f, float(a), float(a + d))
            for v in ("1", "2") for t in ("A", "B", None) for f in ("x", "y") for a, d in [(100, 3), (200, -7), (300, 11)]]
    df = scored(spark, data)
    overall, segs = split_evaluation(evaluate_grouping_sets(df))
    o = {r["model_version"]: r for r in overall.collect()}
    o2 = {r["model_version"]: r for r in overall_metrics(df).collect()}
    for v in o:
        assert o[v]["rmse"] == pytest.approx(o2[v]["rmse"])
        assert o[v]["count"] == o2[v]["count"] == 18
    for col in ("town", "flat_type"):
        a = {(r["model_version"], r["segment"]): r["rmse"] for r in segs.where(f"segment_column = '{col}'").collect()}
        b = {(r["model_version"], r["segment"]): r["rmse"] for r in segment_metrics(df, col).collect()}
        assert a.keys() == b.keys()
        assert all(a[k] == pytest.approx(b[k]) for k in a)
    assert segs.where("segment IS NULL").count() == 0


def test_a_single_reader_gets_the_same_rows_without_the_typed_table(spark):
    from modelgate.plans.gate import GateJob, champion_alias
    from modelgate.sources import adapters as A
    from modelgate.sources.tables import Tables
    from tests.conftest import SF0001

    raw = A.raw_sales_with_predictions(Tables(spark, SF0001))
    job = GateJob(raw, A.prediction_columns(), A.MODEL_NAME, champion_alias(spark, A.MODEL_NAME, "1"))
    once = job.rows_once("test")
    assert "typed" not in job.__dict__
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    # the month range stands on the orders, below the joins
    assert any("Filter" in line and "o_orderdate" in line and "yyyy-M" in line for line in plan.split("\n"))
    columns = [c for c in once.columns if c != "model_name"]
    got = sorted(map(str, once.select(*columns).collect()))
    assert got and got == sorted(map(str, job.rows_of("test").select(*columns).collect()))
    assert job.rows_once("test").columns == job.rows_of("test").columns
