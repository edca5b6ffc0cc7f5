"""A few oracle cross-checks inside the test suite (smallest scale).

The full comparison of every query runs with scripts/check_oracles.py.
"""

import duckdb
import pytest

from modelgate.sources.tables import TABLES
from tests.conftest import SF0001

NAMES = ["policy_gate", "evaluate_grouping_sets", "segment_deltas", "categorical_drift", "ks_statistic",
         "render_report", "fold_tags", "parse_reports", "judge_scores", "format_metrics"]
# Queries carrying KS p-values: one formula serves every sample size, so they
# are comparable at both scales, below and above 10 000 values.
PVALUE_NAMES = ["numeric_drift", "drift_report", "evidence_lookup", "ks_pvalue", "resume_reviews"]
SF001 = "/root/testdata/sf0.01"


def _duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.fixture(scope="module")
def duck():
    return _duck(SF0001)


def _compare(spark, con, name, sf_dir):
    import __spark_entry__ as E

    df = E.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    rel = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in rel.description]
    assert sorted(ocols) == cols
    idx = [ocols.index(c) for c in cols]
    want = sorted((tuple(r[i] for i in idx) for r in rel.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", NAMES + PVALUE_NAMES)
def test_query_equals_oracle(spark, duck, name):
    _compare(spark, duck, name, SF0001)


@pytest.mark.parametrize("name", PVALUE_NAMES[:3])
def test_pvalue_query_equals_oracle_on_larger_samples(spark, name):
    _compare(spark, _duck(SF001), name, SF001)


def test_drift_evidence_json_shape(spark):
    import json

    import __spark_entry__ as E

    for r in E.queries()["evidence_lookup"](spark, SF0001).collect():
        doc = json.loads(r["drift_report"])
        assert set(doc) == {"overall_drift_detected", "columns"}
        assert doc["overall_drift_detected"] == any(c["is_drifted"] for c in doc["columns"])
        for c in doc["columns"]:
            assert round(c["statistic"], 4) == c["statistic"]
            assert ("p_value" in c) == (c["type"] == "ks")
        assert "E-" not in r["drift_report"]
