import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from modelgate.operators import registry as R
from modelgate.operators.common import top_k_per_group
from modelgate.operators.sets import dedupe_urls, unique_lines
from tests.conftest import SF0001

T0 = dt.datetime(2024, 1, 1)
T1 = dt.datetime(2024, 1, 2)


def test_alias_fold_uses_ts_then_seq_and_deletes(spark):
    ev = spark.createDataFrame(
        [("m", "champion", "1", T0, 0), ("m", "champion", "2", T1, 1), ("m", "champion", "3", T1, 2),
         ("n", "champion", "1", T0, 0), ("n", "champion", None, T1, 0)],
        R.ALIAS_EVENTS_DDL,
    )
    cur = {r["model_name"]: r["model_version"] for r in R.current_aliases(ev).collect()}
    assert cur == {"m": "3"}


def test_current_champion_metrics_and_missing_run(spark):
    ev = spark.createDataFrame([("m", "champion", "2", T0, 0), ("x", "champion", "9", T0, 0)], R.ALIAS_EVENTS_DDL)
    runs = spark.createDataFrame(
        [("m", "2", "r2", T0, {}, {"test_rmse": 148000.0, "test_mae": 118000.0, "validation_rmse": 1.0})], R.RUNS_DDL)
    got = {r["model_name"]: r for r in R.current_champion(ev, runs).collect()}
    assert (got["m"]["champion_rmse"], got["m"]["champion_mae"]) == (148000.0, 118000.0)
    assert got["x"]["lookup_error"] == "MLflow could not load the backing run for champion model 'x' version 9."


def test_history_newest_first_numeric_versions_with_tags(spark):
    runs = spark.createDataFrame([("m", str(v), f"r{v}", T0, {}, {"test_rmse": float(v)}) for v in (1, 2, 3, 9, 10)], R.RUNS_DDL)
    tags = spark.createDataFrame(
        [("m", "3", "promotion_status", "champion", T0, 0), ("m", "2", "promotion_status", "rejected", T0, 0),
         ("m", "2", "rejection_reasons", "RMSE too high", T0, 1), ("m", "2", "rejection_reasons", None, T1, 0)],
        R.TAG_EVENTS_DDL,
    )
    h = R.training_history(runs, tags, 3).orderBy("rank").collect()
    assert [r["version"] for r in h] == ["10", "9", "3"]
    h2 = {r["version"]: r for r in R.training_history(runs, tags, 10).collect()}
    assert h2["3"]["promotion_status"] == "champion"
    assert h2["2"]["rejection_reasons"] is None


def test_register_candidates_continues_versions(spark):
    runs = spark.createDataFrame([("m", "9", "r9", T0, {}, {}), ("m", "10", "r10", T0, {}, {})], R.RUNS_DDL)
    cands = spark.createDataFrame(
        [("m", "b", T1, {"a.b": "1"}, 1.0, 1.0, 2.0, 2.0), ("m", "a", T1, {}, 1.0, 1.0, 2.0, 2.0),
         ("new", "z", T1, {}, 1.0, 1.0, 2.0, 2.0)],
        "model_name string, candidate_id string, registered_at timestamp, params map<string,string>, "
        "validation_rmse double, validation_mae double, test_rmse double, test_mae double",
    )
    out = R.register_candidates(cands, runs)
    got = {(r["model_name"], r["model_version"]) for r in out["runs"].collect()}
    assert got == {("m", "11"), ("m", "12"), ("new", "1")}
    assert {r["value"] for r in out["tag_events"].collect()} == {"candidate"}


def test_resume_rules(spark):
    reviews = spark.createDataFrame(
        [("r1", "pending_review", "m", "1", "REJECT", []), ("r2", "auto_rejected", "m", "2", "REJECT", ["x"]),
         ("r3", "completed", "m", "3", "PROMOTE", [])],
        "review_id string, status string, model_name string, model_version string, decision string, reasons array<string>",
    )
    decisions = spark.createDataFrame(
        [("r1", "approve", "ann", T1, 1), ("r2", "Approve ", "ann", T1, 2), ("r3", "reject", "ann", T1, 3),
         ("r1", "reject", "ann", T1, 9), ("r4", "approve", "ann", T1, 4), ("r2", "maybe", "ann", T0, 0)],
        "review_id string, decision_text string, reviewer string, decided_at timestamp, seq long",
    )
    res = R.resume_reviews(reviews, decisions)
    applied = {r["review_id"]: r for r in res["registry"].collect()}
    assert applied["r1"]["outcome"] == "promoted" and applied["r1"]["rejection_overridden"] is True
    assert applied["r1"]["decision_source"] == "human_review"
    errors = sorted(r["error"] for r in res["errors"].collect())
    assert "Decision must be either 'approve' or 'reject'." in errors
    assert "Review 'r3' is already completed." in errors
    assert "Review 'r4' was not found." in errors
    assert "Review 'r1' is already completed." in errors
    # r2's first decision by time is no decision word: the review stays open for the valid one
    assert applied["r2"]["outcome"] == "promoted"
    assert applied["r2"]["decision_source"] == "human_override_after_policy_reject"


def test_candidate_alias_is_the_newest_version(spark):
    cands = spark.createDataFrame(
        [("m", f"c{i}", T1, {}, 1.0, 1.0, 1.0, 1.0) for i in range(12)],
        "model_name string, candidate_id string, registered_at timestamp, params map<string,string>, "
        "validation_rmse double, validation_mae double, test_rmse double, test_mae double",
    )
    out = R.register_candidates(cands, R.empty(spark, R.RUNS_DDL))
    versions = sorted(int(r["model_version"]) for r in out["runs"].collect())
    assert versions == list(range(1, 13))
    current = R.current_aliases(out["alias_events"]).collect()
    assert [(r["alias"], r["model_version"]) for r in current] == [("candidate", "12")]


def test_apply_decisions_tags(spark):
    d = spark.createDataFrame(
        [("m", "2", T1, 2, "PROMOTE", [], "human_review", "ann", False, "promoted"),
         ("m", "3", T1, 3, "REJECT", [], "policy_auto_reject", None, False, "rejected")],
        "model_name string, model_version string, decided_at timestamp, seq long, decision string, reasons array<string>, "
        "decision_source string, reviewer string, rejection_overridden boolean, outcome string",
    )
    ev = R.apply_decisions(d)
    assert [r["model_version"] for r in ev["alias_events"].collect()] == ["2"]
    tags = {(r["model_version"], r["key"]): r["value"] for r in R.fold_tags(ev["tag_events"]).collect()}
    assert tags[("2", "promotion_status")] == "champion"
    assert tags[("2", "decision_timestamp")] == "2024-01-02T00:00:00+00:00"
    assert tags[("3", "rejection_reasons")] == "Rejected by human reviewer"
    assert ("3", "policy_reasons") not in tags and ("3", "decision_reviewer") not in tags
    assert tags[("3", "rejection_overridden")] == "false"


def test_top_k_exact_with_hot_group(spark):
    random.seed(1)
    data = [("hot", i, random.random()) for i in range(3000)] + [("cold", i, random.random()) for i in range(20)]
    df = spark.createDataFrame(data, "g string, id int, score double")
    got = top_k_per_group(df, ["g"], [F.col("score").desc(), F.col("id")], 5, salt_buckets=8)
    got = {(r["g"], r["rank"]): r["id"] for r in got.collect()}
    for g in ("hot", "cold"):
        expected = [i for _, i, _ in sorted([d for d in data if d[0] == g], key=lambda d: (-d[2], d[1]))[:5]]
        assert [got[(g, k)] for k in range(1, 6)] == expected


def test_sets_first_seen(spark):
    urls = spark.createDataFrame([(1, 1, " http://a "), (1, 2, "http://b"), (1, 3, "http://a"), (1, 4, "")],
                                 "q int, ord int, url string")
    got = sorted((r["url"], r["first_seen"]) for r in dedupe_urls(urls, ["q"], "ord").collect())
    assert got == [("http://a", 1), ("http://b", 2)]
    lines = spark.createDataFrame([(1, 0, "Line A"), (1, 1, "  line a "), (1, 2, "B"), (1, 3, "  ")], "d int, ord int, line string")
    got = sorted((r["ord"], r["line"]) for r in unique_lines(lines, ["d"], "ord").collect())
    assert got == [(0, "Line A"), (2, "B")]


def test_entry_and_registered_queries(spark):
    import __spark_entry__ as E

    out = E.entry(spark)
    assert set(out.columns) >= {"model_name", "model_version", "decision", "reasons"}
    assert out.count() >= 1
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


@pytest.mark.parametrize("name", ["parse_reports", "judge_scores", "trace_stats", "segment_tail"])
def test_queries_run_on_smallest_scale(spark, name):
    import __spark_entry__ as E

    assert E.queries()[name](spark, SF0001).count() >= 0


def test_gate_with_registry_runs_overrides_and_no_drift(spark):
    from modelgate.plans.gate import GateJob, champion_alias
    from modelgate.sources import adapters as A
    from modelgate.sources.tables import Tables

    t = Tables(spark, SF0001)
    runs = spark.createDataFrame(
        [(A.MODEL_NAME, "1", "r1", T0, {}, {"test_rmse": 1.0, "test_mae": 1.0})], R.RUNS_DDL)
    job = GateJob(raw=A.raw_sales_with_predictions(t), predictions=A.prediction_columns(), model_name=A.MODEL_NAME,
                  alias_events=champion_alias(spark, A.MODEL_NAME, "1"), runs=runs,
                  thresholds={"max_rmse_regression_pct": 1e9, "max_segment_rmse_regression_pct": 1e9}, with_drift=False)
    v = {r["model_version"]: r for r in job.verdicts.collect()}
    assert set(v) == {"2", "3", "4"}
    for r in v.values():
        assert r["champion_rmse"] == 1.0 and r["has_champion"]
        assert "drift_check_skipped" in r["checks_passed"]
        assert "champion_rmse_regression" in r["checks_passed"]
        assert r["decision"] == "PROMOTE"


def test_every_query_plan_stays_small(spark):
    """Guards against expression duplication (a staged parse folded back
    into every consumer makes plans explode and run many times slower)."""
    from modelgate.plans.catalog import QUERIES, _load_all

    _load_all()
    for name, fn in QUERIES.items():
        if name in ("train_gbt", "score"):
            continue
        size = len(fn(spark, SF0001)._jdf.queryExecution().optimizedPlan().toString())
        assert size < 200_000, (name, size)


def test_compacted_log_folds_to_the_same_state(spark):
    rows = [("m", str(v), k, (None if (v + i) % 5 == 0 else f"x{v}{i}"), dt.datetime(2024, 1, 1 + i % 3), i)
            for v in range(1, 5) for i, k in enumerate(["promotion_status", "policy_verdict", "promotion_status", "rejection_reasons"])]
    events = spark.createDataFrame(rows, R.TAG_EVENTS_DDL)
    old, new = events.where("seq < 2"), events.where("seq >= 2")
    full = {tuple(r) for r in R.fold_tags(events).collect()}
    compacted = {tuple(r) for r in R.fold_tags(R.compact_tag_events(old).unionByName(new)).collect()}
    assert compacted == full
    assert R.compact_tag_events(events).count() == events.select("model_version", "key").distinct().count()


def test_compacted_alias_log_keeps_current_aliases(spark):
    rows = [("m", "champion", "1", dt.datetime(2024, 1, 1), 0), ("m", "candidate", "2", dt.datetime(2024, 1, 2), 1),
            ("m", "champion", "2", dt.datetime(2024, 1, 3), 2), ("m", "candidate", None, dt.datetime(2024, 1, 3), 3),
            ("m", "candidate", "3", dt.datetime(2024, 1, 4), 4)]
    events = spark.createDataFrame(rows, R.ALIAS_EVENTS_DDL)
    old, new = events.where("seq < 4"), events.where("seq >= 4")
    full = {tuple(r) for r in R.current_aliases(events).collect()}
    assert full == {("m", "champion", "2"), ("m", "candidate", "3")}
    compacted = R.compact_alias_events(old)
    assert compacted.count() == 2
    assert {tuple(r) for r in R.current_aliases(compacted.unionByName(new)).collect()} == full


def test_gate_without_champion_gates_every_version(spark):
    from modelgate.fixed import NO_CHAMPION_REASON
    from modelgate.plans.gate import GateJob
    from modelgate.sources import adapters as A
    from modelgate.sources.tables import Tables

    t = Tables(spark, SF0001)
    job = GateJob(raw=A.raw_sales_with_predictions(t), predictions=A.prediction_columns(), model_name=A.MODEL_NAME,
                  alias_events=R.empty(spark, R.ALIAS_EVENTS_DDL))
    v = {r["model_version"]: r for r in job.verdicts.collect()}
    assert set(v) == {"1", "2", "3", "4"}
    for r in v.values():
        assert not r["has_champion"]
        assert NO_CHAMPION_REASON in r["reasons"]
        assert "champion_comparison_skipped" in r["checks_passed"]
        assert r["decision"] in ("PROMOTE", "MANUAL_REVIEW")
    reports = {r["model_version"]: r["report"] for r in job.reports.collect()}
    assert all("First model candidate — no incumbent baseline is available." in x for x in reports.values())


def test_scale_conf_partitions_grow_with_input_and_are_capped():
    from modelgate.session import scale_conf

    small = scale_conf(40 << 20, 8)
    assert small["spark.sql.shuffle.partitions"] == "16"
    tb = scale_conf(10 << 40, 1000)
    assert tb["spark.sql.shuffle.partitions"] == str(10 * 1024)
    assert scale_conf(10 << 40, 8000)["spark.sql.shuffle.partitions"] == "16000"  # two waves
    assert scale_conf(100 << 40, 8000)["spark.sql.shuffle.partitions"] == "32768"


def test_size_shuffle_partitions_only_raises(spark):
    from modelgate.session import input_bytes, size_shuffle_partitions
    from tests.conftest import SF0001

    assert input_bytes(spark, [SF0001]) > 0
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1000")
    try:
        assert size_shuffle_partitions(spark, [SF0001]) == 1000
        assert spark.conf.get("spark.sql.shuffle.partitions") == "1000"
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        got = size_shuffle_partitions(spark, [SF0001])
        assert got == 2 * spark.sparkContext.defaultParallelism
        assert spark.conf.get("spark.sql.shuffle.partitions") == str(got)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_registered_query_sizes_the_session_once_per_folder(spark):
    import __spark_entry__ as E
    from modelgate.plans import catalog
    from tests.conftest import SF0001

    run = E.queries()["split_summary"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    catalog._SIZED.clear()
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        run(spark, SF0001)
        assert spark.conf.get("spark.sql.shuffle.partitions") == str(2 * spark.sparkContext.defaultParallelism)
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        run(spark, SF0001)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "1"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_newest_versions_compare_as_numbers(spark):
    from modelgate.operators.ranking import newest_versions

    runs = spark.createDataFrame([("m", str(v)) for v in (1, 2, 9, 10, 11)], "model_name string, model_version string")
    got = newest_versions(runs, 3).orderBy("rank").collect()
    assert [r["model_version"] for r in got] == ["11", "10", "9"]


def test_rank_per_group_is_exact(spark):
    from modelgate.operators.common import rank_per_group

    rows = [(g, i % 7, i) for g in "ab" for i in range(50)] + [(None, 1, 1), (None, None, 2)]
    df = spark.createDataFrame(rows, "g string, v int, i int")
    got = {(r["g"], r["v"], r["i"]): r["n"] for r in rank_per_group(df, ["g"], "v", [F.col("i")], "n").collect()}
    for g in ("a", "b"):
        order = sorted((v, i) for x, v, i in rows if x == g)
        assert [got[g, v, i] for v, i in order] == list(range(1, 51))
    assert {got[None, None, 2], got[None, 1, 1]} == {1, 2}


def test_a_tasks_share_does_not_grow_with_the_input(spark, monkeypatch):
    from modelgate import session

    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for size in (1 << 30, 6 << 30, 60 << 30):
            spark.conf.set(names[0], "1")
            spark.conf.set(names[1], "128m")
            monkeypatch.setattr(session, "input_bytes", lambda *_, size=size: size)
            got = session.size_shuffle_partitions(spark, ["any"])
            assert size / got <= session.PARTITION_INPUT_BYTES == 32 << 20
            assert session._bytes_of(spark.conf.get(names[1])) == session.ADVISORY_BYTES
        assert [session._bytes_of(x) for x in ("64MB", "128m", "1024", "2g", "7b")] == [64 << 20, 128 << 20, 1024, 2 << 30, 7]
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def test_the_typed_table_is_dealt_to_more_partitions(spark, monkeypatch, tmp_path):
    from pyspark.sql import DataFrameWriter

    from modelgate.plans import gate
    from modelgate.plans.catalog import gate_job
    from modelgate.session import _bytes_of

    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    job = gate_job(spark, "/root/testdata/sf0.001")
    job.__dict__.pop("typed", None)
    before, seen, parquet = [spark.conf.get(n) for n in names], [], DataFrameWriter.parquet

    def told(self, *args, **kwargs):
        seen.append([spark.conf.get(n) for n in names])
        return parquet(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", told)
    rows = job.typed.count()
    assert int(seen[0][0]) == int(before[0]) * gate.TYPED_PARTITIONS and _bytes_of(seen[0][1]) == _bytes_of(before[1]) // gate.TYPED_PARTITIONS
    assert [spark.conf.get(n) for n in names] == before
    assert rows == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
