import datetime as dt
import glob
import os
import threading

import pytest
from pyspark.sql import functions as F

from modelgate.operators import reports as K
from modelgate.sources import io as IO


# --- A7/A8 ------------------------------------------------------------------------
NESTED = (
    "id int, x double, at timestamp, day date, s struct<a:double,d:date,inner:struct<f:float>>, l array<double>, "
    "ls array<struct<v:double,t:timestamp>>, m map<int,array<double>>, md map<date,double>"
)


def nested(spark):
    nan, inf = float("nan"), float("inf")
    t, d = dt.datetime(2024, 5, 6, 7, 8, 9, 120000), dt.date(2024, 5, 6)
    rows = [
        (1, nan, t, d, (nan, d, (inf,)), [1.0, nan, None, -inf], [(nan, t), None], {1: [nan, 2.5], 2: None}, {d: nan}),
        (2, 1.5, None, None, None, None, None, None, None),
        (3, inf, t, d, (0.25, None, None), [], [], {}, {}),
    ]
    return spark.createDataFrame(rows, NESTED)


def test_nested_rows_become_json_safe_and_come_back(spark):
    back = "id int, x double, s struct<a:double,d:date,inner:struct<f:float>>, l array<double>, ls array<struct<v:double,t:timestamp>>, " \
           "m map<string,array<double>>, md map<string,double>, at timestamp, day date"
    df = nested(spark)
    records = IO.rows_to_json(df)
    assert records.where(F.col("record").contains("NaN") | F.col("record").contains("Infinity")).count() == 0
    got = {r["id"]: r for r in IO.json_to_rows(records, "record", back).collect()}
    t, d = dt.datetime(2024, 5, 6, 7, 8, 9, 120000), dt.date(2024, 5, 6)
    one = got[1]
    assert one["x"] is None and one["at"] == t and one["day"] == d
    assert one["s"]["a"] is None and one["s"]["d"] == d and one["s"]["inner"]["f"] is None
    assert one["l"] == [1.0, None, None, None] and one["ls"][0]["v"] is None and one["ls"][0]["t"] == t and one["ls"][1] is None
    assert one["m"] == {"1": [None, 2.5], "2": None} and one["md"] == {"2024-05-06": None}
    assert got[2]["s"] is None and got[2]["l"] is None and got[2]["m"] is None
    assert got[3]["x"] is None and got[3]["l"] == [] and got[3]["m"] == {} and got[3]["s"]["a"] == 0.25


def test_infinities_are_kept_on_request(spark):
    records = IO.rows_to_json(nested(spark), infinities="keep")
    got = {r["id"]: r for r in IO.json_to_rows(records, "record", "id int, x double, l array<double>").collect()}
    assert got[3]["x"] == float("inf") and got[1]["x"] is None
    assert got[1]["l"] == [1.0, None, None, float("-inf")]
    with pytest.raises(ValueError):
        IO.rows_to_json(nested(spark), infinities="maybe")


# --- A2 ---------------------------------------------------------------------------
def test_two_writers_make_one_snapshot(spark, tmp_path):
    raw = spark.range(50).withColumnRenamed("id", "n")
    out, errors = [], []

    def write():
        try:
            out.append(IO.materialize_snapshot(spark, raw, str(tmp_path), "sales/2024", "test").collect())
        except Exception as exc:  # noqa: BLE001
            errors.append(exc)

    threads = [threading.Thread(target=write) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    assert len({r[0]["path"] for r in out}) == 1
    assert IO.read_manifest(spark, str(tmp_path / "manifest")).count() == 1
    forced = IO.materialize_snapshot(spark, raw.limit(5), str(tmp_path), "sales/2024", "test", force=True).first()
    assert forced["record_count"] == 5 and forced["path"] != out[0][0]["path"]
    assert IO.materialize_snapshot(spark, raw, str(tmp_path), "sales/2024", "test").first()["path"] == forced["path"]
    other = IO.materialize_snapshot(spark, raw, str(tmp_path), "sales", "test").first()
    assert other["record_count"] == 50
    assert IO.read_manifest(spark, str(tmp_path / "manifest")).count() == 3


def test_a_torn_write_is_not_seen(spark, tmp_path):
    os.makedirs(tmp_path / "pending" / "half" / "_temporary")
    (tmp_path / "pending" / "half" / "part-0.parquet").write_bytes(b"PAR1")
    row = IO.materialize_snapshot(spark, spark.range(3), str(tmp_path), "a", "test").first()
    assert row["record_count"] == 3
    assert IO.read_manifest(spark, str(tmp_path / "manifest")).count() == 1


# --- A5 ---------------------------------------------------------------------------
def test_evaluation_files_follow_the_rows_not_the_versions(spark, tmp_path):
    scored = spark.range(6_000).select(
        F.lit("m").alias("model_name"), (F.col("id") % 200).cast("string").alias("model_version"),
        F.lit("test").alias("split"), F.col("id").cast("double").alias("prediction"),
    )
    hot = scored.withColumn("model_version", F.lit("1"))
    for name, df in (("many", scored), ("hot", hot)):
        paths = IO.persist_evaluation(df, df.limit(0), df.limit(10), str(tmp_path / name), file_rows=1_000)
        files = glob.glob(paths["scored"] + "/*.parquet")
        assert 2 <= len(files) <= 6
        assert len(glob.glob(paths["segments"] + "/*.parquet")) == 1
        back = spark.read.parquet(paths["scored"])
        assert back.count() == 6_000 and set(back.columns) == set(df.columns)
        per_file = back.groupBy(F.input_file_name()).count().collect()
        assert max(r["count"] for r in per_file) < 3_000
        assert spark.read.parquet(paths["overall"]).count() == 0


# --- A10 --------------------------------------------------------------------------
def test_packets_old_broken_and_incomplete(spark, tmp_path):
    lines = [
        '{"model_name":"m","model_version":"1","status":"pending_review","policy_verdict":{"decision":"PROMOTE","reasons":["a","b"]}}',
        '{"registration":{"model_name":"m","model_version":"2","run_id":"r"},"policy_verdict":{"decision":"REJECT"},"extra":1}',
        '{"model_name":"m","model_version":"3"}',
        '{"model_name":"m","model_ver',
        '{"policy_verdict":{"decision":"REJECT"}}',
        '{"model_name":"m","model_version":"4","candidate_metrics":{"rmse":"not a number"},"policy_verdict":{"decision":"REJECT"}}',
    ]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.json").write_text("\n".join(lines[:4]) + "\n")
    (tmp_path / "p" / "b.json").write_text("\n".join(lines[4:]) + "\n")
    got = IO.read_handoff_checked(spark, str(tmp_path / "p"))
    rows = {(r["model_version"], r["evidence_error"]) for r in got.collect()}
    assert rows == {("1", None), ("2", None), ("3", IO.PACKET_WITHOUT_VERDICT), (None, IO.PACKET_UNREADABLE),
                    (None, IO.PACKET_WITHOUT_MODEL), ("4", IO.PACKET_UNREADABLE)}
    first = got.where("model_version = '1'").first()
    assert first["created_at"] is None and first["registration"] is None and first["policy_verdict"]["reasons"] == ["a", "b"]
    assert got.where("evidence_error is null").select("policy_verdict.decision").count() == 2


# --- F7/K9 ------------------------------------------------------------------------
MESSAGES = "conv_id int, pos int, type string, content string, tool_calls array<struct<id:string,name:string,args:map<string,int>>>, tool_call_id string, name string"


def test_tool_names_and_arguments(spark):
    rows = [
        (1, 0, "ai", "", [("c", "first", {"n": 1}), ("d", "other", None), ("", "blank", None)], None, None),
        (1, 1, "tool", "r1", None, "c", None),
        (1, 2, "ai", "", [("c", "second", {}), ("c", "third", {"n": 3}), ("c", None, None)], None, None),
        (1, 3, "tool", "r2", None, "c", None),
        (1, 4, "tool", "r3", None, "c", "own"),
        (1, 5, "tool", "r4", None, None, None),
        (1, 6, "tool", "r5", None, "unknown", None),
        (2, 0, "tool", "early", None, "c", None),
        (2, 1, "ai", "", [("c", "late", None)], None, None),
    ]
    ev = K.trace_events(spark.createDataFrame(rows, MESSAGES)).collect()
    results = {(r["conv_id"], r["message_index"]): (r["tool_call_id"], r["tool_name"], r["content"]) for r in ev if r["event"] == "tool_result"}
    assert results == {
        (1, 1): ("c", "first", "r1"), (1, 3): ("c", "third", "r2"), (1, 4): ("c", "own", "r3"), (1, 5): (None, None, "r4"),
        (1, 6): ("unknown", None, "r5"), (2, 0): ("c", None, "early"),
    }
    calls = sorted((r["conv_id"], r["message_index"], r["k"], r["tool_call_id"], r["tool_name"], r["tool_args"]) for r in ev if r["event"] == "tool_call")
    assert calls[0] == (1, 0, 0, "c", "first", '{"n":1}') and calls[2][3:] == (None, "blank", None)
    assert len(calls) == 7
    assert K.trace_events(spark.createDataFrame([], MESSAGES)).count() == 0


def test_a_call_id_used_often_costs_its_rows_only(spark):
    n = 30_000
    call = F.when(F.col("id") % 2 == 0, F.array(F.struct(F.lit("c").alias("id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("name"))))
    m = spark.range(n).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("pos"), F.when(F.col("id") % 2 == 1, F.lit("tool")).otherwise(F.lit("ai")).alias("type"),
        F.lit("x").alias("content"), call.alias("tool_calls"), F.when(F.col("id") % 2 == 1, F.lit("c")).alias("tool_call_id"),
        F.lit(None).cast("string").alias("name"),
    )
    ev = K.trace_events(m)
    assert ev.count() == n
    wrong = ev.where((F.col("event") == "tool_result") & (F.col("tool_name") != F.concat(F.lit("t"), (F.col("message_index") - 1).cast("string"))))
    assert wrong.count() == 0
    assert "Join" not in ev._jdf.queryExecution().optimizedPlan().toString()
