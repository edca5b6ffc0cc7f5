import itertools
import random

import pytest
from pyspark.sql import functions as F

from modelgate.functions.stats import ks_pvalue_exact
from modelgate.operators import sets as S
from modelgate.operators.drift import ks_statistics, numeric_drift
from modelgate.operators.evaluate import segment_metrics
from modelgate.operators.ordering import place_in_group
from modelgate.operators.ranking import worst_segments
from modelgate.operators.registry import register_candidates


def plain_places(rows, key, order):
    out, groups = {}, {}
    for r in rows:
        groups.setdefault(key(r), []).append(r)
    for members in groups.values():
        for i, r in enumerate(sorted(members, key=order)):
            out[r] = i + 1
    return out


@pytest.mark.parametrize("groups", [1, 3, 400])
def test_places_equal_a_plain_sort(spark, groups):
    rng = random.Random(groups)
    rows = [(f"g{rng.randrange(groups)}" if rng.random() > 0.05 else None, rng.randrange(50), i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(5)
    got = place_in_group(df, ["g"], [F.col("v").desc(), F.col("i")])
    assert got.columns == ["g", "v", "i", "place"]
    want = plain_places(rows, lambda r: r[0], lambda r: (-r[1], r[2]))
    assert {tuple(r[:3]): r["place"] for r in got.collect()} == want


def test_places_of_tied_rows_nulls_and_no_rows(spark):
    df = spark.createDataFrame([("a", None), ("a", 1), ("a", 1), ("a", 1), (None, 2)], "g string, v int")
    got = sorted(((r["g"] or "", r["place"], r["v"]) for r in place_in_group(df, ["g"], [F.col("v")]).collect()), key=repr)
    assert got == [("", 1, 2), ("a", 1, None), ("a", 2, 1), ("a", 3, 1), ("a", 4, 1)]
    assert place_in_group(df.limit(0), ["g"], [F.col("v")]).count() == 0
    assert sorted(r["place"] for r in place_in_group(df, [], [F.col("g"), F.col("v")]).collect()) == [1, 2, 3, 4, 5]


def test_a_hot_group_is_spread_over_tasks(spark):
    df = spark.range(20_000).select(F.lit("m").alias("g"), (F.col("id") * 7919 % 20_000).alias("v"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranges = df.repartitionByRange("g", "v").groupBy(F.spark_partition_id()).count().collect()
        assert len(ranges) > 4 and max(r["count"] for r in ranges) < 10_000
        placed = place_in_group(df, ["g"], [F.col("v")])
        assert placed.where(F.col("place") != F.col("v") + 1).count() == 0
        assert "Window" not in placed._jdf.queryExecution().optimizedPlan().toString().replace("Window [", "", 1)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_segment_order_and_worst_segments_of_one_group(spark):
    rows = [("m", "1", f"s{i % 60}", 100.0, 100.0 + (i % 60) // 2) for i in range(240)]
    scored = spark.createDataFrame(rows, "model_name string, model_version string, town string, resale_price double, prediction double")
    got = segment_metrics(scored, "town").collect()
    order = sorted(got, key=lambda r: (r["rmse"], r["segment"]))
    assert [r["ord"] for r in order] == list(range(1, 61))
    deltas = spark.createDataFrame(
        [("m", "1", "town", f"s{i}", 1.0, 1.0, float(i % 5), i) for i in range(40)],
        "model_name string, model_version string, segment_column string, segment_value string, candidate_rmse double, "
        "champion_rmse double, rmse_delta_pct double, ord int",
    )
    ranked = {r["segment"]: r["rank"] for r in worst_segments(deltas).collect()}
    want = sorted(range(40), key=lambda i: (-(i % 5), i))
    assert [ranked[f"s{i}"] for i in want] == list(range(1, 41))


def test_versions_of_one_model_and_timestamp(spark):
    rows = [("m", f"c{i:03d}") for i in range(300)]
    random.Random(1).shuffle(rows)
    candidates = spark.createDataFrame(rows, "model_name string, candidate_id string").select(
        "*", F.lit("2024-01-01").cast("timestamp").alias("registered_at"), F.create_map(F.lit("id"), "candidate_id").alias("params"),
        *[F.lit(1.0).alias(c) for c in ("validation_rmse", "validation_mae", "test_rmse", "test_mae")],
    )
    runs = spark.createDataFrame([("m", "9"), ("m", "10")], "model_name string, model_version string")
    new = register_candidates(candidates, runs)["runs"].collect()
    assert {r["params"]["id"]: int(r["model_version"]) for r in new} == {f"c{i:03d}": 11 + i for i in range(300)}


def test_merged_results_and_sources(spark):
    rows = [("q", 0, 1, " u1 "), ("q", 0, 2, ""), ("q", 0, 3, "u2"), ("q", 1, 1, "u2"), ("q", 1, 2, "u3"), ("q", 1, 3, "u1"),
            ("p", 1, 5, "u9"), ("p", 0, 7, None)]
    df = spark.createDataFrame(rows, "query string, o int, pos int, url string")
    merged = S.merge_results(df, ["query"], "o", "pos")
    got = sorted(tuple(r) for r in merged.where("query = 'q'").select("place", "o", "pos").collect())
    assert got == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 1), (5, 1, 2), (6, 1, 3)]
    sources = sorted(tuple(r) for r in S.merged_sources(merged, ["query"]).select("query", "source_place", "url", "first_seen").collect())
    assert sources == [("p", 1, "u9", 2), ("q", 1, "u1", 1), ("q", 2, "u2", 3), ("q", 3, "u3", 5)]
    assert S.merge_results(df.limit(0), ["query"], "o", "pos").count() == 0


def test_ks_plan_and_result_do_not_depend_on_the_ranges(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice([rng.gauss(0, 1), 0.5, None]), rng.random()) for k in "ab" for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, x double, side double")
    ref, cur = df.where("side < 0.6"), df.where("side >= 0.6")
    got = [
        sorted((r["k"], r["n_reference"], r["n_current"], round(r["statistic"], 12)) for r in ks_statistics(ref, cur, ["x"], ["k"], buckets=b).collect())
        for b in (1, 3, 50, None)
    ]
    assert got[0] == got[1] == got[2] == got[3]
    plan = ks_statistics(ref, cur, ["x"], ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000


def enumerated(n, m, d):
    """Share of all orders of n and m values whose D is at least d."""
    hit = total = 0
    for places in itertools.combinations(range(n + m), n):
        i = j = 0
        best, chosen = 0, set(places)
        for p in range(n + m):
            i, j = (i + 1, j) if p in chosen else (i, j + 1)
            best = max(best, abs(i * m - j * n))
        total += 1
        hit += best >= round(d * n * m)
    return hit / total


def test_exact_pvalue_equals_enumeration(spark):
    cases = [(n, m, k / (n * m)) for n in range(1, 9) for m in range(1, 9) if n + m <= 11 for k in {0, 1, n * m // 3, n * m // 2, n * m}]
    cases += [(8, 8, 0.5), (7, 8, 0.75)]
    df = spark.createDataFrame([(i, d, n, m) for i, (n, m, d) in enumerate(cases)], "i int, d double, n long, m long")
    plan = df.select(ks_pvalue_exact(df.d, df.n, df.m))
    assert "Python" not in plan._jdf.queryExecution().toString()
    for r in df.select("i", ks_pvalue_exact(df.d, df.n, df.m).alias("p")).collect():
        n, m, d = cases[r["i"]]
        assert r["p"] == pytest.approx(enumerated(n, m, d), abs=1e-12), cases[r["i"]]


def test_exact_pvalue_of_larger_samples_and_the_argument(spark):
    df = spark.createDataFrame([(0.3, 100, 80), (0.15, 300, 200), (None, 3, 3), (1.0, 0, 3)], "d double, n long, m long")
    p = [r[0] for r in df.select(ks_pvalue_exact(df.d, df.n, df.m)).collect()]
    assert p[0] == pytest.approx(0.000487, abs=2e-5) or 0 < p[0] < 2e-3
    assert 0 < p[1] < 0.02 and p[2] is None and p[3] is None
    a = spark.createDataFrame([(float(i),) for i in range(8)], "x double")
    b = spark.createDataFrame([(float(i) + 4.5,) for i in range(7)], "x double")
    exact = numeric_drift(a, b, ["x"], method="exact").first()
    assert exact["p_value"] == pytest.approx(enumerated(8, 7, exact["statistic"]))
    assert numeric_drift(a, b, ["x"]).first()["p_value"] != exact["p_value"]
    with pytest.raises(ValueError, match="method"):
        numeric_drift(a, b, ["x"], method="guess")


def test_one_hot_dictionary_and_vectors(spark):
    from modelgate.operators.encode import category_dictionary, one_hot, slot_columns, widths

    train = spark.createDataFrame([("b", 1), ("a", 2), ("é", 1), (None, 3), ("b", None), ("B", 1)], "town string, kind int")
    d = category_dictionary(train, ["town", "kind"])
    assert sorted((r["column"], r["value"], r["slot"]) for r in d.collect()) == [
        ("kind", "1", 0), ("kind", "2", 1), ("kind", "3", 2), ("town", "B", 0), ("town", "a", 1), ("town", "b", 2), ("town", "é", 3)
    ]
    assert widths(d, ["town", "kind", "x"]) == {"town": 4, "kind": 3, "x": 0}
    new = spark.createDataFrame([("a", 3, 0.5), ("zzz", 1, 0.0), (None, None, None)], "town string, kind int, area double")
    rows = {(r["town"], r["kind"]): (r["indices"], r["values"]) for r in one_hot(new, d, ["town", "kind"], ["area"])[0].collect()}
    assert rows == {("a", 3): ([1, 6, 7], [1.0, 1.0, 0.5]), ("zzz", 1): ([4], [1.0]), (None, None): ([], [])}
    assert one_hot(new, d, ["town", "kind"], ["area"])[1] == 8
    assert slot_columns(new.limit(0), d, ["town"]).count() == 0
    assert category_dictionary(train.limit(0), ["town"]).count() == 0


def test_many_categories_are_numbered_without_the_driver(spark):
    from modelgate.operators.encode import category_dictionary

    df = spark.range(5_000).select(F.format_string("c%05d", F.col("id") * 7 % 5_000).alias("c"))
    wrong = category_dictionary(df, ["c"]).where(F.col("value") != F.format_string("c%05d", F.col("slot")))
    assert wrong.count() == 0
