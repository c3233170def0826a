"""Rank selection against sorting in memory, on distributions that defeat simple bucketing."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from parcelcast.operators import order
from parcelcast.operators.ranks import exact_quantiles, keys_at_ranks, order_statistics


def frame(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


DISTRIBUTIONS = {
    "uniform": [float(i) for i in range(500)],
    "one value": [7.5] * 300,
    "a third equal": [1.0] * 200 + [float(i) for i in range(400)],
    "exponents": [10.0 ** (i % 40 - 20) * (-1) ** i for i in range(300)],
    "extremes": [1.7e308, -1.7e308, 0.0, 5e-324, 1.0, -1.0] * 20,
    "neighbours": [1.0, np.nextafter(1.0, 2.0), np.nextafter(1.0, 0.0)] * 40,
}


@pytest.mark.parametrize("name", DISTRIBUTIONS)
def test_values_at_ranks(spark, name):
    values = sorted(float(v) for v in DISTRIBUTIONS[name])
    random.Random(1).shuffle(DISTRIBUTIONS[name])
    wanted = sorted({0, 1, len(values) // 3, len(values) // 2, len(values) - 1})
    sizes, found = order_statistics(frame(spark, map(float, DISTRIBUTIONS[name])), ["x"], lambda g, n: wanted,
                                    fine_rows=3, buckets=8)
    assert sizes == {("x",): len(values)}
    assert {f.rank: f.value for f in found} == {r: values[r] for r in wanted}
    for f in found:
        assert f.below == sum(v < f.value for v in values)
        assert f.equal == sum(v == f.value for v in values)


def test_values_at_ranks_of_long_integers(spark):
    values = [-(2 ** 63), 2 ** 63 - 1, 0, 1, 2, 3, 2 ** 62, -(2 ** 62), 2 ** 53 + 1, 2 ** 53, 2 ** 53 + 2] * 3
    wanted = list(range(len(values)))
    _, found = order_statistics(frame(spark, values, "bigint"), ["x"], lambda g, n: wanted, fine_rows=1, buckets=4)
    assert [f.value for f in sorted(found, key=lambda f: f.rank)] == sorted(values)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=60))
def test_quantiles_match_numpy(spark, values):
    got = exact_quantiles(frame(spark, values), ["x"], [0.0, 0.25, 0.5, 0.9, 1.0], fine_rows=4, buckets=4)[("x",)]
    for p, v in got.items():
        assert v == pytest.approx(np.quantile(values, p), rel=1e-9, abs=1e-9)


def test_quantiles_by_group_skip_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), ("b", 5.0), (None, 9.0), ("c", None)],
                               "g string, x double")
    got = exact_quantiles(df, ["x"], [0.5], by=["g"])
    assert got == {("x", "a"): {0.5: 2.0}, ("x", "b"): {0.5: 5.0}, ("x", None): {0.5: 9.0}}


def test_quantiles_of_nothing(spark):
    assert exact_quantiles(frame(spark, []), ["x"], [0.5]) == {}


def rows_with_hot_times(n=600, seed=3):
    """Two thirds of all rows share one timestamp, and a third one timestamp and order."""
    rng = random.Random(seed)
    hot, rows = dt.datetime(2024, 1, 2, 5), []
    for i in range(n):
        ts = hot if i % 3 else dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(4000))
        a = 1 if i % 3 == 1 else rng.randrange(5)
        rows.append((ts, a, i, float(rng.randrange(100)), float(rng.randrange(100))))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("fine", [1, 20, 100_000])
def test_cut_with_hot_times(spark, kind, fine):
    rows = rows_with_hot_times()
    df = spark.createDataFrame(rows, "ts timestamp_ntz, a int, b bigint, tiempo_estimado_min double, tiempo_real_min double")
    df = df.withColumn("ts", F.col("ts").cast(kind))
    cut = order.temporal_cut(df, ["ts", "a", "b"], fine_rows=fine)
    assert (cut.rows_before, cut.rows) == (480, 600)
    expected = {r[2] for r in sorted(rows)[:480]}
    assert {r["b"] for r in cut.before(df).collect()} == expected
    assert {r["b"] for r in cut.after(df).collect()} == {r[2] for r in rows} - expected
    labels = {r["b"]: r["split"] for r in order.temporal_split(df, cut).collect()}
    assert {b for b, s in labels.items() if s == "train"} == expected


@pytest.mark.parametrize("n", [600, 607, 7])
def test_segments_with_hot_times(spark, n):
    rows = rows_with_hot_times(n)
    df = spark.createDataFrame(rows, "ts timestamp_ntz, a int, b bigint, tiempo_estimado_min double, tiempo_real_min double")
    got = {r["segment"]: r["mean_abs_error"]
           for r in order.error_evolution(df, ["ts", "a", "b"], fine_rows=5).collect()}
    errors = [abs(r[4] - r[3]) for r in sorted(rows)]
    size = max(1, n // 10)
    expected = [np.mean(errors[i:i + size]) for i in range(0, n, size)][:10]
    assert [got[i] for i in sorted(got)] == pytest.approx(expected)


def test_published_split_sizes(spark):
    df = spark.range(52_585).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.col("id").alias("k"))
    cut = order.temporal_cut(df, ["ts", "k"])
    assert (cut.rows_before, cut.after(df).count()) == (42_068, 10_517)


@pytest.mark.parametrize("fine", [1, 1000])
def test_equal_keys_at_the_cut_are_refused(spark, fine):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1)] * 10, "ts timestamp_ntz, k int")
    with pytest.raises(ValueError, match="unique"):
        order.temporal_cut(df, ["ts", "k"], fine_rows=fine)


def test_rows_without_time_come_last(spark):
    rows = [(dt.datetime(2024, 1, 1 + i) if i < 9 else None, i) for i in range(10)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, k int")
    cut = order.temporal_cut(df, ["ts", "k"])
    assert sorted(r["k"] for r in cut.after(df).collect()) == [8, 9]


def test_empty_table_has_no_validation_rows(spark):
    df = spark.createDataFrame([], "ts timestamp, k int")
    cut = order.temporal_cut(df, ["ts", "k"])
    assert cut.rows == 0 and cut.after(df).count() == 0 and cut.before(df).count() == 0


def test_text_keys_are_refused(spark):
    with pytest.raises(TypeError):
        keys_at_ranks(spark.createDataFrame([("a",)], "k string"), ["k"], lambda n: [0])


def test_many_days_fall_back_to_numeric_buckets(spark, monkeypatch):
    from parcelcast.operators import ranks

    monkeypatch.setattr(ranks, "MAX_GROUPS", 50)
    df = spark.range(400).select(F.timestamp_seconds(F.col("id") * 86_400 * 3).alias("ts"), F.col("id").alias("k"))
    assert order.temporal_cut(df, ["ts", "k"], fine_rows=10).first[1] == 320
    with pytest.raises(ValueError, match="groups"):
        exact_quantiles(df.withColumn("x", F.col("k") * 1.0), ["x"], [0.5], by=["k"])


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_cut_does_not_depend_on_the_session_zone(spark, kind):
    rows = rows_with_hot_times(90)
    schema = "ts timestamp_ntz, a int, b bigint, tiempo_estimado_min double, tiempo_real_min double"
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast(kind)).persist()
    df.count()
    expected = {r["b"] for r in order.temporal_cut(df, ["ts", "a", "b"]).before(df).collect()}
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Bogota")
        got = {r["b"] for r in order.temporal_cut(df, ["ts", "a", "b"]).before(df).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        df.unpersist()
    assert got == expected and len(got) == 72


def test_values_that_are_not_finite(spark):
    odd = F.when(F.col("id") == 5, float("inf")).when(F.col("id") == 6, float("-inf")).when(F.col("id") == 7, float("nan"))
    df = spark.range(30_000).select(odd.when(F.col("id") == 8, None).otherwise(F.col("id") * 1.5).alias("x"))
    got = exact_quantiles(df, ["x"], [0.0, 0.5, 1.0])[("x",)]
    rest = sorted([i * 1.5 for i in range(30_000) if i not in (5, 6, 7, 8)] + [float("inf"), float("-inf")])
    assert got[0.0] == float("-inf") and got[1.0] == float("inf")
    assert got[0.5] == (rest[len(rest) // 2 - 1] + rest[len(rest) // 2]) / 2


@pytest.mark.parametrize("fine_rows", [20_000, 5])
@pytest.mark.parametrize("timed, key", [("true", "if(id % 3 = 0, null, id % 7)"), ("id % 10 > 3", "if(id % 3 = 0, double('nan'), double('inf'))")])
def test_missing_keys_split_exactly(spark, fine_rows, timed, key):
    rows = spark.range(100).selectExpr(f"if({timed}, timestamp'2024-01-01', null) as t", f"{key} as k", "id as row_id")
    cut = order.temporal_cut(rows, ["t", "k", "row_id"], fine_rows=fine_rows)
    counts = {r["split"]: r["count"] for r in order.temporal_split(rows, cut).groupBy("split").count().collect()}
    assert counts == {"train": 80, "validation": 20}
    assert (cut.before(rows).count(), cut.after(rows).count()) == (80, 20)


def test_closer_passes_use_hash_aggregates(spark):
    df = spark.range(50_000).selectExpr("double(id * id % 99991) as x")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    plans = []
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        collect = type(df).collect

        def kept(self):
            plans.append(self._jdf.queryExecution().executedPlan().toString())
            return collect(self)

        type(df).collect = kept
        exact_quantiles(df, ["x"], [0.5])
    finally:
        type(df).collect = collect
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(plans) > 1 and not any("SortAggregate" in p for p in plans)
