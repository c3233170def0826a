"""Registry operators on the published metric table."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from parcelcast.operators import kpi, registry as reg
from parcelcast.session import scratch_path
from parcelcast.sources.registry import read_registry, update_registry

PUBLISHED = [
    ("Linear Regression", 3.982522211604906, 24.76643979610383, 4.976589172927963, 0.0709015149797724, 42068, 10517),
    ("GLM (Gamma, log-link)", 4.162346981732474, 27.609299775508475, 5.25445523108804, 0.0737716613873419, 42068, 10517),
    ("HistGradientBoosting", 4.021348149402483, 25.31622024996556, 5.03152265720483, 0.0714628779931954, 42068, 10517),
    ("XGBoost", 4.104561923600365, 26.363025254656463, 5.134493670719292, 0.07284941257760585, 42068, 10517),
]
COLUMNS = "model_name string, MAE double, MSE double, RMSE double, MAPE double, n_train long, n_validation long"


def raw(spark, rows):
    numbered = [(*r, i) for i, r in enumerate(rows)]
    return spark.createDataFrame(numbered, COLUMNS + ", ord long")


def test_confidence_of_the_published_models(spark):
    got = reg.kpis_confidence(reg.load_registry(raw(spark, PUBLISHED))).first()
    assert got["n_models"] == 4 and got["best_model"] == "linear"
    assert got["mae_global"] == pytest.approx(4.067694816585057, abs=1e-12)
    assert got["rmse_global"] == pytest.approx(5.0992651829850315, abs=1e-12)
    assert got["mape_global"] == pytest.approx(7.224636673447889, abs=1e-12)
    assert got["precision_global"] == pytest.approx(92.77536332655211, abs=1e-12)
    assert got["score_confianza"] == pytest.approx(92.04765010183203, abs=1e-10)
    assert got["best_rmse"] == 4.976589172927963


def test_file_round_trip(spark):
    path = scratch_path(spark, "registry")
    spark.createDataFrame(PUBLISHED, COLUMNS).coalesce(1).write.option("header", True).csv(path)
    got = reg.load_registry(read_registry(spark, path)).orderBy("ord").collect()
    assert [r["model_name"] for r in got] == ["linear", "glm", "histgb", "xgboost"]
    assert got[3]["mape"] == 0.07284941257760585


def test_file_is_updated_in_place(spark):
    path = scratch_path(spark, "registry")
    for row in PUBLISHED:
        update_registry(spark, path, spark.createDataFrame([row], COLUMNS))
    better = ("GLM (Gamma, inverse-link)", 4.0, 25.0, 5.0, 0.07, 42068, 10517)
    update_registry(spark, path, spark.createDataFrame([better], COLUMNS), contains="GLM")
    rows = read_registry(spark, path).orderBy("ord").collect()
    assert [r["model_name"] for r in rows] == ["Linear Regression", "HistGradientBoosting", "XGBoost", better[0]]
    assert rows[0]["MSE"] == 24.76643979610383


def test_writers_at_the_same_time_lose_no_row(spark):
    path = scratch_path(spark, "registry")
    rows = [(f"Model {i}", float(i), 1.0, 1.0, 1.0, 1, 1) for i in range(12)]
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda r: update_registry(spark, path, spark.createDataFrame([r], COLUMNS)), rows))
    got = read_registry(spark, path).orderBy("ord").collect()
    assert sorted((r["model_name"], r["MAE"]) for r in got) == sorted(r[:2] for r in rows)
    assert [r["ord"] for r in got] == list(range(12))


def test_updates_replay_in_order(spark):
    path = scratch_path(spark, "registry")
    first = [("A", 1.0, 1.0, 1.0, 1.0, 1, 1), ("B x", 2.0, 1.0, 1.0, 1.0, 1, 1), (None, 3.0, 1.0, 1.0, 1.0, 1, 1)]
    update_registry(spark, path, spark.createDataFrame(first, COLUMNS))
    update_registry(spark, path, spark.createDataFrame([("A", 4.0, 1.0, 1.0, 1.0, 1, 1)], COLUMNS))
    update_registry(spark, path, spark.createDataFrame([], COLUMNS), contains="x")      # only takes away
    update_registry(spark, path, spark.createDataFrame([("B x", 5.0, 1.0, 1.0, 1.0, 1, 1)], COLUMNS))
    got = read_registry(spark, path).orderBy("ord").collect()
    assert [(r["model_name"], r["MAE"]) for r in got] == [(None, 3.0), ("A", 4.0), ("B x", 5.0)]


def test_a_plain_file_is_not_written_into(spark):
    path = scratch_path(spark, "registry")
    spark.createDataFrame(PUBLISHED, COLUMNS).coalesce(1).write.option("header", True).csv(path)
    with pytest.raises(ValueError, match="plain CSV"):
        update_registry(spark, path, spark.createDataFrame(PUBLISHED[:1], COLUMNS))


def test_empty_registry(spark):
    empty = reg.load_registry(raw(spark, []))
    assert tuple(reg.kpis_confidence(empty).first()) == (0, 0.0, 0.0, 0.0, 0.0, "N/A", 0.0, 0.0)
    assert tuple(reg.best_model(empty).first()) == ("linear", 0.0)


def test_duplicates_and_unknown_names(spark):
    rows = [PUBLISHED[1], ("My Forest", 1.0, 1.0, 1.0, 1.0, 1, 1), (("glm v2"), 9.0, 9.0, 9.0, 9.0, 9, 9)]
    got = reg.load_registry(raw(spark, rows)).orderBy("ord").collect()
    assert [(r["model_name"], r["mae"]) for r in got] == [("glm", 9.0), ("my forest", 1.0)]


def test_ties_go_to_the_earlier_model(spark):
    rows = [("b", 1.0, 1.0, 2.0, 1.0, 1, 1), ("a", 1.0, 1.0, 2.0, 1.0, 1, 1)]
    table = reg.load_registry(raw(spark, rows))
    assert reg.best_model(table).first()["best_model"] == "b"
    assert [r["model_name"] for r in reg.model_comparison(table).orderBy("rank").collect()] == ["b", "a"]


def test_upsert_replaces_by_name_or_by_text(spark):
    table = spark.createDataFrame(PUBLISHED, COLUMNS)
    fresh = spark.createDataFrame([("XGBoost", 1.0, 1.0, 1.0, 1.0, 1, 1)], COLUMNS)
    got = {r["model_name"]: r["MAE"] for r in reg.registry_upsert(table, fresh).collect()}
    assert len(got) == 4 and got["XGBoost"] == 1.0
    other = spark.createDataFrame([("GLM (inverse)", 2.0, 1.0, 1.0, 1.0, 1, 1)], COLUMNS)
    names = [r["model_name"] for r in reg.registry_upsert(table, other, contains="GLM").collect()]
    assert sorted(names) == ["GLM (inverse)", "HistGradientBoosting", "Linear Regression", "XGBoost"]


def test_kpis_of_an_unregistered_model(spark):
    rows = spark.createDataFrame([(50.0,), (70.0,)], "tiempo_real_min double")
    table = reg.load_registry(raw(spark, PUBLISHED))
    known = kpi.kpis_actual(rows, table, "glm").first()
    assert known["rmse"] == 5.25445523108804 and known["otif"] == 50.0
    unknown = kpi.kpis_actual(rows, table, "other").first()
    assert (unknown["mae"], unknown["rmse"], unknown["mape"]) == (0.0, 0.0, 0.0)
    assert kpi.flashcards(rows, table, "other").count() == 4


def test_metrics_with_a_zero_label(spark):
    rows = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0)], "tiempo_real_min double, p double")
    got = kpi.regression_metrics(rows, "p").first()
    assert (got["mae"], got["mse"], got["rmse"], got["n_validation"]) == (1.0, 1.0, 1.0, 2)
    assert got["mape"] == pytest.approx((1 / 2.220446049250313e-16 + 0.5) / 2)
    assert rows.limit(0).transform(lambda d: kpi.regression_metrics(d, "p")).where(F.col("mae").isNull()).count() == 1
