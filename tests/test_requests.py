"""Completion, validation and scenario rows of prediction requests."""

from parcelcast.operators import requests as rq
from parcelcast.schema import FEATURES, TABLE_BOUNDS

GOOD = dict(localidad="Kennedy", distancia_km=5.5, nivel_trafico=3.0, lluvia_mm=2.0, estrato=3, tipo_via="Calle",
            tipo_zona="Urbana", vehiculo="Moto", tiempo_estimado_min=15.0)
SCHEMA = ("localidad string, distancia_km double, nivel_trafico double, lluvia_mm double, estrato int, tipo_via string,"
          " tipo_zona string, vehiculo string, tiempo_estimado_min double")


def frame(spark, *changes):
    return spark.createDataFrame([tuple({**GOOD, **c}.values()) for c in changes], SCHEMA)


def test_ranges(spark):
    cases = [({}, []), (dict(distancia_km=0.1), ["distancia_km:range"]), (dict(distancia_km=50.0), ["distancia_km:range"]),
             (dict(nivel_trafico=0.0), ["nivel_trafico:range"]), (dict(nivel_trafico=6.0), ["nivel_trafico:range"]),
             (dict(nivel_trafico=2.5), ["nivel_trafico:integer"]), (dict(lluvia_mm=-1.0), ["lluvia_mm:range"]),
             (dict(lluvia_mm=101.0), ["lluvia_mm:range"]), (dict(lluvia_mm=100.0), []), (dict(estrato=0), ["estrato:range"]),
             (dict(estrato=7), ["estrato:range"]), (dict(tiempo_estimado_min=0.0), ["tiempo_estimado_min:range"]),
             (dict(tiempo_estimado_min=500.0), ["tiempo_estimado_min:range"]), (dict(localidad=None), ["localidad:required"]),
             (dict(lluvia_mm=None, estrato=None), []), (dict(distancia_km=float("nan")), ["distancia_km:range"])]
    checked = rq.validate_requests(frame(spark, *[c for c, _ in cases]))
    assert [r["violations"] for r in checked.collect()] == [v for _, v in cases]
    assert rq.accepted(checked).count() + rq.rejected(checked).count() == len(cases)
    assert rq.accepted(checked).count() == 3


def test_table_bounds_allow_levels_below_one(spark):
    rows = frame(spark, dict(nivel_trafico=0.5), dict(nivel_trafico=3.0)).drop("tiempo_estimado_min")
    bounds = [b for b in TABLE_BOUNDS if b[0] in rows.columns]
    assert [r["valid"] for r in rq.validate_requests(rows, bounds, ["localidad"]).collect()] == [True, False]


def test_completion(spark):
    rows = spark.createDataFrame([("a", None, None), ("b", 0.0, 20.0), ("c", 4.0, 20.0)],
                                 "id string, distancia_km double, tiempo_estimado_min double")
    got = {r["id"]: r for r in rq.complete_requests(rows, ["id"]).collect()}
    assert list(got["a"].asDict()) == ["id", *FEATURES]
    assert (got["a"]["distancia_km"], got["a"]["tiempo_estimado_min"], got["a"]["eficiencia_estimacion"]) == (5.0, 15.0, 3.0)
    assert (got["a"]["localidad"], got["a"]["anio"], got["a"]["nivel_trafico"]) == ("Kennedy", 2024, 2.0)
    assert got["b"]["eficiencia_estimacion"] == 0.0 and got["c"]["eficiencia_estimacion"] == 5.0


def test_completion_keeps_a_given_finite_efficiency(spark):
    rows = spark.createDataFrame([(7.0,), (float("inf"),), (float("nan"),)], "eficiencia_estimacion double")
    assert [r[0] for r in rq.complete_requests(rows).select("eficiencia_estimacion").collect()] == [7.0, 0.0, 3.0]


def test_scenario_rows_replace_zeros(spark):
    rows = spark.createDataFrame(
        [(0.0, 0.0, 0, None, 0.9, -1.0), (2.0, 30.0, 5, "Suba", 1.9, 4.0), (None, float("nan"), None, None, None, None)],
        "distancia_km double, tiempo_estimado_min double, estrato int, localidad string, zona_riesgo double,"
        " eficiencia_estimacion double")
    a, b, c = rq.scenario_features(rows, 2024, 2, 29, 3).collect()
    assert (a["distancia_km"], a["tiempo_estimado_min"], a["estrato"], a["localidad"]) == (5.0, 45.0, 3, "Kennedy")
    assert a["eficiencia_estimacion"] == 9.0 and a["zona_riesgo"] == 0 and a["intentos_entrega"] == 1
    assert (b["distancia_km"], b["estrato"], b["localidad"], b["zona_riesgo"]) == (2.0, 5, "Suba", 1)
    assert b["eficiencia_estimacion"] == 4.0
    assert (c["distancia_km"], c["tiempo_estimado_min"], c["eficiencia_estimacion"]) == (5.0, 45.0, 9.0)
    assert (a["anio"], a["mes"], a["dia"], a["dia_semana"]) == (2024, 2, 29, 3)


def test_unknown_zones(spark):
    rows = frame(spark, {}, dict(localidad="Atlantis"), dict(localidad="Atlantis"), dict(localidad=None))
    assert rq.unknown_zones(rows).collect() == [("Atlantis", 2)]
