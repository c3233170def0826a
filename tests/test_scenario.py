"""Projected month against a plain Python computation."""

import calendar
import datetime as dt
import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from parcelcast.functions.columns import date_features
from parcelcast.operators import scenario as sc
from parcelcast.plans import pages


def pool(spark, n, days, same_hash=False):
    """``n`` deliveries spread over the given dates."""
    rows = [(i, days[i % len(days)], f"Z{i % 9}", 1.0 + i % 6, 0.2 + (i % 8) / 10, 40.0 + i % 45, 30.0 + i % 9,
             "0" * 32 if same_hash else hashlib.md5(str(i).encode()).hexdigest()) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, fecha_pedido timestamp, localidad string, distancia_km double,"
                                     " nivel_trafico double, tiempo_real_min double, tiempo_estimado_min double, row_hash string")
    more = dict(tipo_via=F.lit("Local"), tipo_zona=F.lit("x"), vehiculo=F.lit("Moto"), estrato=F.lit(3), lluvia_mm=F.lit(0.0),
                pendiente_promedio=F.lit(1.0), zona_riesgo=F.lit(0.0), cliente_ausente=F.lit(0), intentos_entrega=F.lit(1))
    return date_features(df.withColumns(more)), rows


def expected_days(rows, year, month):
    by_dow = defaultdict(list)
    for r in rows:
        by_dow[r[1].weekday()].append(r)
    everything = sorted(rows, key=lambda r: r[7])
    mean = max(sum(map(len, by_dow.values())) / len(by_dow), 1.0)
    base = max(round(len(rows) / max(len({r[1].day for r in rows}), 1)), 40)
    seen, out = Counter(), {}
    for day in range(1, calendar.monthrange(year, month)[1] + 1):
        dow = dt.date(year, month, day).weekday()
        demand = max(20, round(base * (len(by_dow[dow]) / mean if by_dow[dow] else 1.0)))
        size = min(max(10, demand // 20), 28)
        ranked = sorted(by_dow[dow], key=lambda r: r[7]) or everything
        picked = [ranked[(seen[dow] * size + i) % len(ranked)] for i in range(size)]
        seen[dow] += 1
        eta = [min(180, max(8, 20 + r[3] * 2.5 + r[4] * 30 + 0.7 + 9)) for r in picked]
        late = 100 - 100 * sum(e <= 60 for e in eta) / size
        out[day] = (sum(eta) / size, 100 - late, late, demand, sum(r[4] for r in picked) / size, late)
    return out


FORMULA = sc.formula_predictor
MONDAYS = [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 8)]
WEEK = [dt.datetime(2024, 1, d) for d in range(1, 8)]


@pytest.mark.parametrize("n, days, month", [
    (3000, WEEK, (2024, 2)), (700, WEEK, (2023, 12)), (40, WEEK, (2024, 2)), (6, MONDAYS, (2025, 2)), (9000, MONDAYS, (2024, 7))])
def test_daily_projection(spark, n, days, month):
    df, rows = pool(spark, n, days)
    got = {r["day"]: tuple(r)[1:] for r in sc.project_month(df, *month, FORMULA, mode="sample").daily.collect()}
    want = expected_days(rows, *month)
    assert sorted(got) == sorted(want)
    for day, values in want.items():
        assert got[day] == pytest.approx(values), day


def test_rows_with_one_hash_are_still_found(spark):
    df, _ = pool(spark, 20_000, WEEK, same_hash=True)
    got = sc.lowest_hashes(df.select("row_hash", F.col("dia_semana").alias("pool")), "pool", "row_hash", 140,
                           {i: 20_000 // 7 + (i < 1) for i in range(7)})
    assert {r["pool"]: r["count"] for r in got.groupBy("pool").count().collect()} == {i: 140 for i in range(7)}


def test_full_mode_scores_every_row_of_the_weekday(spark):
    df, rows = pool(spark, 210, WEEK)
    got = sc.project_month(df, 2024, 2, FORMULA)
    assert got.scored.count() == 29 * 30
    only = sc.project_month(pool(spark, 50, MONDAYS)[0], 2024, 2, FORMULA)
    assert only.scored.groupBy("day").count().select("count").distinct().collect() == [(50,)]


def test_copies_of_a_row_are_sampled_alike_every_time(spark):
    df, _ = pool(spark, 2000, WEEK, same_hash=True)
    df = df.withColumn("row_id", F.col("id"))
    first, again = (sc.project_month(d, 2024, 2, FORMULA, mode="sample").daily.orderBy("day").collect() for d in (df, df.repartition(7)))
    assert first == again


def test_zone_risk_covers_the_six_largest(spark):
    df, rows = pool(spark, 950, WEEK)
    sizes = Counter(r[2] for r in rows)
    top = sorted(sizes, key=lambda z: (-sizes[z], z))[:6]
    got = {r["localidad"]: r for r in sc.zone_risk(df, 2024, 2, FORMULA, mode="sample").collect()}
    assert sorted(got) == sorted(top)
    for zone in top:
        size = min(max(8, sizes[zone] // 40), 24)
        picked = sorted((r for r in rows if r[2] == zone), key=lambda r: r[7])[:size]
        eta = [min(180, max(8, 20 + r[3] * 2.5 + r[4] * 30 + 0.7 + 9)) for r in picked]
        assert got[zone]["eta"] == pytest.approx(sum(eta) / size)
        assert got[zone]["riesgo"] == pytest.approx(100 * sum(e > 60 for e in eta) / size)


def test_history_falls_back_to_the_estimate(spark):
    df, _ = pool(spark, 300, WEEK)
    with_target = {r["metric"]: r for r in sc.historical_vs_predicted(sc.project_month(df, 2024, 2, FORMULA)).collect()}
    without = {r["metric"]: r for r in
               sc.historical_vs_predicted(sc.project_month(df.drop("tiempo_real_min"), 2024, 2, FORMULA)).collect()}
    assert with_target["Demanda diaria"]["historical"] == 43.0
    assert with_target["ETA promedio (min)"]["historical"] > 60 > 40 > without["ETA promedio (min)"]["historical"]


def test_demand_modes(spark):
    df, _ = pool(spark, 4200, [dt.datetime(2024, m, 1) for m in (1, 2, 3)])
    profile = sc.demand_profile(df)
    assert sc.demand_base(profile).first()["demand_base"] == 4200
    assert sc.demand_base(profile, "per_calendar_day").first()["demand_base"] == 1400


def test_nested_month(spark):
    df, _ = pool(spark, 300, WEEK)
    empty = spark.createDataFrame([], "model_name string, ord long, mae double, rmse double, mape double, n_validation long")
    page = pages.future_page(df, empty, FORMULA, month="2024-02")
    nested = pages.monthly_payload(page).first()
    assert nested["summary"]["horizon"] == "2024-02" and [d["day"] for d in nested["daily"]] == list(range(1, 30))
    scored = sc.project_month(df, 2024, 2, FORMULA).scored.count()
    assert sum(r["n"] for r in nested["distribucion_eta"]) == scored > 29 * 40
    assert len(nested["historico_vs_predicho"]) == 3
    assert page["kpis"].first()["rmse"] == 0.0


def test_nothing_to_project_from(spark):
    df, _ = pool(spark, 3, WEEK)
    with pytest.raises(ValueError):
        sc.project_month(df.where("id < 0"), 2024, 2, FORMULA)
