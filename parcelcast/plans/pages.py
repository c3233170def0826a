"""What each page of the dashboard asks for, as named DataFrames or one nested record."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from parcelcast.functions.columns import target_month
from parcelcast.operators import kpi, order, registry as reg, scenario
from parcelcast.schema import DEFAULT_MODEL


def actual_page(validation: DataFrame, registry: DataFrame, order_by: Sequence[str],
                model: str = DEFAULT_MODEL, filters: dict | None = None) -> dict[str, DataFrame]:
    rows = kpi.apply_filters(validation, **filters) if filters else validation
    return {
        "kpis": kpi.kpis_actual(rows, registry, model),
        "flashcards": kpi.flashcards(rows, registry, model),
        "por_localidad": kpi.by_zone(rows),
        "por_via": kpi.by_road(rows),
        "evolucion_temporal": order.real_vs_estimated_top(rows, order_by),
        "trafico_impacto": kpi.traffic_impact(rows),
        "lluvia_impacto": order.rain_levels(rows),
    }


def future_page(validation: DataFrame, registry: DataFrame, predictor: scenario.Predictor | dict[str, scenario.Predictor],
                model: str = DEFAULT_MODEL, month: str | None = None, today: dt.date | None = None,
                **options) -> dict[str, DataFrame]:
    """``predictor`` adds predictions, or names one for each model, of which ``model`` picks its own."""
    year, number, _ = target_month(month, today)
    options["predictor"] = predictor[model] if isinstance(predictor, dict) else predictor
    projection = scenario.project_month(validation, year, number, **options)
    return {
        "kpis": scenario.kpis_future(projection, registry, model),
        "summary": scenario.scenario_summary(projection),
        "daily": projection.daily,
        "distribucion_eta": scenario.eta_distribution(projection),
        "riesgo_por_localidad": scenario.zone_risk(validation, year, number, **{
            k: v for k, v in options.items() if k in ("predictor", "row_hash", "mode")}),
        "trafico_vs_riesgo": scenario.traffic_risk_points(projection),
        "historico_vs_predicho": scenario.historical_vs_predicted(projection),
    }


def confidence_page(validation: DataFrame, registry: DataFrame, order_by: Sequence[str]) -> dict[str, DataFrame]:
    return {
        "kpis": reg.kpis_confidence(registry),
        "modelos_metricas": reg.model_comparison(registry),
        "mejor_modelo": reg.best_model(registry),
        "evolucion_error": order.error_evolution(validation, order_by),
        "distribucion_error": order.error_levels(validation),
        "histograma_error": kpi.error_histogram(validation),
    }


def monthly_payload(page: dict[str, DataFrame]) -> DataFrame:
    """The projected month as one nested record.

    Gathering is safe here: every part has at most 31 days, a few zones, or the whole minutes of a prediction.
    """
    nested = page["summary"].select(F.struct("*").alias("summary"))
    for name in ("daily", "riesgo_por_localidad", "trafico_vs_riesgo", "historico_vs_predicho",
                 "distribucion_eta"):
        if name in page:
            part = page[name].agg(F.array_sort(F.collect_list(F.struct(*page[name].columns))).alias(name))
            nested = nested.withColumn(name, part.scalar())
    return nested
