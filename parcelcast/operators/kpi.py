"""KPIs and grouped summaries of a delivery table. Each is one map-side combined aggregate."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from parcelcast.functions.columns import percent_of_rows, signed_error
from parcelcast.operators.ranks import exact_quantiles, typed_literal
from parcelcast.operators.registry import model_metric
from parcelcast.schema import (DEFAULT_MODEL, KPIS_ACTUAL, MODEL_CARDS, ON_TIME_MIN, TABLE_CARDS, TARGET,
                               TIMESTAMP)
from parcelcast.session import local_table


def delivery_kpis(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, extremes, population deviation, count, on-time and delayed share of the real time."""
    eta = F.col(TARGET)
    return df.groupBy(*by).agg(
        F.coalesce(F.avg(eta), F.lit(0.0)).alias("eta_mean"),
        F.coalesce(F.max(eta), F.lit(0.0)).alias("eta_max"),
        F.coalesce(F.min(eta), F.lit(0.0)).alias("eta_min"),
        F.coalesce(F.stddev_pop(eta), F.lit(0.0)).alias("eta_std"),
        F.count(F.lit(1)).alias("n_records"),
        F.coalesce(percent_of_rows(eta <= ON_TIME_MIN), F.lit(0.0)).alias("otif"),
        F.coalesce(percent_of_rows(eta > ON_TIME_MIN), F.lit(0.0)).alias("delays_pct"))


def apply_filters(df: DataFrame, zone: str | None = None, road: str | None = None,
                  vehicle: str | None = None, max_traffic: float | None = None,
                  date_from: dt.date | str | None = None, date_to: dt.date | str | None = None) -> DataFrame:
    """The dashboard's optional filters, all of which can be pushed to the scan.

    Both dates are inclusive, so the upper bound is the start of the following day.
    """
    kind = dict(df.dtypes)[TIMESTAMP]
    for column, value in (("localidad", zone), ("tipo_via", road), ("vehiculo", vehicle)):
        if value is not None:
            df = df.where(F.col(column) == value)
    if max_traffic is not None:
        df = df.where(F.col("nivel_trafico") <= max_traffic)
    if date_from is not None:
        df = df.where(F.col(TIMESTAMP) >= typed_literal(_midnight(date_from), kind))
    if date_to is not None:
        df = df.where(F.col(TIMESTAMP) < typed_literal(_midnight(date_to) + dt.timedelta(days=1), kind))
    return df


def _midnight(day: dt.date | str) -> dt.datetime:
    day = dt.date.fromisoformat(day) if isinstance(day, str) else day
    return dt.datetime(day.year, day.month, day.day)


def kpis_actual(df: DataFrame, registry: DataFrame, model: str = DEFAULT_MODEL,
                filters: dict | None = None) -> DataFrame:
    """KPIs of the table next to the registered errors of ``model`` (0 when it is not registered)."""
    rows = apply_filters(df, **filters) if filters else df
    return delivery_kpis(rows).select(
        F.lit(model).alias("model_name"), "*",
        *[F.coalesce(model_metric(registry, model, m), F.lit(0.0)).alias(m) for m in ("mae", "rmse", "mape")]
    ).select(*KPIS_ACTUAL)


def flashcards(df: DataFrame, registry: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """Label, value, unit and trend of the dashboard cards, in display order."""
    stats = _cards(delivery_kpis(df), TABLE_CARDS, 1)
    errors = _cards(registry.where(F.col("model_name") == model), MODEL_CARDS, 1 + len(TABLE_CARDS))
    return stats.unionByName(errors)


def _cards(figures: DataFrame, cards: Sequence[tuple], first: int) -> DataFrame:
    rows = F.array(*[
        F.struct(F.lit(first + i).alias("position"), F.lit(label).alias("label"),
                 F.round(F.expr(figure), 2).alias("value"), F.lit(unit).alias("unit"),
                 F.lit(trend).cast("string").alias("trend"))
        for i, (label, figure, unit, trend) in enumerate(cards)])
    return figures.select(F.inline(rows))


def mean_by(df: DataFrame, key: str | Column, name: str) -> DataFrame:
    """Mean real time and number of known times per key; rows without key are left out.

    Partial aggregation runs before the shuffle, so a key with a third of all rows costs one
    partial row per task.
    """
    column = F.col(key) if isinstance(key, str) else key
    return (df.select(column.alias(name), TARGET).where(F.col(name).isNotNull())
            .groupBy(name).agg(F.avg(TARGET).alias("mean"), F.count(TARGET).alias("count")))


def by_zone(df: DataFrame) -> DataFrame:
    return mean_by(df, "localidad", "localidad").orderBy("localidad")


def by_road(df: DataFrame) -> DataFrame:
    return mean_by(df, "tipo_via", "tipo_via").orderBy("tipo_via")


def traffic_impact(df: DataFrame, bucket: float | None = None) -> DataFrame:
    """Mean real time per exact traffic level, or per level bucket on continuous data."""
    level = F.col("nivel_trafico")
    if bucket is not None:
        level = F.floor(level / bucket) * F.lit(bucket)
    return mean_by(df, level, "nivel_trafico").orderBy("nivel_trafico")


def top_zones(df: DataFrame, limit: int) -> DataFrame:
    counts = (df.where(F.col("localidad").isNotNull()).groupBy("localidad")
              .agg(F.count(F.lit(1)).alias("n")))
    return counts.orderBy(F.desc("n"), "localidad").limit(limit)


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """Equal-width histogram between the extremes; empty bins are absent."""
    numbers = df.select(value.cast("double").alias("x")).where(F.col("x").isNotNull())
    ends = numbers.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if ends["lo"] is None:
        return local_table(numbers.sparkSession, [], "bucket int, n bigint")
    width = (ends["hi"] - ends["lo"]) / bins
    bucket = (F.least(F.lit(bins), F.floor((F.col("x") - ends["lo"]) / width) + 1)
              if width > 0 else F.lit(1))
    return numbers.groupBy(bucket.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def error_histogram(df: DataFrame, bins: int = 20) -> DataFrame:
    return histogram(df, signed_error(), bins)


def road_box(df: DataFrame, by: str = "tipo_via", value: str = TARGET, **options) -> DataFrame:
    """Five-number summary of the real time per road type, with exact quartiles.

    Quartiles come from counting passes, so no task ever holds the values of one road type.
    """
    rows = df.select(by, value).where(F.col(by).isNotNull())
    summary = exact_quantiles(rows, [value], [0.0, 0.25, 0.5, 0.75, 1.0], by=[by], **options)
    out = [(group[1], q[0.0], q[0.25], q[0.5], q[0.75], q[1.0]) for group, q in sorted(summary.items())]
    fields = [T.StructField(by, rows.schema[by].dataType)]
    fields += [T.StructField(c, T.DoubleType()) for c in ("low", "q1", "med", "q3", "high")]
    return local_table(df.sparkSession, out, T.StructType(fields))


def regression_metrics(df: DataFrame, prediction: str, label: str = TARGET, by: Sequence[str] = ()) -> DataFrame:
    """MAE, MSE, RMSE and MAPE (a fraction) in one aggregate."""
    error = F.col(label) - F.col(prediction)
    epsilon = F.lit(2.220446049250313e-16)
    return df.groupBy(*by).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error) / F.greatest(F.abs(F.col(label)), epsilon)).alias("mape"),
        F.count(error).alias("n_validation"))
