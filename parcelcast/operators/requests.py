"""Prediction requests: completion, range validation, unknown zones, scenario rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from parcelcast.schema import (FEATURES, KNOWN_ZONES, REQUEST_BOUNDS, REQUEST_DEFAULTS,
                               REQUIRED_REQUEST_FIELDS, SCENARIO_DEFAULTS)


def _given(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None)


def complete_requests(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Fill what a request leaves out, derive its efficiency, and put features in model order."""
    filled = df.select(
        *keep,
        *[F.coalesce(_given(df, c), F.lit(d)).cast(_kind(d)).alias(c) for c, d in REQUEST_DEFAULTS.items()],
        _given(df, "eficiencia_estimacion").cast("double").alias("_given"))
    derived = F.when(F.col("distancia_km") > 0, F.try_divide("tiempo_estimado_min", "distancia_km")).otherwise(0.0)
    value = F.when(F.isnan("_given"), derived).otherwise(F.coalesce("_given", derived))
    finite = F.when(F.abs(value) < F.lit(float("inf")), value).otherwise(0.0)
    return filled.withColumn("eficiencia_estimacion", finite).select(*keep, *FEATURES)


def _kind(default) -> str:
    return {int: "int", float: "double", str: "string"}[type(default)]


def validate_requests(df: DataFrame, bounds: Sequence[tuple] = REQUEST_BOUNDS,
                      required: Sequence[str] = REQUIRED_REQUEST_FIELDS) -> DataFrame:
    """Adds ``violations`` (names of broken rules) and ``valid``; no row is dropped."""
    broken = [F.when(F.col(c).isNull(), f"{c}:required") for c in required]
    for name, low, low_in, high, high_in, *_ in bounds:
        value = F.col(name)
        under = value < low if low_in else value <= low
        over = value > high if high_in else value >= high
        broken.append(F.when(under | over | F.isnan(value.cast("double")), f"{name}:range"))
    for name in (b[0] for b in bounds if "integer" in b[5:]):
        broken.append(F.when(F.col(name) != F.floor(name), f"{name}:integer"))
    return (df.withColumn("violations", F.array_compact(F.array(*broken)))
            .withColumn("valid", F.size("violations") == 0))


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where("valid").drop("valid", "violations")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.where("not valid").drop("valid")


def unknown_zones(df: DataFrame, known: Sequence[str] = KNOWN_ZONES) -> DataFrame:
    """Zones outside the known list with their row counts; the short list is a literal, not a join."""
    return (df.where(F.col("localidad").isNotNull() & ~F.col("localidad").isin(list(known)))
            .groupBy("localidad").agg(F.count(F.lit(1)).alias("n")))


def scenario_features(df: DataFrame, year, month, day, weekday, keep: Sequence[str] = ()) -> DataFrame:
    """Feature row of a projected day: zero or missing numbers take the default, the date is set.

    ``year`` … ``weekday`` are numbers or columns. The risk level is cut to a whole number.
    """
    whole = {"estrato", "zona_riesgo", "cliente_ausente", "intentos_entrega"}
    columns = {}
    for name, default in SCENARIO_DEFAULTS.items():
        value = _given(df, name)
        if isinstance(default, str):
            columns[name] = F.coalesce(value, F.lit(default))
            continue
        known = F.when(~F.isnan(value.cast("double")), value)
        chosen = F.when(F.coalesce(known, F.lit(0)) == 0, F.lit(default)).otherwise(known)
        columns[name] = chosen.cast("int" if name in whole else "double")
    columns.update({n: _as_column(v).cast("int") for n, v in
                    (("anio", year), ("mes", month), ("dia", day), ("dia_semana", weekday))})
    efficiency = F.coalesce(_given(df, "eficiencia_estimacion").cast("double"), F.lit(0.0))
    rows = df.select(*keep, *[c.alias(n) for n, c in columns.items()], efficiency.alias("_given"))
    derived = F.when((F.col("_given") <= 0) & (F.col("distancia_km") > 0),
                     F.col("tiempo_estimado_min") / F.col("distancia_km")).otherwise(F.col("_given"))
    return rows.withColumn("eficiencia_estimacion", derived).select(*keep, *FEATURES)


def _as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)
