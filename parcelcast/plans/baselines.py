"""Ridge lines on one feature each: models that one aggregate fits and SQL can check, for registry queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parcelcast.operators.kpi import regression_metrics
from parcelcast.schema import ESTIMATE, TARGET

ALPHA = 1.0
#: Registered name and feature of each line; loading shortens the first one's name to the default model's.
LINES = [("Linear Regression on distance", "distancia_km"), ("Ridge on traffic", "nivel_trafico"),
         ("Ridge on rain", "lluvia_mm"), ("Ridge on estimate", ESTIMATE)]


def line_registry(train: DataFrame, validation: DataFrame) -> DataFrame:
    """Registry rows of the lines, fitted on all training rows and judged on all validation rows."""
    y = F.col(TARGET)
    known = train.where(" and ".join(f"{c} is not null" for c in (TARGET, *(x for _, x in LINES))))
    moments = known.agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("my"), *[
        f.alias(f"{k}_{x}") for _, x in LINES
        for k, f in (("m", F.avg(x)), ("c", F.covar_pop(x, y)), ("v", F.var_pop(x)))]).first()
    n = moments["n"]
    lines = []
    for _, x in LINES:
        weight = (moments[f"c_{x}"] or 0.0) * n / ((moments[f"v_{x}"] or 0.0) * n + ALPHA)
        lines.append(F.lit(moments["my"] or 0.0) + (F.col(x) - F.lit(moments[f"m_{x}"] or 0.0)) * F.lit(weight))
    scored = validation.select(TARGET, F.posexplode(F.array(*lines)).alias("model", "prediction"))
    errors = regression_metrics(scored, "prediction", by=["model"])
    name = F.element_at(F.array(*[F.lit(v) for v, _ in LINES]), F.col("model") + 1)
    return errors.select(
        F.col("model").cast("bigint").alias("ord"), name.alias("model_name"), F.col("mae").alias("MAE"), F.col("mse").alias("MSE"),
        F.col("rmse").alias("RMSE"), F.col("mape").alias("MAPE"), F.lit(n).cast("bigint").alias("n_train"), "n_validation")
