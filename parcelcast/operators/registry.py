"""Metrics registry: one small row per model. Loading, replacing, ranking, confidence score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelcast.functions.columns import normalize_model_name
from parcelcast.schema import DEFAULT_MODEL, KPIS_CONFIDENCE, VARIABILITY_WEIGHT

METRICS = ["mae", "mse", "rmse", "mape", "n_train", "n_validation"]


def load_registry(raw: DataFrame) -> DataFrame:
    """Rows per short model name. A later row replaces the values of an earlier one but keeps its place.

    ``raw`` has the registry columns and ``ord``, the position of the row.
    """
    named = raw.select(normalize_model_name("model_name").alias("model_name"), "ord",
                       F.struct(*[F.col(m if m in raw.columns else m.upper()).alias(m) for m in METRICS])
                       .alias("values"))
    merged = named.groupBy("model_name").agg(F.min("ord").alias("ord"), F.max_by("values", "ord").alias("values"))
    return merged.select("model_name", "ord", "values.*")


def registry_upsert(registry: DataFrame, new: DataFrame, contains: str | None = None) -> DataFrame:
    """Replace the rows of the new models, append the new rows.

    ``contains`` replaces every row whose name contains that text instead of the equal name.
    """
    kept = (registry.where(~F.coalesce(F.col("model_name").contains(contains), F.lit(False)))
            if contains else registry.join(new.select("model_name").distinct(), "model_name", "left_anti"))
    return kept.unionByName(new)


def model_metric(registry: DataFrame, model: str, metric: str) -> Column:
    """One registered value as a scalar subquery: null when the model is not registered."""
    return registry.where(F.col("model_name") == model).agg(F.max(metric)).scalar()


def best_model(registry: DataFrame) -> DataFrame:
    """Smallest RMSE, the earlier row on ties; the default model with 0.0 for an empty registry."""
    best = F.min_by("model_name", F.struct("rmse", "ord"))
    return registry.where(F.col("rmse").isNotNull()).agg(
        F.coalesce(best, F.lit(DEFAULT_MODEL)).alias("best_model"),
        F.coalesce(F.min("rmse"), F.lit(0.0)).alias("best_rmse"))


def model_comparison(registry: DataFrame) -> DataFrame:
    """Models with their errors and rank by RMSE. One row per model, so one task can rank them."""
    by_rmse = Window.orderBy("rmse", "ord")
    return registry.select("model_name", "ord", *METRICS, F.row_number().over(by_rmse).alias("rank"))


def kpis_confidence(registry: DataFrame) -> DataFrame:
    """Mean errors over the models and the confidence score; zeros and 'N/A' when there is none."""
    mape = F.avg(F.col("mape") * 100)
    means = registry.agg(
        F.count(F.lit(1)).alias("n_models"), F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse_mean"),
        F.stddev_pop("rmse").alias("spread"), mape.alias("mape_pct"),
        F.min_by("model_name", F.struct("rmse", "ord")).alias("best"), F.min("rmse").alias("lowest"))
    precision = F.greatest(F.lit(0.0), 100.0 - F.col("mape_pct"))
    penalty = F.when(F.col("rmse_mean") > 0, F.try_divide(F.col("spread"), F.col("rmse_mean")) * 100.0).otherwise(100.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), precision - penalty * VARIABILITY_WEIGHT))

    def known(value: Column, default) -> Column:
        return F.when(F.col("n_models") > 0, value).otherwise(F.lit(default))

    return means.select(
        "n_models",
        known(precision, 0.0).alias("precision_global"),
        known(F.col("mae"), 0.0).alias("mae_global"),
        known(F.col("rmse_mean"), 0.0).alias("rmse_global"),
        known(F.col("mape_pct"), 0.0).alias("mape_global"),
        known(F.col("best"), "N/A").alias("best_model"),
        known(F.col("lowest"), 0.0).alias("best_rmse"),
        known(score, 0.0).alias("score_confianza"),
    ).select(*KPIS_CONFIDENCE)
