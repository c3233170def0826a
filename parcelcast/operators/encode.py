"""Feature preparation: efficiency, scaling, one-hot and first-appearance encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (OneHotEncoder, SQLTransformer, StringIndexer, StringIndexerModel,
                                VectorAssembler)
from pyspark.sql import DataFrame, Window, functions as F

from parcelcast.functions.columns import date_features, ratio
from parcelcast.operators.ranks import exact_quantiles
from parcelcast.schema import CATEGORICAL, ESTIMATE, NUMERIC, TREE_FEATURES

MAX_CATEGORIES = 100_000     # vocabularies live on the driver and in the saved model


def median_of(df: DataFrame, column: str, **options) -> float | None:
    """Exact median of the finite values, found by counting passes."""
    return exact_quantiles(df, [column], [0.5], **options).get((column,), {}).get(0.5)


def impute_median(df: DataFrame, column: str, fit_on: DataFrame | None = None, **options) -> DataFrame:
    """Fill nulls with the median of ``fit_on`` (default: the table itself)."""
    if df.agg(F.count_if(F.col(column).isNull())).first()[0] == 0:
        return df
    middle = median_of(df if fit_on is None else fit_on, column, **options)
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(middle).cast("double")))


def with_features(df: DataFrame, fit_on: DataFrame | None = None) -> DataFrame:
    """Date parts and the efficiency ratio, the latter without nulls."""
    def derive(rows: DataFrame) -> DataFrame:
        return date_features(rows).withColumn("eficiencia_estimacion", ratio(ESTIMATE, "distancia_km"))

    return impute_median(derive(df), "eficiencia_estimacion", None if fit_on is None else derive(fit_on))


def scaler_stats(train: DataFrame, columns: Sequence[str] = NUMERIC) -> DataFrame:
    """Mean and population deviation per column, one aggregate over the training rows."""
    moments = train.agg(*[f(F.col(c).cast("double")).alias(f"{p}_{c}")
                          for c in columns for p, f in (("mu", F.avg), ("sd", F.stddev_pop))])
    rows = ", ".join(f"'{c}', `mu_{c}`, `sd_{c}`" for c in columns)
    return moments.selectExpr(f"stack({len(columns)}, {rows}) as (feature, mean, std)")


def scale_stage(train: DataFrame, columns: Sequence[str] = NUMERIC) -> SQLTransformer:
    """Pipeline stage adding ``<column>_scaled``; a constant column is only centred.

    ``StandardScaler`` would divide by the sample deviation, hence own columns.
    """
    stats = {r["feature"]: r for r in scaler_stats(train, columns).collect()}
    scaled = [f"(CAST({c} AS DOUBLE) - {stats[c]['mean'] or 0.0!r}D) / {(stats[c]['std'] or 1.0)!r}D AS {c}_scaled"
              for c in columns]
    return SQLTransformer(statement=f"SELECT *, {', '.join(scaled)} FROM __THIS__")


def scale_numeric(df: DataFrame, train: DataFrame, columns: Sequence[str] = NUMERIC) -> DataFrame:
    return scale_stage(train, columns).transform(df)


def one_hot_stages(columns: Sequence[str] = CATEGORICAL) -> list:
    """Sorted vocabulary, one slot per known category; unknown and null give all zeros."""
    indexer = StringIndexer(inputCols=list(columns), outputCols=[f"{c}_index" for c in columns],
                            stringOrderType="alphabetAsc", handleInvalid="keep")
    encoder = OneHotEncoder(inputCols=[f"{c}_index" for c in columns],
                            outputCols=[f"{c}_onehot" for c in columns], dropLast=True)
    return [indexer, encoder]


def fit_linear_features(train: DataFrame) -> PipelineModel:
    """Scaled numerics then one-hot categories, assembled into ``features``."""
    assembler = VectorAssembler(
        inputCols=[f"{c}_scaled" for c in NUMERIC] + [f"{c}_onehot" for c in CATEGORICAL],
        outputCol="features", handleInvalid="error")
    return Pipeline(stages=[scale_stage(train), *one_hot_stages(), assembler]).fit(train)


def linear_feature_names(model: PipelineModel) -> list[str]:
    indexer = next(s for s in model.stages if isinstance(s, StringIndexerModel))
    return NUMERIC + [f"{c}={v}" for c, labels in zip(CATEGORICAL, indexer.labelsArray) for v in labels]


def appearance_order(train: DataFrame, order: Sequence[str], columns: Sequence[str] = CATEGORICAL) -> DataFrame:
    """Categories numbered by first appearance in training order.

    The smallest leading key of each category comes from a hash aggregate with fixed-width buffers; only
    the rows that have it are then compared on the whole order.
    """
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    tall = train.select(F.col(order[0]).alias("lead"), F.struct(*order).alias("seen"),
                        F.expr(f"stack({len(columns)}, {pairs}) as (feature, category)")).where("category is not null")
    first = tall.groupBy("feature", "category").agg(F.min("lead").alias("first"))
    at_first = tall.join(first, ["feature", "category"]).where(F.col("lead").eqNullSafe(F.col("first")))
    seen = at_first.groupBy("feature", "category").agg(F.min("seen").alias("seen"))
    number = F.row_number().over(Window.partitionBy("feature").orderBy("seen"))
    return seen.select("feature", "category", (number - 1).alias("code"))


def ordinal_models(train: DataFrame, order: Sequence[str], columns: Sequence[str] = CATEGORICAL
                   ) -> list[StringIndexerModel]:
    """First-appearance vocabularies as indexer models, which are saved and loaded with the pipeline."""
    rows = appearance_order(train, order, columns).limit(MAX_CATEGORIES + 1).collect()
    if len(rows) > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} categories")
    models = []
    for c in columns:
        labels = [r["category"] for r in sorted((r for r in rows if r["feature"] == c), key=lambda r: r["code"])]
        models.append(StringIndexerModel.from_labels(labels, inputCol=c, outputCol=f"{c}_seen", handleInvalid="keep"))
    return models


def ordinal_stages(train: DataFrame, order: Sequence[str], columns: Sequence[str] = CATEGORICAL) -> list:
    """Adds ``<column>_code``: number of first appearance, -1 for unseen or missing."""
    models = ordinal_models(train, order, columns)
    codes = ", ".join(f"CAST(IF({c}_seen = {len(m.labels)}, -1, {c}_seen) AS INT) AS {c}_code"
                      for c, m in zip(columns, models))
    return [*models, SQLTransformer(statement=f"SELECT *, {codes} FROM __THIS__")]


def ordinal_encode(df: DataFrame, train: DataFrame, order: Sequence[str],
                   columns: Sequence[str] = CATEGORICAL) -> DataFrame:
    return PipelineModel(stages=ordinal_stages(train, order, columns)).transform(df)


def fit_tree_features(train: DataFrame, order: Sequence[str]) -> PipelineModel:
    """Codes and raw numerics in table order, assembled into ``features``."""
    inputs = [f"{c}_code" if c in CATEGORICAL else c for c in TREE_FEATURES]
    assembler = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error")
    return PipelineModel(stages=[*ordinal_stages(train, order), assembler])
