"""Profile of a table: null counts, types, describe() with exact quartiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from parcelcast.operators.ranks import exact_quantiles
from parcelcast.session import local_table


def profile_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null count and type per column: one aggregate, then one row turned into many."""
    types = dict(df.dtypes)
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = ", ".join(f"'{c}', '{types[c]}', `{c}`" for c in columns)
    return counted.selectExpr(f"stack({len(columns)}, {rows}) as (column, type, nulls)")


def profile_describe(df: DataFrame, columns: Sequence[str], **options) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles per numeric column."""
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75], **options)
    moments = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns
                       for n, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_samp), ("lo", F.min), ("hi", F.max))]
                     ).first()
    rows = []
    for c in columns:
        q = quartiles.get((c,), {})
        rows.append((c, moments[f"n_{c}"], *[_number(moments[f"{k}_{c}"]) for k in ("m", "s", "lo")],
                     q.get(0.25), q.get(0.5), q.get(0.75), _number(moments[f"hi_{c}"])))
    names = ["mean", "std", "min", "q25", "q50", "q75", "max"]
    schema = T.StructType([T.StructField("column", T.StringType()), T.StructField("count", T.LongType()),
                           *[T.StructField(n, T.DoubleType()) for n in names]])
    return local_table(df.sparkSession, rows, schema)


def _number(value) -> float | None:
    return None if value is None else float(value)
