"""Metrics registry on disk: a log of updates, each one small CSV in a folder of its own.

An update only adds an ``update=`` folder under a name that no other writer picks, so trainings that register at the same
time lose no row. Readers replay the log in the order of the names, which begin with the time of the update: a row holds
until a later update replaces it. A failed update leaves no committed file. A folder with plain CSV files is read as it is.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from parcelcast.schema import REGISTRY
from parcelcast.session import local_table, pin

MAX_MODELS = 10_000
#: What an update holds: rows with their place and, in one row without name, the text whose rows it replaces.
_LOGGED = T.StructType([*REGISTRY.fields, T.StructField("place", T.LongType()), T.StructField("contains", T.StringType())])


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry rows with ``ord``, their position."""
    rows = spark.read.schema(REGISTRY).option("header", True).csv(path)
    if "update" not in rows.columns:
        return rows.withColumn("ord", F.monotonically_increasing_id())
    logged = spark.read.schema(_LOGGED).option("header", True).csv(path).withColumn("update", F.col("update").cast("string"))
    rows = logged.where("place is not null")
    marks = logged.where("place is null").select(F.col("update").alias("later"), F.col("contains").alias("part"))
    named = rows.select(F.col("update").alias("later"), F.col("model_name").alias("name")).distinct().join(marks, "later")
    by_name = (F.col("later") > F.col("update")) & F.col("part").isNull() & (F.col("name") == F.col("model_name"))
    by_text = (F.col("later") > F.col("update")) & F.col("model_name").contains(F.col("part"))
    left = rows.join(named, by_name, "left_anti").join(marks, by_text, "left_anti")
    place = F.row_number().over(Window.orderBy("update", "place")) - 1       # a row for each model, so one task can number them
    return left.select(*REGISTRY.names, place.cast("bigint").alias("ord"))


def update_registry(spark: SparkSession, path: str, new: DataFrame, contains: str | None = None) -> DataFrame:
    """Replace or append model rows in the registry, which need not exist yet; of several rows of ``new`` all are kept.

    ``contains`` replaces every row whose name contains that text instead of the rows of equal name.
    """
    if _exists(spark, path):
        files = spark.read.schema(REGISTRY).option("header", True).csv(path)
        if "update" not in files.columns and files.limit(1).count():
            raise ValueError(f"{path} holds a plain CSV; register its rows in a folder of its own")
    fresh = pin(new.withColumn("place", F.monotonically_increasing_id()).withColumn("contains", F.lit(None).cast("string")).select(*_LOGGED.names), MAX_MODELS)
    mark = local_table(spark, [(*[None] * len(REGISTRY.fields), None, contains)], _LOGGED)
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    rows = fresh.unionByName(mark).repartition(1).sortWithinPartitions("place")
    rows.write.mode("errorifexists").option("header", True).csv(f"{path.rstrip('/')}/update={name}")
    return read_registry(spark, path)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path).schema
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True
