"""Feature sets and JSON records on disk."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from parcelcast.operators.encode import fit_linear_features, fit_tree_features, linear_feature_names
from parcelcast.schema import CATEGORICAL, FAMILIES, TARGET, TREE_FEATURES

MAX_SPLITS = 8      # that are written apart; more, or odd names, or over older files, go by partition column


def bind_features_target(features: DataFrame, target: DataFrame, key: Sequence[str]) -> DataFrame:
    """Join features and label on the row key (files have no row order to rely on).

    The key must be unique, as ``row_id`` of a staged table is.
    """
    return features.join(target, list(key))


def with_position(files: DataFrame, name: str = "position") -> DataFrame:
    """Rows of a file scan with their number from 0 in the order of the files' paths and of the lines in them.

    A task reads a split from front to back, so a row's place in its split follows from the running number; the rows of
    the splits before it are a sum over a table with one row for each split. Nothing is sorted but that table.
    """
    split = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]
    rows = files.select("*", *split).withColumn("_at", F.monotonically_increasing_id())
    sizes = rows.groupBy("_file", "_start").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("_file", "_start", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base"))
    joined = rows.join(F.broadcast(base), ["_file", "_start"])      # a row for each split
    return joined.select(*files.columns, (F.col("_at") + F.col("_base")).alias(name))


def bind_by_position(features: DataFrame, target: DataFrame) -> DataFrame:
    """Join two file scans row by row, as files without key are meant. Tables of different length raise, and so does a
    column that both have."""
    both = set(features.columns) & set(target.columns)
    if both:
        raise ValueError(f"columns in both tables: {sorted(both)}")
    left, right = with_position(features, "_position"), with_position(target, "_position")
    lengths = [df.count() for df in (features, target)]
    if lengths[0] != lengths[1]:
        raise ValueError(f"{lengths[0]} rows of features, {lengths[1]} of the target")
    return left.join(right, "_position").drop("_position")


def _is_there(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        return True
    except AnalysisException:
        return False


def write_feature_sets(labelled: DataFrame, order: Sequence[str], root: str, fmt: str = "parquet",
                       families: Sequence[str] = FAMILIES) -> dict[str, str]:
    """Write one table per family under ``root``, partitioned by ``split``, label in the row.

    ``labelled`` has the features, the label and ``split``. Linear families get one ``features``
    vector (numbered columns in CSV), tree families the coded columns.
    """
    train = labelled.where(F.col("split") == "train")
    scaled = fit_linear_features(train) if {"linear", "glm"} & set(families) else None
    coded = fit_tree_features(train, order).transform(labelled) if {"histgb", "xgboost"} & set(families) else None
    paths, tables = {}, {}
    for family in families:
        if family in ("linear", "glm"):
            table = scaled.transform(labelled).select("features", TARGET, "split")
            if fmt == "csv":
                values = vector_to_array("features")
                numbered = [values[i].alias(str(i)) for i in range(len(linear_feature_names(scaled)))]
                table = table.select(*numbered, TARGET, "split")
        else:
            table = coded.select(*[F.col(f"{c}_code").alias(c) if c in CATEGORICAL else F.col(c)
                                   for c in TREE_FEATURES], TARGET, "split")
        paths[family] = f"{root.rstrip('/')}/{family}"
        tables[family] = table
    names = sorted(r[0] or "" for r in labelled.select(F.col("split").cast("string")).distinct().limit(MAX_SPLITS + 1).collect())
    plain = 0 < len(names) <= MAX_SPLITS and all(n.isalnum() for n in names) and not any(_is_there(labelled.sparkSession, p) for p in paths.values())

    def write(family: str, name: str | None) -> None:
        if name is None:
            tables[family].write.partitionBy("split").mode("overwrite").option("header", True).format(fmt).save(paths[family])
        else:
            rows = tables[family].where(F.col("split") == name).drop("split")
            rows.write.mode("overwrite").option("header", True).format(fmt).save(f"{paths[family]}/split={name}")

    # a write by partition column would sort, and spill, every row; the smaller writes run side by side
    jobs = [(family, name) for name in (names if plain else [None]) for family in families]
    run = inheritable_thread_target(labelled.sparkSession)(write)
    with ThreadPoolExecutor(max(1, len(jobs))) as pool:
        for done in [pool.submit(run, *job) for job in jobs]:
            done.result()
    return paths


def json_records(df: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """One JSON text per row; rows are not gathered into one array, so any size is fine."""
    rows = df.orderBy(*order) if order else df
    return rows.select(F.to_json(F.struct(*df.columns)).alias("record"))
