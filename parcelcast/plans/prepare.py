"""Offline preparation: derive, split by time and write the delivery table once for all readers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from parcelcast.operators.encode import with_features
from parcelcast.operators.order import temporal_cut, temporal_split
from parcelcast.session import ROW_ID, scratch_path, stage

_SHARED: dict[tuple, object] = {}


def prepare(rows: DataFrame, order: Sequence[str], path: str | None = None) -> DataFrame:
    """Write ``rows`` with date parts, efficiency, ``row_id`` and ``split``, partitioned by ``split``.

    The input is staged first: finding the cut takes a few counting passes, which then read the key
    columns of one Parquet table instead of repeating the joins behind ``rows``. ``row_id`` closes
    the order, so the split has exact sizes even when a third of the rows are copies of one row.
    """
    spark = rows.sparkSession
    staged = stage(rows, "rows")
    labelled = temporal_split(with_features(staged), temporal_cut(staged, [*order, ROW_ID]))
    path = (path or scratch_path(spark, "prepared")).rstrip("/")
    for split in ("train", "validation"):       # a write by partition column would sort, and spill, every row
        labelled.where(F.col("split") == split).drop("split").write.mode("overwrite").parquet(f"{path}/split={split}")
    return spark.read.schema(labelled.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Drop what ``once`` holds for this application, after its scratch folder was cleaned."""
    for key in [k for k in _SHARED if k[0] == spark.sparkContext.applicationId]:
        del _SHARED[key]


def input_state(spark: SparkSession, paths: Sequence[str]) -> tuple:
    """Files, bytes and a hash of paths, sizes and times of all input files; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    state = files.agg(F.count(F.lit(1)), F.sum("length"), F.bit_xor(F.xxhash64("path", "length", "modificationTime")))
    return tuple(state.first())


def once(spark: SparkSession, name: tuple, build: Callable[[], object], inputs: Sequence[str] = ()):
    """What pages share (a table, trained models): built by the first caller of this application, then reused until one
    of the ``inputs``, files or folders, changes."""
    key, state = (spark.sparkContext.applicationId, *name), input_state(spark, inputs) if inputs else ()
    if key not in _SHARED or _SHARED[key][0] != state:
        _SHARED[key] = state, build()
    return _SHARED[key][1]
