"""Session helpers: shared scratch folder and small driver-bounded tables."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

ROW_ID = "row_id"
SPLIT_BYTES = 4 << 20     # Spark cuts files into pieces of at least this many bytes, so that each core gets one
_SHIPPING = threading.Lock()


def checkpoint_root(spark: SparkSession) -> str:
    """Folder for written intermediates: the one the cluster names, else a fresh one (local runs)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not spark.sparkContext.getCheckpointDir():      # set on the session after its start
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="parcelcast-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: later passes scan
    only the columns they need, and a lost executor re-reads files instead of redoing joins.

    The written rows carry ``row_id``, a number that is stable from then on; as the last key of an
    order it tells exact copies of a row apart.
    """
    path = scratch_path(df.sparkSession, name)
    df = spread(df).withColumn(ROW_ID, F.monotonically_increasing_id())
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Redistribute rows that come from fewer and smaller files than keep all cores busy, so that the passes over the
    written table run in parallel. Larger inputs, which Spark splits however few their files are, stay where they are."""
    spark = df.sparkSession
    cores, files = spark.sparkContext.defaultParallelism, df.inputFiles()
    if not 0 < len(files) < cores:
        return df if files else df.repartition(cores)
    size = spark.read.format("binaryFile").load([unquote(f) for f in files]).agg(F.sum("length")).first()[0]
    return df.repartition(cores) if size < cores * SPLIT_BYTES else df


def pin(df: DataFrame, max_rows: int) -> DataFrame:
    """Turn an aggregate of at most ``max_rows`` rows into a local relation.

    The bound is checked, so this never pulls a table that grows with the data.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        raise ValueError(f"expected at most {max_rows} rows, got more; columns: {df.columns}")
    return df.sparkSession.createDataFrame(rows, df.schema)


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    """A few driver-made rows as a local relation (Arrow keeps them off the Python worker path)."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    columns = {f.name: [r[i] for r in rows] for i, f in enumerate(schema.fields)}
    return spark.createDataFrame(pa.table(columns), schema)


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors once, so that tasks can import it wherever they run."""
    sc = spark.sparkContext
    with _SHIPPING:
        if getattr(sc, "_parcelcast_sent", False):
            return
        root = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="parcelcast-source-"), "parcelcast_core.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        sc.addPyFile(archive)
        sc._parcelcast_sent = True
