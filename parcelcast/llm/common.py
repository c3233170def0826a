"""Helpers shared by the operators: written intermediates and views of text batches as byte arrays."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from parcelcast.session import scratch_path

#: Text bytes that one vectorised step works on; a longer single text is a step of its own.
STEP_BYTES = 24 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: it cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors once, so that workers can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_parcelcast_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="parcelcast-source-"), "parcelcast.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(archive)
    sc._parcelcast_shipped = True


#: What operators keep in this worker from task to task: operator -> (key, value).
_KEPT: dict[str, tuple] = {}


def kept(owner: str, key: object, make: Callable) -> object:
    """``make()``, kept in this worker until the operator asks for another key or a task of another operator begins."""
    if owner not in _KEPT or _KEPT[owner][0] != key:
        _KEPT.pop(owner, None)
        _KEPT[owner] = key, make()
    return _KEPT[owner][1]


def forget_others(owner: str | None) -> None:
    """Drop what operators other than ``owner`` keep in this worker."""
    for other in [k for k in _KEPT if k != owner]:
        del _KEPT[other]


def by_batch(df: DataFrame, run: Callable, schema: str, owner: str | None = None) -> DataFrame:
    """``mapInArrow`` with the package at hand on the workers. A worker that goes on to another operator's tasks gives up what
    it keeps for ``owner``, and after each task the memory that Arrow holds in reserve."""
    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(owner)
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    ship(df.sparkSession)
    return df.mapInArrow(alone, schema)


def by_group(df: DataFrame, key: str, run: Callable, schema: str) -> DataFrame:
    """``applyInArrow`` on the groups of a bounded size that ``key`` makes."""
    ship(df.sparkSession)
    return df.groupBy(key).applyInArrow(run, schema)


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``limit`` bytes at most in each."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def filled(column: pa.Array) -> pa.Array:
    """A text column with nulls as empty texts."""
    return pc.fill_null(column, "")


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each starts (one more entry than texts)."""
    arr = filled(column).cast(pa.large_binary())
    offsets = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset:arr.offset + len(arr) + 1]
    if len(arr) == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    data = np.frombuffer(arr.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary column whose row i is ``data[offsets[i]:offsets[i + 1]]`` (offsets count items)."""
    data = np.ascontiguousarray(data)
    ends = (np.asarray(offsets, dtype=np.int64) * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all items of the given ranges, one range after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a fixed bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x


#: Multiplier of the rolling sums and its inverse modulo 2**64, and a number for each byte.
_A = 0x9E3779B97F4A7C15
_A_INVERSE = pow(_A, -1, 1 << 64)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x5851F42D4C957F2D))
_POWERS: dict[int, np.ndarray] = {}
#: Powers that a worker keeps for each base; those of more bytes are made anew.
_KEPT_POWERS = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers, at least; of long ones no table stays in the worker."""
    if base not in _POWERS:
        factors = np.full(_KEPT_POWERS, base, np.uint64)
        factors[0] = 1
        _POWERS[base] = np.multiply.accumulate(factors)
    have = _POWERS[base]
    if n <= len(have):
        return have[:n]
    heads = np.full(-(-n // len(have)), pow(base, len(have), 1 << 64), np.uint64)
    heads[0] = 1
    return np.multiply.outer(np.multiply.accumulate(heads), have).ravel()[:n]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each ``data[start:end]``; it depends on the bytes alone."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _powers(_A, len(data)), out=sums[1:])
    inside = (sums[ends] - sums[starts]) * _powers(_A_INVERSE, len(data) + 1)[starts]
    return mix(inside + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def hash_words(words: pa.Array) -> np.ndarray:
    """64-bit hash of each text of a column."""
    data, at = as_bytes(words)
    return hash_spans(data, at[:-1], at[1:])
