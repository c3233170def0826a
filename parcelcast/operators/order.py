"""Ordered operators: temporal split, consecutive segments, first rows in table order."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelcast.functions.columns import signed_error
from parcelcast.operators.ranks import FINE_ROWS, is_before_key, keys_at_ranks, typed_literal
from parcelcast.schema import (ERROR_ROWS, ERROR_SEGMENTS, ESTIMATE, RAIN_ROWS, TARGET, TOP_ESTIMATES,
                               TRAIN_RATIO)


@dataclass(frozen=True)
class Cut:
    """A place in the total order of ``order``: ``first`` is the key of the first row after it."""
    order: tuple
    kinds: tuple
    first: tuple | None
    rows_before: int
    rows: int

    def is_before(self) -> Column:
        if self.first is None:
            return F.lit(True)
        return is_before_key(self.order, self.kinds, self.first)

    def before(self, df: DataFrame) -> DataFrame:
        """Rows before the cut; the plain bound on the leading key reaches the file scan."""
        if self.first is None:
            return df
        if self.first[0] is None:
            return df.where(self.is_before())
        return df.where((F.col(self.order[0]) <= typed_literal(self.first[0], self.kinds[0])) & self.is_before())

    def after(self, df: DataFrame) -> DataFrame:
        if self.first is None:
            return df.where(F.lit(False))
        if self.first[0] is None:
            return df.where(~self.is_before())
        lead = F.col(self.order[0])
        return df.where((lead.isNull() | (lead >= typed_literal(self.first[0], self.kinds[0]))) & ~self.is_before())


def _kinds(df: DataFrame, order: Sequence[str]) -> tuple:
    types = dict(df.dtypes)
    return tuple(types[k] for k in order)


def temporal_cut(df: DataFrame, order: Sequence[str], ratio: float = TRAIN_RATIO,
                 fine_rows: int = FINE_ROWS) -> Cut:
    """Find the first validation row: the one at rank ``floor(n * ratio)`` of the time order."""
    n, keys = keys_at_ranks(df, order, lambda rows: [math.floor(rows * ratio)], fine_rows=fine_rows)
    place = math.floor(n * ratio)
    return Cut(tuple(order), _kinds(df, order), keys.get(place), place, n)


def temporal_split(df: DataFrame, cut: Cut) -> DataFrame:
    """Label every row 'train' or 'validation'; a projection, no row moves."""
    return df.withColumn("split", F.when(cut.is_before(), "train").otherwise("validation"))


def segment_starts(df: DataFrame, order: Sequence[str], segments: int = ERROR_SEGMENTS,
                   fine_rows: int = FINE_ROWS) -> tuple[int, list[tuple]]:
    """Segment size and the key that opens each segment of ``max(1, n // segments)`` rows."""
    def size_of(rows: int) -> int:
        return max(1, rows // segments)

    n, keys = keys_at_ranks(df, order, lambda rows: [size_of(rows) * i for i in range(segments + 1)],
                            fine_rows=fine_rows)
    return size_of(n), [keys[r] for r in sorted(keys)]


def error_evolution(df: DataFrame, order: Sequence[str], segments: int = ERROR_SEGMENTS,
                    fine_rows: int = FINE_ROWS) -> DataFrame:
    """Mean absolute error of consecutive equal segments of the table, first ``segments`` only.

    The rows of a segment are recognised by comparing keys with at most eleven boundary keys, so the
    only shuffle is that of ten partial averages per task.
    """
    _, starts = segment_starts(df, order, segments, fine_rows)
    before = [is_before_key(order, _kinds(df, order), start) for start in starts]
    rows = df.where(before[segments]) if len(before) > segments else df
    segment = F.lit(min(len(starts), segments) - 1)
    for number in reversed(range(1, min(len(starts), segments))):
        segment = F.when(before[number], number - 1).otherwise(segment)
    return (rows.select(segment.alias("segment"), F.abs(signed_error()).alias("error"))
            .groupBy("segment").agg(F.avg("error").alias("mean_abs_error")))


def first_rows(df: DataFrame, order: Sequence, limit: int, position: str) -> DataFrame:
    """First ``limit`` rows of an order, numbered from 1: a heap per task, then ``limit`` rows in one."""
    top = df.orderBy(*order).limit(limit)
    return top.withColumn(position, F.row_number().over(Window.orderBy(*order)))


def real_vs_estimated_top(df: DataFrame, order: Sequence[str], limit: int = TOP_ESTIMATES) -> DataFrame:
    """The rows with the smallest estimate, with real and estimated minutes."""
    top = first_rows(df.select(ESTIMATE, TARGET, *order), [ESTIMATE, *order], limit, "x")
    return top.select("x", F.col(TARGET).alias("real"), F.col(ESTIMATE).alias("estimado"))


def rain_levels(df: DataFrame) -> DataFrame:
    """Mean real minutes and number of deliveries at each rain level, over all rows that have both."""
    rows = df.dropna(subset=["lluvia_mm", TARGET])
    return rows.groupBy(F.col("lluvia_mm").alias("lluvia")).agg(F.avg(TARGET).alias("eta"), F.count(F.lit(1)).alias("n"))


def error_levels(df: DataFrame, step: float = 0.5) -> DataFrame:
    """Number of rows in each ``step`` of the signed error, over all rows that have one."""
    return (df.select((F.floor(signed_error() / step) * step).alias("error")).where("error is not null")
            .groupBy("error").agg(F.count(F.lit(1)).alias("n")))


def rain_impact(df: DataFrame, order: Sequence[str], limit: int = RAIN_ROWS) -> DataFrame:
    """The first ``limit`` rows as points, as the published page draws them; ``rain_levels`` has all rows."""
    rows = df.select("lluvia_mm", TARGET, *order).dropna(subset=["lluvia_mm", TARGET])
    top = first_rows(rows, order, limit, "x")
    return top.select("x", F.col("lluvia_mm").alias("lluvia"), F.col(TARGET).alias("eta"))


def error_sample(df: DataFrame, order: Sequence[str], limit: int = ERROR_ROWS) -> DataFrame:
    """The first ``limit`` errors as points; ``error_levels`` and the histogram have all rows."""
    rows = df.select(signed_error().alias("error"), *order)
    return first_rows(rows, order, limit, "x").select("x", "error")
