"""Exact positions in a distributed order, without sorting or shuffling the fact table.

A global ``row_number`` would push every row through one task, and a window per timestamp would
push every row of a hot timestamp through one task. What splits, segments and quantiles really
need is only the *value at a few positions*. That is found by counting: each pass counts rows per
bucket of the remaining interval (a map-side combined aggregate of at most ``BUCKETS`` rows per
position), keeps the bucket that holds the position and looks closer. Once few rows are left they
are counted value by value. The result is exact for any distribution, skew and ties included.
"""

from __future__ import annotations

import datetime as dt
import math
import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from parcelcast.session import local_table

BUCKETS = 1024
FINE_ROWS = 20_000     # intervals with at most this many rows are resolved value by value
MAX_GROUPS = 100_000    # groups (and first-level buckets) that may be returned to the driver
NO_NUMBER = 2 ** 63 - 1     # stands for a missing key of whole numbers or times, which sorts last
LARGEST = sys.float_info.max    # stands for infinity, and for a missing or undefined key of decimals


@dataclass(frozen=True)
class Found:
    """``value`` stands at ``rank`` (from 0) of its group; ``below`` rows are smaller, ``equal`` equal."""
    group: tuple
    rank: int
    value: float | int
    below: int
    equal: int


@dataclass(frozen=True)
class _Cell:
    """``rows`` values from ``low`` to ``high``; ``start`` values of the group are smaller."""
    low: float | int
    high: float | int
    rows: int
    start: int


@dataclass(frozen=True)
class _Interval:
    group: tuple
    cell: _Cell
    ranks: list[int]


def order_statistics(df: DataFrame, columns: Sequence[str], ranks: Callable[[tuple, int], Sequence[int]],
                     by: Sequence[str] = (), coarse: Column | None = None, fine_rows: int = FINE_ROWS,
                     buckets: int = BUCKETS) -> tuple[dict[tuple, int], list[Found]]:
    """Exact values at given ranks of each column within each group of ``by``.

    ``ranks(group, n)`` names the wanted ranks, where ``group`` is ``(column, *by values)`` and ``n``
    its row count without nulls and NaN; infinities come back as plus or minus ``LARGEST``. ``coarse`` is an optional first-level bucket that respects the order and
    has few values (a day for a timestamp); it saves a pass. Whole numbers next to decimals are read as decimals.
    Returns the row count per group and the values found.
    """
    types = dict(df.dtypes)
    kind = "bigint" if all(types[c] in ("tinyint", "smallint", "int", "bigint") for c in columns) else "double"
    number = "cast(`{0}` as bigint)" if kind == "bigint" else "if(isnan(`{0}`), null, if(abs(`{0}`) > {1!r}D, signum(`{0}`) * {1!r}D, cast(`{0}` as double)))"
    pairs = ", ".join(f"'{c}', {number.format(c, LARGEST)}" for c in columns)
    extra = [coarse.alias("_coarse")] if coarse is not None else [F.lit(0).alias("_coarse")]
    tall = df.select(*by, *extra, F.expr(f"stack({len(columns)}, {pairs}) as (_column, _value)"))
    tall = tall.where(F.col("_value").isNotNull())
    keys = ["_column", *by]

    first = (tall.groupBy(*keys, "_coarse")
             .agg(F.count(F.lit(1)).alias("n"), F.min("_value").alias("low"), F.max("_value").alias("high"))
             .limit(MAX_GROUPS + 1).collect())
    if len(first) > MAX_GROUPS and coarse is not None:
        return order_statistics(df, columns, ranks, by, None, fine_rows, buckets)
    if len(first) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups or first-level buckets; group by fewer values")
    grouped: dict[tuple, list] = {}
    for row in first:
        grouped.setdefault(tuple(row[k] for k in keys), []).append(row)

    sizes, open_, found = {}, [], []
    for group, rows in grouped.items():
        start, cells = 0, []
        for row in sorted(rows, key=lambda r: r["low"]):
            cells.append(_Cell(row["low"], row["high"], row["n"], start))
            start += row["n"]
        sizes[group] = start
        wanted = sorted({r for r in ranks(group, start) if 0 <= r < start})
        _assign(cells, group, wanted, open_, found)

    while open_:
        closer: list[_Interval] = []
        for interval, cells in _look_closer(tall, keys, kind, open_, fine_rows, buckets):
            if any(c.rows == interval.cell.rows and (c.low, c.high) == (interval.cell.low, interval.cell.high) for c in cells):
                raise RuntimeError(f"counting does not narrow {interval}")
            _assign(cells, interval.group, interval.ranks, closer, found)
        open_ = closer
    return sizes, found


def _with_infinity(value: float | int) -> float | int:
    return math.copysign(math.inf, value) if isinstance(value, float) and abs(value) == LARGEST else value


def _assign(cells: list[_Cell], group: tuple, ranks: list[int], open_: list[_Interval],
            found: list[Found]) -> None:
    """Give each rank the cell that holds it; a cell of one single value is the answer."""
    for cell in cells:
        inside = [r for r in ranks if cell.start <= r < cell.start + cell.rows]
        if not inside:
            continue
        if cell.low == cell.high:
            found.extend(Found(group, r, cell.low, cell.start, cell.rows) for r in inside)
        else:
            open_.append(_Interval(group, cell, inside))


def _look_closer(tall: DataFrame, keys: list[str], kind: str, intervals: list[_Interval],
                 fine_rows: int, buckets: int) -> list[tuple[_Interval, list[_Cell]]]:
    """One pass over the data: the cells inside each interval that hold a wanted rank."""
    spark = tall.sparkSession
    value_type = T.LongType() if kind == "bigint" else T.DoubleType()
    fields = [T.StructField(f"_g{i}", tall.schema[k].dataType) for i, k in enumerate(keys)]
    fields += [T.StructField("_state", T.IntegerType()), T.StructField("_low", value_type),
               T.StructField("_high", value_type), T.StructField("_halve", T.BooleanType()),
               T.StructField("_fine", T.BooleanType())]
    held = T.StructType([T.StructField("_state", T.IntegerType()), T.StructField("_begin", T.LongType()),
                         T.StructField("_ranks", T.ArrayType(T.LongType()))])
    rows = []
    for number, i in enumerate(intervals):
        span = i.cell.high - i.cell.low
        halve = span >= 2 ** 62 if kind == "bigint" else math.isinf(span)   # else the difference overflows
        rows.append((*i.group, number, i.cell.low, i.cell.high, halve, i.cell.rows <= fine_rows))
    # Bounded by groups x ranks, both named by the caller and checked above: safe to broadcast.
    states = F.broadcast(local_table(spark, rows, T.StructType(fields)))
    condition = F.col("_value").between(F.col("_low"), F.col("_high"))
    for i, k in enumerate(keys):
        condition = condition & F.col(f"_g{i}").eqNullSafe(F.col(k))
    inside = tall.join(states, condition)

    half = "shiftright({0}, 1)" if kind == "bigint" else "{0} * 0.5D"
    part = {c: F.when(F.col("_halve"), F.expr(half.format(c))).otherwise(F.col(c))
            for c in ("_value", "_low", "_high")}
    share = ((part["_value"] - part["_low"]).cast("double")
             / (part["_high"] - part["_low"]).cast("double"))
    bucket = F.least(F.lit(buckets - 1), F.floor(share * buckets).cast("int"))
    counted = (inside.select("_state", "_value",
                             F.when(F.col("_fine"), F.lit(-1)).otherwise(bucket).alias("_bucket"),
                             F.when(F.col("_fine"), F.col("_value")).alias("_exact"))
               .groupBy("_state", "_bucket", "_exact")
               .agg(F.count(F.lit(1)).alias("n"), F.min("_value").alias("low"), F.max("_value").alias("high")))
    wanted = local_table(spark, [(k, i.cell.start, i.ranks) for k, i in enumerate(intervals)], held)
    counted = counted.join(F.broadcast(wanted), "_state")     # as many rows as ``states``
    # Per state at most max(BUCKETS, FINE_ROWS) aggregated rows reach this window.
    smaller = Window.partitionBy("_state").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("start", F.col("_begin") + F.coalesce(F.sum("n").over(smaller), F.lit(0)))
    holds = F.exists("_ranks", lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("n")))
    cells: dict[int, list[_Cell]] = {}
    for row in placed.where(holds).select("_state", "low", "high", "n", "start").collect():
        cells.setdefault(row["_state"], []).append(_Cell(row["low"], row["high"], row["n"], row["start"]))
    return [(interval, cells.get(number, [])) for number, interval in enumerate(intervals)]


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float],
                    by: Sequence[str] = (), **options) -> dict[tuple, dict[float, float]]:
    """Linearly interpolated quantiles per ``(column, *by)``, exact at any size."""
    def wanted(_group, n):
        places = [p * (n - 1) for p in probabilities]
        return [f(x) for x in places for f in (math.floor, math.ceil)]

    sizes, found = order_statistics(df, columns, wanted, by=by, **options)
    at = {(f.group, f.rank): _with_infinity(f.value) for f in found}
    out: dict[tuple, dict[float, float]] = {}
    for group, n in sizes.items():
        for p in probabilities:
            place = p * (n - 1)
            low, high = at[group, math.floor(place)], at[group, math.ceil(place)]
            share = place - math.floor(place)
            out.setdefault(group, {})[p] = low if low == high or share == 0 else low + (high - low) * share
    return out


def keys_at_ranks(df: DataFrame, keys: Sequence[str], ranks: Callable[[int], Sequence[int]],
                  fine_rows: int = FINE_ROWS, buckets: int = BUCKETS) -> tuple[int, dict[int, tuple]]:
    """The key tuples at given ranks of the order by ``keys``; returns ``(row count, {rank: tuple})``.

    Resolved key by key: first the leading value at each rank, then the next key among the rows that
    share that value, so even a leading value held by a third of all rows is only ever counted.
    The full key must be unique at the ranks asked for; otherwise this raises ValueError.
    """
    typed = {name: kind for name, kind in df.dtypes}
    numbers = {k: _as_number(F.col(k), typed[k]) for k in keys}
    narrow = df.select([c.alias(k) for k, c in numbers.items()])
    leading_day = (F.expr(f"`{keys[0]}` div 86400000000")
                   if typed[keys[0]].startswith("timestamp") else None)
    done: dict[int, tuple] = {}
    prefixes: dict[tuple, dict[int, int]] = {}          # prefix values -> {rank: rank inside the prefix}
    total = 0
    for depth, key in enumerate(keys):
        by = list(keys[:depth])
        source = narrow if depth == 0 else _with_prefix(narrow, by, prefixes)
        inner = {p: {r: inside for r, inside in wanted.items()} for p, wanted in prefixes.items()}
        sizes, found = order_statistics(
            source, [key],
            (lambda _g, n: ranks(n)) if depth == 0 else (lambda g, _n: inner[g[1:]].values()),
            by=by, coarse=leading_day if depth == 0 else None, fine_rows=fine_rows, buckets=buckets)
        if depth == 0:
            total = sum(sizes.values())
            inner = {(): {r: r for r in ranks(total) if 0 <= r < total}}
        at = {(f.group[1:], f.rank): f for f in found}
        unresolved: dict[tuple, dict[int, int]] = {}
        small = True
        for prefix, wanted in inner.items():
            for rank, inside in wanted.items():
                hit = at[prefix, inside]
                unresolved.setdefault((*prefix, hit.value), {})[rank] = inside - hit.below
                small = small and hit.equal <= fine_rows
        prefixes = unresolved
        if small and depth + 1 < len(keys):
            done = _resolve_small(narrow, list(keys), depth + 1, prefixes)
            break
        if depth + 1 == len(keys):
            if any(f.equal > 1 for f in found):
                raise ValueError(f"rows with equal {list(keys)} stand at a wanted rank; add a unique key")
            done = {rank: prefix for prefix, wanted in prefixes.items() for rank in wanted}
        if not prefixes:
            break
    return total, {rank: tuple(_from_number(v, typed[k]) for v, k in zip(values, keys))
                   for rank, values in done.items()}


def _with_prefix(narrow: DataFrame, by: list[str], prefixes: dict) -> DataFrame:
    schema = T.StructType([narrow.schema[c] for c in by])
    # One row per wanted rank at most: safe to broadcast.
    chosen = F.broadcast(local_table(narrow.sparkSession, list(prefixes), schema))
    return narrow.join(chosen, by, "left_semi")


def _resolve_small(narrow: DataFrame, keys: list[str], depth: int, prefixes: dict) -> dict[int, tuple]:
    """Rank the at most FINE_ROWS rows of each prefix by the remaining keys."""
    if not prefixes:
        return {}
    by, rest = keys[:depth], keys[depth:]
    schema = T.StructType([*[T.StructField(f"_p{i}", narrow.schema[c].dataType) for i, c in enumerate(by)],
                           T.StructField("_inside", T.LongType()), T.StructField("_rank", T.LongType())])
    wanted = [(*p, inside, rank) for p, ranks in prefixes.items() for rank, inside in ranks.items()]
    targets = F.broadcast(local_table(narrow.sparkSession, wanted, schema))
    order = Window.partitionBy(*by).orderBy(*rest)
    ranked = (_with_prefix(narrow, by, prefixes)
              .select(*keys, (F.row_number().over(order) - 1).alias("_place"),
                      F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_copies")))
    condition = F.col("_place") == F.col("_inside")
    for i, c in enumerate(by):
        condition = condition & (F.col(c) == F.col(f"_p{i}"))
    rows = ranked.join(targets, condition).collect()
    if any(r["_copies"] > 1 for r in rows):
        raise ValueError(f"rows with equal {keys} stand at a wanted rank; add a unique key")
    return {r["_rank"]: tuple(r[k] for k in keys) for r in rows}


def _as_number(column: Column, kind: str) -> Column:
    """Order-keeping number of a key; missing keys are the largest at every depth."""
    if kind == "timestamp":
        return F.coalesce(F.unix_micros(column), F.lit(NO_NUMBER))
    if kind == "timestamp_ntz":     # wall-clock arithmetic, so that no session time zone gets in
        seconds = F.unix_date(column.cast("date")).cast("bigint") * 86400 + F.hour(column) * 3600 + F.minute(column) * 60
        return F.coalesce(seconds * 1_000_000 + (F.extract(F.lit("SECOND"), column) * 1_000_000).cast("bigint"), F.lit(NO_NUMBER))
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.coalesce(column.cast("bigint"), F.lit(NO_NUMBER))
    if kind in ("float", "double"):
        known = F.coalesce(F.nanvl(column.cast("double"), F.lit(None)), F.lit(LARGEST))
        return F.greatest(F.least(known, F.lit(LARGEST)), F.lit(-LARGEST))
    raise TypeError(f"order columns must be timestamps or numbers, got {kind}")


def _from_number(value, kind: str):
    if value == (LARGEST if isinstance(value, float) else NO_NUMBER):
        return None
    value = _with_infinity(value)
    if kind.startswith("timestamp"):
        return dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=value)
    return value


def typed_literal(value, kind: str) -> Column:
    """Literal of exactly the column's type, so that comparisons need no cast and reach the scan."""
    if kind == "timestamp":
        return F.to_timestamp(F.lit(value.isoformat(sep=" ") + "+00:00"))
    if kind == "timestamp_ntz":
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value).cast(kind)


def is_before_key(order: Sequence[str], kinds: Sequence[str], values: tuple) -> Column:
    """Whether a row's key tuple is smaller than ``values``; missing keys are larger than all others.

    Written as nested comparisons: nearly every row is decided by the leading key alone. None in
    ``values`` is a missing key (infinity and NaN count as missing in decimals).
    """
    before = F.lit(False)
    for name, kind, value in reversed(list(zip(order, kinds, values))):
        if value is None:
            largest = F.lit(LARGEST if kind in ("float", "double") else NO_NUMBER)
            known = _as_number(F.col(name), kind) < largest
            before = known | before
        else:
            literal = typed_literal(value, kind)
            before = F.coalesce((F.col(name) < literal) | ((F.col(name) == literal) & before), F.lit(False))
    return before
