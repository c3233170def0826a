"""Column expressions: dates, ratios, clipping, flags, errors, lookups, names.

Everything here stays inside generated JVM code; there is no Python UDF in the package.
"""

from __future__ import annotations

import calendar
import datetime as dt
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from parcelcast.schema import (BASE_MINUTES, ESTIMATE, ESTIMATED_MINUTES_PER_TRAFFIC, MINUTES_PER_KM,
                               MINUTES_PER_RAIN_MM, MINUTES_PER_SLOPE, MINUTES_RANGE, MODEL_NAME_FRAGMENTS,
                               ON_TIME_MIN, PEAK_HOURS, RAINY_MONTHS, REAL_MINUTES_PER_TRAFFIC, ROAD_MINUTES,
                               TARGET, TIMESTAMP)


def parse_timestamp(text: str | Column, fmt: str | None = None) -> Column:
    col = F.col(text) if isinstance(text, str) else text
    return F.try_to_timestamp(col, F.lit(fmt)) if fmt else F.try_to_timestamp(col)


def date_features(df: DataFrame, ts: str = TIMESTAMP) -> DataFrame:
    """Adds anio, mes, dia and dia_semana (Monday is 0)."""
    return df.withColumns({
        "anio": F.year(ts), "mes": F.month(ts), "dia": F.dayofmonth(ts), "dia_semana": F.weekday(ts),
    })


def ratio(numerator: str, denominator: str) -> Column:
    """Null where the denominator is zero or the quotient is not finite."""
    quotient = F.try_divide(F.col(numerator), F.col(denominator))
    return F.when(F.abs(quotient) < F.lit(float("inf")), quotient)


def eta_formula() -> Column:
    """Expected real minutes from the features, clipped to the physical range."""
    minutes = (_route_minutes(REAL_MINUTES_PER_TRAFFIC) + F.col("lluvia_mm") * MINUTES_PER_RAIN_MM
               + F.col("pendiente_promedio") * MINUTES_PER_SLOPE + road_minutes())
    return clip(minutes, *MINUTES_RANGE)


def baseline_eta() -> Column:
    """The estimate: route minutes only."""
    return _route_minutes(ESTIMATED_MINUTES_PER_TRAFFIC)


def _route_minutes(per_traffic: float) -> Column:
    return F.lit(BASE_MINUTES) + F.col("distancia_km") * MINUTES_PER_KM + F.col("nivel_trafico") * per_traffic


def road_minutes(column: str = "tipo_via", unknown: float | None = 0.0) -> Column:
    """Minutes of a road type; a four-entry literal map needs no join. ``unknown=None`` gives null."""
    pairs = [F.lit(x) for pair in ROAD_MINUTES.items() for x in pair]
    found = F.try_element_at(F.create_map(*pairs), F.col(column))
    return found if unknown is None else F.coalesce(found, F.lit(unknown))


def clip(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), value)))


def is_peak_hour(ts: str) -> Column:
    hour = F.hour(ts)
    return reduce(or_, [hour.between(*span) for span in PEAK_HOURS]).cast("int")


def is_rainy_month(ts: str) -> Column:
    return F.month(ts).isin(RAINY_MONTHS).cast("int")


def signed_error(real: str = TARGET, estimate: str = ESTIMATE) -> Column:
    return F.col(real) - F.col(estimate)


def late_flag(eta: str | Column, limit: float = ON_TIME_MIN) -> Column:
    col = F.col(eta) if isinstance(eta, str) else eta
    return (col > limit).cast("int")


def percent_of_rows(condition: Column) -> Column:
    """Share of all rows, null conditions counted in the denominator only; null for an empty input."""
    return F.try_divide(F.count_if(condition) * F.lit(100.0), F.count(F.lit(1)))


def whole(value: Column) -> Column:
    """Cast to int, truncating toward zero; unparsable text becomes null."""
    return value.try_cast("double").try_cast("int")


def normalize_model_name(name: str | Column) -> Column:
    """Short model name: the first known fragment found in the lower-cased registry name."""
    lowered = F.lower(F.col(name) if isinstance(name, str) else name)
    chain = None
    for fragment, short in MODEL_NAME_FRAGMENTS:
        hit = lowered.contains(fragment)
        chain = F.when(hit, short) if chain is None else chain.when(hit, short)
    return chain.otherwise(lowered)


def following_month(today: str | Column) -> Column:
    """First day of the calendar month after ``today``."""
    return F.add_months(F.trunc(today, "MM"), 1)


def month_label(day: str | Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def target_month(month: str | None, today: dt.date | None = None) -> tuple[int, int, str]:
    """Resolve 'YYYY-MM' (or the month after ``today``) to year, month and label."""
    if month:
        pieces = month.split("-")
        if len(pieces) != 2 or not all(p.isdigit() for p in pieces):
            raise ValueError(f"month must look like YYYY-MM, got {month!r}")
        year, number = (int(p) for p in pieces)
        if not 1 <= number <= 12:
            raise ValueError(f"month must be between 01 and 12, got {month!r}")
    else:
        start = (today or dt.date.today()).replace(day=1)
        after = start + dt.timedelta(days=calendar.monthrange(start.year, start.month)[1])
        year, number = after.year, after.month
    return year, number, f"{year}-{number:02d}"
