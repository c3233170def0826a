"""Projected month: demand, expected delivery time and delay risk by day and zone."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from parcelcast.functions.columns import eta_formula, late_flag, percent_of_rows
from parcelcast.operators.kpi import top_zones
from parcelcast.operators.registry import model_metric
from parcelcast.operators.requests import scenario_features
from parcelcast.schema import (COMPARED, DAILY, DAY_SAMPLE, DEFAULT_MODEL, DEMAND_PER_SAMPLE, ESTIMATE, KPIS_FUTURE,
                               MIN_BASE_DEMAND, MIN_DAY_DEMAND, ON_TIME_MIN, POOL_PER_SAMPLE,
                               PREDICTION_FLOOR, SCENARIO_DEFAULTS, TARGET, TOP_ZONES, ZONE_SAMPLE)
from parcelcast.session import ROW_ID, pin

Predictor = Callable[[DataFrame], DataFrame]      # feature rows -> the same rows with ``prediction``

MAX_DAYS = 100_000                # distinct calendar days in a history
WEEKS = 5                         # a weekday occurs at most five times in a month
DAY_RANKS = WEEKS * DAY_SAMPLE[1]
ANY_DAY = -1                      # pool of a weekday without history: all rows
OVERDRAW = 16                     # expected rows per wanted row that pass the hash threshold


def formula_predictor(rows: DataFrame) -> DataFrame:
    return rows.withColumn("prediction", F.greatest(eta_formula(), F.lit(PREDICTION_FLOOR)))


def demand_profile(pool: DataFrame) -> DataFrame:
    """Rows per calendar day: the only full aggregate that all demand figures need."""
    return (pool.where(F.col("dia_semana").isNotNull())
            .groupBy("anio", "mes", "dia", "dia_semana").agg(F.count(F.lit(1)).alias("n")))


def weekday_factor(profile: DataFrame) -> DataFrame:
    """Rows per weekday over the mean of the weekdays that occur (at least 1)."""
    per_day = profile.groupBy("dia_semana").agg(F.sum("n").alias("n"))
    mean = F.avg("n").over(Window.partitionBy())      # at most seven rows
    return per_day.select("dia_semana", "n", (F.col("n") / F.greatest(mean, F.lit(1.0))).alias("factor"))


def demand_base(profile: DataFrame, mode: str = "per_day_of_month") -> DataFrame:
    """Typical demand of one day.

    'per_day_of_month' divides the rows by the number of different days of the month (the published
    behaviour), 'per_calendar_day' by the number of different dates.
    """
    days = {"per_day_of_month": F.count_distinct("dia"), "per_calendar_day": F.count(F.lit(1))}[mode]
    mean = F.coalesce(F.sum("n"), F.lit(0)) / F.greatest(days, F.lit(1))
    return profile.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), days.alias("days"),
                       F.greatest(F.rint(mean), F.lit(float(MIN_BASE_DEMAND))).cast("bigint").alias("demand_base"))


def calendar(spark: SparkSession, year: int, month: int) -> DataFrame:
    """Days of the month with weekday (Monday is 0) and how often that weekday occurred before."""
    first = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    days = spark.range(1).select(F.explode(F.sequence(first, F.last_day(first))).alias("date"))
    day = F.dayofmonth("date")
    return days.select(day.alias("day"), F.weekday("date").alias("dow"),
                       ((day - 1) / 7).cast("int").alias("week"))


def daily_demand(profile: DataFrame, year: int, month: int, mode: str = "per_day_of_month") -> DataFrame:
    """Demand of each day of the month and the sample size it asks for."""
    factors = weekday_factor(profile).select("dia_semana", "factor", F.col("n").alias("pool_rows"))
    base = demand_base(profile, mode)
    raw = F.rint(base.select("demand_base").scalar() * F.coalesce("factor", F.lit(1.0)))
    demand = F.greatest(raw, F.lit(float(MIN_DAY_DEMAND))).cast("bigint")
    low, high = DAY_SAMPLE
    days = calendar(profile.sparkSession, year, month).join(
        F.broadcast(factors), F.col("dow") == F.col("dia_semana"), "left")
    sized = F.least(F.greatest(F.floor(demand / DEMAND_PER_SAMPLE), F.lit(low)), F.lit(high))
    return days.select("day", "dow", "week", demand.alias("demand_predicted"),
                       sized.cast("int").alias("sample_rows"),
                       F.when(F.col("pool_rows").isNull(), ANY_DAY).otherwise(F.col("dow")).alias("pool"),
                       F.coalesce("pool_rows", base.select("n").scalar()).alias("pool_rows"))


def lowest_hashes(df: DataFrame, group: str, row_hash: str, limit: int, sizes: dict) -> DataFrame:
    """The ``limit`` rows with the smallest hash of every group, numbered from 0.

    ``row_hash`` is an md5 text; ``sizes`` the rows per group. A threshold on the hash lets about
    ``OVERDRAW * limit`` rows per group through, so that neither sort nor shuffle grows with the
    table; the window limits again inside each task before its shuffle. Should hash values be so
    repetitive that a group falls short, the rows are ranked without the threshold.
    """
    order = Window.partitionBy(group).orderBy(row_hash, *_tie(df))

    def ranked(rows: DataFrame) -> DataFrame:
        numbered = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
        return numbered.withColumn("rank", F.col("rank") - 1)

    wanted = {g: min(limit, n) for g, n in sizes.items()}
    if not wanted:
        return ranked(df.where(F.lit(False)))
    # Hexadecimal texts order like their numbers; 'g' is above every digit and lets all rows through.
    bound = {g: f"{16 ** 15 * OVERDRAW * limit // n:015x}" if n > OVERDRAW * limit else "g" for g, n in sizes.items()}
    pairs = [F.lit(x) for pair in bound.items() for x in pair]
    below = F.col(row_hash) < F.try_element_at(F.create_map(*pairs), F.col(group))
    rows_at_most = limit * len(wanted)
    chosen = pin(ranked(df.where(below)), rows_at_most)
    got = {r[group]: r["n"] for r in chosen.groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(got.get(g, 0) < n for g, n in wanted.items()):
        chosen = pin(ranked(df.where(F.col(group).isin(list(wanted)))), rows_at_most)
    return chosen


@dataclass(frozen=True)
class Projection:
    """A projected month: scored rows, their daily figures, and the history they came from."""
    label: str
    scored: DataFrame
    daily: DataFrame
    profile: DataFrame
    pool: DataFrame


def project_month(pool: DataFrame, year: int, month: int, predictor: Predictor,
                  row_hash: str = "row_hash", mode: str = "full",
                  demand_mode: str = "per_day_of_month") -> Projection:
    """Score all past rows of each day's weekday or, with mode='sample', the published sample of them by hash.

    ``pool`` has the delivery columns and date parts; a sample also needs an md5 text ``row_hash``.
    """
    profile = pin(demand_profile(pool), MAX_DAYS)
    if profile.isEmpty():
        raise ValueError("there are no dated rows to project from")
    days = pin(daily_demand(profile, year, month, demand_mode), 31)
    columns = _feature_columns(pool)
    known = pool.where(F.col("dia_semana").isNotNull())
    if mode == "sample":
        rows = _sampled_days(known.select(F.col("dia_semana").alias("pool"), row_hash, *_tie(known), *columns),
                             days, profile, row_hash)
    elif mode == "full":
        rows = known.select(F.col("dia_semana").alias("pool"), *columns)
        if days.where(F.col("pool") == ANY_DAY).count():
            rows = rows.unionByName(rows.withColumn("pool", F.lit(ANY_DAY)))
        rows = rows.join(F.broadcast(days), "pool").withColumn("i", F.lit(0))   # at most 31 days
    else:
        raise ValueError(f"mode must be 'sample' or 'full', got {mode!r}")
    keep = ["day", "i", "demand_predicted"]
    features = scenario_features(rows, year, month, F.col("day"), F.col("dow"), keep=keep)
    scored = predictor(features).select(*keep, "nivel_trafico", "prediction")
    return Projection(f"{year}-{month:02d}", scored, _daily(scored), profile, pool)


def _tie(rows: DataFrame) -> list[str]:
    """What tells copies of a row apart, where it is there."""
    return [c for c in (ROW_ID,) if c in rows.columns]


def _feature_columns(pool: DataFrame) -> list[str]:
    return [c for c in (*SCENARIO_DEFAULTS, "eficiencia_estimacion") if c in pool.columns]


def _sampled_days(rows: DataFrame, days: DataFrame, profile: DataFrame, row_hash: str) -> DataFrame:
    """The k-th occurrence of a weekday takes the k-th block of its hash order, wrapping around."""
    sizes = {r["dia_semana"]: r["n"] for r in weekday_factor(profile).collect()}
    by_day = lowest_hashes(rows, "pool", row_hash, DAY_RANKS, sizes)
    # The lowest hashes of all rows are among the lowest hashes of the weekdays.
    any_day = (by_day.withColumn("rank", F.row_number().over(Window.orderBy(row_hash, *_tie(by_day))) - 1)
               .where(F.col("rank") < DAY_RANKS).withColumn("pool", F.lit(ANY_DAY)))
    ranked = by_day.unionByName(any_day)
    slots = days.select("day", "dow", "pool", "week", "sample_rows", "pool_rows", "demand_predicted",
                        F.explode(F.sequence(F.lit(0), F.col("sample_rows") - 1)).alias("i"))
    slots = slots.withColumn("rank", (F.col("week") * F.col("sample_rows") + F.col("i")) % F.col("pool_rows"))
    return slots.join(ranked, ["pool", "rank"])


def _daily(scored: DataFrame) -> DataFrame:
    on_time = percent_of_rows(F.col("prediction") <= ON_TIME_MIN)
    per_day = scored.groupBy("day").agg(
        F.avg("prediction").alias("eta_expected"), on_time.alias("otif_expected"),
        F.max("demand_predicted").alias("demand_predicted"), F.avg("nivel_trafico").alias("traffic_expected"))
    late = 100.0 - F.col("otif_expected")
    return per_day.withColumn("delays_expected", late).withColumn("risk_delay", late).select(*DAILY)


def zone_risk(pool: DataFrame, year: int, month: int, predictor: Predictor,
              row_hash: str = "row_hash", mode: str = "full") -> DataFrame:
    """Share of late predictions and mean prediction in the zones with most rows, mid-month."""
    pool = pool.select(*([row_hash, *_tie(pool)] if mode == "sample" else []), *_feature_columns(pool))
    zones = pin(top_zones(pool, TOP_ZONES), TOP_ZONES)
    sizes = {r["localidad"]: r["n"] for r in zones.collect()}
    inside = pool.where(F.col("localidad").isin(list(sizes)))
    if mode == "sample":
        low, high = ZONE_SAMPLE
        ranked = lowest_hashes(inside, "localidad", row_hash, high, sizes)
        size = F.least(F.greatest(F.floor(F.col("n") / POOL_PER_SAMPLE), F.lit(low)), F.lit(high)).cast("int")
        slots = zones.select("localidad", "n", F.explode(F.sequence(F.lit(0), size - 1)).alias("i"))
        slots = slots.select("localidad", (F.col("i") % F.col("n")).alias("rank"))
        inside = slots.join(ranked, ["localidad", "rank"])
    scored = predictor(scenario_features(inside, year, month, 15, 2))
    return scored.groupBy("localidad").agg((F.avg(late_flag("prediction")) * 100.0).alias("riesgo"),
                                           F.avg("prediction").alias("eta"))


def scenario_summary(projection: Projection) -> DataFrame:
    """Month totals: plain means over the days."""
    year, month = projection.label.split("-")
    return projection.daily.agg(
        F.lit(projection.label).alias("horizon"), F.lit(month).alias("month"), F.lit(int(year)).alias("year"),
        F.avg("eta_expected").alias("eta_expected_mean"), F.avg("otif_expected").alias("otif_expected"),
        F.avg("delays_expected").alias("delays_expected"),
        F.sum("demand_predicted").cast("bigint").alias("demand_month_predicted"),
        F.avg("demand_predicted").alias("demand_daily_predicted_mean"))


def kpis_future(projection: Projection, registry: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    return scenario_summary(projection).select(
        F.lit(model).alias("model_name"), F.col("eta_expected_mean").alias("eta_mean"),
        F.col("otif_expected").alias("otif"), F.col("delays_expected").alias("delays_pct"),
        F.col("demand_month_predicted").alias("n_records"), "horizon", "demand_month_predicted",
        "demand_daily_predicted_mean",
        *[F.coalesce(model_metric(registry, model, m), F.lit(0.0)).alias(m) for m in ("mae", "rmse", "mape")]
    ).select(*KPIS_FUTURE)


def traffic_risk_points(projection: Projection) -> DataFrame:
    return projection.daily.select("day", F.col("traffic_expected").alias("traffic"),
                                   F.col("risk_delay").alias("risk"), F.col("demand_predicted").alias("demand"))


def historical_vs_predicted(projection: Projection) -> DataFrame:
    """Daily demand, mean time and late share: history next to projection.

    Without a real time the history is judged by the estimate.
    """
    eta = TARGET if TARGET in projection.pool.columns else ESTIMATE
    past = projection.pool.agg(F.avg(eta).alias("eta"), percent_of_rows(F.col(eta) > ON_TIME_MIN).alias("late"))
    demand = projection.profile.agg(F.rint(F.sum("n") / F.greatest(F.count_distinct("dia"), F.lit(1))).alias("demand"))
    history = [demand.scalar(), past.select("eta").scalar(), past.select("late").scalar()]
    rows = [F.struct(F.lit(i + 1).alias("position"), F.lit(name).alias("metric"), before.alias("historical"),
                     F.avg(ahead).alias("predicted"))
            for i, (name, before, ahead) in enumerate(zip(
                COMPARED, history, ("demand_predicted", "eta_expected", "delays_expected")))]
    return projection.daily.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def eta_distribution(projection: Projection) -> DataFrame:
    """Scored deliveries per whole minute of the prediction: a few hundred rows at any size."""
    return projection.scored.groupBy(F.floor("prediction").alias("eta")).agg(F.count(F.lit(1)).alias("n"))


def eta_points(projection: Projection) -> DataFrame:
    """Every scored delivery, as the published page draws its sample."""
    return projection.scored.select("day", "i", F.col("prediction").alias("eta"))
