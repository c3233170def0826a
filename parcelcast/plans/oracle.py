"""Independent SQL (DuckDB dialect) for the registered queries, over the same tables."""

from __future__ import annotations

from parcelcast.schema import CATEGORICAL, KNOWN_ZONES, NUMERIC

KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
ORDER = "fecha_pedido, " + KEYS

DELIVERIES = f"""
deliveries as (
  select {KEYS}, o_orderdate as fecha_pedido, n_name as localidad, cast(p_size % 6 + 1 as integer) as estrato,
    case l_linenumber % 4 when 0 then 'Troncal' when 1 then 'Arterial' when 2 then 'Local' else 'Destapada' end as tipo_via,
    c_mktsegment as tipo_zona, o_orderpriority as vehiculo,
    greatest(0.5e0, l_quantity * 0.12e0) as distancia_km,
    0.2e0 + l_discount * 8e0 as nivel_trafico,
    l_tax * 50e0 as lluvia_mm,
    p_size * 0.16e0 as pendiente_promedio,
    (cast(round(o_totalprice * 100e0) as bigint) % 101) / 100e0 as zona_riesgo,
    cast(case when l_returnflag = 'R' then 1 else 0 end as integer) as cliente_ausente,
    cast(case o_orderstatus when 'F' then 1 when 'O' then 2 else 3 end as integer) as intentos_entrega,
    20e0 + greatest(0.5e0, l_quantity * 0.12e0) * 2.5e0 + (0.2e0 + l_discount * 8e0) * 20e0 as tiempo_estimado_min,
    least(180e0, greatest(8e0,
      20e0 + greatest(0.5e0, l_quantity * 0.12e0) * 2.5e0 + (0.2e0 + l_discount * 8e0) * 30e0
      + l_tax * 50e0 * 1.8e0 + p_size * 0.16e0 * 0.7e0
      + case l_linenumber % 4 when 0 then 0e0 when 1 then 5e0 when 2 then 9e0 else 20e0 end
      + (cast(round(l_extendedprice * 100e0) as bigint) % 1001) / 100e0 - 5e0)) as tiempo_real_min
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey join part on l_partkey = p_partkey),
dated as (
  select *, cast(year(fecha_pedido) as integer) as anio, cast(month(fecha_pedido) as integer) as mes,
    cast(day(fecha_pedido) as integer) as dia, cast(isodow(fecha_pedido) - 1 as integer) as dia_semana,
    tiempo_estimado_min / distancia_km as eficiencia_estimacion,
    md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,
        cast(round(l_extendedprice * 100e0) as bigint))) as row_hash,
    row_number() over (order by {ORDER}) - 1 as pos, count(*) over () as total
  from deliveries),
train as (select * from dated where pos < floor(total * 0.8e0)),
validation as (select * from dated where pos >= floor(total * 0.8e0))
"""

REQUESTS = f"""
requests as (
  select {KEYS},
    case l_linenumber when 1 then 'Kennedy' when 2 then 'Suba' when 3 then 'Bosa' when 4 then 'Usme'
      when 5 then 'Tunjuelito' when 6 then 'Chapinero' end as localidad,
    case when l_partkey % 50 = 0 then 0e0 else l_quantity end as distancia_km,
    l_discount * 60e0 as nivel_trafico,
    case when l_tax > 0 then l_tax * 1500e0 end as lluvia_mm,
    cast(case when l_suppkey % 9 <> 3 then l_suppkey % 9 end as integer) as estrato,
    case when l_linestatus = 'F' then 'Local' end as tipo_via,
    l_extendedprice / 200e0 as tiempo_estimado_min
  from lineitem)
"""

REGISTRY = """
moments as (
  select count(*) as n, avg(tiempo_real_min) as my, avg(distancia_km) as md, covar_pop(tiempo_real_min, distancia_km) * count(*) / (var_pop(distancia_km) * count(*) + 1e0) as wd,
    avg(nivel_trafico) as mt, covar_pop(tiempo_real_min, nivel_trafico) * count(*) / (var_pop(nivel_trafico) * count(*) + 1e0) as wt,
    avg(lluvia_mm) as mr, covar_pop(tiempo_real_min, lluvia_mm) * count(*) / (var_pop(lluvia_mm) * count(*) + 1e0) as wr,
    avg(tiempo_estimado_min) as me, covar_pop(tiempo_real_min, tiempo_estimado_min) * count(*) / (var_pop(tiempo_estimado_min) * count(*) + 1e0) as we
  from train),
tall as (
  select 0 as m, tiempo_real_min as y, my + (distancia_km - md) * wd as p, n from validation cross join moments
  union all select 1 as m, tiempo_real_min as y, my + (nivel_trafico - mt) * wt as p, n from validation cross join moments
  union all select 2 as m, tiempo_real_min as y, my + (lluvia_mm - mr) * wr as p, n from validation cross join moments
  union all select 3 as m, tiempo_real_min as y, my + (tiempo_estimado_min - me) * we as p, n from validation cross join moments),
raw_registry as (
  select m::bigint as ord, case m when 0 then 'Linear Regression on distance' when 1 then 'Ridge on traffic'
      when 2 then 'Ridge on rain' else 'Ridge on estimate' end as model_name,
    avg(abs(y - p)) as mae, avg((y - p) * (y - p)) as mse, sqrt(avg((y - p) * (y - p))) as rmse,
    avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16)) as mape, any_value(n) as n_train,
    count(*) as n_validation
  from tall group by m),
registry as (
  select case m when 0 then 'linear' when 1 then 'ridge on traffic' when 2 then 'ridge on rain' else 'ridge on estimate' end as model_name,
    ord, mae, mse, rmse, mape, n_train, n_validation
  from (select ord as m, * from raw_registry))
"""

DEMAND = """
profile as (select anio, mes, dia, dia_semana, count(*) as n from validation group by all),
weekdays as (select dia_semana, sum(n)::bigint as n from profile group by 1),
factors as (select dia_semana, n, n / greatest((select avg(n) from weekdays), 1e0) as factor from weekdays),
base as (
  select sum(n)::bigint as n, count(distinct dia) as days,
    greatest(round_even(sum(n)::double / greatest(count(distinct dia), 1), 0), 40e0)::bigint as demand_base
  from profile),
month_days as (
  select cast(day(d) as integer) as day, cast(isodow(d) - 1 as integer) as dow, cast((day(d) - 1) // 7 as integer) as week
  from (select unnest(generate_series(timestamp '2024-02-01', timestamp '2024-02-29', interval 1 day)) as d)),
demand as (
  select day, dow, week, greatest(round_even(demand_base * coalesce(factor, 1e0), 0), 20e0)::bigint as demand_predicted,
    f.n as pool_rows
  from month_days left join factors f on dow = f.dia_semana cross join base),
days as (
  select *, cast(least(greatest(demand_predicted // 20, 10), 28) as integer) as sample_rows from demand)
"""

SAMPLED_ROWS = """
features as (
  select row_hash, pos, dia_semana, localidad, tipo_via,
    case when nivel_trafico = 0 then 2e0 else nivel_trafico end as nivel_trafico,
    least(180e0, greatest(8e0, 20e0 + case when distancia_km = 0 then 5e0 else distancia_km end * 2.5e0
      + case when nivel_trafico = 0 then 2e0 else nivel_trafico end * 30e0 + lluvia_mm * 1.8e0
      + case when pendiente_promedio = 0 then 0.5e0 else pendiente_promedio end * 0.7e0
      + case tipo_via when 'Troncal' then 0e0 when 'Arterial' then 5e0 when 'Local' then 9e0 else 20e0 end)) as eta
  from validation),
ranked as (select *, row_number() over (partition by dia_semana order by row_hash) - 1 as rank from features),
slots as (select d.*, unnest(generate_series(0, sample_rows - 1)) as i from days d),
scored as (
  select s.day, cast(s.i as integer) as i, s.demand_predicted, r.nivel_trafico, r.eta
  from slots s join ranked r on r.dia_semana = s.dow and r.rank = (s.week * s.sample_rows + s.i) % s.pool_rows),
daily as (
  select day, avg(eta) as eta_expected, avg(case when eta <= 60 then 100e0 else 0e0 end) as otif_expected,
    100e0 - avg(case when eta <= 60 then 100e0 else 0e0 end) as delays_expected,
    max(demand_predicted) as demand_predicted, avg(nivel_trafico) as traffic_expected,
    100e0 - avg(case when eta <= 60 then 100e0 else 0e0 end) as risk_delay
  from scored group by day)
"""

SCENARIO_ROWS = SAMPLED_ROWS[:SAMPLED_ROWS.index("ranked as")] + """
scored as (
  select d.day, d.demand_predicted, f.nivel_trafico, f.eta from days d join features f on f.dia_semana = d.dow),
""" + SAMPLED_ROWS[SAMPLED_ROWS.index("daily as"):]


def _with(*parts: str, body: str) -> str:
    return "with " + ",".join(p.strip() for p in parts) + "\n" + body.strip()


def _d(body: str) -> str:
    return _with(DELIVERIES, body=body)


def _q(body: str) -> str:
    return _with(REQUESTS, body=body)


def _r(body: str) -> str:
    return _with(DELIVERIES, REGISTRY, body=body)


def _s(body: str, registry: bool = False, rows: str = SCENARIO_ROWS) -> str:
    parts = [DELIVERIES, DEMAND, rows] + ([REGISTRY] if registry else [])
    return _with(*parts, body=body)


def _round(*names: str) -> str:
    return ", ".join(f"round({n}, 6) as {n}" for n in names)


def _kpis(source: str, where: str = "true") -> str:
    def known(value: str, name: str) -> str:
        return f"round(coalesce({value}, 0e0), 6) as {name}"

    y, n = "tiempo_real_min", "nullif(count(*), 0)"
    columns = [known(f"avg({y})", "eta_mean"), known(f"max({y})", "eta_max"), known(f"min({y})", "eta_min"),
               known(f"stddev_pop({y})", "eta_std"), "count(*) as n_records",
               known(f"count(*) filter ({y} <= 60) * 100e0 / {n}", "otif"),
               known(f"count(*) filter ({y} > 60) * 100e0 / {n}", "delays_pct")]
    return f"select {', '.join(columns)} from {source} where {where}"


_CATEGORIES = ("localidad", "tipo_via", "tipo_zona", "vehiculo")
_MEDIAN = "case when distancia_km <= 0.5e0 then null else tiempo_estimado_min / distancia_km end"
_METRIC_COLUMNS = "round(mae, 6) as mae, round(mse, 6) as mse, round(rmse, 6) as rmse, round(mape, 6) as mape, n_train, n_validation"
_REQUEST_RULES = """concat_ws(',',
    case when localidad is null then 'localidad:required' end,
    case when distancia_km <= 0.1e0 or distancia_km >= 50 then 'distancia_km:range' end,
    case when nivel_trafico < 1 or nivel_trafico > 5 then 'nivel_trafico:range' end,
    case when lluvia_mm < 0 or lluvia_mm > 100 then 'lluvia_mm:range' end,
    case when estrato < 1 or estrato > 6 then 'estrato:range' end,
    case when tiempo_estimado_min <= 0 or tiempo_estimado_min >= 500 then 'tiempo_estimado_min:range' end,
    case when nivel_trafico <> floor(nivel_trafico) then 'nivel_trafico:integer' end)"""
_TABLE_RULES = """concat_ws(',',
    case when distancia_km < 0.5e0 or distancia_km > 15 then 'distancia_km:range' end,
    case when nivel_trafico < 0.2e0 or nivel_trafico > 1 then 'nivel_trafico:range' end,
    case when estrato < 1 or estrato > 6 then 'estrato:range' end,
    case when pendiente_promedio < 0 or pendiente_promedio > 15 then 'pendiente_promedio:range' end,
    case when zona_riesgo < 0 or zona_riesgo > 1 then 'zona_riesgo:range' end,
    case when tiempo_real_min < 8 or tiempo_real_min > 180 then 'tiempo_real_min:range' end)"""


def _group_mean(key: str, source: str = "validation", name: str | None = None) -> str:
    return (f"select {key} as {name or key}, round(avg(tiempo_real_min), 6) as mean, count(tiempo_real_min) as count "
            f"from {source} group by 1")


def _scaled() -> str:
    stats = ", ".join(f"avg({c}) as mu_{c}, stddev_pop({c}) as sd_{c}" for c in NUMERIC)
    columns = ", ".join(f"round(({c} - mu_{c}) / case when sd_{c} = 0 then 1e0 else sd_{c} end, 6) as {c}_scaled"
                        for c in NUMERIC)
    return _d(f"select {KEYS}, case when pos < floor(total * 0.8e0) then 'train' else 'validation' end as split, "
              f"{columns} from dated cross join (select {stats} from train)")


def _one_hot() -> str:
    joins = " ".join(
        f"left join (select {c} as v, row_number() over (order by {c}) as slot, count(*) over () as width "
        f"from (select distinct {c} from train)) t_{c} on d.{c} = t_{c}.v" for c in _CATEGORIES)
    columns = ", ".join(
        f"t_{c}.slot as {c}_slot, cast((select count(distinct {c}) from train) as integer) as {c}_width"
        for c in _CATEGORIES)
    return _d(f"select {KEYS}, {columns} from dated d {joins}")


def _ordinal() -> str:
    joins = " ".join(
        f"left join (select {c} as v, row_number() over (order by min(pos)) - 1 as code from train group by {c}) "
        f"t_{c} on d.{c} = t_{c}.v" for c in _CATEGORIES)
    columns = ", ".join(f"cast(coalesce(t_{c}.code, -1) as integer) as {c}_code" for c in _CATEGORIES)
    return _d(f"select {KEYS}, {columns} from dated d {joins}")


def _describe() -> str:
    columns = ["estrato", "distancia_km", "nivel_trafico", "lluvia_mm", "pendiente_promedio", "zona_riesgo",
               "cliente_ausente", "intentos_entrega", "tiempo_estimado_min", "tiempo_real_min"]
    return _d(" union all ".join(
        f"select '{c}' as \"column\", count({c}) as count, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, "
        f"round(min({c}), 6) as min, round(quantile_cont({c}, 0.25), 6) as q25, round(quantile_cont({c}, 0.5), 6) as q50, "
        f"round(quantile_cont({c}, 0.75), 6) as q75, round(max({c}), 6) as max from deliveries" for c in columns))


def _nulls() -> str:
    kinds = {"localidad": "string", "distancia_km": "double", "nivel_trafico": "double", "lluvia_mm": "double",
             "estrato": "int", "tipo_via": "string", "tiempo_estimado_min": "double"}
    master = {"fecha_pedido": "timestamp_ntz", "localidad": "string", "estrato": "int", "tipo_via": "string", "tipo_zona": "string",
              "vehiculo": "string", "distancia_km": "double", "nivel_trafico": "double", "lluvia_mm": "double",
              "pendiente_promedio": "double", "zona_riesgo": "double", "cliente_ausente": "int", "intentos_entrega": "int",
              "tiempo_estimado_min": "double", "tiempo_real_min": "double"}
    return _with(DELIVERIES, REQUESTS, body=" union all ".join(
        f"select '{c}' as \"column\", '{k}' as type, count(*) filter ({c} is null) as nulls, '{source}' as source from {source}"
        for source, columns in (("requests", kinds), ("deliveries", master)) for c, k in columns.items()))


def _feature_sets() -> str:
    width = "(14 + " + " + ".join(f"(select count(distinct {c}) from train)" for c in _CATEGORIES) + ")"
    return _d(f"""
      select family, split, n, cast(case when family in ('linear', 'glm') then {width} else 18 end as integer) as width, label_sum
      from (select unnest(['linear', 'glm', 'histgb', 'xgboost']) as family)
      cross join (select case when pos < floor(total * 0.8e0) then 'train' else 'validation' end as split, count(*) as n,
                    round(sum(tiempo_real_min), 6) as label_sum from dated group by 1)""")


def _completed() -> str:
    return _q(f"""
      select {KEYS}, coalesce(estrato, 3) as estrato, distancia_km,
        nivel_trafico, coalesce(lluvia_mm, 0e0) as lluvia_mm,
        0.5e0 as pendiente_promedio, 0e0 as zona_riesgo, 0 as cliente_ausente, 1 as intentos_entrega,
        tiempo_estimado_min,
        case when distancia_km > 0 then tiempo_estimado_min / distancia_km else 0e0 end as eficiencia_estimacion,
        2024 as anio, 1 as mes, 1 as dia, 0 as dia_semana, coalesce(localidad, 'Kennedy') as localidad,
        coalesce(tipo_via, 'Calle') as tipo_via, 'Urbana' as tipo_zona, 'Moto' as vehiculo
      from requests""")


def _scenario_features() -> str:
    return _q(f"""
      select {KEYS}, case when coalesce(estrato, 0) = 0 then 3 else estrato end as estrato,
        d as distancia_km, case when nivel_trafico = 0 then 2e0 else nivel_trafico end as nivel_trafico,
        coalesce(lluvia_mm, 0e0) as lluvia_mm, 0.5e0 as pendiente_promedio, 0 as zona_riesgo,
        0 as cliente_ausente, 1 as intentos_entrega, tiempo_estimado_min,
        tiempo_estimado_min / d as eficiencia_estimacion, 2025 as anio, 2 as mes, 15 as dia, 2 as dia_semana,
        coalesce(localidad, 'Kennedy') as localidad, coalesce(tipo_via, 'Calle') as tipo_via, 'Urbana' as tipo_zona,
        'Moto' as vehiculo
      from (select *, case when distancia_km = 0 then 5e0 else distancia_km end as d from requests)""")


def _zones() -> str:
    return _s("""
      , top as (select localidad, count(*) as n from validation group by 1 order by n desc, localidad limit 6),
      zone_ranked as (select f.*, row_number() over (partition by f.localidad order by row_hash) - 1 as zrank
                      from features f join top using (localidad)),
      zone_slots as (select localidad, n, unnest(generate_series(0, least(greatest(n // 40, 8), 24) - 1)) as i from top)
      select z.localidad, round(avg(case when r.eta > 60 then 100e0 else 0e0 end), 6) as riesgo, round(avg(r.eta), 6) as eta
      from zone_slots z join zone_ranked r on r.localidad = z.localidad and r.zrank = z.i % z.n group by 1""", rows=SAMPLED_ROWS)


def _gradients() -> str:
    """At the optimum every mean gradient is zero, of all numeric columns and all categories; the rows counted are all
    training rows."""
    numeric = [f"select '{c}' as feature from train group by 1" for c in NUMERIC]
    categories = [f"select distinct '{c}=' || {c} as feature from train where {c} is not null" for c in CATEGORICAL]
    return _d("select feature, 0e0 as gradient, (select count(*) from train) as n_train from (" + " union all ".join(numeric + categories) + ")")


def _status(model: str) -> str:
    return _q(f"""
        select {KEYS}, '{model}' as model_name, case when v = '' then 'success' else 'rejected' end as status, v as violations,
          cast(v = '' as integer) as scored, 1 as has_rmse
        from (select *, {_REQUEST_RULES} as v from requests)""")


def _available(saved: str) -> str:
    return _d(f"""
        select unnest(['linear', 'glm', 'histgb', 'xgboost']) as model_name, unnest([{saved}]) as available,
          unnest([1, 0, 0, 0]) as is_default, 'ok' as status,
          (select cast(count(*) > 0 as integer) from validation) as metrics_available""")


ORACLE: dict[str, str] = {
    "scan_deliveries": _d("select * replace (strftime(fecha_pedido, '%Y-%m-%d %H:%M:%S') as fecha_pedido) from deliveries"),
    "date_features": _d(f"select {KEYS}, anio, mes, dia, dia_semana from dated"),
    "efficiency_ratio": _d(f"select {KEYS}, {_MEDIAN} as eficiencia_estimacion from deliveries"),
    "impute_median": _d(f"""
        select {KEYS}, round(coalesce({_MEDIAN}, (select median({_MEDIAN}) from deliveries)), 6) as eficiencia_estimacion
        from deliveries"""),
    "eta_formula": _d(f"""
        select {KEYS}, round(20e0 + distancia_km * 2.5e0 + nivel_trafico * 20e0, 6) as eta_base,
          round(least(180e0, greatest(8e0, 20e0 + distancia_km * 2.5e0 + nivel_trafico * 30e0 + lluvia_mm * 1.8e0
            + pendiente_promedio * 0.7e0
            + case tipo_via when 'Troncal' then 0e0 when 'Arterial' then 5e0 when 'Local' then 9e0 else 20e0 end)), 6) as eta_full
        from deliveries"""),
    "clip_ranges": _d(f"""
        select {KEYS}, least(5e0, greatest(1e0, distancia_km)) as distancia_km,
          least(0.7e0, greatest(0.5e0, nivel_trafico)) as nivel_trafico,
          least(80e0, greatest(40e0, tiempo_real_min)) as tiempo_real_min
        from deliveries"""),
    "traffic_weather_flags": """
        select event_id,
          cast(case when hour(ts) between 6 and 9 or hour(ts) between 16 and 20 then 1 else 0 end as integer) as hora_pico,
          cast(case when month(ts) in (4, 5, 10, 11) then 1 else 0 end as integer) as mes_lluvioso
        from events""",
    "via_factor_lookup": _d(f"""
        select {KEYS}, case when l_linenumber = 7 then 'Calle' else tipo_via end as tipo_via,
          case when l_linenumber = 7 then null when tipo_via = 'Troncal' then 0e0 when tipo_via = 'Arterial' then 5e0
            when tipo_via = 'Local' then 9e0 else 20e0 end as minutos_via
        from deliveries"""),
    "error_columns": _d(f"""
        select {KEYS}, round(tiempo_real_min - tiempo_estimado_min, 6) as error,
          round(abs(tiempo_real_min - tiempo_estimado_min), 6) as error_abs from deliveries"""),
    "late_flag": _d(f"select {KEYS}, cast(tiempo_real_min > 60 as integer) as retraso from deliveries"),
    "target_month": _d("""
        select strftime(m, '%Y-%m') as month, strftime(m + interval 1 month, '%Y-%m') as horizon,
          cast(day(last_day(m + interval 1 month)) as integer) as days, n
        from (select date_trunc('month', fecha_pedido) as m, count(*) as n from deliveries group by 1)"""),
    "complete_requests": _completed(),
    "validate_requests": _q(f"""
        select {KEYS}, {_REQUEST_RULES} as violations, cast({_REQUEST_RULES} = '' as integer) as valid from requests"""),
    "validate_table": _d(f"""
        select {KEYS}, {_TABLE_RULES} as violations, cast({_TABLE_RULES} = '' as integer) as valid from deliveries"""),
    "unknown_zones": _q("select localidad, count(*) as n from requests where localidad not in ("
                        + ", ".join(f"'{z}'" for z in KNOWN_ZONES) + ") group by 1"),
    "scenario_features": _scenario_features(),
    "temporal_split": _d(f"""
        select {KEYS}, case when pos < floor(total * 0.8e0) then 'train' else 'validation' end as split from dated"""),
    "real_vs_estimated_top": _d(f"""
        select cast(row_number() over (order by tiempo_estimado_min, {ORDER}) as integer) as x,
          round(tiempo_real_min, 6) as real, round(tiempo_estimado_min, 6) as estimado
        from validation qualify row_number() over (order by tiempo_estimado_min, {ORDER}) <= 20"""),
    "rain_impact": _d("""
        select round(lluvia_mm, 6) as lluvia, round(avg(tiempo_real_min), 6) as eta, count(*) as n
        from validation where lluvia_mm is not null and tiempo_real_min is not null group by lluvia_mm"""),
    "error_sample": _d("""
        select floor((tiempo_real_min - tiempo_estimado_min) / 0.5e0) * 0.5e0 as error, count(*) as n
        from validation where tiempo_real_min - tiempo_estimado_min is not null group by 1"""),
    "error_evolution": _d("""
        select cast(p // greatest(1, t // 10) as integer) as segment,
          round(avg(abs(tiempo_real_min - tiempo_estimado_min)), 6) as mean_abs_error
        from (select *, row_number() over (order by pos) - 1 as p, count(*) over () as t from validation)
        where p // greatest(1, t // 10) < 10 group by 1"""),
    "kpis_actual": _r(f"""
        select 'linear' as model_name, k.*, round(coalesce(mae, 0e0), 6) as mae, round(coalesce(rmse, 0e0), 6) as rmse,
          round(coalesce(mape, 0e0), 6) as mape
        from ({_kpis('validation')}) k left join registry on registry.model_name = 'linear'"""),
    "kpis_filtered": _d(_kpis("deliveries", """localidad = 'NATION_1' and tipo_via = 'Local' and vehiculo = '2-HIGH'
          and nivel_trafico <= 0.7e0 and cast(fecha_pedido as date) between date '2000-06-01' and date '2001-03-31'""")),
    "flashcards": _r("""
        select 1 as position, 'ETA Promedio' as label, round(avg(tiempo_real_min), 2) as value, 'min' as unit, null::varchar as trend from validation
        union all select 2, 'ETA Máximo', round(max(tiempo_real_min), 2), 'min', null from validation
        union all select 3, 'ETA Mínimo', round(min(tiempo_real_min), 2), 'min', null from validation
        union all select 4, 'Desviación Estándar', round(stddev_pop(tiempo_real_min), 2), 'min', null from validation
        union all select 5, 'Error Promedio (MAE)', round(mae, 2), 'min', 'down' from registry where model_name = 'ridge on traffic'
        union all select 6, 'RMSE', round(rmse, 2), 'min', 'down' from registry where model_name = 'ridge on traffic'
        union all select 7, 'Error Porcentual (MAPE)', round(mape * 100, 2), '%', 'down' from registry where model_name = 'ridge on traffic'
        union all select 8, 'Registros Validación', n_validation::double, 'registros', null from registry where model_name = 'ridge on traffic'"""),
    "by_zone": _d(_group_mean("localidad")),
    "by_road": _d(_group_mean("tipo_via")),
    "traffic_impact": _d("select round(nivel_trafico, 6) as nivel_trafico, mean, count from ("
                         + _group_mean("nivel_trafico") + ")"),
    "traffic_impact_bucketed": _d("select round(nivel_trafico, 6) as nivel_trafico, mean, count from ("
                                  + _group_mean("floor(nivel_trafico / 0.1e0) * 0.1e0", name="nivel_trafico") + ")"),
    "top_zones": _d("select localidad, count(*) as n from validation group by 1 order by n desc, localidad limit 6"),
    "error_histogram": _d("""
        select cast(least(20, floor((x - lo) / ((hi - lo) / 20)) + 1) as integer) as bucket, count(*) as n
        from (select tiempo_real_min - tiempo_estimado_min as x from validation)
        cross join (select min(tiempo_real_min - tiempo_estimado_min) as lo,
                      max(tiempo_real_min - tiempo_estimado_min) as hi from validation) group by 1"""),
    "road_box": _d("""
        select tipo_via, round(min(tiempo_real_min), 6) as low, round(quantile_cont(tiempo_real_min, 0.25), 6) as q1,
          round(quantile_cont(tiempo_real_min, 0.5), 6) as med, round(quantile_cont(tiempo_real_min, 0.75), 6) as q3,
          round(max(tiempo_real_min), 6) as high
        from validation group by 1"""),
    "profile_nulls": _nulls(),
    "profile_describe": _describe(),
    "regression_metrics": _d("""
        select round(avg(abs(e)), 6) as mae, round(avg(e * e), 6) as mse, round(sqrt(avg(e * e)), 6) as rmse,
          round(avg(abs(e) / greatest(abs(y), 2.220446049250313e-16)), 6) as mape, count(*) as n_validation
        from (select tiempo_real_min as y, tiempo_real_min - tiempo_estimado_min as e from validation)"""),
    "payload_json": _d("select cast(to_json({'localidad': localidad, 'mean': mean, 'count': count}) as varchar) as record from ("
                       + _group_mean("localidad") + ")"),
    "registry_load": _r(f"select model_name, {_METRIC_COLUMNS} from registry"),
    "normalize_model_name": """
        select p_partkey,
          case when n like '%linear%' then 'linear' when n like '%glm%' then 'glm' when n like '%histgradient%' then 'histgb'
            when n like '%xgboost%' then 'xgboost' else n end as model_name
        from (select p_partkey, lower(case p_partkey % 5 when 0 then 'Linear ' when 1 then 'my GLM ' when 2 then 'HistGradient'
                when 3 then 'XGBoost-' else 'Other ' end || p_name) as n from part)""",
    "registry_upsert": _r("""
        select model_name, round(MAE, 6) as "MAE", round(MSE, 6) as "MSE",
          round(case when model_name = 'Ridge on rain' then rmse * 2e0 else rmse end, 6) as "RMSE", round(mape, 6) as "MAPE",
          n_train, n_validation
        from raw_registry where model_name <> 'Ridge on traffic'
        union all
        select model_name, 0e0, round(mse, 6), round(rmse, 6), round(mape, 6), n_train, n_validation
        from raw_registry where model_name = 'Ridge on traffic'"""),
    "best_model": _r("select model_name as best_model, round(rmse, 6) as best_rmse from registry order by rmse, ord limit 1"),
    "model_comparison": _r(f"""
        select model_name, {_METRIC_COLUMNS}, cast(row_number() over (order by registry.rmse, ord) as integer) as rank from registry"""),
    "kpis_confidence": _r("""
        , g as (select count(*) as k, avg(mae) as a, avg(rmse) as b, avg(mape * 100) as c, stddev_pop(rmse) as s from registry)
        select k as n_models, round(greatest(0e0, 100 - c), 6) as precision_global, round(a, 6) as mae_global,
          round(b, 6) as rmse_global, round(c, 6) as mape_global,
          (select model_name from registry order by rmse, ord limit 1) as best_model,
          (select round(min(rmse), 6) from registry) as best_rmse,
          round(greatest(0e0, least(100e0, greatest(0e0, 100 - c) - s / b * 100 * 0.35e0)), 6) as score_confianza
        from g"""),
    "scaler_stats": _d(" union all ".join(
        f"select '{c}' as feature, round(avg({c}), 6) as mean, round(stddev_pop({c}), 6) as std from train" for c in NUMERIC)),
    "scale_numeric": _scaled(),
    "one_hot": _one_hot(),
    "ordinal_encode": _ordinal(),
    "bind_features_target": _d(f"select {KEYS}, tiempo_estimado_min, tiempo_real_min from deliveries"),
    "bind_by_position": _d(f"select {KEYS}, tiempo_estimado_min, tiempo_real_min from deliveries"),
    "write_feature_sets": _feature_sets(),
    "weekday_factor": _with(DELIVERIES, DEMAND, body="select dia_semana, n, round(factor, 6) as factor from factors"),
    "demand_base": _with(DELIVERIES, DEMAND, body="select n, days, demand_base from base"),
    "demand_base_calendar": _d("""
        select count(*) as n, count(distinct cast(fecha_pedido as date)) as days,
          greatest(round_even(count(*)::double / greatest(count(distinct cast(fecha_pedido as date)), 1), 0), 40e0)::bigint as demand_base
        from validation"""),
    "daily_demand": _with(DELIVERIES, DEMAND, body="select day, dow, demand_predicted, sample_rows from days"),
    "scenario_daily": _s("select day, " + _round("eta_expected", "otif_expected", "delays_expected")
                         + ", demand_predicted, " + _round("traffic_expected", "risk_delay") + " from daily"),
    "scenario_daily_full": _s("""
        select d.day, round(avg(f.eta), 6) as eta_expected,
          round(avg(case when f.eta <= 60 then 100e0 else 0e0 end), 6) as otif_expected,
          round(100e0 - avg(case when f.eta <= 60 then 100e0 else 0e0 end), 6) as delays_expected,
          max(d.demand_predicted) as demand_predicted, round(avg(f.nivel_trafico), 6) as traffic_expected,
          round(100e0 - avg(case when f.eta <= 60 then 100e0 else 0e0 end), 6) as risk_delay
        from days d join features f on f.dia_semana = d.dow group by 1"""),
    "scenario_summary": _s("""
        select '2024-02' as horizon, '02' as month, 2024 as year, round(avg(eta_expected), 6) as eta_expected_mean,
          round(avg(otif_expected), 6) as otif_expected, round(avg(delays_expected), 6) as delays_expected,
          sum(demand_predicted)::bigint as demand_month_predicted, round(avg(demand_predicted), 6) as demand_daily_predicted_mean
        from daily"""),
    "zone_risk_sample": _zones(),
    "zone_risk": _s("""
        , top as (select localidad, count(*) as n from validation group by 1 order by n desc, localidad limit 6)
        select f.localidad, round(avg(case when f.eta > 60 then 100e0 else 0e0 end), 6) as riesgo, round(avg(f.eta), 6) as eta
        from features f join top using (localidad) group by 1"""),
    "scenario_daily_sample": _s("select day, " + _round("eta_expected", "otif_expected", "delays_expected")
                                + ", demand_predicted, " + _round("traffic_expected", "risk_delay") + " from daily", rows=SAMPLED_ROWS),
    "traffic_risk_points": _s("""
        select day, round(traffic_expected, 6) as traffic, round(risk_delay, 6) as risk, demand_predicted as demand from daily"""),
    "eta_distribution": _s("select floor(eta)::bigint as eta, count(*) as n from scored group by 1"),
    "eta_points_sample": _s("select day, i, round(eta, 6) as eta from scored", rows=SAMPLED_ROWS),
    "historical_vs_predicted": _s("""
        select 1 as position, 'Demanda diaria' as metric,
          (select round_even(count(*)::double / greatest(count(distinct dia), 1), 0) from validation) as historical,
          (select round(avg(demand_predicted), 6) from daily) as predicted
        union all select 2, 'ETA promedio (min)', (select round(avg(tiempo_real_min), 6) from validation),
          (select round(avg(eta_expected), 6) from daily)
        union all select 3, '% Retrasos', (select round(avg(case when tiempo_real_min > 60 then 100e0 else 0e0 end), 6) from validation),
          (select round(avg(delays_expected), 6) from daily)"""),
    "kpis_future": _s("""
        select 'linear' as model_name, round(avg(eta_expected), 6) as eta_mean, round(avg(otif_expected), 6) as otif,
          round(avg(delays_expected), 6) as delays_pct, sum(demand_predicted)::bigint as n_records, '2024-02' as horizon,
          sum(demand_predicted)::bigint as demand_month_predicted, round(avg(demand_predicted), 6) as demand_daily_predicted_mean,
          (select round(mae, 6) from registry where model_name = 'linear') as mae,
          (select round(rmse, 6) from registry where model_name = 'linear') as rmse,
          (select round(mape, 6) from registry where model_name = 'linear') as mape
        from daily""", registry=True),
    "batch_score_formula": _with(DELIVERIES, REGISTRY, REQUESTS, body=f"""
        select {KEYS}, 'linear' as model_name,
          round(case when v = '' then greatest(0.1e0, least(180e0, greatest(8e0, 20e0 + distancia_km * 2.5e0 + nivel_trafico * 30e0
            + coalesce(lluvia_mm, 0e0) * 1.8e0 + 0.5e0 * 0.7e0 + case when tipo_via = 'Local' then 9e0 else 0e0 end))) end, 6) as prediction,
          'tiempo_real_min' as target_variable,
          (select round(rmse, 6) from registry where model_name = 'linear') as rmse_validation,
          case when v = '' then 'success' else 'rejected' end as status, v as violations
        from (select *, {_REQUEST_RULES} as v from requests)"""),
    "ridge_gradient": _gradients(),
    "glm_gradient": _gradients(),
    "training_report": _d("""
        select unnest(['linear', 'glm', 'histgb', 'xgboost']) as model_name, 1 as trained,
          (select count(*) from train) as n_train, (select count(*) from validation) as n_validation, 1 as beats_mean"""),
    "batch_status": _status("xgboost"),
    "batch_status_fallback": _status("linear"),
    "model_availability": _available("1, 1, 1, 1"),
    "model_availability_fallback": _available("1, 0, 0, 0"),
    "importance_order": """
        select m.model_name, cast(r.rank as integer) as rank, 1 as is_share, 1 as in_sum
        from (select unnest(['histgb', 'xgboost']) as model_name) m, (select unnest(range(1, 6)) as rank) r""",
    "scenario_days": _s("""
        select d.day, max(d.demand_predicted) as demand_predicted, round(avg(f.nivel_trafico), 6) as traffic_expected, 1 as in_range
        from days d join features f on f.dia_semana = d.dow group by 1"""),
    "ridge1d": _d("""
        select round(w, 6) as w, round(my - w * mx, 6) as intercept, n
        from (select covar_pop(tiempo_real_min, distancia_km) * count(*) / (var_pop(distancia_km) * count(*) + 1e0) as w,
                avg(tiempo_real_min) as my, avg(distancia_km) as mx, count(*) as n from deliveries)"""),
}
