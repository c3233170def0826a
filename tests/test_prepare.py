"""Derivations, preparation, encoders and files."""

import datetime as dt

import numpy as np
import pytest

from parcelcast.schema import MASTER
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrameWriter, functions as F

from parcelcast import schema
from parcelcast.functions import columns as fx
from parcelcast.operators import encode, kpi
from parcelcast.plans.prepare import once, prepare
from parcelcast.session import pin, scratch_path
from parcelcast.sources import artifacts, deliveries as src


def master(spark, n=50, **changes):
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        row = dict(fecha_pedido=start + dt.timedelta(hours=7 * i), localidad=f"Z{i % 4}", estrato=i % 6 + 1,
                   tipo_via=["Troncal", "Arterial", "Local", "Destapada"][i % 4], tipo_zona="Comercial", vehiculo="Moto",
                   distancia_km=1.0 + i % 7, nivel_trafico=0.2 + 0.1 * (i % 8), lluvia_mm=float(i % 5),
                   pendiente_promedio=float(i % 11), zona_riesgo=0.5, cliente_ausente=i % 2, intentos_entrega=1,
                   tiempo_estimado_min=30.0 + i % 13, tiempo_real_min=50.0 + i % 17)
        row.update({k: v(i) for k, v in changes.items()})
        rows.append(tuple(row[f.name] for f in schema.MASTER.fields))
    return spark.createDataFrame(rows, schema.MASTER)


def test_csv_round_trip(spark):
    path = scratch_path(spark, "csv")
    rows = master(spark)
    rows.write.option("header", True).csv(path)
    back = src.read_csv(spark, path)
    assert back.dtypes == rows.dtypes
    assert sorted(back.collect()) == sorted(rows.collect())


def test_nan_is_read_as_missing(spark):
    path = scratch_path(spark, "parquet")
    master(spark, lluvia_mm=lambda i: float("nan") if i % 2 else 1.0).write.parquet(path)
    assert src.read_parquet(spark, path).where("lluvia_mm is null").count() == 25


def test_zero_distance_takes_the_median(spark):
    rows = master(spark, 9, distancia_km=lambda i: 0.0 if i < 3 else 1.0, tiempo_estimado_min=lambda i: 10.0 * i)
    got = [r[0] for r in encode.with_features(rows).orderBy("fecha_pedido").select("eficiencia_estimacion").collect()]
    assert got == [55.0] * 3 + [30.0, 40.0, 50.0, 60.0, 70.0, 80.0]
    part = encode.with_features(rows, fit_on=rows.where("tiempo_estimado_min <= 50"))
    assert part.where("distancia_km = 0").select("eficiencia_estimacion").distinct().collect() == [(40.0,)]


def test_split_sizes_with_copies_of_one_row(spark):
    fixed = dt.datetime(2024, 1, 3)
    rows = master(spark, 60, fecha_pedido=lambda i: fixed if i % 3 else dt.datetime(2024, 1, 1 + i // 4),
                  **{c: (lambda v: lambda i: v if i % 3 else type(v)(i))(v) for c, v in
                     dict(distancia_km=3.0, tiempo_real_min=60.0, estrato=2).items()})
    table = prepare(src.with_row_key(rows), ["fecha_pedido", "row_key"])
    assert {r["split"]: r["count"] for r in table.groupBy("split").count().collect()} == {"train": 48, "validation": 12}
    assert table.agg(F.max(F.when(F.col("split") == "train", F.col("fecha_pedido")))).first()[0] <= \
        table.agg(F.min(F.when(F.col("split") == "validation", F.col("fecha_pedido")))).first()[0]


def test_unseen_and_missing_categories(spark):
    rows = encode.with_features(master(spark))
    train = rows.where("localidad <> 'Z3'")
    odd = rows.where("localidad = 'Z3'").unionByName(rows.limit(1).withColumn("localidad", F.lit(None).cast("string")))
    coded = encode.ordinal_encode(odd, train, ["fecha_pedido"])
    assert {r[0] for r in coded.select("localidad_code").collect()} == {-1}
    linear = encode.fit_linear_features(train)
    vectors = linear.transform(odd).select(vector_to_array("localidad_onehot").alias("v")).collect()
    assert all(r["v"] == [0.0, 0.0, 0.0] for r in vectors)
    assert len(encode.linear_feature_names(linear)) == 14 + 3 + 3 + 1 + 1


def test_codes_follow_first_appearance(spark):
    rows = master(spark, 8, localidad=lambda i: "ccabbdda"[i])
    codes = encode.appearance_order(rows, ["fecha_pedido"], ["localidad"]).collect()
    assert {r["category"]: r["code"] for r in codes} == {"c": 0, "a": 1, "b": 2, "d": 3}


def test_scaling_uses_population_deviation_and_keeps_constants(spark):
    rows = encode.with_features(master(spark))
    got = np.array(encode.scale_numeric(rows, rows).orderBy("fecha_pedido")
                   .select("distancia_km_scaled", "zona_riesgo_scaled").collect())
    x = np.array([1.0 + i % 7 for i in range(50)])
    assert got[:, 0] == pytest.approx((x - x.mean()) / x.std())
    assert got[:, 1] == pytest.approx(np.zeros(50), abs=1e-12)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_feature_sets(spark, fmt):
    table = prepare(src.with_row_key(master(spark)), ["fecha_pedido", "row_key"])
    paths = artifacts.write_feature_sets(table, ["fecha_pedido", "row_key"], scratch_path(spark, "sets"), fmt)
    assert sorted(paths) == ["glm", "histgb", "linear", "xgboost"]
    for family, path in paths.items():
        got = spark.read.format(fmt).option("header", True).load(path)
        assert got.where("split = 'train'").count() == 40 and got.count() == 50
        if family == "histgb":
            assert got.columns == [*schema.TREE_FEATURES, schema.TARGET, "split"]
        elif fmt == "csv" and family == "glm":
            assert got.columns[:3] == ["0", "1", "2"]


def test_feature_sets_are_written_without_a_sort(spark, monkeypatch):
    table = prepare(src.with_row_key(master(spark)), ["fecha_pedido", "row_key"])
    root, real = scratch_path(spark, "sets"), DataFrameWriter.partitionBy
    monkeypatch.setattr(DataFrameWriter, "partitionBy", lambda *_: pytest.fail("a write by partition column"))
    paths = artifacts.write_feature_sets(table, ["fecha_pedido", "row_key"], root)
    monkeypatch.setattr(DataFrameWriter, "partitionBy", real)
    assert {s: spark.read.parquet(paths["glm"]).where(F.col("split") == s).count() for s in ("train", "validation")} == {"train": 40, "validation": 10}
    odd = table.withColumn("split", F.when(F.col("split") == "train", "train"))      # a null, over files that are there
    paths = artifacts.write_feature_sets(odd, ["fecha_pedido", "row_key"], root, families=["xgboost"])
    assert {(r.split, r["count"]) for r in spark.read.parquet(paths["xgboost"]).groupBy("split").count().collect()} == {("train", 40), (None, 10)}


def test_month_resolution():
    assert fx.target_month("2024-02") == (2024, 2, "2024-02")
    assert fx.target_month(None, dt.date(2023, 12, 31)) == (2024, 1, "2024-01")
    assert fx.target_month(None, dt.date(2024, 1, 31)) == (2024, 2, "2024-02")
    for bad in ("2023-13", "2023-00", "2023", "abc-de"):
        with pytest.raises(ValueError):
            fx.target_month(bad)


def test_small_expressions(spark):
    df = spark.createDataFrame([("12.9",), ("-12.9",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(fx.whole(F.col("t"))).collect()] == [12, -12, None, None]
    times = spark.createDataFrame([("2024-04-01 06:00:00",), ("2024-01-01 10:59:59",), ("bad",)], "t string")
    times = times.withColumn("ts", fx.parse_timestamp("t"))
    got = [tuple(r) for r in times.select(fx.is_peak_hour("ts"), fx.is_rainy_month("ts")).collect()]
    assert got == [(1, 1), (0, 0), (None, None)]


def test_pin_refuses_more_rows_than_promised(spark):
    assert pin(spark.range(5), 5).count() == 5
    with pytest.raises(ValueError):
        pin(spark.range(6), 5)


def test_histogram_of_a_constant_and_of_nothing(spark):
    same = spark.createDataFrame([(2.0, 1.0)] * 4, "tiempo_real_min double, tiempo_estimado_min double")
    assert kpi.error_histogram(same).collect() == [(1, 4)]
    assert kpi.error_histogram(same.limit(0)).collect() == []


def test_kpis_of_missing_times_and_of_nothing(spark):
    rows = master(spark, 4, tiempo_real_min=lambda i: None if i == 0 else [50.0, 60.0, 70.0][i - 1])
    got = kpi.delivery_kpis(rows).first()
    assert got["n_records"] == 4 and got["otif"] == 50.0 and got["delays_pct"] == 25.0
    assert kpi.delivery_kpis(rows.limit(0)).first().asDict() == dict(
        eta_mean=0.0, eta_max=0.0, eta_min=0.0, eta_std=0.0, n_records=0, otif=0.0, delays_pct=0.0)


def test_date_filter_includes_both_ends(spark):
    rows = master(spark, 48, fecha_pedido=lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(hours=i * 3))
    assert kpi.apply_filters(rows, date_from="2024-01-02", date_to="2024-01-03").count() == 16


def test_lines_that_do_not_parse_are_reported(spark, tmp_path):
    (tmp_path / "deliveries.csv").write_text(",".join(MASTER.names) + "\n"
                                             + ",".join("1" if "time" not in f.dataType.simpleString() else "2024-01-01 00:00:00" for f in MASTER.fields) + "\n"
                                             + ",".join("x" for _ in MASTER.fields) + "\n")
    lines = src.rejected_csv(spark, str(tmp_path / "deliveries.csv")).collect()
    assert [r[0] for r in lines] == [",".join("x" for _ in MASTER.fields)]


def test_any_table_can_be_sampled_by_hash(spark):
    rows = spark.createDataFrame([(1, None), (None, 1), (1, None)], "a int, b int")
    hashes = [r.row_hash for r in src.with_row_hash(rows).collect()]
    assert hashes[0] == hashes[2] != hashes[1] and all(len(h) == 32 for h in hashes)


def test_two_files_without_key_are_bound_by_position(spark):
    root = scratch_path(spark, "positions")
    for name, values in (("x", range(20_000)), ("y", range(20_000))):
        rows = spark.range(20_000).repartitionByRange(3, "id").sortWithinPartitions("id")      # three files
        rows.select((F.col("id") * (1 if name == "x" else 2)).alias(name)).write.option("header", True).csv(f"{root}/{name}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        x = spark.read.schema("x long").option("header", True).csv(f"{root}/x")
        y = spark.read.schema("y long").option("header", True).csv(f"{root}/y")
        assert x.rdd.getNumPartitions() > 10
        got = artifacts.bind_by_position(x, y)
        assert got.columns == ["x", "y"] and got.count() == 20_000 and got.where("y <> 2 * x").count() == 0
        numbered = artifacts.with_position(x)
        assert numbered.where("position <> x").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    shorter = spark.read.schema("y long").option("header", True).csv(f"{root}/y/part-00000*")
    with pytest.raises(ValueError, match="rows of features"):
        artifacts.bind_by_position(x, shorter)
    with pytest.raises(ValueError, match="both tables"):
        artifacts.bind_by_position(x, x)


def test_what_is_shared_is_built_again_when_the_input_changes(spark):
    path, built = scratch_path(spark, "shared"), []
    spark.range(5).write.parquet(path)

    def rows():
        return once(spark, ("count", path), lambda: built.append(1) or spark.read.parquet(path).count(), [path])

    assert (rows(), rows(), len(built)) == (5, 5, 1)
    spark.range(3).write.mode("append").parquet(path)
    assert (rows(), rows(), len(built)) == (8, 8, 2)


def test_preparation_moves_and_sorts_no_row_after_the_joins(spark, monkeypatch):
    from pyspark.sql import DataFrameWriter

    from parcelcast import session

    def refuse(*_):
        raise AssertionError("a write by partition column sorts all rows")

    monkeypatch.setattr(session, "SPLIT_BYTES", 0)      # as with an input above it
    path = scratch_path(spark, "one-file")
    src.with_row_key(master(spark, 60)).coalesce(1).write.parquet(path)
    rows = spark.read.parquet(path)
    assert "Exchange" not in session.spread(rows)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(DataFrameWriter, "partitionBy", refuse)
    table = prepare(rows, ["fecha_pedido", "row_key"])
    assert {r["split"]: r["count"] for r in table.groupBy("split").count().collect()} == {"train": 48, "validation": 12}
