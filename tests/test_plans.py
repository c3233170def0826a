"""Shape of the physical plans."""

import re

import pytest
from pyspark.sql import functions as F

from parcelcast.operators import kpi, order, profile, requests, scenario
from parcelcast.plans import catalog
from parcelcast.sources.deliveries import KEYS, ORDER, deliveries

PYTHON_NODES = re.compile(r"(ArrowEvalPython|BatchEvalPython|MapInPandas|MapInArrow|FlatMapGroups)")
ONE_PASS = ["scan_deliveries", "date_features", "efficiency_ratio", "eta_formula", "clip_ranges", "error_columns",
            "late_flag", "complete_requests", "validate_requests", "scenario_features", "temporal_split", "by_zone",
            "by_road", "traffic_impact", "kpis_actual", "error_evolution", "scale_numeric", "one_hot", "ordinal_encode",
            "scenario_daily_full", "profile_nulls", "ridge1d"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ONE_PASS)
def test_no_python_and_no_unpartitioned_rows(spark, sf, name):
    text = plan(catalog.QUERIES[name](spark, sf))
    assert not PYTHON_NODES.search(text)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    for block in re.split(r"Exchange SinglePartition", text)[1:]:       # only partial aggregates may meet in one task
        assert re.match(r"[^\n]*\n[^\n]*HashAggregate\(keys=\[\]", block), block[:300]
    assert "Window" not in text


def test_splitting_moves_no_row(spark, prepared):
    cut = order.temporal_cut(prepared, ORDER)
    assert "Exchange" not in plan(order.temporal_split(prepared, cut))


def test_validation_rows_are_pruned_by_partition_and_column(spark, sf):
    text = plan(kpi.by_road(catalog._validation(spark, sf)))
    assert re.search(r"PartitionFilters: \[[^\]]*split#\d+ = validation", text)
    assert re.search(r"ReadSchema: struct<tipo_via:string,tiempo_real_min:double>|FileScan parquet \[tipo_via#\d+,tiempo_real_min", text)


def test_cut_and_filters_reach_the_scan(spark, sf, prepared):
    cut = order.temporal_cut(prepared, ORDER)
    text = plan(cut.after(prepared.drop("split")))
    assert "GreaterThanOrEqual(fecha_pedido" in text
    text = plan(kpi.apply_filters(prepared, date_from="2000-01-01", date_to="2000-02-01"))
    assert "GreaterThanOrEqual(fecha_pedido" in text and "LessThan(fecha_pedido" in text


def test_hot_keys_of_the_view_are_split(spark, tmp_path):
    """A third of the lines share one order and one part, a third of the orders one customer."""
    n, root = 60_000, str(tmp_path)
    hot = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))
    filler = F.sha2(F.col("id").cast("string"), 256)
    tables = {
        "lineitem": dict(l_orderkey=hot % 20_000, l_linenumber=(F.col("id") % 7).cast("int"), l_partkey=hot % 20_000,
                         l_suppkey=F.col("id"), l_extendedprice=F.rand(1), l_quantity=F.rand(2), l_discount=F.rand(3),
                         l_tax=F.rand(4), l_returnflag=F.lit("A")),
        "orders": dict(o_orderkey=F.col("id"), o_custkey=hot % 20_000, o_orderstatus=F.lit("F"), o_totalprice=F.rand(5),
                       o_orderdate=F.timestamp_seconds(F.col("id") * 3600), o_orderpriority=filler),
        "customer": dict(c_custkey=F.col("id"), c_nationkey=(F.col("id") % 25).cast("int"), c_mktsegment=filler),
        "part": dict(p_partkey=F.col("id"), p_size=(F.col("id") % 50).cast("int")),
        "nation": dict(n_nationkey=F.col("id").cast("int"), n_name=filler),
    }
    sizes = {"lineitem": n, "orders": n, "customer": 20_000, "part": 20_000, "nation": 25}
    for name, columns in tables.items():
        spark.range(0, sizes[name], 1, 8).select([c.alias(k) for k, c in columns.items()]).write.parquet(f"{root}/{name}.parquet")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df = deliveries(spark, root)
        rows = df.collect()
        text = plan(df)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(rows) == n
    assert len(re.findall(r"SortMergeJoin\(skew=true\)", text.split("Initial Plan")[0])) >= 3


def test_view_reads_only_needed_columns(spark, sf):
    text = plan(deliveries(spark, sf).groupBy("tipo_via").count())
    lines = [x for x in text.splitlines() if "FileScan" in x and "lineitem.parquet" in x]
    assert lines and not re.search(r"l_tax|l_discount|l_quantity", lines[0])


def test_top_rows_use_a_heap(spark, prepared):
    text = plan(order.real_vs_estimated_top(prepared, ORDER))
    assert "TakeOrderedAndProject" in text


def test_hash_sample_limits_before_its_shuffle(spark, prepared, monkeypatch):
    plans = []
    monkeypatch.setattr(scenario, "pin", lambda df, n: plans.append(plan(df)) or df)
    sizes = {r["localidad"]: r["n"] for r in kpi.top_zones(prepared, 6).collect()}
    rows = prepared.withColumn("row_hash", catalog.row_hash())
    scenario.lowest_hashes(rows, "localidad", "row_hash", 24, sizes)
    below = plans[0].split("Exchange hashpartitioning")[1]
    assert "WindowGroupLimit" in below and "Partial" in below


def test_requests_and_profile_need_no_join(spark, sf):
    text = plan(profile.profile_nulls(requests.validate_requests(catalog._requests(spark, sf)), ["localidad", *KEYS]))
    assert "Join" not in text
