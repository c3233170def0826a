"""Delivery fact table: CSV / Parquet scans with a fixed schema, and the view over TPC-H-like tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from parcelcast.schema import MASTER, TARGET, TIMESTAMP

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
ORDER = [TIMESTAMP, *KEYS]
TABLES = ["nation", "customer", "orders", "part", "lineitem"]      # behind the view


def without_nan(df: DataFrame) -> DataFrame:
    """NaN means missing in delivery files; Spark orders NaN above every number, so make it null."""
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select([
        F.when(~F.isnan(c), F.col(c)).alias(c) if c in doubles else F.col(c) for c in df.columns
    ])


def read_csv(spark: SparkSession, path: str, schema: T.StructType = MASTER) -> DataFrame:
    return without_nan(spark.read.schema(schema).option("header", True).csv(path))


def rejected_csv(spark: SparkSession, path: str, schema: T.StructType = MASTER) -> DataFrame:
    """Lines of a delivery file with a value that its column's type cannot hold (read as null otherwise), as text."""
    held = T.StructType([*schema.fields, T.StructField("_line", T.StringType())])
    rows = spark.read.schema(held).option("header", True).option("columnNameOfCorruptRecord", "_line").csv(path)
    # all columns are read, as Spark only parses, and so only checks, those that are asked for
    return rows.where(F.col("_line").isNotNull() & (F.size(F.array_compact(F.array(*[F.col(c).cast("string") for c in schema.names]))) >= 0)).select("_line")


def read_parquet(spark: SparkSession, path: str, schema: T.StructType = MASTER) -> DataFrame:
    return without_nan(spark.read.schema(schema).parquet(path))


def with_row_key(df: DataFrame, name: str = "row_key") -> DataFrame:
    """64-bit key over all columns, for tables that bring no key of their own."""
    return df.withColumn(name, F.xxhash64(*df.columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line in the delivery schema, plus the five key columns.

    Order-level dimensions are joined before the lines so that the widest table is shuffled least;
    no side is forced to broadcast, because customer, part and orders all grow with the data
    (Spark broadcasts one by itself when its measured size is under the threshold, and splits hot
    keys of the sort-merge joins at run time).
    """
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    lines = table(spark, sf_dir, "lineitem").select(
        *KEYS, "l_quantity", "l_discount", "l_tax", "l_returnflag")
    buyers = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    placed = orders.join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    joined = (lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
              .join(placed, F.col("l_orderkey") == F.col("o_orderkey")))

    distance = F.greatest(F.lit(0.5), F.col("l_quantity") * 0.12)
    traffic = F.lit(0.2) + F.col("l_discount") * 8.0
    slope = F.col("p_size") * F.lit(0.16)
    rain = F.col("l_tax") * 50.0
    road = F.col("l_linenumber") % 4
    road_name = (F.when(road == 0, "Troncal").when(road == 1, "Arterial")
                 .when(road == 2, "Local").otherwise("Destapada"))
    road_minutes = (F.when(road == 0, F.lit(0.0)).when(road == 1, F.lit(5.0))
                    .when(road == 2, F.lit(9.0)).otherwise(F.lit(20.0)))
    residual = (F.round(F.col("l_extendedprice") * 100.0).cast("bigint") % 1001) / F.lit(100.0)
    real = (F.lit(20.0) + distance * 2.5 + traffic * 30.0 + F.col("l_tax") * 50.0 * 1.8
            + slope * 0.7 + road_minutes + residual - 5.0)
    return joined.select(
        *KEYS,
        F.col("o_orderdate").alias("fecha_pedido"),
        F.col("n_name").alias("localidad"),
        (F.col("p_size") % 6 + 1).alias("estrato"),
        road_name.alias("tipo_via"),
        F.col("c_mktsegment").alias("tipo_zona"),
        F.col("o_orderpriority").alias("vehiculo"),
        distance.alias("distancia_km"),
        traffic.alias("nivel_trafico"),
        rain.alias("lluvia_mm"),
        slope.alias("pendiente_promedio"),
        ((F.round(F.col("o_totalprice") * 100.0).cast("bigint") % 101) / F.lit(100.0)).alias("zona_riesgo"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("cliente_ausente"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2)
        .otherwise(3).alias("intentos_entrega"),
        (F.lit(20.0) + distance * 2.5 + traffic * 20.0).alias("tiempo_estimado_min"),
        F.least(F.lit(180.0), F.greatest(F.lit(8.0), real)).alias(TARGET),
    )


def with_row_hash(df: DataFrame, name: str = "row_hash") -> DataFrame:
    """MD5 text over all columns, which sampled projections order by; copies of a row share it, and ``row_id`` tells them apart."""
    texts = [F.concat(F.lit(c), F.lit("="), F.coalesce(F.col(c).cast("string"), F.lit("\0"))) for c in df.columns]
    return df.withColumn(name, F.md5(F.concat_ws("|", *texts)))


def row_hash() -> Column:
    """Hash of the five key columns (price as whole cents, so that its text form is portable)."""
    cents = F.round(F.col("l_extendedprice") * 100.0).cast("bigint")
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in KEYS[:4]], cents.cast("string")))
