"""Run registered queries next to their SQL and compare rows; usable as a script."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _value(x):
    if x is None:
        return None
    if isinstance(x, float):
        return None if math.isnan(x) else round(x + 0.0, 6)
    return x


def normal(rows, columns):
    place = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_value(r[i]) for i in place) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    a, b = normal(got, df.columns), normal(want, names)
    different = [(x, y) for x, y in zip(a, b) if x != y]
    if different:
        return f"{len(different)} of {len(a)} rows differ, first: {different[0][0]} != {different[0][1]}"
    types = {type(v) for r in a for v in r} - {type(None)}
    if not types <= {int, float, str, bool}:
        return f"types {types}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in names or list(queries):
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracle:
                problem = compare(df, con, oracle[name])
                label = "equal" if problem is None else f"DIFFERENT {problem}"
            else:
                problem, label = None, f"{len(df.collect())} rows"
        except Exception as error:  # report every query, not only the first failure
            problem = label = f"FAILED {type(error).__name__} {str(error)[:600]}"
        bad += problem is not None
        print(f"{name:28s} {time.time() - start:6.2f}s {label}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
