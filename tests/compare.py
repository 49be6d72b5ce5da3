"""Run named queries on Spark and their SQL on DuckDB, and compare whole results."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 6)
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted([tuple(_norm(r[i]) for i in order) for r in rows], key=repr)


def spark_rows(df):
    return _rows(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    return _rows([d[0] for d in cur.description], cur.fetchall())


def difference(a, b):
    """None if equal, else a short description."""
    if a[0] != b[0]:
        return f"columns {a[0]} / {b[0]}"
    if a[1] == b[1]:
        return None
    sa, sb = set(a[1]), set(b[1])
    return f"rows {len(a[1])} / {len(b[1])}; only spark {list(sa - sb)[:3]}; only sql {list(sb - sa)[:3]}"


def main(sf_dir: str, names: list[str]) -> None:
    from pyspark.sql import SparkSession

    from quire.plans.catalog import QUERIES

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, (query, sql) in QUERIES.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            got = spark_rows(query(spark, sf_dir))
            t_spark = time.time() - start
            why = None if sql is None else difference(got, duck_rows(con, sql))
            state = "rows" if sql is None else "ok" if why is None else "DIFF"
            print(f"{state:5} {name} rows={len(got[1])} {t_spark:.1f}s {why or ''}"[:900], flush=True)
            bad += why is not None
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name} {str(e)[:700]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
