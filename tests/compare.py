"""Holds a query's rows against its SQL, run by DuckDB on the same tables.

As a script: ``python -m tests.compare SF_DIR [NAME ...]`` compares queries and prints a line for each.
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            source = f"{path}/*.parquet" if os.path.isdir(path) else path
            if glob.glob(source):
                con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{source}')")
    return con


def _plain(x):
    if isinstance(x, bool):
        return int(x)
    if isinstance(x, Decimal):
        return float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(_plain(y) for y in x)
    return x


def _sorted(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=repr)


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """What sets the two results apart; empty if nothing does."""
    got_columns, got = df.columns, [tuple(r) for r in df.collect()]
    cursor = con.execute(sql)
    want_columns = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} against {sorted(want_columns)}"
    a, b = _sorted(got_columns, got), _sorted(want_columns, want)
    if a == b:
        return ""
    only_a, only_b = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return f"{len(a)} against {len(b)} rows; columns {sorted(got_columns)}; only in the query {only_a}; only in the SQL {only_b}"


def main(sf_dir: str, names: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles, bad = connect(sf_dir), entry.queries(), entry.oracle_sql(), 0
    for name in names or queries:
        began = time.time()
        try:
            df = queries[name](spark, sf_dir)
            said = difference(df, con, oracles[name]) if name in oracles else f"{df.count()} rows, no SQL"
        except Exception as error:  # noqa: BLE001  the next query should run all the same
            said = f"ERROR {str(error)[:1500]}"
        bad += bool(said) and "no SQL" not in said
        print(f"{name} {time.time() - began:.1f}s {said or 'same'}"[:3000], flush=True)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
