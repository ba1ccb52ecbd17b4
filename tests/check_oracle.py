"""Compare registered queries with their check SQL: ``python tests/check_oracle.py SF_DIR [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def bag(columns: list[str], rows: list[tuple]) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(cell(row[i]) for i in order) for row in rows)


def compare(spark, con, name: str, sf_dir: str, query, sql: str) -> tuple[int, str]:
    """(rows, problem); the problem is empty if both sides agree."""
    df = query(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    result = con.execute(sql)
    want_columns = [c[0] for c in result.description]
    got, want = bag(df.columns, rows), bag(want_columns, result.fetchall())
    if got[0] != want[0]:
        return len(rows), f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        only_spark, only_sql = got[1] - want[1], want[1] - got[1]
        return len(rows), (f"{sum(only_spark.values())} rows only in Spark, {sum(only_sql.values())} only in SQL\n"
                           f"  {got[0]}\n  spark {list(only_spark)[:2]}\n  sql   {list(only_sql)[:2]}")
    return len(rows), ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf, names = sys.argv[1], sys.argv[2:]
    session = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate())
    session.sparkContext.setLogLevel("OFF")
    con = duck(sf)
    failed = 0
    for key, query in entry.queries().items():
        if names and key not in names:
            continue
        begin = time.time()
        try:
            rows, problem = compare(session, con, key, sf, query, entry.oracle_sql()[key])
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            rows, problem = -1, f"{type(error).__name__}: {str(error)[:700]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {key:34s} {rows:7d} rows {time.time() - begin:6.2f} s {problem}", flush=True)
    print("failed:", failed)
