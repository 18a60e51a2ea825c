"""Run a registered query and its SQL and compare them as bags of rows.

``python tests/oracle.py [sf dir] [name part ...]`` checks by hand.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


TIMES: list[float] = []


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "is_integer") or hasattr(value, "as_integer_ratio"):
        return float(value) if not isinstance(value, int) else value
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, run, sql, sf_dir):
    start = time.time()
    df = run(spark, sf_dir)
    spark_names, spark_rows = rows_of(df.columns, df.collect())
    TIMES.append(time.time() - start)
    if sql is None:
        return len(spark_rows), None
    result = con.execute(sql)
    duck_names, duck_rows = rows_of([d[0] for d in result.description], result.fetchall())
    if spark_names != duck_names:
        return len(spark_rows), f"columns {spark_names} != {duck_names}"
    if len(spark_rows) != len(duck_rows):
        return len(spark_rows), f"{len(spark_rows)} rows != {len(duck_rows)}"
    for a, b in zip(spark_rows, duck_rows):
        if a != b:
            return len(spark_rows), f"row {str(a)[:600]} != {str(b)[:600]}"
    return len(spark_rows), None


def main(argv):
    import __spark_entry__ as entry
    from twinline.session import get_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.001"
    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), entry.oracle_sql(), []
    for name, run in entry.queries().items():
        if argv[2:] and not any(part in name for part in argv[2:]):
            continue
        start = time.time()
        try:
            n, problem = compare(spark, con, run, sqls.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            n, problem = -1, f"{type(error).__name__}: {str(error)[:1500]}"
        state = "ok" if problem is None else "BAD"
        if name not in sqls:
            state += " (rows only)"
        print(f"{state:16} {name:40} {n:8} rows spark {TIMES[-1] if TIMES else 0:6.2f}s all {time.time() - start:6.2f}s", problem or "", flush=True)
        if problem:
            bad.append(name)
    print("failed:", bad)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
