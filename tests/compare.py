"""Run queries on Spark and their SQL on DuckDB over the same tables; report the differences."""

import glob
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def cell(value):
    if value is None:
        return "\x00null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if hasattr(value, "normalize") and hasattr(value, "as_tuple"):
        return "decimal " + str(value)
    return type(value).__name__ + " " + str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, build, sql, sf_dir):
    """(problem or None, rows, Spark seconds, SQL seconds)."""
    start = time.time()
    df = build(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return None, len(got[1]), took, 0.0
    start = time.time()
    con.execute(sql)
    columns = [d[0] for d in con.description]
    want = rows_of(columns, con.fetchall())
    sql_took = time.time() - start
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}", len(got[1]), took, sql_took
    if got[1] != want[1]:
        mine, theirs = set(got[1]), set(want[1])
        return (f"{len(got[1])} rows against {len(want[1])}; only Spark "
                f"{sorted(mine - theirs)[:2]}; only SQL {sorted(theirs - mine)[:2]}"
                ), len(got[1]), took, sql_took
    return None, len(got[1]), took, sql_took


def main(names, sf_dir):
    from shelfline.session import build_session
    import __spark_entry__ as entry

    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8",
                                                 "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles, bad = entry.queries(), entry.oracle_sql(), 0
    for name in names or list(queries):
        try:
            problem, n, a, b = compare(spark, con, name, queries[name], oracles.get(name), sf_dir)
        except Exception as failure:
            problem, n, a, b = f"{type(failure).__name__}: {str(failure)[:900]}", 0, 0, 0
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name:26s} rows={n} spark={a:.2f}s "
              f"sql={b:.2f}s {problem or ('' if oracles.get(name) else '(rows only)')}"[:1600],
              flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[2:], sys.argv[1])
