"""Compare registered queries with their SQL in DuckDB: python tests/check_sql.py SF_DIR [NAME...]"""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf_dir, name):
    """Rows of the query, and what differs."""
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            con.execute(f"create view {f[:-8]} as select * from '{sf_dir}/{f}'")
    made = entry.queries()[name](spark, sf_dir)
    got = rows_of(made.columns, [tuple(r) for r in made.collect()])
    result = con.execute(entry.oracle_sql()[name])
    want = rows_of([d[0] for d in result.description], result.fetchall())
    if got[0] != want[0]:
        return len(got[1]), f"columns {got[0]} and {want[0]}"
    differ = [(a, b) for a, b in zip(got[1], want[1], strict=False) if a != b]
    return len(got[1]), "" if got[1] == want[1] else f"{len(got[1])} and {len(want[1])} rows, first difference {differ[:1]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    for name in sys.argv[2:] or entry.oracle_sql():
        began = time.time()
        try:
            n, differs = compare(spark, sys.argv[1], name)
        except Exception as e:
            n, differs = -1, f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{name}: {n} rows, {time.time() - began:.1f} s {differs and 'DIFFERS ' + differs}", flush=True)
