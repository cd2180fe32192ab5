"""Compare every registered query with its SQL twin: python -m tests.oracle [sf_dir] [name pattern]."""

from __future__ import annotations

import math
import re
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def cell(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v + 0.0)
        return str(v)

    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir, name, query, sql):
    df = query(spark, sf_dir)
    got = canonical([tuple(x) for x in df.collect()], df.columns)
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = canonical(cur.fetchall(), cols)
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return "" if not bad else f"{len(bad)} of {len(got)} rows differ ({sorted(cols)}), first {bad[0]}"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pattern = sys.argv[2] if len(sys.argv) > 2 else "."
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g").config("spark.python.sql.dataFrameDebugging.enabled", "false").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con, sqls, failed = connect(sf_dir), oracle_sql(), 0
    for name, q in queries().items():
        if not re.search(pattern, name):
            continue
        t = time.time()
        try:
            verdict = compare(spark, con, sf_dir, name, q, sqls[name]) if name in sqls else f"no SQL ({q(spark, sf_dir).count()} rows)"
        except Exception as e:  # keep going, report at the end
            verdict = f"error {str(e)[:600]}"
        failed += bool(verdict) and not verdict.startswith("no SQL")
        print(f"{'ok ' if not verdict else 'BAD'} {name:32s} {time.time() - t:5.1f}s {verdict}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
