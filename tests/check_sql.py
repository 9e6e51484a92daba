"""Run registered queries beside their SQL on DuckDB and compare rows. Used by test_queries.py and by hand:

    python tests/check_sql.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))
from quern.plans.views import TABLES  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, Decimal)):
        return int(v) if v == int(v) else float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return 0.0 if v == 0 else v
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=str)


def compare(spark, con, sf_dir, name, query, sql):
    """None when equal, else a message."""
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    rel = con.execute(sql)
    want_cols = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(df.columns) != sorted(want_cols):
        return f"columns {sorted(df.columns)} != {sorted(want_cols)}"
    kinds = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    theirs = {d[0]: str(d[1]) for d in rel.description}
    off = [(c, t, theirs[c]) for c, t in df.dtypes if kinds.get(t, t) != theirs[c]
           and not (theirs[c] == "NUMBER" or theirs[c] == "STRING")]
    if off:
        return f"types {off}"
    a, b = rows_of(df.columns, got), rows_of(want_cols, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}; only ours {[x for x in a if x not in set(b)][:3]}; only theirs {[x for x in b if x not in set(a)][:3]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} rows differ, e.g. {bad[:3]}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession
    import __spark_entry__ as entry
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if only and not any(o in name for o in only):
            continue
        t0 = time.time()
        try:
            if name in sqls:
                message = compare(spark, con, sf, name, fn, sqls[name])
            else:
                message = None if fn(spark, sf).count() >= 0 else "no rows"
        except Exception as e:  # report and go on
            message = f"{type(e).__name__}: {str(e)[:500]}"
        bad += message is not None
        print(f"{'ok  ' if message is None else 'FAIL'} {name} {time.time() - t0:.1f}s{'' if name in sqls else ' (no SQL)'} {message or ''}"[:900], flush=True)
    print("missing queries:", sorted(set(sqls) - set(entry.queries())), "failed:", bad)
