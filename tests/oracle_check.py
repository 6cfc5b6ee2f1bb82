"""Compare every registered query with its DuckDB oracle, like the driver does:
column names, row count, and an order-insensitive multiset of rounded values.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
                 "tinyint": "TINYINT", "smallint": "SMALLINT", "float": "FLOAT", "array<string>": "VARCHAR[]",
                 "timestamp_ntz": "TIMESTAMP", "date": "DATE"}

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        r = round(v, 6)
        return 0.0 if r == 0 else r
    if isinstance(v, decimal.Decimal):
        return norm(float(v))
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def check(spark, sf_dir, names=None):
    import __spark_entry__ as e
    qs, sql = e.queries(), e.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            cols = df.columns
            rows = [tuple(r) for r in df.collect()]
        except Exception as ex:  # noqa: BLE001
            results[name] = ("SPARK_ERROR", repr(ex)[:400])
            continue
        if name not in sql:
            results[name] = ("ROWS_ONLY", f"{len(rows)} rows {time.time() - t0:.1f}s")
            continue
        try:
            con.execute(f"CREATE OR REPLACE TEMP VIEW oracle_{name} AS {sql[name]}")
            cur = con.execute(f"SELECT * FROM oracle_{name}")
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as ex:  # noqa: BLE001
            results[name] = ("SQL_ERROR", repr(ex)[:400])
            continue
        if sorted(cols) != sorted(dcols):
            results[name] = ("COLS", f"spark={sorted(cols)} sql={sorted(dcols)}")
        elif len(rows) != len(drows):
            results[name] = ("COUNT", f"spark={len(rows)} sql={len(drows)}")
        else:
            a, b = canon(cols, rows), canon(dcols, drows)
            wrong = {}
            if a == b:  # values agree: also compare column types
                stypes = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
                          for f in df.schema.fields}
                dtypes = {c: str(t) for c, t in zip(dcols, con.sql(f"SELECT * FROM oracle_{name}").types)}
                wrong = {c: (stypes[c], dtypes.get(c)) for c in stypes if stypes[c] != dtypes.get(c)}
            if a == b and wrong:
                results[name] = ("TYPES", repr(wrong)[:400])
            elif a == b:
                results[name] = ("OK", f"{len(rows)} rows {time.time() - t0:.1f}s")
            else:
                diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
                results[name] = ("VALUES", repr(diff)[:600])
    return results


if __name__ == "__main__":
    from pyspark.sql import SparkSession
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    res = check(spark, sf, sys.argv[2:] or None)
    bad = 0
    for k, (status, msg) in res.items():
        print(f"{status:12s} {k:28s} {msg}")
        bad += status not in ("OK", "ROWS_ONLY")
    print(f"{len(res) - bad}/{len(res)} ok")
