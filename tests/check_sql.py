"""Compare a query's rows with its SQL's, in DuckDB on the same files."""

import datetime as dt
import os
from decimal import Decimal

SF = "/root/testdata/sf0.001"


def value(v):
    if isinstance(v, float | Decimal):
        return round(float(v), 6)
    return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


def differs(spark, query, sql, sf=SF):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    want = sorted(repr([value(dict(zip(names, r, strict=True))[c]) for c in sorted(names)]) for r in cursor.fetchall())
    df = query(spark, sf)
    got = sorted(repr([value(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    return None if sorted(df.columns) == sorted(names) and got == want else (df.columns, names, len(got), len(want))
