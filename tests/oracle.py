"""Runs a query and its SQL twin on the same tables and compares rows whatever their order."""

import decimal
import os
from collections import Counter
from pathlib import Path

import duckdb

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return tuple(map(plain, v)) if isinstance(v, list) else v


def same(spark, query, sql, folder=SMALL):
    df = query(spark, folder)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = Counter(tuple(plain(row[i]) for i in at) for row in r.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
