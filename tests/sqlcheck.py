"""Compare a query with its SQL on DuckDB."""

import math
from collections import Counter
from pathlib import Path

import duckdb


def _cell(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}" if v else "0"
    if isinstance(v, int):
        return f"{float(v):.9g}" if v else "0"
    return str(v)


def _rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in data)


def assert_same(df, sql, folder):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    got, want = _rows(df.columns, [tuple(r) for r in df.collect()]), _rows(cols, cur.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
