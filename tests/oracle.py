"""Compares registered queries with their SQL in DuckDB: rows, columns and values, in any order."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, list | tuple):
        return tuple(map(plain, x))
    return int(x) if isinstance(x, bool) else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df, sql: str, con) -> str:
    """Empty where both agree."""
    rel = con.execute(sql)
    columns = [c[0] for c in rel.description]
    expected = rows_of(columns, rel.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if got == expected:
        return ""
    wrong = [x for x in got if x not in expected][:2] if len(got) < 3000 else [a for a, b in zip(got, expected, strict=False) if a != b][:2]
    missing = [x for x in expected if x not in got][:2] if len(got) < 3000 else [b for a, b in zip(got, expected, strict=False) if a != b][:2]
    return f"{len(got)} rows against {len(expected)}; got {str(wrong)[:300]}; expected {str(missing)[:300]}"
