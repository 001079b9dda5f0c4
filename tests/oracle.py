"""Compare a query with its SQL in DuckDB, rows without order."""

import glob
import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda x: round(x, 6) + 0.0 if isinstance(x, float) and not math.isnan(x) else x
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr), sorted(names)


def differences(df, con, sql):
    got = plain([tuple(r) for r in df.collect()], df.columns)
    rel = con.sql(sql)
    want = plain(rel.fetchall(), rel.columns)
    if got == want:
        return ""
    if got[1] != want[1]:
        return f"columns {got[1]} and {want[1]}"
    a, b = set(got[0]), set(want[0])
    return f"rows {len(got[0])} and {len(want[0])}; only here {list(a - b)[:3]}; only in SQL {list(b - a)[:3]}"
