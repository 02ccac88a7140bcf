"""Holds queries against their SQL on DuckDB, values in any order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if hasattr(x, "isoformat"):
        return x.isoformat()[:10]
    return 0.0 if isinstance(x, float) and x == 0 else x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def same(spark, name, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    found = con.execute(sql)
    want_names = [c[0] for c in found.description]
    df = query(spark, sf_dir)
    assert sorted(df.columns) == sorted(want_names), name
    assert rows_of(df.columns, df.collect()) == rows_of(want_names, found.fetchall()), name
