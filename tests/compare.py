"""Rows of Spark and DuckDB in one form."""

import decimal
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9) if v == v else None
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)


def duck_rows(con, sql):
    r = con.sql(sql)
    cols = sorted(r.columns)
    return cols, sorted((tuple(map(plain, x)) for x in r.select(*[f'"{c}"' for c in cols]).fetchall()), key=repr)
