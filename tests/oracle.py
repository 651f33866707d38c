"""Rows of a query and of its SQL, in a form that can be compared."""

import os

import duckdb
import numpy as np


def connect(sf_dir):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        path = os.path.join(sf_dir, file)
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{source}'")
    return con


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=str)


def same(df, con, sql):
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, cursor.fetchall())
