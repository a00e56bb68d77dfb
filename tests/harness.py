"""Run a registered query in Spark and its SQL oracle in DuckDB; compare.

Comparison: same column names, same row count, and equal multisets of rows
(doubles rounded to 6 places, column order by name, rows sorted).
"""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    out = [tuple(_norm(v) for v in r) for r in df[cols].itertuples(index=False, name=None)]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark, name: str, sf_dir: str, con=None) -> dict:
    import __spark_entry__ as E
    q = E.queries()[name]
    sql = E.oracle_sql().get(name)
    sdf = q(spark, sf_dir)
    a = pd.DataFrame([r.asDict() for r in sdf.collect()], columns=sdf.columns)
    res = {"name": name, "spark_rows": len(a)}
    if sql is None:
        res["oracle"] = False
        return res
    con = con or duck(sf_dir)
    b = con.execute(sql).df()
    res.update(oracle_rows=len(b), cols_match=sorted(a.columns) == sorted(b.columns))
    if res["cols_match"]:
        ra, rb = rows(a), rows(b)
        res["values_match"] = ra == rb
        if not res["values_match"]:
            diff = [(x, y) for x, y in zip(ra, rb) if x != y][:3]
            res["first_diffs"] = diff
    else:
        res["spark_cols"], res["oracle_cols"] = list(a.columns), list(b.columns)
    return res
