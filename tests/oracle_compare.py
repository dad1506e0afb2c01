"""Run one catalogue query on Spark and its SQL on DuckDB over the same Parquet files and
compare them the way the driver does: column names, row count, and the multiset of rows."""

from __future__ import annotations

import math

import duckdb

from tabsight.sources.tables import TABLES, table_path


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if hasattr(v, "tolist"):
        return tuple(_norm(x) for x in v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in records), key=repr)


def compare(spark, key: str, sf_dir: str, con=None) -> tuple[bool, str]:
    from tabsight.plans.catalog import ORACLES, QUERIES
    sdf = QUERIES[key](spark, sf_dir)
    s_names = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    con = con or duck(sf_dir)
    res = con.execute(ORACLES[key])
    d_names = [c[0] for c in res.description]
    d_rows = res.fetchall()
    if sorted(s_names) != sorted(d_names):
        return False, f"columns differ: spark={sorted(s_names)} duckdb={sorted(d_names)}"
    if len(s_rows) != len(d_rows):
        return False, f"row count spark={len(s_rows)} duckdb={len(d_rows)}"
    a, b = rows_of(s_names, s_rows), rows_of(d_names, d_rows)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{len(bad)} rows differ, first: spark={bad[0][0]} duckdb={bad[0][1]}"
    return True, f"{len(a)} rows"
