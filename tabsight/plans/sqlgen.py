"""Writers of the DuckDB oracle SQL text (independent re-statements of each operator in SQL).

The Spark operators never run this text; it exists so every SQL-expressible operator is
checked against a second engine on the same Parquet tables.
"""

from __future__ import annotations

from ..functions import names as N
from .schemas import SCHEMAS

R = 6


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def contains_any(expr: str, keywords: list[str]) -> str:
    return "(" + " OR ".join(f"strpos({expr}, {lit(k)}) > 0" for k in keywords) + ")"


def name_reason_sql(expr: str = "lower(trim(column_name))") -> str:
    return (f"CASE WHEN {contains_any(expr, N.ID_KEYWORDS)} THEN {lit(N.REASON_ID)} "
            f"WHEN {contains_any(expr, N.DATE_KEYWORDS)} THEN {lit(N.REASON_DATE)} "
            f"WHEN {contains_any(expr, N.TEXT_KEYWORDS)} THEN {lit(N.REASON_TEXT)} END")


def column_stats_sql(table: str, source: str | None = None, columns: list[tuple[str, str]] | None = None) -> str:
    """One row per column of ``table``: position, name, class, counts, distinct, moments."""
    src = source or table
    parts = []
    for i, (c, k) in enumerate(columns or SCHEMAS[table]):
        x = q(c)
        num = k in ("numeric", "boolean")
        xd = f"CAST({x} AS DOUBLE)"
        parts.append(
            f"SELECT {i} AS position, {lit(c)} AS column_name, {lit(k)} AS cls, count(*) AS n_rows, "
            f"count({x}) AS n_nonnull, count(DISTINCT {x}) AS n_distinct, "
            f"max(CASE WHEN {x} IS NULL THEN 1 ELSE 0 END) AS has_null, "
            + (f"avg({xd}) AS mean, stddev_samp({xd}) AS std_samp, stddev_pop({xd}) AS std_pop, "
               f"min({xd}) AS mn, max({xd}) AS mx " if num else
               "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std_samp, CAST(NULL AS DOUBLE) AS std_pop, "
               "CAST(NULL AS DOUBLE) AS mn, CAST(NULL AS DOUBLE) AS mx ")
            + f"FROM {src}")
    return "\nUNION ALL\n".join(parts)


def screen_sql(table: str, source: str | None = None, target: str | None = None) -> str:
    hc = "coalesce((n_distinct + has_null)::DOUBLE / nullif(n_rows, 0) > 0.95, false)"
    nc = ("CASE WHEN n_rows < 2 THEN true WHEN n_nonnull < 2 THEN true "
          "WHEN cls IN ('numeric', 'boolean') THEN coalesce(CASE WHEN abs(mean) < 1e-10 THEN std_samp < 1e-10 "
          "ELSE abs(std_samp / nullif(mean, 0)) < 0.01 END, false) "
          "ELSE coalesce(n_distinct::DOUBLE / nullif(n_nonnull, 0) < 0.01, false) END")
    nr = name_reason_sql()
    reason = (f"CASE WHEN ({nr}) IS NOT NULL THEN ({nr}) "
              f"WHEN {hc} THEN 'High cardinality (' || CAST(n_distinct + has_null AS VARCHAR) || ' unique values, likely ID)' "
              f"WHEN {nc} THEN {lit(N.REASON_CONSTANT)} END")
    if target:
        reason = f"CASE WHEN column_name = {lit(target)} THEN NULL ELSE {reason} END"
    return (f"WITH s AS ({column_stats_sql(table, source)})\n"
            f"SELECT position, column_name, cls, "
            f"CASE WHEN ({nr}) IS NULL THEN CAST(n_distinct + has_null AS BIGINT) END AS n_distinct, "
            f"{reason} AS reason FROM s")


def quantile_sql(x: str, p: float) -> str:
    return f"quantile_cont({x}, {p})"
