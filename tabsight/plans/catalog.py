"""The query catalogue: one Spark query per operator of the inventory, each paired (where the
operator is SQL-expressible) with an independent DuckDB statement over the same tables.

``QUERIES[key] = fn(spark, sf_dir) -> DataFrame``; ``ORACLES[key] = sql``. Every query reads
whole tables (or frames Spark derives from them); no row caps, id subsets or sampling.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classes import NUMERIC, classify
from ..operators import profile as P
from ..operators import screen as S
from ..operators import stats as ST
from ..sources.tables import read_table
from . import derived as DV
from .schemas import SCHEMAS, cols
from .sqlgen import R, column_stats_sql, lit, q, screen_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return deco


def T(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


# =============================================================== screening

for _t in ["lineitem", "part", "events", "documents", "customer", "conversations", "orders"]:
    _key = "screen_columns" if _t == "lineitem" else f"screen_columns_{_t}"

    def _mk(t):
        return lambda spark, d: S.screen_columns(T(spark, d, t))

    register(_key, screen_sql(_t))(_mk(_t))


@register("screen_columns_target", screen_sql("lineitem", target="l_extendedprice"))
def _screen_target(spark, d):
    return S.screen_columns(T(spark, d, "lineitem"), target_col="l_extendedprice")


@register("removed_features", f"SELECT column_name, reason FROM ({screen_sql('lineitem')}) WHERE reason IS NOT NULL")
def _removed(spark, d):
    return S.removed_features(S.screen_columns(T(spark, d, "lineitem")))


@register("clean_table", "SELECT l_linenumber, l_quantity, l_discount, l_tax FROM lineitem")
def _clean(spark, d):
    clean, _ = S.validate_and_clean(T(spark, d, "lineitem"))
    return clean


_CLASS_OF_TYPE = (
    "CASE WHEN data_type IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'HUGEINT', 'FLOAT', 'DOUBLE') "
    "OR data_type LIKE 'DECIMAL%' THEN 'numeric' WHEN data_type = 'VARCHAR' THEN 'categorical' "
    "WHEN data_type = 'BOOLEAN' THEN 'boolean' WHEN data_type = 'DATE' OR data_type LIKE 'TIMESTAMP%' THEN 'datetime' "
    "ELSE 'other' END")


def _catalogue_sql(table: str) -> str:
    return (f"SELECT CAST(ordinal_position - 1 AS INTEGER) AS position, column_name, {_CLASS_OF_TYPE} AS cls "
            f"FROM information_schema.columns WHERE table_name = {lit(table)} "
            f"AND (SELECT count(*) FROM {table}) >= 0")


@register("column_classes", _catalogue_sql("lineitem"))
def _column_classes(spark, d):
    # The class of every column, as the first three columns of the profile table
    return P.column_profile(T(spark, d, "lineitem")).select("position", "column_name", "cls")


_PREP_ID_SQL = (
    "lower(column_name) = 'id' OR suffix(lower(column_name), '_id') "
    + "".join(f"OR strpos(lower(column_name), '_{p}') > 0 OR strpos(lower(column_name), '{p}_') > 0 "
              for p in ["id", "index", "uid"]))


@register("prep_drop_columns",
          f"SELECT column_name FROM ({_catalogue_sql('lineitem')}) WHERE {_PREP_ID_SQL} OR column_name = 'l_extendedprice'")
def _prep_drop(spark, d):
    # Exclude ∪ ID rule ∪ target over the column catalogue
    prof = P.column_profile(T(spark, d, "lineitem")).select("column_name")
    return prof.where(S.prep_id_col(F.col("column_name")) | (F.col("column_name") == "l_extendedprice"))


# =============================================================== profile reports

_L_NUM = cols("lineitem", NUMERIC)


@register("overview_metrics", None)
def _overview(spark, d):
    return P.overview_metrics(T(spark, d, "lineitem"))


def _overview_sql() -> str:
    t = "lineitem"
    names = cols(t)
    nulls = " + ".join(f"count(*) - count({q(c)})" for c in names)
    hc = " + ".join(f"CASE WHEN (SELECT count(DISTINCT {q(c)}) + max(CASE WHEN {q(c)} IS NULL THEN 1 ELSE 0 END) "
                    f"FROM {t})::DOUBLE / nullif((SELECT count(*) FROM {t}), 0) > 0.95 THEN 1 ELSE 0 END" for c in names)
    all_cols = ", ".join(q(c) for c in names)
    return (f"SELECT CAST(count(*) AS BIGINT) AS n_records, CAST({len(names)} AS BIGINT) AS n_features, "
            f"CAST({len(cols(t, 'numeric'))} AS BIGINT) AS n_numeric, "
            f"CAST({len(cols(t, 'categorical'))} AS BIGINT) AS n_categorical, "
            f"round(coalesce(({nulls}) * 100.0 / nullif(count(*) * {len(names)}, 0), 0.0), {R}) AS missing_pct, "
            f"CAST((SELECT count(*) FROM {t}) - (SELECT count(*) FROM (SELECT DISTINCT {all_cols} FROM {t})) AS BIGINT) AS duplicates, "
            f"CAST({hc} AS BIGINT) AS n_high_card FROM {t}")


ORACLES["overview_metrics"] = _overview_sql()


@register("duplicate_count",
          "SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_linenumber, l_discount, l_tax FROM lineitem)) AS BIGINT) AS duplicates, "
          "CAST((SELECT count(*) FROM (SELECT DISTINCT l_linenumber, l_discount, l_tax FROM lineitem)) AS BIGINT) AS n_distinct_rows, "
          "CAST(count(*) AS BIGINT) AS n_rows FROM lineitem")
def _dups(spark, d):
    return P.duplicate_count(DV.lineitem_dups(T(spark, d, "lineitem")))


def _describe_sql(table: str, columns: list[str], source: str | None = None) -> str:
    src = source or table
    parts = []
    for c in columns:
        x = f"CAST({q(c)} AS DOUBLE)"
        parts.append(f"SELECT {lit(c)} AS column_name, CAST(count({x}) AS BIGINT) AS count, round(avg({x}), {R}) AS mean, "
                     f"round(stddev_samp({x}), {R}) AS std, round(min({x}), {R}) AS min, "
                     f"round(quantile_cont({x}, 0.25), {R}) AS q25, round(quantile_cont({x}, 0.5), {R}) AS q50, "
                     f"round(quantile_cont({x}, 0.75), {R}) AS q75, round(max({x}), {R}) AS max FROM {src}")
    return " UNION ALL ".join(parts)


@register("describe_numeric", _describe_sql("lineitem", _L_NUM))
def _describe(spark, d):
    return ST.describe_numeric(T(spark, d, "lineitem"))


def _moments_sql(table: str, columns: list[str], source: str | None = None) -> str:
    src = source or table
    parts = []
    for c in columns:
        x = f"CAST({q(c)} AS DOUBLE)"
        parts.append(
            f"SELECT {lit(c)} AS column_name, (SELECT avg({x}) FROM {src}) AS m, count({x}) AS n, count(*) AS n_rows, "
            f"avg({x}) AS mean, quantile_cont({x}, 0.5) AS median, stddev_samp({x}) AS std, min({x}) AS mn, max({x}) AS mx, "
            f"var_samp({x}) AS variance, "
            f"avg(power({x} - (SELECT avg({x}) FROM {src}), 2)) AS m2, avg(power({x} - (SELECT avg({x}) FROM {src}), 3)) AS m3, "
            f"avg(power({x} - (SELECT avg({x}) FROM {src}), 4)) AS m4 FROM {src}")
    inner = " UNION ALL ".join(parts)
    ok = "n >= 2"
    return (f"SELECT column_name, CASE WHEN {ok} THEN round(mean, {R}) END AS mean, "
            f"CASE WHEN {ok} THEN round(median, {R}) END AS median, CASE WHEN {ok} THEN round(std, {R}) END AS std, "
            f"CASE WHEN {ok} THEN round(mn, {R}) END AS min, CASE WHEN {ok} THEN round(mx, {R}) END AS max, "
            f"CASE WHEN {ok} THEN round(std * std, {R}) END AS variance, "
            f"CASE WHEN {ok} THEN round(m3 / nullif(power(m2, 1.5), 0), {R}) END AS skewness, "
            f"CASE WHEN {ok} THEN round(m4 / nullif(m2 * m2, 0) - 3.0, {R}) END AS kurtosis, "
            f"CASE WHEN {ok} THEN round((n_rows - n)::DOUBLE / n_rows, {R}) END AS missing_ratio, "
            f"CASE WHEN NOT ({ok}) THEN 'Insufficient data' END AS error FROM ({inner})")


@register("feature_distribution", _moments_sql("lineitem", _L_NUM))
def _featdist(spark, d):
    return ST.feature_distribution(T(spark, d, "lineitem"))


def _outliers_iqr_sql(table: str, columns: list[str]) -> str:
    parts = []
    for c in columns:
        x = f"CAST({q(c)} AS DOUBLE)"
        parts.append(
            f"SELECT {lit(c)} AS column_name, count({x}) AS n, "
            f"count(*) FILTER (WHERE {x} < b.q1 - 1.5 * (b.q3 - b.q1) OR {x} > b.q3 + 1.5 * (b.q3 - b.q1)) AS o "
            f"FROM {table}, (SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM {table}) b")
    inner = " UNION ALL ".join(parts)
    return (f"SELECT column_name, CAST(CASE WHEN n < 4 THEN 0 ELSE o END AS BIGINT) AS n_outliers, "
            f"CASE WHEN n < 4 THEN 0.0 ELSE round(o::DOUBLE / n, {R}) END AS outlier_ratio FROM ({inner})")


@register("outliers_iqr", _outliers_iqr_sql("lineitem", _L_NUM))
def _oiqr(spark, d):
    return ST.outliers_iqr(T(spark, d, "lineitem"))


def _outliers_z_sql(table: str, columns: list[str]) -> str:
    parts = []
    for c in columns:
        x = f"CAST({q(c)} AS DOUBLE)"
        parts.append(
            f"SELECT {lit(c)} AS column_name, count({x}) AS n, "
            f"count(*) FILTER (WHERE abs({x} - b.m) / nullif(b.s, 0) > 3.0) AS o "
            f"FROM {table}, (SELECT avg({x}) AS m, stddev_pop({x}) AS s FROM {table}) b")
    inner = " UNION ALL ".join(parts)
    return (f"SELECT column_name, CAST(CASE WHEN n < 4 THEN 0 ELSE o END AS BIGINT) AS n_outliers, "
            f"CASE WHEN n < 4 THEN 0.0 ELSE round(o::DOUBLE / n, {R}) END AS outlier_ratio FROM ({inner})")


@register("outliers_zscore", _outliers_z_sql("lineitem", _L_NUM))
def _oz(spark, d):
    return ST.outliers_zscore(T(spark, d, "lineitem"))


@register("value_counts",
          "SELECT p_type AS value, count(*) AS count FROM part WHERE p_type IS NOT NULL GROUP BY p_type")
def _vc(spark, d):
    return P.value_counts(T(spark, d, "part"), "p_type")


@register("value_counts_orders",
          "SELECT o_orderpriority AS value, count(*) AS count FROM orders GROUP BY o_orderpriority")
def _vc2(spark, d):
    return P.value_counts(T(spark, d, "orders"), "o_orderpriority")


def _histogram_sql(table: str, c: str, bins: int = 30) -> str:
    x = f"CAST({q(c)} AS DOUBLE)"
    return (f"WITH s AS (SELECT min({x}) AS mn, max({x}) AS mx, avg({x}) AS mean, quantile_cont({x}, 0.5) AS med FROM {table}), "
            f"b AS (SELECT CASE WHEN s.mx = s.mn THEN 1 ELSE least({bins}, CAST(floor({bins}.0 * ({x} - s.mn) / (s.mx - s.mn)) + 1 AS INTEGER)) END AS bin "
            f"FROM {table}, s WHERE {x} IS NOT NULL) "
            f"SELECT CAST(bin AS INTEGER) AS bin, round(s.mn + (bin - 1) * ((s.mx - s.mn) / {bins}), {R}) AS bin_lo, "
            f"round(s.mn + bin * ((s.mx - s.mn) / {bins}), {R}) AS bin_hi, count(*) AS count, round(s.mean, {R}) AS mean, "
            f"round(s.med, {R}) AS median FROM b, s GROUP BY bin, s.mn, s.mx, s.mean, s.med")


@register("histogram", _histogram_sql("lineitem", "l_extendedprice"))
def _hist(spark, d):
    return ST.histogram(T(spark, d, "lineitem"), "l_extendedprice")


@register("histogram_events", _histogram_sql("events", "value"))
def _hist2(spark, d):
    return ST.histogram(T(spark, d, "events"), "value")


def _missing_sql(source: str, columns: list[str]) -> str:
    parts = [f"SELECT {lit(c)} AS column_name, CAST(count(*) - count({q(c)}) AS BIGINT) AS n_missing, "
             f"round((count(*) - count({q(c)})) * 100.0 / count(*), {R}) AS missing_pct FROM {source}" for c in columns]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE n_missing > 0"


@register("missing_by_column", _missing_sql(f"({DV.LINEITEM_NULLS_SQL})", cols("lineitem")))
def _missing(spark, d):
    return P.missing_by_column(DV.lineitem_nulls(T(spark, d, "lineitem")))


def _corr_sql(source: str, columns: list[str]) -> str:
    parts = []
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            xa, xb = f"CAST({q(a)} AS DOUBLE)", f"CAST({q(b)} AS DOUBLE)"
            both = f"{xa} IS NOT NULL AND {xb} IS NOT NULL"
            parts.append(
                f"SELECT {lit(a)} AS x, {lit(b)} AS y, round(covar_pop({xa}, {xb}) / "
                f"nullif(stddev_pop(CASE WHEN {both} THEN {xa} END) * stddev_pop(CASE WHEN {both} THEN {xb} END), 0), {R}) AS r "
                f"FROM {source}")
    return " UNION ALL ".join(parts)


@register("correlation_matrix", _corr_sql("lineitem", _L_NUM))
def _corr(spark, d):
    return ST.correlation_matrix(T(spark, d, "lineitem"))


@register("correlation_nulls", _corr_sql(f"({DV.LINEITEM_NULLS_SQL})", ["l_quantity", "l_discount", "l_tax"]))
def _corr_nulls(spark, d):
    return ST.correlation_matrix(DV.lineitem_nulls(T(spark, d, "lineitem")), ["l_quantity", "l_discount", "l_tax"])


@register("correlation_selected", _corr_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount"]))
def _corr_sel(spark, d):
    # The default bivariate selection is the first three numeric columns (at most five)
    df = T(spark, d, "lineitem")
    sel = [c for c in ["l_quantity", "l_extendedprice", "l_discount"]][:5]
    return ST.correlation_matrix(df, sel)


def _summary_sql(table: str) -> str:
    parts = []
    for i, (c, k) in enumerate(SCHEMAS[table]):
        x = q(c)
        if k == NUMERIC:
            xd = f"CAST({x} AS DOUBLE)"
            parts.append(f"SELECT {lit(c)} AS column_name, 'Numeric' AS type, CAST(count({x}) AS BIGINT) AS non_null, "
                         f"CAST(count(*) - count({x}) AS BIGINT) AS missing, round(avg({xd}), {R}) AS mean, "
                         f"round(stddev_samp({xd}), {R}) AS std, round(min({xd}), {R}) AS min, round(max({xd}), {R}) AS max, "
                         f"CAST(NULL AS BIGINT) AS \"unique\", CAST(NULL AS VARCHAR) AS mode, CAST(NULL AS VARCHAR) AS top_category FROM {table}")
        elif k == "categorical":
            mode = (f"(SELECT v FROM (SELECT {x} AS v, count(*) AS n FROM {table} WHERE {x} IS NOT NULL GROUP BY {x}) "
                    f"ORDER BY n DESC, v ASC LIMIT 1)")
            parts.append(f"SELECT {lit(c)} AS column_name, 'Categorical' AS type, CAST(count({x}) AS BIGINT) AS non_null, "
                         f"CAST(count(*) - count({x}) AS BIGINT) AS missing, CAST(NULL AS DOUBLE) AS mean, "
                         f"CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, "
                         f"CAST(count(DISTINCT {x}) AS BIGINT) AS \"unique\", {mode} AS mode, {mode} AS top_category FROM {table}")
    return " UNION ALL ".join(parts)


@register("summary_table", _summary_sql("part"))
def _summary(spark, d):
    return ST.summary_table(T(spark, d, "part"))


def _catdist_sql(table: str, columns: list[str], k: int = 5) -> str:
    parts = []
    for c in columns:
        x = q(c)
        parts.append(
            f"SELECT {lit(c)} AS column_name, CAST((SELECT count(DISTINCT {x}) FROM {table}) AS BIGINT) AS n_distinct, "
            f"(SELECT v FROM f WHERE col = {lit(c)} AND rk = 1) AS mode, "
            f"round(coalesce((SELECT (count(*) - count({x}))::DOUBLE / count(*) FROM {table}), 0.0), {R}) AS missing_ratio, "
            f"(SELECT string_agg(v || '=' || CAST(n AS VARCHAR), '; ' ORDER BY rk) FROM f WHERE col = {lit(c)} AND rk <= {k}) AS top_values")
    freq = " UNION ALL ".join(
        f"SELECT {lit(c)} AS col, v, n, row_number() OVER (ORDER BY n DESC, v ASC) AS rk FROM "
        f"(SELECT {q(c)} AS v, count(*) AS n FROM {table} WHERE {q(c)} IS NOT NULL GROUP BY {q(c)})" for c in columns)
    return f"WITH f AS ({freq}) " + " UNION ALL ".join(parts)


@register("category_distribution", _catdist_sql("orders", cols("orders", "categorical")))
def _catdist(spark, d):
    return P.category_distribution(T(spark, d, "orders"))


@register("category_distribution_documents", _catdist_sql("documents", ["lang", "source", "text"]))
def _catdist2(spark, d):
    return P.category_distribution(T(spark, d, "documents"), ["lang", "source", "text"])


@register("sample_rows", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def _sample(spark, d):
    # IO5: the first ten rows; deterministic form orders by the key (a limit that is the feature)
    return T(spark, d, "orders").orderBy("o_orderkey").limit(10)


def _high_card_sql(table: str) -> str:
    return (f"SELECT column_name, coalesce((n_distinct + has_null)::DOUBLE / nullif(n_rows, 0) > 0.95, false) AS high_cardinality, "
            f"CAST(n_distinct + has_null AS BIGINT) AS n_unique FROM ({column_stats_sql(table)})")


@register("high_cardinality", _high_card_sql("lineitem"))
def _hc(spark, d):
    df = T(spark, d, "lineitem")
    prof = P.full_profile(df)
    return prof.select("column_name",
                       S.high_cardinality_col(F.col("n_distinct"), F.col("has_null"), F.col("n_rows")).alias("high_cardinality"),
                       (F.col("n_distinct") + F.col("has_null")).cast("long").alias("n_unique"))


def _near_const_sql(table: str, source: str | None = None) -> str:
    nc = ("CASE WHEN n_rows < 2 THEN true WHEN n_nonnull < 2 THEN true "
          "WHEN cls IN ('numeric', 'boolean') THEN coalesce(CASE WHEN abs(mean) < 1e-10 THEN std_samp < 1e-10 "
          "ELSE abs(std_samp / nullif(mean, 0)) < 0.01 END, false) "
          "ELSE coalesce(n_distinct::DOUBLE / nullif(n_nonnull, 0) < 0.01, false) END")
    return f"SELECT column_name, {nc} AS near_constant FROM ({column_stats_sql(table, source)})"


@register("near_constant", _near_const_sql("lineitem", f"({DV.LINEITEM_NULLS_SQL})"))
def _nc(spark, d):
    df = DV.lineitem_nulls(T(spark, d, "lineitem"))
    prof = P.full_profile(df)
    return prof.select("column_name", S.near_constant_col(
        F.col("cls"), F.col("n_rows"), F.col("n_nonnull"), F.col("n_distinct"), F.col("mean"),
        F.col("std_samp")).alias("near_constant"))


# =============================================================== preprocessing
from ..operators import knn_impute as KN  # noqa: E402
from ..operators import prep as PR  # noqa: E402


@register("blank_to_null",
          f"SELECT event_id, CASE WHEN regexp_matches(event_type, '^\\s*$') THEN NULL ELSE event_type END AS event_type "
          f"FROM ({DV.EVENTS_BLANK_SQL})")
def _blank(spark, d):
    return PR.blank_to_null(DV.events_blank(T(spark, d, "events"))).select("event_id", "event_type")


def _impute_sql(stat: str) -> str:
    src = f"({DV.LINEITEM_NULLS_SQL})"
    return (f"SELECT l_orderkey, l_linenumber, coalesce(l_quantity, s.q) AS l_quantity, coalesce(l_discount, s.d) AS l_discount "
            f"FROM {src}, (SELECT {stat.format('l_quantity')} AS q, {stat.format('l_discount')} AS d FROM {src}) s")


@register("impute_median", _impute_sql("quantile_cont({}, 0.5)"))
def _imp_med(spark, d):
    df = DV.lineitem_nulls(T(spark, d, "lineitem"))
    pre = PR.Preprocessor(numeric_strategy="median", scaler_type="standard").fit(df.select("l_quantity", "l_discount"))
    return df.select("l_orderkey", "l_linenumber",
                     *[F.coalesce(F.col(c), F.lit(pre.num_fill[c])).alias(c) for c in ["l_quantity", "l_discount"]])


@register("impute_mean", _impute_sql("avg({})").replace("coalesce(l_quantity, s.q)", "round(coalesce(l_quantity, s.q), 6)")
          .replace("coalesce(l_discount, s.d)", "round(coalesce(l_discount, s.d), 6)"))
def _imp_mean(spark, d):
    df = DV.lineitem_nulls(T(spark, d, "lineitem"))
    pre = PR.Preprocessor(numeric_strategy="mean").fit(df.select("l_quantity", "l_discount"))
    return df.select("l_orderkey", "l_linenumber",
                     *[F.round(F.coalesce(F.col(c), F.lit(pre.num_fill[c])), R).alias(c) for c in ["l_quantity", "l_discount"]])


@register("impute_mode",
          f"SELECT l_orderkey, l_linenumber, coalesce(l_returnflag, (SELECT v FROM (SELECT l_returnflag AS v, count(*) AS n "
          f"FROM ({DV.LINEITEM_NULLS_SQL}) WHERE l_returnflag IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1)) AS l_returnflag "
          f"FROM ({DV.LINEITEM_NULLS_SQL})")
def _imp_mode(spark, d):
    df = DV.lineitem_nulls(T(spark, d, "lineitem"))
    pre = PR.Preprocessor().fit(df.select("l_returnflag"))
    return df.select("l_orderkey", "l_linenumber", F.coalesce("l_returnflag", F.lit(pre.cat_fill["l_returnflag"])).alias("l_returnflag"))


def _knn_cell(column):
    return (f"SELECT id, avg(v) AS v FROM (SELECT id, q_{column} AS v, row_number() OVER (PARTITION BY id ORDER BY dist, donor) AS nth "
            f"FROM d WHERE {column} IS NULL AND q_{column} IS NOT NULL) WHERE nth <= 5 GROUP BY id")


_KNN_COLS = ["size", "price", "width"]


@register("impute_knn",  # all donors of every row with a missing cell, by nan-Euclidean distance
          f"WITH p AS ({DV.PART_NULLS_SQL}), d AS (SELECT r.row_id AS id, o.row_id AS donor, r.size, r.price, r.width, "
          + ", ".join(f"o.{c} AS q_{c}" for c in _KNN_COLS) + ", ("
          + " + ".join(f"coalesce((r.{c} - o.{c}) * (r.{c} - o.{c}), 0)" for c in _KNN_COLS) + ") * 3 / ("
          + " + ".join(f"CAST(r.{c} IS NOT NULL AND o.{c} IS NOT NULL AS INTEGER)" for c in _KNN_COLS) + ") AS dist "
          "FROM p r JOIN p o ON (r.size IS NULL OR r.price IS NULL OR r.width IS NULL) AND ("
          + " OR ".join(f"(r.{c} IS NOT NULL AND o.{c} IS NOT NULL)" for c in _KNN_COLS) + ")), "
          + ", ".join(f"f_{c} AS ({_knn_cell(c)})" for c in _KNN_COLS)
          + " SELECT p.row_id, " + ", ".join(f"round(coalesce(p.{c}, f_{c}.v, (SELECT avg({c}) FROM p)), 6) AS {c}" for c in _KNN_COLS)
          + " FROM p " + " ".join(f"LEFT JOIN f_{c} ON f_{c}.id = p.row_id" for c in _KNN_COLS))
def _imp_knn(spark, d):
    got = KN.knn_impute(DV.part_nulls(T(spark, d, "part")), _KNN_COLS)
    return got.select("row_id", *[F.round(c, R).alias(c) for c in _KNN_COLS])


_SCALE_COLS = ["l_quantity", "l_discount", "l_tax"]


@register("scale_standard",
          "SELECT l_orderkey, l_linenumber, " + ", ".join(
              f"round(({c} - (SELECT avg({c}) FROM lineitem)) / coalesce(nullif((SELECT stddev_pop({c}) FROM lineitem), 0), 1), {R}) AS {c}"
              for c in _SCALE_COLS) + " FROM lineitem")
def _scale_std(spark, d):
    df = T(spark, d, "lineitem")
    pre = PR.Preprocessor(scaler_type="standard").fit(df.select(*_SCALE_COLS))
    return pre.transform(df, keep=["l_orderkey", "l_linenumber"]).select(
        "l_orderkey", "l_linenumber", *[F.round(c, R).alias(c) for c in _SCALE_COLS])


@register("scale_minmax",
          "SELECT l_orderkey, l_linenumber, " + ", ".join(
              f"round(({c} - (SELECT min({c}) FROM lineitem)) / coalesce(nullif((SELECT max({c}) - min({c}) FROM lineitem), 0), 1), {R}) AS {c}"
              for c in _SCALE_COLS) + " FROM lineitem")
def _scale_mm(spark, d):
    df = T(spark, d, "lineitem")
    pre = PR.Preprocessor(scaler_type="minmax").fit(df.select(*_SCALE_COLS))
    return pre.transform(df, keep=["l_orderkey", "l_linenumber"]).select(
        "l_orderkey", "l_linenumber", *[F.round(c, R).alias(c) for c in _SCALE_COLS])


@register("one_hot",
          "SELECT p_partkey, 'p_brand_' || p_brand AS feature, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS feature_index FROM part")
def _one_hot(spark, d):
    df = T(spark, d, "part")
    pre = PR.Preprocessor().fit(df.select("p_brand"))
    names = pre.feature_names()
    wide = pre.transform(df, keep=["p_partkey"])
    hot = F.array_position(F.array(*[F.col(f"`{n}`") for n in names]), 1.0).cast("int") - 1
    return wide.select("p_partkey", F.element_at(F.array(*[F.lit(n) for n in names]), hot + 1).alias("feature"),
                       hot.alias("feature_index"))


@register("feature_names",
          "SELECT 0 AS position, 'p_size' AS feature UNION ALL SELECT 1, 'p_retailprice' UNION ALL "
          "SELECT CAST(1 + dense_rank() OVER (ORDER BY p_brand) AS INTEGER), 'p_brand_' || p_brand FROM (SELECT DISTINCT p_brand FROM part)")
def _feat_names(spark, d):
    df = T(spark, d, "part").select("p_brand", "p_size", "p_retailprice")
    pre = PR.Preprocessor().fit(df)
    # F8 as a table derived from the fitted levels: (position, feature)
    levels = PR.frequency_table(df.select("p_brand"), ["p_brand"]).select("value").distinct()
    num = spark.createDataFrame([(i, c) for i, c in enumerate(pre.numeric_features)], "position int, feature string")
    cat = levels.select((F.dense_rank().over(PR_window_value()) + len(pre.numeric_features) - 1).cast("int").alias("position"),
                        F.concat(F.lit("p_brand_"), F.col("value")).alias("feature"))
    return num.unionByName(cat)


def PR_window_value():
    from pyspark.sql import Window
    return Window.orderBy("value")


@register("dedupe_rows", f"SELECT DISTINCT * FROM ({DV.LINEITEM_DUPS_SQL})")
def _dedupe(spark, d):
    return PR.dedupe_rows(DV.lineitem_dups(T(spark, d, "lineitem")))


def _prep_table_sql() -> str:
    base = "SELECT DISTINCT p_brand, p_size, p_retailprice FROM part"
    num = []
    for c in ["p_size", "p_retailprice"]:
        num.append(f"SELECT p_brand, p_size, p_retailprice, '{c}' AS feature, "
                   f"round((CAST({c} AS DOUBLE) - s.m_{c}) / coalesce(nullif(s.s_{c}, 0), 1), {R}) AS value FROM b, s")
    stats = ("SELECT " + ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}"
                                   for c in ["p_size", "p_retailprice"]) + " FROM b")
    cat = ("SELECT b.p_brand, b.p_size, b.p_retailprice, 'p_brand_' || l.v AS feature, "
           "CASE WHEN b.p_brand = l.v THEN 1.0 ELSE 0.0 END AS value FROM b, (SELECT DISTINCT p_brand AS v FROM b) l")
    return f"WITH b AS ({base}), s AS ({stats}) " + " UNION ALL ".join(num + [cat])


@register("preprocess_table", _prep_table_sql())
def _prep_table(spark, d):
    # M1/M2 on part's usable columns: dedupe → impute → scale → one-hot, long form per (row, feature)
    df = T(spark, d, "part").select("p_brand", "p_size", "p_retailprice")
    prepared = PR.preprocess(df)
    names = prepared.feature_names
    keys = ["p_brand", "p_size", "p_retailprice"]
    base = prepared.base.select("*", *[F.col(k).alias(f"key_{k}") for k in keys])
    wide = prepared.preprocessor.transform(base, keep=[f"key_{k}" for k in keys])
    longf = wide.select(*[F.col(f"key_{k}").alias(k) for k in keys], F.inline(F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").alias("value")) for n in names])))
    return longf.select(*keys, "feature", F.round("value", R).alias("value"))


def _pca_sql() -> str:
    return (
        "WITH s AS (SELECT avg(p_size::DOUBLE) AS m0, avg(p_retailprice) AS m1, var_samp(p_size::DOUBLE) AS a, "
        "covar_samp(p_size::DOUBLE, p_retailprice) AS b, var_samp(p_retailprice) AS c FROM part), "
        "e AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) AS l1, "
        "(a + c) / 2 - sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) AS l2 FROM s), "
        "v AS (SELECT *, b / sqrt(b * b + (l1 - a) * (l1 - a)) AS u0, (l1 - a) / sqrt(b * b + (l1 - a) * (l1 - a)) AS u1, "
        "b / sqrt(b * b + (l2 - a) * (l2 - a)) AS w0, (l2 - a) / sqrt(b * b + (l2 - a) * (l2 - a)) AS w1 FROM e), "
        "f AS (SELECT *, CASE WHEN (CASE WHEN abs(u0) >= abs(u1) THEN u0 ELSE u1 END) < 0 THEN -1 ELSE 1 END AS su, "
        "CASE WHEN (CASE WHEN abs(w0) >= abs(w1) THEN w0 ELSE w1 END) < 0 THEN -1 ELSE 1 END AS sw FROM v) "
        f"SELECT p_partkey, round(su * ((p_size - m0) * u0 + (p_retailprice - m1) * u1), {R}) AS PC1, "
        f"round(sw * ((p_size - m0) * w0 + (p_retailprice - m1) * w1), {R}) AS PC2 FROM part, f")


@register("pca_scatter", _pca_sql())
def _pca(spark, d):
    res = PR.pca(T(spark, d, "part"), ["p_size", "p_retailprice"], 2, keep=["p_partkey"])
    frame, _ = res
    return frame.select("p_partkey", F.round("PC1", R).alias("PC1"), F.round("PC2", R).alias("PC2"))


@register("pca_explained",
          "WITH s AS (SELECT var_samp(p_size::DOUBLE) AS a, covar_samp(p_size::DOUBLE, p_retailprice) AS b, "
          "var_samp(p_retailprice) AS c FROM part), e AS (SELECT (a + c) / 2 + sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) AS l1, "
          "(a + c) / 2 - sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) AS l2 FROM s) "
          f"SELECT 'PC1' AS component, round(l1 / (l1 + l2), {R}) AS explained_variance_ratio FROM e "
          f"UNION ALL SELECT 'PC2', round(l2 / (l1 + l2), {R}) FROM e")
def _pca_ev(spark, d):
    res = PR.pca(T(spark, d, "part"), ["p_size", "p_retailprice"], 2, keep=["p_partkey"])
    # C5 side table: explained variance per component, derived from the fitted covariance of the scan
    rows = [(f"PC{i + 1}", float(r)) for i, r in enumerate(res[1])]
    return spark.createDataFrame(rows, "component string, explained_variance_ratio double").select(
        "component", F.round("explained_variance_ratio", R).alias("explained_variance_ratio"))


# =============================================================== cluster metrics on fixed labels
from ..functions import bands as BD  # noqa: E402
from ..operators import cluster_metrics as CM  # noqa: E402
from ..operators import dbscan as DB  # noqa: E402
from ..operators import neighbors as NB  # noqa: E402

_PL = f"({DV.PART_LABELS_SQL})"
_PP = f"({DV.PART_POINTS_SQL})"
_XY = ["x0", "x1"]


def _labels(spark, d):
    return DV.part_labels(T(spark, d, "part"))


@register("cluster_sizes", f"SELECT cluster, count(*) AS size FROM {_PL} GROUP BY cluster")
def _csizes(spark, d):
    return CM.cluster_sizes(_labels(spark, d))


@register("cluster_counts",
          f"SELECT CAST(count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS BIGINT) AS n_clusters, "
          f"CAST(count(*) FILTER (WHERE cluster = -1) AS BIGINT) AS n_noise, CAST(count(*) AS BIGINT) AS n_rows FROM {_PL}")
def _ccounts(spark, d):
    return CM.cluster_counts(_labels(spark, d))


@register("cluster_balance",
          f"SELECT round(avg(size), 6) AS avg_size, min(size) AS min_size, max(size) AS max_size, "
          f"round(max(size)::DOUBLE / min(size), 6) AS size_ratio FROM (SELECT cluster, count(*) AS size FROM {_PL} GROUP BY cluster)")
def _cbal(spark, d):
    return CM.cluster_balance(_labels(spark, d))


_CENT_SQL = (f"c AS (SELECT cluster, count(*) AS n, avg(x0) AS c0, avg(x1) AS c1 FROM {_PL} GROUP BY cluster), "
             f"w AS (SELECT p.cluster, (p.x0 - c.c0) * (p.x0 - c.c0) + (p.x1 - c.c1) * (p.x1 - c.c1) AS d2 "
             f"FROM {_PL} p JOIN c USING (cluster))")


@register("inertia", f"WITH {_CENT_SQL} SELECT round(sum(d2), 6) AS inertia FROM w")
def _inertia(spark, d):
    lab = _labels(spark, d)
    return spark.createDataFrame([(round(CM.within_cluster_ss(lab, _XY), R),)], "inertia double")


@register("davies_bouldin",
          f"WITH {_CENT_SQL}, s AS (SELECT cluster, avg(sqrt(d2)) AS s FROM w GROUP BY cluster), "
          f"r AS (SELECT a.cluster, max((sa.s + sb.s) / sqrt((a.c0 - b.c0) * (a.c0 - b.c0) + (a.c1 - b.c1) * (a.c1 - b.c1))) AS r "
          f"FROM c a JOIN c b ON a.cluster <> b.cluster JOIN s sa ON sa.cluster = a.cluster JOIN s sb ON sb.cluster = b.cluster GROUP BY a.cluster) "
          f"SELECT round(avg(r), 6) AS davies_bouldin FROM r")
def _db(spark, d):
    lab = _labels(spark, d)
    return spark.createDataFrame([(round(CM.davies_bouldin(lab, _XY), R),)], "davies_bouldin double")


@register("calinski_harabasz",
          f"WITH {_CENT_SQL}, g AS (SELECT avg(x0) AS g0, avg(x1) AS g1, count(*) AS n FROM {_PL}), "
          f"b AS (SELECT sum(c.n * ((c.c0 - g.g0) * (c.c0 - g.g0) + (c.c1 - g.g1) * (c.c1 - g.g1))) AS b, count(*) AS k FROM c, g) "
          f"SELECT round(b.b * (g.n - b.k) / ((SELECT sum(d2) FROM w) * (b.k - 1)), 6) AS calinski_harabasz FROM b, g")
def _ch(spark, d):
    lab = _labels(spark, d)
    return spark.createDataFrame([(round(CM.calinski_harabasz(lab, _XY), R),)], "calinski_harabasz double")


def _sil_rows_sql(src: str) -> str:
    return (f"pr AS (SELECT a.row_id, a.cluster AS ca, b.cluster AS cb, "
            f"(a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1) AS d FROM {src} a JOIN {src} b ON a.row_id <> b.row_id), "
            f"m AS (SELECT row_id, ca, cb, avg(d) AS md FROM pr GROUP BY row_id, ca, cb), "
            f"sr AS (SELECT row_id, ca AS cluster, max(CASE WHEN ca = cb THEN md END) AS a, min(CASE WHEN ca <> cb THEN md END) AS b "
            f"FROM m GROUP BY row_id, ca), "
            f"sil AS (SELECT row_id, cluster, CASE WHEN a IS NULL THEN 0.0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0.0) END AS s FROM sr)")


@register("silhouette_sq", f"WITH {_sil_rows_sql(_PL)} SELECT round(avg(s), 6) AS silhouette_sq FROM sil")
def _sil(spark, d):
    lab = _labels(spark, d)
    return spark.createDataFrame([(round(CM.silhouette_sq(lab, _XY), R),)], "silhouette_sq double")


@register("silhouette_by_cluster",
          f"WITH {_sil_rows_sql(_PL)}, g AS (SELECT cluster, avg(s) AS sil FROM sil GROUP BY cluster) "
          f"SELECT cluster, round(sil, 6) AS silhouette, "
          f"CASE WHEN sil > 0.5 THEN 'strong' WHEN sil > 0.2 THEN 'moderate' ELSE 'weak' END AS quality, "
          f"CASE WHEN sil < -0.2 THEN {lit(BD.SIL_VERY_WEAK)} WHEN sil < 0.0 THEN {lit(BD.SIL_WEAK_NEG)} "
          f"WHEN sil < 0.3 THEN {lit(BD.SIL_WEAK)} WHEN sil < 0.5 THEN {lit(BD.SIL_MODERATE)} "
          f"WHEN sil < 0.7 THEN {lit(BD.SIL_GOOD)} ELSE {lit(BD.SIL_EXCELLENT)} END AS reading, "
          f"CASE WHEN sil < -0.2 THEN 'error' WHEN sil < 0.3 THEN 'warning' WHEN sil < 0.5 THEN 'info' ELSE 'success' END AS level "
          f"FROM g")
def _sil_by(spark, d):
    # F13 / F14 applied per segment: each cluster's mean silhouette, banded two ways
    lab = _labels(spark, d)
    rows = CM.silhouette_rows(lab, _XY).groupBy("cluster").agg(F.avg("silhouette").alias("sil"))
    msg, level = BD.silhouette_reading(F.col("sil"))
    return rows.select("cluster", F.round("sil", R).alias("silhouette"), BD.cluster_quality_band(F.col("sil")).alias("quality"),
                       msg.alias("reading"), level.alias("level"))


def _eval_sql(src: str, name: str) -> str:
    """Safe metrics + 4-dp summary for one labelling of part_points (noise counted as a cluster)."""
    return (f"WITH {_sil_rows_sql(src)}, "
            f"c AS (SELECT cluster, count(*) AS n, avg(x0) AS c0, avg(x1) AS c1 FROM {src} GROUP BY cluster), "
            f"w AS (SELECT p.cluster, (p.x0 - c.c0) * (p.x0 - c.c0) + (p.x1 - c.c1) * (p.x1 - c.c1) AS d2 FROM {src} p JOIN c USING (cluster)), "
            f"s AS (SELECT cluster, avg(sqrt(d2)) AS s FROM w GROUP BY cluster), "
            f"r AS (SELECT a.cluster, max((sa.s + sb.s) / sqrt((a.c0 - b.c0) * (a.c0 - b.c0) + (a.c1 - b.c1) * (a.c1 - b.c1))) AS r "
            f"FROM c a JOIN c b ON a.cluster <> b.cluster JOIN s sa ON sa.cluster = a.cluster JOIN s sb ON sb.cluster = b.cluster GROUP BY a.cluster), "
            f"g AS (SELECT avg(x0) AS g0, avg(x1) AS g1, count(*) AS n FROM {src}), "
            f"b AS (SELECT sum(c.n * ((c.c0 - g.g0) * (c.c0 - g.g0) + (c.c1 - g.g1) * (c.c1 - g.g1))) AS b, count(*) AS k FROM c, g), "
            f"k AS (SELECT count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS nc, count(*) FILTER (WHERE cluster = -1) AS nn, count(*) AS nr FROM {src}), "
            f"mt AS (SELECT k.nc, k.nn, k.nr, CASE WHEN k.nc < 2 THEN -1.0 ELSE (SELECT avg(s) FROM sil) END AS sil, "
            f"CASE WHEN k.nc < 2 THEN NULL ELSE (SELECT avg(r) FROM r) END AS db, "
            f"CASE WHEN k.nc < 2 THEN NULL ELSE b.b * (g.n - b.k) / ((SELECT sum(d2) FROM w) * (b.k - 1)) END AS ch FROM k, b, g) "
            f"SELECT {lit(name)} AS model, CAST(nc AS BIGINT) AS n_clusters, CAST(nn AS BIGINT) AS n_noise, CAST(nr AS BIGINT) AS n_rows, "
            f"round(sil, 4) AS silhouette_sq, round(db, 4) AS davies_bouldin_score, round(ch, 4) AS calinski_harabasz_score, "
            f"CASE WHEN sil > 0.5 THEN 'strong' WHEN sil > 0.2 THEN 'moderate' ELSE 'weak' END AS quality, sil AS raw_sil FROM mt")


def _evaluation_frame(spark, lab, name: str):
    m = CM.safe_metrics(lab, _XY)

    def r4(v):
        return None if v is None else round(v, 4)

    row = (name, m["n_clusters"], m["n_noise"], m["n_rows"], r4(m["silhouette"]), r4(m["davies_bouldin"]),
           r4(m["calinski_harabasz"]), float(m["silhouette"]))
    df = spark.createDataFrame([row], "model string, n_clusters long, n_noise long, n_rows long, silhouette_sq double, "
                                      "davies_bouldin_score double, calinski_harabasz_score double, raw_sil double")
    return df.withColumn("quality", BD.cluster_quality_band(F.col("raw_sil")))


@register("cluster_evaluation",
          f"SELECT model, n_clusters, n_noise, silhouette_sq, davies_bouldin_score, calinski_harabasz_score, quality "
          f"FROM ({_eval_sql(_PL, 'p_size_bands')})")
def _ceval(spark, d):
    # F16: the rounded evaluation summary of one labelling
    return _evaluation_frame(spark, _labels(spark, d), "p_size_bands").select(
        "model", "n_clusters", "n_noise", "silhouette_sq", "davies_bouldin_score", "calinski_harabasz_score", "quality")


_PRICE_SPLIT_SQL = f"(SELECT row_id, x0, x1, CASE WHEN x1 > 0 THEN 1 ELSE 0 END AS cluster FROM {_PP})"


def _price_split(spark, d):
    pts = DV.part_points(T(spark, d, "part"))
    return pts.select("row_id", "x0", "x1", F.when(F.col("x1") > 0, 1).otherwise(0).alias("cluster"))


@register("select_clustering",
          f"WITH e AS (SELECT * FROM ({_eval_sql(_PL, 'p_size_bands')}) UNION ALL SELECT * FROM ({_eval_sql(_PRICE_SPLIT_SQL, 'price_split')})), "
          f"a AS (SELECT model, raw_sil - CASE WHEN n_clusters <= 1 THEN 1.0 ELSE 0.0 END "
          f"- CASE WHEN n_noise::DOUBLE / n_rows > 0.3 THEN (n_noise::DOUBLE / n_rows - 0.3) * 2.0 ELSE 0.0 END AS adj, "
          f"CASE model WHEN 'p_size_bands' THEN 0 ELSE 1 END AS ord FROM e) "
          f"SELECT model, round(adj, 6) AS adjusted_score, row_number() OVER (ORDER BY adj DESC, ord) = 1 AS selected FROM a")
def _select(spark, d):
    # Adjusted score per candidate; the best (first listed on ties) is selected
    ev = _evaluation_frame(spark, _labels(spark, d), "p_size_bands").withColumn("ord", F.lit(0)).unionByName(
        _evaluation_frame(spark, _price_split(spark, d), "price_split").withColumn("ord", F.lit(1)))
    return CM.select_best(ev)


# =============================================================== neighbours and DBSCAN


def _points(spark, d):
    return DV.with_features(DV.part_points(T(spark, d, "part")))


_KNN_SQL = (f"WITH p AS {_PP}, pr AS (SELECT a.row_id, sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1)) AS d "
            f"FROM p a, p b), rk AS (SELECT row_id, d, row_number() OVER (PARTITION BY row_id ORDER BY d) AS r FROM pr), "
            f"ms AS (SELECT greatest(5, CAST(floor(ln(count(*))) AS INTEGER)) AS k FROM p), "
            f"kd AS (SELECT row_id, d AS kdist FROM rk, ms WHERE r = ms.k)")


@register("knn_distance", f"{_KNN_SQL} SELECT row_id, round(kdist, 6) AS kdist FROM kd")
def _knn(spark, d):
    pts = _points(spark, d)
    k = pts.select(BD.dbscan_min_samples(F.count(F.lit(1)))).first()[0]
    return NB.kth_neighbor_distance(pts, k).select("row_id", F.round("kdist", R).alias("kdist"))


@register("dbscan_eps",
          f"{_KNN_SQL} SELECT (SELECT k FROM ms) AS min_samples, round(quantile_cont(kdist, 0.9), 6) AS eps FROM kd")
def _eps(spark, d):
    pts = _points(spark, d)
    k = pts.select(BD.dbscan_min_samples(F.count(F.lit(1)))).first()[0]
    eps, _ = NB.estimate_eps(pts, k)
    return spark.createDataFrame([(int(k), round(eps, R))], "min_samples int, eps double")


def _dbscan_sql(eps_sql: str, ms_sql: str) -> str:
    return (
        f"WITH RECURSIVE p AS {_PP}, "
        f"nb AS (SELECT a.row_id AS i, b.row_id AS j FROM p a JOIN p b ON "
        f"sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1)) <= ({eps_sql})), "
        f"core AS (SELECT i FROM nb GROUP BY i HAVING count(*) >= ({ms_sql})), "
        f"ce AS (SELECT nb.i, nb.j FROM nb JOIN core c1 ON nb.i = c1.i JOIN core c2 ON nb.j = c2.i), "
        f"reach(node, lbl) AS (SELECT i, i FROM core UNION SELECT ce.j, r.lbl FROM reach r JOIN ce ON ce.i = r.node), "
        f"comp AS (SELECT node, min(lbl) AS c FROM reach GROUP BY node), "
        f"num AS (SELECT c, dense_rank() OVER (ORDER BY c) - 1 AS k FROM (SELECT DISTINCT c FROM comp)), "
        f"corelab AS (SELECT comp.node, num.k FROM comp JOIN num USING (c)), "
        f"border AS (SELECT nb.i AS node, min(cl.k) AS k FROM nb JOIN corelab cl ON nb.j = cl.node "
        f"WHERE nb.i NOT IN (SELECT i FROM core) GROUP BY nb.i) "
        f"SELECT p.row_id, CAST(coalesce(cl.k, b.k, -1) AS INTEGER) AS cluster FROM p "
        f"LEFT JOIN corelab cl ON p.row_id = cl.node LEFT JOIN border b ON p.row_id = b.node")


@register("dbscan_labels", _dbscan_sql("0.12", "7"))
def _dbscan_fixed(spark, d):
    return DB.dbscan(_points(spark, d), 0.12, 7).select("row_id", "cluster")


@register("dbscan_labels_fine", _dbscan_sql("0.10", "7"))
def _dbscan_fine(spark, d):
    return DB.dbscan(_points(spark, d), 0.10, 7).select("row_id", "cluster")


# =============================================================== model metrics and splits
from ..operators import model_eval as ME  # noqa: E402

_LP = f"({DV.LABEL_PRED_SQL})"
_LN = f"({DV.LINE_PRED_SQL})"


def _clsmetrics_sql(src: str) -> str:
    return (f"WITH conf AS (SELECT label AS t, prediction AS p, count(*) AS c FROM {src} GROUP BY 1, 2), "
            f"cls AS (SELECT t AS cls FROM conf UNION SELECT p FROM conf), "
            f"per AS (SELECT cls.cls, coalesce((SELECT sum(c) FROM conf WHERE t = cls.cls), 0) AS support, "
            f"coalesce((SELECT sum(c) FROM conf WHERE p = cls.cls), 0) AS npred, "
            f"coalesce((SELECT sum(c) FROM conf WHERE t = cls.cls AND p = cls.cls), 0) AS tp FROM cls), "
            f"pr AS (SELECT *, coalesce(tp::DOUBLE / nullif(npred, 0), 0.0) AS prec, coalesce(tp::DOUBLE / nullif(support, 0), 0.0) AS rec FROM per), "
            f"f AS (SELECT *, coalesce(2.0 * prec * rec / nullif(prec + rec, 0), 0.0) AS f1 FROM pr) "
            f"SELECT round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy, round(sum(support * f1) / sum(support), 6) AS f1, "
            f"round(sum(support * prec) / sum(support), 6) AS precision, round(sum(support * rec) / sum(support), 6) AS recall FROM f")


@register("classification_metrics", _clsmetrics_sql(_LP))
def _clsm(spark, d):
    return ME.classification_metrics(DV.label_pred(T(spark, d, "labels")))


@register("roc_auc",
          f"WITH g AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM {_LP} GROUP BY score), "
          f"c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM g) "
          f"SELECT round(sum(pos * (neg_below + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM c")
def _auc(spark, d):
    return spark.createDataFrame([(round(ME.roc_auc(DV.label_pred(T(spark, d, "labels"))), R),)], "roc_auc double")


@register("regression_metrics",
          f"WITH s AS (SELECT sum((label - prediction) * (label - prediction)) AS ssr, sum(abs(label - prediction)) AS sae, "
          f"sum((label - (SELECT avg(label) FROM {_LN})) * (label - (SELECT avg(label) FROM {_LN}))) AS sst, count(*) AS n FROM {_LN}) "
          f"SELECT round(sqrt(ssr / n), 6) AS rmse, round(sae / n, 6) AS mae, "
          f"round(CASE WHEN sst = 0 THEN CASE WHEN ssr = 0 THEN 1.0 ELSE 0.0 END ELSE 1.0 - ssr / sst END, 6) AS r2 FROM s")
def _regm(spark, d):
    return ME.regression_metrics(DV.line_pred(T(spark, d, "lineitem")))


@register("class_counts",
          "SELECT p_type AS cls, count(*) AS count, count(*) = min(count(*)) OVER () AS rarest FROM part GROUP BY p_type")
def _ccls(spark, d):
    return ME.class_counts(T(spark, d, "part"), "p_type")


@register("problem_type",
          "SELECT column_name, CASE WHEN cls = 'categorical' THEN 'classification' "
          "WHEN n_distinct::DOUBLE / n_rows < 0.05 THEN 'classification' ELSE 'regression' END AS problem_type "
          f"FROM ({column_stats_sql('lineitem')}) WHERE cls IN ('numeric', 'categorical')")
def _ptype(spark, d):
    # F10 for every candidate target column of the table
    prof = P.full_profile(T(spark, d, "lineitem")).where(F.col("cls").isin("numeric", "categorical"))
    return prof.select("column_name", ME.problem_type_col(F.col("cls") == "categorical", F.col("n_distinct"),
                                                          F.col("n_rows")).alias("problem_type"))


@register("label_encode",
          "SELECT p_type AS value, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS index FROM (SELECT DISTINCT p_type FROM part)")
def _lenc(spark, d):
    return ME.label_index(T(spark, d, "part"), "p_type")


_SEG_SQL = ("SELECT d.source, count(*) AS n, avg(CASE WHEN l.quality = l.toxic THEN 1.0 ELSE 0.0 END) AS acc "
            "FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY d.source")

# Performance reading messages (cuts 0.6 / 0.75).
_PERF_MSG = {
    "weak": ("⚠️ Model performance is weak ({p}). Predictions are unreliable and should not drive decisions yet.", "warning"),
    "moderate": ("💡 Moderate performance ({p}). Model shows some predictive power but could be improved.", "info"),
    "strong": ("✅ Strong performance ({p}). Model predictions are reasonably reliable.", "success"),
}


def _pct_sql(x: str) -> str:
    return f"CAST(round({x} * 100, 1) AS VARCHAR) || '%'"


def _perf_sql() -> str:
    band = "CASE WHEN acc < 0.6 THEN 'weak' WHEN acc <= 0.75 THEN 'moderate' ELSE 'strong' END"
    msg = "CASE " + " ".join(
        f"WHEN {band} = {lit(b)} THEN replace({lit(m)}, '{{p}}', {_pct_sql('acc')})" for b, (m, _) in _PERF_MSG.items()) + " END"
    lvl = "CASE " + " ".join(f"WHEN {band} = {lit(b)} THEN {lit(v)}" for b, (_, v) in _PERF_MSG.items()) + " END"
    return (f"SELECT source, CAST(n AS BIGINT) AS n, round(acc, 6) AS score, {band} AS band, {msg} AS message, {lvl} AS level "
            f"FROM ({_SEG_SQL})")


def pct_col(x):
    return F.concat(F.round(x * 100, 1).cast("string"), F.lit("%"))


@register("performance_band", _perf_sql())
def _perf(spark, d):
    # F12 per segment: accuracy of a fixed rule within each document source, banded
    lab = T(spark, d, "labels")
    docs = T(spark, d, "documents").select("doc_id", "source")
    seg = (lab.join(docs, "doc_id").groupBy("source")
           .agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("quality") == F.col("toxic"), 1.0).otherwise(0.0)).alias("acc")))
    band = BD.performance_band(F.col("acc"))
    msg = None
    lvl = None
    for b, (m, v) in _PERF_MSG.items():
        pre, post = m.split("{p}")
        text = F.concat(F.lit(pre), pct_col(F.col("acc")), F.lit(post))
        msg = F.when(band == b, text) if msg is None else msg.when(band == b, text)
        lvl = F.when(band == b, F.lit(v)) if lvl is None else lvl.when(band == b, F.lit(v))
    return seg.select("source", F.col("n").cast("long").alias("n"), F.round("acc", R).alias("score"), band.alias("band"),
                      msg.alias("message"), lvl.alias("level"))


def _nsplits_sql(table: str, cls: str) -> str:
    return f"(SELECT greatest(2, least(5, min(c))) FROM (SELECT count(*) AS c FROM {table} GROUP BY {cls}))"


@register("cv_folds",
          f"SELECT p_partkey, CAST((row_number() OVER (PARTITION BY p_type ORDER BY md5('42|' || CAST(p_partkey AS VARCHAR))) - 1) "
          f"% {_nsplits_sql('part', 'p_type')} AS INTEGER) AS fold FROM part")
def _folds(spark, d):
    part = T(spark, d, "part").select("p_partkey", "p_type")
    counts = {r[0]: r[1] for r in part.groupBy("p_type").count().collect()}
    k = ME.n_splits_for(counts, "classification")
    return ME.assign_folds(part, "p_partkey", "p_type", k).select("p_partkey", "fold")


@register("holdout_split",
          "WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY p_type), "
          "a AS (SELECT p_type, n, CAST(floor(0.2 * n) AS BIGINT) AS base, 0.2 * n - floor(0.2 * n) AS frac FROM c), "
          "r AS (SELECT *, row_number() OVER (ORDER BY frac DESC, p_type) AS rr FROM a), "
          "q AS (SELECT p_type, base + CASE WHEN rr <= CAST(ceil(0.2 * (SELECT count(*) FROM part)) AS BIGINT) - (SELECT sum(base) FROM a) "
          "THEN 1 ELSE 0 END AS quota FROM r) "
          "SELECT p.p_partkey, (row_number() OVER (PARTITION BY p.p_type ORDER BY md5('42|' || CAST(p.p_partkey AS VARCHAR))) - 1) < q.quota AS is_test "
          "FROM part p JOIN q USING (p_type)")
def _holdout(spark, d):
    part = T(spark, d, "part").select("p_partkey", "p_type")
    return ME.holdout(part, "p_partkey", "p_type", 0.2).select("p_partkey", "is_test")


# fold scores of three fixed predictors of labels.quality, over stratified folds
_FOLD_SQL = (f"WITH f AS (SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('42|' || CAST(doc_id AS VARCHAR))) - 1) "
             f"% (SELECT greatest(2, least(5, min(c))) FROM (SELECT count(*) AS c FROM {_LP} GROUP BY label)) AS INTEGER) AS fold FROM {_LP}), "
             "s AS (SELECT 'toxic_rule' AS model, fold, avg(CASE WHEN prediction = label THEN 1.0 ELSE 0.0 END) AS score FROM f GROUP BY fold "
             "UNION ALL SELECT 'always_one', fold, avg(CASE WHEN label = 1.0 THEN 1.0 ELSE 0.0 END) FROM f GROUP BY fold "
             "UNION ALL SELECT 'score_rule', fold, avg(CASE WHEN (CASE WHEN score > 0.5 THEN 1.0 ELSE 0.0 END) = label THEN 1.0 ELSE 0.0 END) FROM f GROUP BY fold)")


def _fold_scores(spark, d):
    lp = DV.label_pred(T(spark, d, "labels"))
    counts = {r[0]: r[1] for r in lp.groupBy("label").count().collect()}
    k = ME.n_splits_for(counts, "classification")
    f = ME.assign_folds(lp, "doc_id", "label", k)
    rules = {"toxic_rule": F.col("prediction"), "always_one": F.lit(1.0),
             "score_rule": F.when(F.col("score") > 0.5, 1.0).otherwise(0.0)}
    out = None
    for name, pred in rules.items():
        s = f.groupBy("fold").agg(F.avg(F.when(pred == F.col("label"), 1.0).otherwise(0.0)).alias("score")) \
             .select(F.lit(name).alias("model"), "fold", "score")
        out = s if out is None else out.unionByName(s)
    return out


@register("fold_scores", f"{_FOLD_SQL} SELECT model, fold, round(score, 6) AS score FROM s")
def _fscores(spark, d):
    return _fold_scores(spark, d).select("model", "fold", F.round("score", R).alias("score"))


@register("cv_stability",
          f"{_FOLD_SQL} SELECT model, round(avg(score), 6) AS mean_score, round(stddev_pop(score), 6) AS std_score, "
          f"round(CASE WHEN avg(score) > 0 THEN stddev_pop(score) / avg(score) ELSE 0.0 END, 6) AS cv FROM s GROUP BY model")
def _cvstab(spark, d):
    return ME.fold_stability(_fold_scores(spark, d))


@register("cv_metrics",
          f"{_FOLD_SQL}, c AS (SELECT fold, cls, sum(support) AS support, sum(guessed) AS guessed, sum(hit) AS hit FROM ("
          "SELECT fold, label AS cls, 1 AS support, 0 AS guessed, CASE WHEN label = prediction THEN 1 ELSE 0 END AS hit FROM f "
          "UNION ALL SELECT fold, prediction, 0, 1, 0 FROM f) GROUP BY fold, cls), "
          "m AS (SELECT *, coalesce(hit / nullif(CAST(guessed AS DOUBLE), 0), 0) AS pr, coalesce(hit / nullif(CAST(support AS DOUBLE), 0), 0) AS re FROM c) "
          "SELECT fold, round(sum(hit) / CAST(sum(support) AS DOUBLE), 6) AS accuracy, "
          "round(sum(support * coalesce(2 * pr * re / nullif(pr + re, 0), 0)) / sum(support), 6) AS f1, "
          "round(sum(support * pr) / sum(support), 6) AS precision, round(sum(support * re) / sum(support), 6) AS recall FROM m GROUP BY fold")
def _cv_metrics(spark, d):
    # Every metric of every fold in one pass, as the trainer scores its folds
    lp = DV.label_pred(T(spark, d, "labels"))
    k = ME.n_splits_for({r[0]: r[1] for r in lp.groupBy("label").count().collect()}, "classification")
    m = ME.fold_metrics(ME.assign_folds(lp, "doc_id", "label", k), "classification")
    return m.select("fold", *[F.round(c, R).alias(c) for c in ("accuracy", "f1", "precision", "recall")])


@register("label_decode",
          "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS code, p_type AS predicted_label FROM part")
def _label_decode(spark, d):
    # F11, there and back: class numbers from the sorted labels, and the labels that the numbers stand for
    part = T(spark, d, "part").select("p_partkey", "p_type")
    index = ME.label_index(part, "p_type")
    levels = [r["value"] for r in index.orderBy("index").collect()]
    coded = part.join(index, F.col("p_type") == F.col("value")).select("p_partkey", F.col("index").alias("code"))
    return ME.label_names(coded, levels, "code")


@register("model_ranking",
          f"{_FOLD_SQL} SELECT model, round(avg(score), 6) AS score, CAST(row_number() OVER (ORDER BY avg(score) DESC, model) AS INTEGER) AS rank "
          f"FROM s GROUP BY model")
def _mrank(spark, d):
    # Fold lists averaged (non-numeric scores skipped), ranked best first
    from pyspark.sql import Window
    s = _fold_scores(spark, d).withColumn("score", F.col("score").try_cast("double")).where(F.col("score").isNotNull())
    g = s.groupBy("model").agg(F.avg("score").alias("score"))
    return g.select("model", F.round("score", R).alias("score"),
                    F.row_number().over(Window.orderBy(F.desc("score"), "model")).cast("int").alias("rank"))


# =============================================================== trainers (M11–M16, M18, IO4, F18)
from ..operators import train as TR  # noqa: E402


@register("ridge_fit",
          "WITH s AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem), "
          "c AS (SELECT sum((l_quantity - mx) * (l_extendedprice - my)) AS sxy, sum((l_quantity - mx) * (l_quantity - mx)) AS sxx FROM lineitem, s) "
          "SELECT round(sxy / (sxx + 1.0), 4) AS coefficient, round(my - sxy / (sxx + 1.0) * mx, 4) AS intercept FROM c, s")
def _ridge(spark, d):
    coef, icpt = TR.ridge_closed_form(T(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 1.0)
    return spark.createDataFrame([(round(coef, 4), round(icpt, 4))], "coefficient double, intercept double")


def _cv_frame(spark, res: "TR.ModelingResult"):
    rows = [(m, int(f), float(s), float(res.all_scores[m]), m == res.best_model_name, res.problem_type)
            for m, scores in res.cross_val_scores.items() for f, s in enumerate(scores)]
    return spark.createDataFrame(rows, "model string, fold int, score double, mean_score double, is_best boolean, problem_type string")


def _binary_input(spark, d):
    lab = T(spark, d, "labels")
    docs = T(spark, d, "documents").select("doc_id", "n_chars", "source")
    return lab.join(docs, "doc_id").select("n_chars", "source", "quality")


@register("train_classification")
def _train_cls(spark, d):
    # Part → p_type (6 classes) from size, price and brand; per-fold scores
    df = T(spark, d, "part").select("p_size", "p_retailprice", "p_brand", "p_type")
    return _cv_frame(spark, TR.train(df, "p_type"))


@register("train_binary")
def _train_bin(spark, d):
    return _cv_frame(spark, TR.train(_binary_input(spark, d), "quality"))


@register("train_regression")
def _train_reg(spark, d):
    # Lineitem → l_extendedprice from quantity, discount, tax
    df = T(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_extendedprice")
    return _cv_frame(spark, TR.train(df, "l_extendedprice"))


@register("cv_scores")
def _cv_scores(spark, d):
    # Every metric per model and fold, beside the facts of the run
    res = TR.train(_binary_input(spark, d), "quality")
    facts = res.run_facts(spark).first().asDict()
    return res.cv_scores(spark).select("*", *[F.lit(v).alias(c) for c, v in facts.items()])


@register("feature_importance_topk")
def _fi_topk(spark, d):
    # Top-5 importances of the refitted best model, named from the feature metadata
    res = TR.train(_binary_input(spark, d), "quality")
    rows = [(i + 1, f, float(v), res.best_model_name) for i, (f, v) in enumerate(res.feature_importance)]
    return spark.createDataFrame(rows, "rank int, feature string, importance double, model string")


def _binary_features(spark, d):
    base, pre, problem, levels = TR.prepare_supervised(_binary_input(spark, d), "quality")
    from pyspark.ml import Pipeline
    stages = TR.feature_pipeline(pre, ["row_id", "label"])
    return base, pre, stages


@register("linear_importance")
def _lin_imp(spark, d):
    # |coefficients| of the logistic model, averaged over classes
    base, pre, stages = _binary_features(spark, d)
    from pyspark.ml import Pipeline
    n = base.count()
    lr = TR.make_models(TR.CLASSIFICATION, n, 2)["LogisticRegression"]
    model = Pipeline(stages=stages + [lr]).fit(base)
    imp = TR.importances(model.stages[-1], len(pre.feature_names()))
    rows = sorted(zip(pre.feature_names(), [float(x) for x in imp]), key=lambda t: -t[1])
    return spark.createDataFrame([(f, v) for f, v in rows], "feature string, importance double")


@register("model_roundtrip")
def _roundtrip(spark, d):
    # IO4 / F11: fitted preprocessing, forest and labels saved, loaded and re-scored
    from pyspark.ml import Pipeline
    base, pre, stages = _binary_features(spark, d)
    features = Pipeline(stages=stages).fit(base)
    forest = TR.fit_forest(features.transform(base), pre, TR.forest_shape(pre, TR.CLASSIFICATION, 2))
    model = TR.FittedModel(features, forest, pre.numeric_features, pre.categorical_features, TR.CLASSIFICATION, ["0", "1"])
    path = TR._new_path(spark, "quality_random_forest")
    model.save(path)
    again = TR.FittedModel.load(spark, path)
    cols = pre.numeric_features + pre.categorical_features
    rows = base.select(*cols).distinct()
    a = model.transform(rows).withColumnRenamed("prediction", "was").withColumnRenamed("predicted_label", "label_was")
    b = again.transform(rows).select(TR.row_key(cols).alias("row_id"), "prediction", "predicted_label")
    return (a.withColumn("row_id", TR.row_key(cols)).join(b, "row_id")
            .select("row_id", F.col("was").alias("prediction"), F.col("prediction").alias("reloaded_prediction"), "predicted_label",
                    ((F.col("was") == F.col("prediction")) & (F.col("label_was") == F.col("predicted_label"))).alias("same")))


# =============================================================== findings
from ..operators import findings as FD  # noqa: E402

_LI_COLS = cols("lineitem")
_DOC_COLS = cols("documents")


def _null_sum_sql(columns):
    return " + ".join(f"count(*) - count({q(c)})" for c in columns)


_SEGMENTS_SQL = (
    f"SELECT 'lineitem:l_linenumber=' || CAST(l_linenumber AS VARCHAR) AS subject, count(*) AS n_records, "
    f"({_null_sum_sql(_LI_COLS)}) * 100.0 / (count(*) * {len(_LI_COLS)}) AS missing_pct, {len(_LI_COLS)} AS n_features "
    f"FROM ({DV.LINEITEM_NULLS_SQL}) GROUP BY l_linenumber UNION ALL "
    f"SELECT 'documents:lang=' || lang, count(*), ({_null_sum_sql(_DOC_COLS)}) * 100.0 / (count(*) * {len(_DOC_COLS)}), {len(_DOC_COLS)} "
    f"FROM documents GROUP BY lang")


def _segments(spark, d):
    li = DV.lineitem_nulls(T(spark, d, "lineitem"))
    docs = T(spark, d, "documents")

    def seg(df, key, prefix, columns):
        nulls = None
        for c in columns:
            t = F.count_if(F.col(c).isNull())
            nulls = t if nulls is None else nulls + t
        return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_records"), nulls.alias("nulls")).select(
            F.concat(F.lit(prefix), F.col(key).cast("string")).alias("subject"), "n_records",
            (F.col("nulls") * 100.0 / (F.col("n_records") * len(columns))).alias("missing_pct"),
            F.lit(len(columns)).alias("n_features"))

    return seg(li, "l_linenumber", "lineitem:l_linenumber=", _LI_COLS).unionByName(seg(docs, "lang", "documents:lang=", _DOC_COLS))


@register("findings_quality", FD.run_sql(_SEGMENTS_SQL, "subject", FD.DATA_QUALITY, "data_quality"))
def _fq(spark, d):
    # G1 per segment: record count, missing %, feature count
    return FD.run(_segments(spark, d), "subject", FD.DATA_QUALITY, "data_quality")


@register("findings_missing_flag", FD.run_sql(_SEGMENTS_SQL, "subject", FD.MISSING_FLAG, "missing_flag"))
def _fmf(spark, d):
    return FD.run(_segments(spark, d), "subject", FD.MISSING_FLAG, "missing_flag")


@register("quality_metrics",
          f"SELECT subject, CAST(n_records AS BIGINT) AS total_samples, CAST(n_features AS INTEGER) AS total_features, "
          f"round(missing_pct, 6) AS missing_values_pct FROM ({_SEGMENTS_SQL})")
def _qm(spark, d):
    # A17 per segment
    return _segments(spark, d).select("subject", F.col("n_records").cast("long").alias("total_samples"),
                                      F.col("n_features").cast("int").alias("total_features"),
                                      F.round("missing_pct", R).alias("missing_values_pct"))


def _clustering_metrics_sql(src: str, name: str) -> str:
    return (f"SELECT e.model AS subject, e.n_clusters, e.raw_sil AS silhouette, e.n_noise, e.n_rows, "
            f"s.min_size, s.max_size, s.all_min_size, s.all_max_size, s.avg_size FROM ({_eval_sql(src, name)}) e, "
            f"(SELECT min(CASE WHEN cluster <> -1 THEN size END) AS min_size, max(CASE WHEN cluster <> -1 THEN size END) AS max_size, "
            f"min(size) AS all_min_size, max(size) AS all_max_size, avg(size) AS avg_size "
            f"FROM (SELECT cluster, count(*) AS size FROM {src} GROUP BY cluster)) s")


_CLM_SQL = (f"{_clustering_metrics_sql(_PL, 'p_size_bands')} UNION ALL "
            f"{_clustering_metrics_sql(_PRICE_SPLIT_SQL, 'price_split')}")


def _clustering_metrics(spark, d):
    out = None
    for name, lab in [("p_size_bands", _labels(spark, d)), ("price_split", _price_split(spark, d))]:
        m = CM.safe_metrics(lab, _XY)
        sizes = CM.cluster_sizes(lab).agg(
            F.min(F.when(F.col("cluster") != -1, F.col("size"))).alias("min_size"),
            F.max(F.when(F.col("cluster") != -1, F.col("size"))).alias("max_size"),
            F.min("size").alias("all_min_size"), F.max("size").alias("all_max_size"), F.avg("size").alias("avg_size"))
        row = sizes.select(F.lit(name).alias("subject"), F.lit(m["n_clusters"]).cast("long").alias("n_clusters"),
                           F.lit(float(m["silhouette"])).alias("silhouette"), F.lit(m["n_noise"]).cast("long").alias("n_noise"),
                           F.lit(m["n_rows"]).cast("long").alias("n_rows"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@register("findings_clustering", FD.run_sql(_CLM_SQL, "subject", FD.CLUSTERING_BUSINESS, "clustering"))
def _fcl(spark, d):
    # G2 per clustering of part_points
    return FD.run(_clustering_metrics(spark, d), "subject", FD.CLUSTERING_BUSINESS, "clustering")


@register("findings_cluster_quality", FD.run_sql(_CLM_SQL, "subject", FD.CLUSTER_QUALITY, "cluster_quality"))
def _fcq(spark, d):
    return FD.run(_clustering_metrics(spark, d), "subject", FD.CLUSTER_QUALITY, "cluster_quality")


@register("findings_cluster_balance", FD.run_sql(_CLM_SQL, "subject", FD.CLUSTER_BALANCE, "cluster_balance"))
def _fcb(spark, d):
    return FD.run(_clustering_metrics(spark, d), "subject", FD.CLUSTER_BALANCE, "cluster_balance")


# importance table: |Pearson r| of each numeric lineitem column with l_extendedprice
_IMP_FEATS = [c for c in _L_NUM if c != "l_extendedprice"]
_IMP_SQL = " UNION ALL ".join(
    f"SELECT {lit(c)} AS feature, covar_pop({q(c)}, l_extendedprice) / nullif(stddev_pop({q(c)}) * stddev_pop(l_extendedprice), 0) AS r FROM lineitem"
    for c in _IMP_FEATS)


def _importance(spark, d):
    li = T(spark, d, "lineitem")
    aggs = [F.try_divide(F.covar_pop(F.col(c).cast("double"), F.col("l_extendedprice")),
                         F.stddev_pop(F.col(c).cast("double")) * F.stddev_pop("l_extendedprice")).alias(c) for c in _IMP_FEATS]
    wide = li.agg(*aggs)
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("r")) for c in _IMP_FEATS])))


@register("importance_abs_topk",
          f"SELECT feature, round(r, 6) AS importance, CAST(rk AS INTEGER) AS rank FROM "
          f"(SELECT *, row_number() OVER (ORDER BY abs(r) DESC, feature) AS rk FROM ({_IMP_SQL})) WHERE rk <= 5")
def _iabs(spark, d):
    # Top-5 by absolute value (a limit that is the feature)
    from pyspark.sql import Window
    imp = _importance(spark, d)
    w = Window.orderBy(F.desc(F.abs("r")), "feature")
    return imp.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= 5).select(
        "feature", F.round("r", R).alias("importance"), "rank")


_IMPABS_SQL = f"SELECT feature, abs(r) AS importance FROM ({_IMP_SQL})"
_IMPSUM_SQL = (
    f"WITH r AS (SELECT feature, importance AS imp, row_number() OVER (ORDER BY importance DESC, feature) AS rk FROM ({_IMPABS_SQL})) "
    f"SELECT CAST(least(count(*), 3) AS INTEGER) AS n_imp, max(CASE WHEN rk = 1 THEN feature END) AS f1, "
    f"max(CASE WHEN rk = 2 THEN feature END) AS f2, max(CASE WHEN rk = 3 THEN feature END) AS f3, "
    f"coalesce(sum(CASE WHEN rk = 1 THEN imp END) * 100.0 / nullif(sum(imp), 0), 0.0) AS p1, "
    f"coalesce(sum(CASE WHEN rk = 2 THEN imp END) * 100.0 / nullif(sum(imp), 0), 0.0) AS p2, "
    f"coalesce(sum(CASE WHEN rk = 3 THEN imp END) * 100.0 / nullif(sum(imp), 0), 0.0) AS p3, "
    f"coalesce(sum(CASE WHEN rk <= 5 THEN imp END) * 100.0 / nullif(sum(imp), 0), 0.0) AS top5_pct, "
    f"CAST(count(*) FILTER (WHERE imp > 0) AS BIGINT) AS n_positive, CAST(count(*) AS BIGINT) AS n_total FROM r")


def _imp_summary(spark, d):
    imp = _importance(spark, d).select("feature", F.abs("r").alias("importance"))
    return FD.importance_summary(imp).withColumn("subject", F.lit("l_extendedprice"))


@register("importance_share",
          f"SELECT round(p1 + p2 + p3, 6) AS top3_pct, round(top5_pct, 6) AS top5_pct, n_positive FROM ({_IMPSUM_SQL})")
def _ishare(spark, d):
    # A27
    s = _imp_summary(spark, d)
    return s.select(F.round(F.col("p1") + F.col("p2") + F.col("p3"), R).alias("top3_pct"),
                    F.round("top5_pct", R).alias("top5_pct"), "n_positive")


@register("top_drivers",
          f"SELECT string_agg(feature, ', ' ORDER BY rk) AS top_drivers FROM (SELECT feature, row_number() OVER "
          f"(ORDER BY importance DESC, feature) AS rk FROM ({_IMPABS_SQL})) WHERE rk <= 3")
def _tdrv(spark, d):
    # K5: the three strongest drivers as one text
    s = _imp_summary(spark, d)
    return s.select(F.concat_ws(", ", "f1", "f2", "f3").alias("top_drivers"))


@register("findings_features", FD.run_sql(f"SELECT 'l_extendedprice' AS subject, * FROM ({_IMPSUM_SQL})", "subject",
                                          FD.FEATURES_BUSINESS, "features"))
def _ffeat(spark, d):
    # G7 on the |r| importance table
    return FD.run(_imp_summary(spark, d), "subject", FD.FEATURES_BUSINESS, "features")


@register("findings_drivers", FD.run_sql(f"SELECT 'l_extendedprice' AS subject, * FROM ({_IMPSUM_SQL})", "subject",
                                         FD.DRIVERS, "drivers"))
def _fdrv(spark, d):
    return FD.run(_imp_summary(spark, d), "subject", FD.DRIVERS, "drivers")


_MODEL_METRICS_SQL = (
    f"{_FOLD_SQL}, st AS (SELECT model, avg(score) AS cv_mean, stddev_pop(score) AS cv_std FROM s GROUP BY model) "
    f"SELECT model AS subject, model AS model_name, 'classification' AS problem_type, cv_mean AS best_score, cv_mean, cv_std, "
    f"(SELECT count(*) FROM labels) AS n_records, 0.0 AS missing_pct, "
    f"(SELECT feature FROM ({_IMPABS_SQL}) ORDER BY importance DESC, feature LIMIT 1) AS top_feature FROM st")


def _model_metrics(spark, d):
    st = _fold_scores(spark, d).groupBy("model").agg(F.avg("score").alias("cv_mean"), F.stddev_pop("score").alias("cv_std"))
    n = T(spark, d, "labels").count()
    top = _imp_summary(spark, d).first()["f1"]
    return st.select(F.col("model").alias("subject"), F.col("model").alias("model_name"), F.lit("classification").alias("problem_type"),
                     F.col("cv_mean").alias("best_score"), "cv_mean", "cv_std", F.lit(n).alias("n_records"),
                     F.lit(0.0).alias("missing_pct"), F.lit(top).alias("top_feature"))


for _key, _groups, _section in [("findings_model", FD.MODEL_BUSINESS, "modeling"),
                                ("findings_performance", FD.PERFORMANCE, "performance"),
                                ("findings_optimization", FD.OPTIMIZATION, "optimization"),
                                ("findings_next_steps", FD.NEXT_STEPS, "recommendations")]:
    def _mkf(groups, section):
        return lambda spark, d: FD.run(_model_metrics(spark, d), "subject", groups, section)
    register(_key, FD.run_sql(f"{_MODEL_METRICS_SQL}", "subject", _groups, _section))(_mkf(_groups, _section))


_RECO_SQL = f"SELECT subject, n_records, missing_pct, n_features, subject LIKE 'lineitem%' AS has_clustering FROM ({_SEGMENTS_SQL})"


@register("findings_recommend", FD.run_sql(_RECO_SQL, "subject", FD.RECOMMEND, "recommendations"))
def _freco(spark, d):
    # G11 per segment (clustering considered run for the lineitem segments)
    seg = _segments(spark, d).withColumn("has_clustering", F.col("subject").startswith("lineitem"))
    return FD.run(seg, "subject", FD.RECOMMEND, "recommendations")


# =============================================================== whole runs, sources and sinks (M5, M6, M17, G12, G13, IO1, IO6)
from ..operators import kmeans as KMS  # noqa: E402
from ..sources import csv as CSV  # noqa: E402
from ..sources import sinks as SK  # noqa: E402
from . import analysis as AN  # noqa: E402


@register("kmeans_labels")
def _km_labels(spark, d):
    # M5: best of 10 seeds at k = 4 on part_points, re-scaled first
    pts = DV.part_points(T(spark, d, "part"))
    lab, k, _, cost = KMS.kmeans(pts, _XY, k=4)
    return lab.select("row_id", "cluster")


@register("kmeans_auto_k")
def _km_auto(spark, d):
    # M6: the k search table (k, squared silhouette, training cost) and the chosen k
    pts = DV.part_points(T(spark, d, "part"))
    lab, k, search, cost = KMS.kmeans(pts, _XY, k=None)
    rows = [(kk, s, c, kk == k) for kk, s, c, _err in search]
    return spark.createDataFrame(rows, "k int, silhouette double, cost double, chosen boolean")


@register("dbscan_auto")
def _dbscan_auto(spark, d):
    # M7 + M8: ε from the 90th percentile of k-distances, min_samples = max(5, ⌊ln n⌋)
    pts = _points(spark, d)
    k = pts.select(BD.dbscan_min_samples(F.count(F.lit(1)))).first()[0]
    eps, _ = NB.estimate_eps(pts, k)
    return DB.dbscan(pts, eps, k).select("row_id", "cluster")


@register("full_report")
def _full_report(spark, d):
    # The whole unsupervised run on part, as its findings table
    res = AN.run_analysis(T(spark, d, "part"))
    return res.findings


@register("findings_summary")
def _summary(spark, d):
    # Data quality, clustering, modelling, features and recommendations of one supervised run
    res = AN.run_analysis(_binary_input(spark, d), target_col="quality", run_modeling=True)
    return res.findings


@register("cluster_labels")
def _cluster_labels(spark, d):
    # IO6: the labelled processed table written as Parquet and read back
    res = AN.run_analysis(T(spark, d, "part"))
    path = SK.write_labelled(res.labelled, "part_labelled")
    return spark.read.parquet(path).select("row_id", "cluster")


@register("csv_scan")
def _csv_scan(spark, d):
    # IO1: events written as CSV (blank strings, timestamps, JSON text) and read back with narrowing
    ev = DV.events_blank(T(spark, d, "events"))
    path = SK.results_dir(spark, "events_csv")
    ev.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    back = CSV.read_csv(spark, path)
    return back.select([F.col(f"`{c}`") for c in back.columns])


ORACLES["dbscan_auto"] = _dbscan_sql(
    f"SELECT quantile_cont(kdist, 0.9) FROM (SELECT row_id, d AS kdist FROM (SELECT row_id, d, row_number() OVER "
    f"(PARTITION BY row_id ORDER BY d) AS r FROM (SELECT a.row_id, sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * "
    f"(a.x1 - b.x1)) AS d FROM {_PP} a, {_PP} b)) WHERE r = (SELECT greatest(5, CAST(floor(ln(count(*))) AS INTEGER)) FROM {_PP}))",
    f"SELECT greatest(5, CAST(floor(ln(count(*))) AS INTEGER)) FROM {_PP}")


@register("silhouette_interval")
def _silhouette_interval(spark, d):
    # Bounds of the Euclidean silhouette of a fixed clustering; brute force in tests/test_silhouette.py
    from ..operators import metric_index as MX
    from ..operators import silhouette as SI
    pts = DV.part_labels(T(spark, d, "part"))
    tree = MX.build(DV.with_features(pts).select("row_id", "features"))
    found = SI.silhouette(tree, pts.select("row_id", "cluster"))
    return spark.createDataFrame([(round(found.low, R), round(found.high, R), tree.n_rows, found.exact_pairs, found.cell_pairs)],
                                 "silhouette_low double, silhouette_high double, n_rows long, exact_pairs long, cell_pairs long")


@register("dbscan_embeddings")
def _dbscan_emb(spark, d):
    # M7 + M8 on 64-dimensional vectors (one ball tree for ε and clusters, exact distances)
    from ..operators import metric_index as MX
    emb = T(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"),
                                            F.col("embedding").cast("array<double>").alias("features"))
    k = emb.select(BD.dbscan_min_samples(F.count(F.lit(1)))).first()[0]
    tree = MX.build(emb) if NB.dimension(emb) > NB.GRID_DIMS else None
    eps, _ = NB.estimate_eps(emb, k, tree=tree)
    return DB.dbscan(emb, eps, k, tree).select("row_id", "cluster")


register("screen_columns_pages", screen_sql("pages"))(lambda spark, d: S.screen_columns(T(spark, d, "pages")))
register("screen_columns_benchmark", screen_sql("benchmark"))(lambda spark, d: S.screen_columns(T(spark, d, "benchmark")))
