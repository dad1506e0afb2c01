"""Derived inputs: frames Spark derives from the base tables (nulls, duplicates, points, fixed
labels and predictions), each with the equivalent SQL for the oracle side.

They give the operators inputs the base tables lack (NULLs, blank strings, known clusterings)
while still growing with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ------------------------------------------------------------------ lineitem_nulls
LINEITEM_NULLS_SQL = (
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, "
    "CASE WHEN l_quantity > 45 THEN NULL ELSE l_quantity END AS l_quantity, l_extendedprice, "
    "nullif(l_discount, 0.0) AS l_discount, l_tax, nullif(l_returnflag, 'R') AS l_returnflag, "
    "l_linestatus, l_shipdate FROM lineitem")


def lineitem_nulls(li: DataFrame) -> DataFrame:
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.when(F.col("l_quantity") > 45, F.lit(None).cast("double")).otherwise(F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice",
        F.when(F.col("l_discount") == 0.0, F.lit(None).cast("double")).otherwise(F.col("l_discount")).alias("l_discount"),
        "l_tax",
        F.when(F.col("l_returnflag") == "R", F.lit(None).cast("string")).otherwise(F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus", "l_shipdate")


# ------------------------------------------------------------------ part_nulls
PART_NULLS_SQL = (
    "SELECT p_partkey AS row_id, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS size, "
    "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_retailprice AS DOUBLE) / 32 END AS price, "
    "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(length(p_type) AS DOUBLE) END AS width FROM part")


def part_nulls(part: DataFrame) -> DataFrame:
    key = F.col("p_partkey")
    return part.select(key.alias("row_id"), F.when(key % 5 != 0, F.col("p_size").cast("double")).alias("size"),
                       F.when(key % 7 != 0, F.col("p_retailprice").cast("double") / 32).alias("price"),
                       F.when(key % 11 != 0, F.length("p_type").cast("double")).alias("width"))


# ------------------------------------------------------------------ lineitem_dups
LINEITEM_DUPS_SQL = "SELECT l_linenumber, l_discount, l_tax FROM lineitem"


def lineitem_dups(li: DataFrame) -> DataFrame:
    return li.select("l_linenumber", "l_discount", "l_tax")


# ------------------------------------------------------------------ events_blank
EVENTS_BLANK_SQL = (
    "SELECT event_id, ts, user_id, CASE WHEN event_type = 'error' THEN '  ' ELSE event_type END AS event_type, "
    "value, props FROM events")


def events_blank(ev: DataFrame) -> DataFrame:
    return ev.withColumn("event_type", F.when(F.col("event_type") == "error", F.lit("  ")).otherwise(F.col("event_type")))


# ------------------------------------------------------------------ part_points / part_labels
# Standardised with the population std computed from exact integer sums (sizes and price
# cents are integers), so both engines produce bit-identical coordinates: mean = Σv/n and
# var = (n·Σv² − (Σv)²)/n², each rounded to double once.
PART_POINTS_SQL = (
    "WITH g AS (SELECT CAST(p_size AS BIGINT) AS v0, CAST(round(p_retailprice * 100) AS BIGINT) AS v1, "
    "min(p_partkey) AS row_id FROM part GROUP BY p_size, p_retailprice), "
    "a AS (SELECT count(*) AS n, sum(v0) AS s0, sum(v0 * v0) AS q0, sum(v1) AS s1, sum(v1 * v1) AS q1 FROM g), "
    "s AS (SELECT CAST(s0 AS DOUBLE) / CAST(n AS DOUBLE) AS m0, "
    "sqrt(CAST(n * q0 - s0 * s0 AS DOUBLE) / CAST(n * n AS DOUBLE)) AS d0, "
    "CAST(s1 AS DOUBLE) / CAST(n AS DOUBLE) AS m1, sqrt(CAST(n * q1 - s1 * s1 AS DOUBLE) / CAST(n * n AS DOUBLE)) AS d1 FROM a) "
    "SELECT row_id, (CAST(v0 AS DOUBLE) - m0) / coalesce(nullif(d0, 0), 1) AS x0, "
    "(CAST(v1 AS DOUBLE) - m1) / coalesce(nullif(d1, 0), 1) AS x1, CAST(v0 AS INTEGER) AS p_size FROM g, s")


def part_points(part: DataFrame) -> DataFrame:
    """(row_id, x0, x1, p_size): distinct (p_size, p_retailprice), standardised (population std)."""
    g = part.groupBy(F.col("p_size").cast("long").alias("v0"),
                     F.round(F.col("p_retailprice") * 100).cast("long").alias("v1")).agg(F.min("p_partkey").alias("row_id"))
    dec = "decimal(38,0)"
    st = g.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v0").cast(dec)).alias("s0"),
               F.sum((F.col("v0") * F.col("v0")).cast(dec)).alias("q0"), F.sum(F.col("v1").cast(dec)).alias("s1"),
               F.sum((F.col("v1").cast(dec) * F.col("v1").cast(dec))).alias("q1")).first()
    n = int(st["n"])

    def stats(sv, qv):
        sv, qv = int(sv), int(qv)
        mean = float(sv) / float(n)
        sd = (float(n * qv - sv * sv) / float(n * n)) ** 0.5
        return mean, (sd if sd else 1.0)

    m0, d0 = stats(st["s0"], st["q0"])
    m1, d1 = stats(st["s1"], st["q1"])
    return g.select("row_id", ((F.col("v0").cast("double") - F.lit(m0)) / F.lit(d0)).alias("x0"),
                    ((F.col("v1").cast("double") - F.lit(m1)) / F.lit(d1)).alias("x1"),
                    F.col("v0").cast("int").alias("p_size"))


PART_LABELS_SQL = (
    f"SELECT row_id, x0, x1, CASE WHEN p_size = 1 THEN -1 ELSE CAST(floor(p_size / 17.0) AS INTEGER) END AS cluster "
    f"FROM ({PART_POINTS_SQL})")


def part_labels(part: DataFrame) -> DataFrame:
    pts = part_points(part)
    return pts.select("row_id", "x0", "x1",
                      F.when(F.col("p_size") == 1, F.lit(-1)).otherwise(F.floor(F.col("p_size") / 17.0).cast("int"))
                      .alias("cluster"))


def with_features(points: DataFrame, cols: list[str] = ("x0", "x1")) -> DataFrame:
    """Add a ``features`` array<double> column from coordinate columns."""
    return points.withColumn("features", F.array(*[F.col(c).cast("double") for c in cols]))


# ------------------------------------------------------------------ label_pred / line_pred
LABEL_PRED_SQL = (
    "SELECT doc_id, CAST(quality AS DOUBLE) AS label, CAST(toxic AS DOUBLE) AS prediction, "
    "(doc_id % 101) / 100.0 AS score FROM labels")


def label_pred(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.col("quality").cast("double").alias("label"),
                         F.col("toxic").cast("double").alias("prediction"),
                         (F.col("doc_id") % 101 / 100.0).cast("double").alias("score"))


LINE_PRED_SQL = "SELECT l_quantity AS label, 25.0 + 10 * l_discount AS prediction FROM lineitem"


def line_pred(li: DataFrame) -> DataFrame:
    return li.select(F.col("l_quantity").alias("label"), (F.lit(25.0) + F.lit(10.0) * F.col("l_discount")).alias("prediction"))
