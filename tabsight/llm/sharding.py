"""Balanced contiguous shards from global byte-size prefix sums.

Rows are put in one order (``doc_id`` first, nulls first; ties by size, checksum and place in the
input, so equal ids spread over partitions too) by a range exchange. Each partition's total of
bytes and rows goes into a small table, one row a partition, whose running sums are every
partition's offset; a running sum inside the partition gives each row's global byte position, and
the shard is the cut of ``n_shards`` equal byte targets that holds the row's midpoint. Only ids,
sizes and checksums move; texts do not.

Defined results: a null text has no bytes, so its size is the fixed cost of a row; the checksum
of a null text is that of an empty one. An empty table gives no rows. Repeated rows each get a
slot of their own. A text larger than a target fills its shard alone as far as order allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tabsight.llm.common import stored

ROW_BYTES = 8


def shard_by_bytes(docs: DataFrame, n_shards: int = 24, id_column: str = "doc_id", text: str = "text",
                   row_bytes: int = ROW_BYTES) -> DataFrame:
    """One row per row of ``docs``: its id, ``size``, ``text_crc32``, global byte ``start`` and
    row number, ``shard`` and gapless ``slot`` within it."""
    thin = docs.select(
        F.col(id_column).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + row_bytes).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("place"))
    order = [F.col("id").asc_nulls_first(), "size", "text_crc32", "place"]
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written once: the range bounds are sampled, so every later step must see the same split
    ranged = stored(thin.repartitionByRange(n_parts, *order).withColumn("part", F.spark_partition_id()), "ranged")

    # one row a partition
    totals = ranged.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(everything).alias("all_bytes"))

    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (ranged.withColumns({"upto": F.sum("size").over(within), "nth": F.count("*").over(within)})
              .join(F.broadcast(offsets), "part")
              .select("id", "size", "text_crc32",
                      (F.col("bytes_before") + F.col("upto") - F.col("size")).alias("start"),
                      (F.col("rows_before") + F.col("nth") - 1).alias("row_number"), "all_bytes"))
    cut = F.expr(f"cast(least({n_shards - 1}, (2 * start + size) * {n_shards} div (2 * all_bytes)) as int)")
    placed = placed.withColumn("shard", cut).drop("all_bytes")
    firsts = placed.groupBy("shard").agg(F.min("row_number").alias("first"))  # n_shards rows
    return (placed.join(F.broadcast(firsts), "shard")
            .select(F.col("id").alias(id_column), "size", "text_crc32", "start", "row_number", "shard",
                    (F.col("row_number") - F.col("first")).alias("slot")))


def oracle_sql(n_shards: int = 24) -> str:
    """DuckDB SQL of the query's digest; the checksum is worked out byte by byte."""
    return f"""
WITH RECURSIVE steps(n, k, c) AS (
    SELECT i, 0, i FROM range(256) AS r(i)
    UNION ALL
    SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
tab AS (SELECT list(c ORDER BY n) AS crc FROM steps WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
t AS (SELECT doc_id, strlen(x) + {ROW_BYTES} AS size, x, row_number() OVER () AS r FROM d),
bytes AS (SELECT r, hex(encode(x)) AS h FROM t),
sums AS (SELECT r, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2),
                lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT)),
                lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32
         FROM bytes, tab),
o AS (SELECT doc_id, size, text_crc32,
             sum(size) OVER w - size AS start, sum(size) OVER () AS total
      FROM t JOIN sums USING (r) WINDOW w AS (ORDER BY doc_id NULLS FIRST, size, text_crc32, r ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, least({n_shards - 1}, ((2 * start + size) * {n_shards}) // (2 * total))::INT AS shard FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY start) - 1 AS slot, CAST(NULL AS INT) AS grown_shard
FROM s
"""
