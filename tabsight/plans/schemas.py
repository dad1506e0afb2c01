"""Column lists of the test tables, used only to write the DuckDB oracle SQL text.

The Spark side always reads the schema from the Parquet footer; the oracle is plain SQL, so
it needs the column names spelled out.
"""

from __future__ import annotations

N, C, D, B, O = "numeric", "categorical", "datetime", "boolean", "other"

SCHEMAS: dict[str, list[tuple[str, str]]] = {
    "region": [("r_regionkey", N), ("r_name", C)],
    "nation": [("n_nationkey", N), ("n_name", C), ("n_regionkey", N)],
    "customer": [("c_custkey", N), ("c_name", C), ("c_nationkey", N), ("c_acctbal", N), ("c_mktsegment", C)],
    "supplier": [("s_suppkey", N), ("s_name", C), ("s_nationkey", N), ("s_acctbal", N)],
    "part": [("p_partkey", N), ("p_name", C), ("p_brand", C), ("p_type", C), ("p_size", N), ("p_retailprice", N)],
    "orders": [("o_orderkey", N), ("o_custkey", N), ("o_orderstatus", C), ("o_totalprice", N),
               ("o_orderdate", D), ("o_orderpriority", C)],
    "lineitem": [("l_orderkey", N), ("l_partkey", N), ("l_suppkey", N), ("l_linenumber", N), ("l_quantity", N),
                 ("l_extendedprice", N), ("l_discount", N), ("l_tax", N), ("l_returnflag", C),
                 ("l_linestatus", C), ("l_shipdate", D)],
    "events": [("event_id", N), ("ts", D), ("user_id", N), ("event_type", C), ("value", N), ("props", C)],
    "documents": [("doc_id", N), ("text", C), ("lang", C), ("source", C), ("n_chars", N)],
    "embeddings": [("vec_id", N), ("embedding", O), ("label", N)],
    "labels": [("doc_id", N), ("quality", N), ("toxic", N)],
    "conversations": [("conv_id", N), ("turn", N), ("role", C), ("text", C)],
    "pages": [("page_id", N), ("url", C), ("html", C)],
    "benchmark": [("item_id", N), ("text", C)],
}


def cols(table: str, cls: str | None = None) -> list[str]:
    return [c for c, k in SCHEMAS[table] if cls is None or k == cls]
