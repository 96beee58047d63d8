"""A property graph over the star-schema tables, with the same view in SQL.

Node ids are local_id * 8 + kind: customer 0, orders 1, part 2, supplier 3,
nation 4, region 5, event 6.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def packed(column: str, kind: int) -> Column:
    return F.col(column).cast("long") * 8 + kind


def event_code(column: str = "event_type") -> Column:
    return (F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col(column)) - 1).cast("long")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, atype, dst, time, attr: a bag of typed edges. Filters on src or atype reach the branches' scans."""

    def part(name: str, src: Column, atype: Column, dst: Column, time: Column, attr: Column) -> DataFrame:
        return table(spark, sf_dir, name).select(src.alias("src"), atype.cast("long").alias("atype"), dst.alias("dst"), time.cast("long").alias("time"), attr.alias("attr"))

    none, zero = F.lit(""), F.lit(0)
    flags = F.concat("l_returnflag", "l_linestatus")
    return (
        part("orders", packed("o_custkey", 0), F.lit(0), packed("o_orderkey", 1), micros("o_orderdate"), F.col("o_orderpriority"))
        .union(part("lineitem", packed("l_orderkey", 1), F.lit(1), packed("l_partkey", 2), micros("l_shipdate"), flags))
        .union(part("lineitem", packed("l_orderkey", 1), F.lit(2), packed("l_suppkey", 3), micros("l_shipdate"), flags))
        .union(part("customer", packed("c_custkey", 0), F.lit(3), packed("c_nationkey", 4), zero, none))
        .union(part("supplier", packed("s_suppkey", 3), F.lit(4), packed("s_nationkey", 4), zero, none))
        .union(part("nation", packed("n_nationkey", 4), F.lit(5), packed("n_regionkey", 5), zero, none))
        .union(part("events", packed("user_id", 0), event_code() + 6, packed("event_id", 6), micros("ts"), F.col("props")))
    )


#: Table, id column, kind, attributes in order.
NODE_TABLES = [
    ("customer", "c_custkey", 0, ["c_name", "c_mktsegment", "c_nationkey"]),
    ("orders", "o_orderkey", 1, ["o_orderstatus", "o_orderpriority"]),
    ("part", "p_partkey", 2, ["p_name", "p_brand", "p_type", "p_size"]),
    ("supplier", "s_suppkey", 3, ["s_name", "s_nationkey"]),
    ("nation", "n_nationkey", 4, ["n_name"]),
    ("region", "r_regionkey", 5, ["r_name"]),
    ("events", "event_id", 6, ["event_type", "props"]),
]


def node_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, attr_idx, attr. A customer whose key is divisible by 3 has an empty attribute 2."""
    out = None
    for name, key, kind, columns in NODE_TABLES:
        values = [F.when(F.col(key) % 3 == 0, F.lit("")).otherwise(F.col(c).cast("string")) if c == "c_nationkey" else F.col(c).cast("string") for c in columns]
        items = F.explode(F.array(*(F.struct(F.lit(i).alias("attr_idx"), v.alias("attr")) for i, v in enumerate(values))))
        part = table(spark, sf_dir, name).select(packed(key, kind).alias("node_id"), items.alias("x")).select("node_id", "x.attr_idx", F.coalesce("x.attr", F.lit("")).alias("attr"))
        out = part if out is None else out.union(part)
    return out


def _sql_edges() -> str:
    codes = " ".join(f"WHEN '{x}' THEN {6 + i}" for i, x in enumerate(EVENT_TYPES))
    rows = [
        ("o_custkey*8", "0", "o_orderkey*8+1", "epoch_us(o_orderdate)", "o_orderpriority", "orders"),
        ("l_orderkey*8+1", "1", "l_partkey*8+2", "epoch_us(l_shipdate)", "l_returnflag || l_linestatus", "lineitem"),
        ("l_orderkey*8+1", "2", "l_suppkey*8+3", "epoch_us(l_shipdate)", "l_returnflag || l_linestatus", "lineitem"),
        ("c_custkey*8", "3", "c_nationkey*8+4", "0", "''", "customer"),
        ("s_suppkey*8+3", "4", "s_nationkey*8+4", "0", "''", "supplier"),
        ("n_nationkey*8+4", "5", "n_regionkey*8+5", "0", "''", "nation"),
        ("user_id*8", f"CASE event_type {codes} END", "event_id*8+6", "epoch_us(ts)", "props", "events"),
    ]
    return " UNION ALL ".join(f"SELECT CAST({a} AS BIGINT) AS src, CAST({b} AS BIGINT) AS atype, CAST({c} AS BIGINT) AS dst, CAST({d} AS BIGINT) AS time, {e} AS attr FROM {f}" for a, b, c, d, e, f in rows)


def _sql_attrs() -> str:
    parts = []
    for name, key, kind, columns in NODE_TABLES:
        for i, c in enumerate(columns):
            value = f"CASE WHEN {key} % 3 = 0 THEN '' ELSE CAST({c} AS STRING) END" if c == "c_nationkey" else f"CAST({c} AS STRING)"
            parts.append(f"SELECT CAST({key}*8+{kind} AS BIGINT) AS node_id, {i} AS attr_idx, coalesce({value}, '') AS attr FROM {name}")
    return " UNION ALL ".join(parts)


EDGES_SQL = f"edges AS ({_sql_edges()})"
ATTRS_SQL = f"node_attr AS ({_sql_attrs()})"
GRAPH_SQL = f"WITH {EDGES_SQL}, {ATTRS_SQL}"
