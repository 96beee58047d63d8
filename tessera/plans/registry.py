"""Queries by key, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import distributions as dist
from tessera.functions import generators as gen
from tessera.functions import scalar as fn
from tessera.operators import algorithms as algo
from tessera.operators import assoc, links, primitives, search, stats
from tessera.operators.components import connected_components
from tessera.operators.graph import PropertyGraph, edge_set_diff
from tessera.plans import workload
from tessera.sources.derived import ATTRS_SQL, EDGES_SQL, EVENT_TYPES, GRAPH_SQL, edges, event_code, micros, node_attrs, table
from tessera.streaming import oplog

Query = Callable[[SparkSession, str], DataFrame]

C5 = 40  # customer 5
T0, T1 = 820_454_400_000_000, 915_148_800_000_000  # 1996-01-01 and 1999-01-01 in microseconds

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def add(key: str, query: Query, sql: str | None = None) -> None:
    _QUERIES[key] = query
    if sql is not None:
        _SQL[key] = sql


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


E = f"WITH {EDGES_SQL}"
A = f"WITH {ATTRS_SQL}"
ORDER = "ORDER BY time DESC, dst, attr"
BY_LIST = f"PARTITION BY src, atype {ORDER}"
COLS = "src, atype, dst, time, attr"


def _customers(s, d):
    return table(s, d, "customer").select((F.col("c_custkey").cast("long") * 8).alias("node_id"))


# Primitive queries.

add("get_attribute", lambda s, d: primitives.get_attribute(node_attrs(s, d), _customers(s, d), 1), f"{A} SELECT CAST(c_custkey * 8 AS BIGINT) AS node_id, coalesce((SELECT attr FROM node_attr WHERE node_id = c_custkey * 8 AND attr_idx = 1), '') AS attr FROM customer")
add("get_neighbors", lambda s, d: primitives.get_neighbors(edges(s, d), C5), f"{E} SELECT dst FROM edges WHERE src = {C5}")
add("get_neighbors_atype", lambda s, d: primitives.get_neighbors_ordered(edges(s, d), C5, 0), f"{E} SELECT CAST(row_number() OVER ({BY_LIST}) - 1 AS BIGINT) AS pos, dst FROM edges WHERE src = {C5} AND atype = 0")
_URGENT = "EXISTS (SELECT 1 FROM node_attr a WHERE a.node_id = e.dst AND a.attr_idx = 1 AND a.attr = '1-URGENT')"
add("get_neighbors_attr", lambda s, d: primitives.get_neighbors_attr(edges(s, d), node_attrs(s, d), C5, 1, "1-URGENT"), f"{GRAPH_SQL} SELECT dst FROM edges e WHERE src = {C5} AND {_URGENT}")
add("get_neighbors_attr_batch", lambda s, d: primitives.get_neighbors_attr_batch(edges(s, d), node_attrs(s, d), _customers(s, d).withColumnRenamed("node_id", "src"), 1, "1-URGENT", 0), f"{GRAPH_SQL} SELECT src, dst FROM edges e WHERE atype = 0 AND src IN (SELECT c_custkey * 8 FROM customer) AND {_URGENT}")
add("filter_nodes", lambda s, d: primitives.filter_nodes(edges(s, d).where("atype = 1").select(F.col("dst").alias("node_id")), node_attrs(s, d), 1, "Brand#11"), f"{GRAPH_SQL} SELECT dst AS node_id FROM edges e WHERE atype = 1 AND EXISTS (SELECT 1 FROM node_attr a WHERE a.node_id = e.dst AND a.attr_idx = 1 AND a.attr = 'Brand#11')")
add("get_nodes", lambda s, d: primitives.get_nodes(node_attrs(s, d), (1, "BUILDING")), f"{A} SELECT DISTINCT node_id FROM node_attr WHERE attr_idx = 1 AND attr = 'BUILDING'")
add("get_nodes2", lambda s, d: primitives.get_nodes(node_attrs(s, d), (1, "BUILDING"), (2, "7")), f"{A} SELECT node_id FROM node_attr WHERE attr_idx = 1 AND attr = 'BUILDING' INTERSECT SELECT node_id FROM node_attr WHERE attr_idx = 2 AND attr = '7'")
add("get_nodes_empty", lambda s, d: primitives.get_nodes(node_attrs(s, d), (2, "")), f"{A} SELECT DISTINCT node_id FROM node_attr n WHERE NOT EXISTS (SELECT 1 FROM node_attr m WHERE m.node_id = n.node_id AND m.attr_idx = 2 AND m.attr <> '')")
add("get_nodes_union", lambda s, d: primitives.get_nodes_union(node_attrs(s, d), (1, "BUILDING"), (2, "7")), f"{A} SELECT node_id FROM node_attr WHERE attr_idx = 1 AND attr = 'BUILDING' UNION SELECT node_id FROM node_attr WHERE attr_idx = 2 AND attr = '7'")
add("get_edge_attrs", lambda s, d: primitives.get_edge_attrs(edges(s, d), C5, 0), f"{E} SELECT CAST(row_number() OVER ({BY_LIST}) - 1 AS BIGINT) AS pos, attr FROM edges WHERE src = {C5} AND atype = 0")
add("num_nodes", lambda s, d: primitives.num_nodes(node_attrs(s, d)), f"{A} SELECT count(DISTINCT node_id) AS n FROM node_attr")
add("num_edges", lambda s, d: primitives.num_edges(edges(s, d)), f"{E} SELECT count(*) AS n FROM edges")
add("assoc_lists", lambda s, d: assoc.assoc_lists(edges(s, d)), f"{E} SELECT DISTINCT src, atype FROM edges")
add("edge_scan", lambda s, d: edges(s, d), f"{E} SELECT {COLS} FROM edges")
add("neighbor_pattern_join", lambda s, d: primitives.neighbor_pattern_join(edges(s, d), node_attrs(s, d), 1, "Brand#11"), f"{GRAPH_SQL} SELECT src, atype, dst FROM edges JOIN node_attr ON dst = node_id WHERE attr_idx = 1 AND node_attr.attr = 'Brand#11'")

# Association lists.


def _ranked_sql(where: str, keep: str, source: str = "edges") -> str:
    return f"SELECT {COLS} FROM (SELECT *, row_number() OVER ({BY_LIST}) AS rn FROM {source} WHERE {where}) WHERE {keep}"


add("assoc_range", lambda s, d: assoc.assoc_range(edges(s, d), C5, 0, 1, 2), f"{E} {_ranked_sql(f'src = {C5} AND atype = 0', 'rn BETWEEN 2 AND 3')}")
add("assoc_range_wildcard", lambda s, d: assoc.assoc_range(edges(s, d), None, None, 1, 2), f"{E} {_ranked_sql('true', 'rn BETWEEN 2 AND 3')}")


def _list_requests(s, d):
    """A request for every third customer's lists of type 0, and for as many that don't exist."""
    c = table(s, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("long").alias("k"))
    return c.select(F.col("k").alias("req_id"), (F.col("k") * 8).alias("src"), F.lit(0).cast("long").alias("atype")).union(c.select(-F.col("k") - 1, F.col("k") * 8, F.lit(99).cast("long")))


_REQ = "requests AS (SELECT CAST(c_custkey AS BIGINT) AS req_id, CAST(c_custkey * 8 AS BIGINT) AS src, CAST(0 AS BIGINT) AS atype FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT CAST(-c_custkey - 1 AS BIGINT), CAST(c_custkey * 8 AS BIGINT), CAST(99 AS BIGINT) FROM customer WHERE c_custkey % 3 = 0)"
add("assoc_range_batch", lambda s, d: assoc.assoc_range_batch(edges(s, d), _list_requests(s, d).withColumns({"off": F.lit(1), "len": F.lit(2)})), f"{E}, {_REQ} SELECT req_id, {COLS} FROM (SELECT req_id, e.*, row_number() OVER (PARTITION BY req_id {ORDER}) AS rn FROM edges e JOIN requests USING (src, atype)) WHERE rn BETWEEN 2 AND 3")
_NATIONS = [k * 8 + 4 for k in range(5, 25)]
add("assoc_get", lambda s, d: assoc.assoc_get(edges(s, d), C5, 3, _NATIONS, None, T1), f"{E} SELECT {COLS} FROM edges WHERE src = {C5} AND atype = 3 AND dst IN ({', '.join(map(str, _NATIONS))}) AND time <= {T1}")
add("assoc_get_wildcard", lambda s, d: assoc.assoc_get(edges(s, d), None, None, table(s, d, "part").where("p_partkey % 5 = 0").select((F.col("p_partkey").cast("long") * 8 + 2).alias("dst")), T0, T1), f"{E} SELECT {COLS} FROM edges WHERE dst IN (SELECT p_partkey * 8 + 2 FROM part WHERE p_partkey % 5 = 0) AND time BETWEEN {T0} AND {T1}")


def _get_requests(s, d):
    o = table(s, d, "orders").where("o_orderkey % 7 = 0").select(F.col("o_orderkey").cast("long").alias("k"))
    parts = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: ((F.col("k") + i) * 8 + 2).cast("long"))
    return o.select(F.col("k").alias("req_id"), (F.col("k") * 8 + 1).alias("src"), F.lit(1).cast("long").alias("atype"), parts.alias("dst_set"), F.lit(T0).alias("t_low"), F.lit(T1).alias("t_high"))


add("assoc_get_batch", lambda s, d: assoc.assoc_get_batch(edges(s, d), _get_requests(s, d)), f"{E} SELECT CAST(o_orderkey AS BIGINT) AS req_id, {COLS} FROM orders JOIN edges ON src = o_orderkey * 8 + 1 AND atype = 1 WHERE o_orderkey % 7 = 0 AND (dst - 2) // 8 BETWEEN o_orderkey AND o_orderkey + 30 AND time BETWEEN {T0} AND {T1}")
add("assoc_count", lambda s, d: assoc.assoc_count(edges(s, d), C5, 0), f"{E} SELECT count(*) AS n FROM edges WHERE src = {C5} AND atype = 0")
add("assoc_count_wildcard", lambda s, d: assoc.assoc_count(edges(s, d), None, 2), f"{E} SELECT count(*) AS n FROM edges WHERE atype = 2")
add("assoc_count_batch", lambda s, d: assoc.assoc_count_batch(edges(s, d), _list_requests(s, d)), f"{E}, {_REQ} SELECT req_id, count(e.src) AS n FROM requests r LEFT JOIN edges e ON e.src = r.src AND e.atype = r.atype GROUP BY req_id")
add("assoc_time_range", lambda s, d: assoc.assoc_time_range(edges(s, d), C5, 0, T0, T1, 2), f"{E} {_ranked_sql(f'src = {C5} AND atype = 0 AND time BETWEEN {T0} AND {T1}', 'rn <= 2')}")
add("assoc_time_range_wildcard", lambda s, d: assoc.assoc_time_range(edges(s, d), None, None, T0, T1, 2), f"{E} {_ranked_sql(f'time BETWEEN {T0} AND {T1}', 'rn <= 2')}")
add("assoc_time_range_batch", lambda s, d: assoc.assoc_time_range_batch(edges(s, d), _list_requests(s, d).withColumns({"t_low": F.lit(T0), "t_high": F.lit(T1), "limit": F.lit(2)})), f"{E}, {_REQ} SELECT req_id, {COLS} FROM (SELECT req_id, e.*, row_number() OVER (PARTITION BY req_id {ORDER}) AS rn FROM edges e JOIN requests USING (src, atype) WHERE time BETWEEN {T0} AND {T1}) WHERE rn <= 2")
add("assoc_rank", lambda s, d: assoc.ranked(edges(s, d).where("atype = 0")), f"{E} SELECT {COLS}, CAST(row_number() OVER ({BY_LIST}) - 1 AS BIGINT) AS pos FROM edges WHERE atype = 0")
add("obj_get", lambda s, d: primitives.obj_get(node_attrs(s, d), _customers(s, d)), f"{A} SELECT node_id, attr_idx, attr FROM node_attr n WHERE node_id IN (SELECT c_custkey * 8 FROM customer) AND attr_idx <= (SELECT max(attr_idx) FROM node_attr m WHERE m.node_id = n.node_id AND m.attr <> '')")
_DIGITS = "CAST(length(CAST(max(abs({})) AS STRING)) AS BIGINT)"
add("assoc_list_header", lambda s, d: assoc.list_headers(edges(s, d)), f"{E} SELECT src, atype, count(*) AS n, max(time) AS newest, min(time) AS oldest, {_DIGITS.format('time')} AS time_digits, {_DIGITS.format('dst')} AS dst_digits FROM edges GROUP BY src, atype")
add("assoc_list_build", lambda s, d: assoc.build_lists(edges(s, d).where("atype = 0")).select("src", "atype", F.posexplode("edges").alias("pos", "e")).select("src", "atype", F.col("pos").cast("long").alias("pos"), "e.dst", "e.time", "e.attr"), f"{E} SELECT src, atype, CAST(row_number() OVER ({BY_LIST}) - 1 AS BIGINT) AS pos, dst, time, attr FROM edges WHERE atype = 0")
add("time_bounds", lambda s, d: edges(s, d).agg(F.min("time").alias("low"), F.max("time").alias("high")), f"{E} SELECT min(time) AS low, max(time) AS high FROM edges")
add("out_degree", lambda s, d: edges(s, d).groupBy("src").agg(F.count("*").alias("n")), f"{E} SELECT src, count(*) AS n FROM edges GROUP BY src")
add("avg_degree", lambda s, d: edges(s, d).agg(F.round(F.count("*") / F.count_distinct("src"), 6).alias("degree")), f"{E} SELECT round(count(*) / count(DISTINCT src), 6) AS degree FROM edges")
add("update_coverage", lambda s, d: workload.update_coverage(edges(s, d), edges(s, d).where("dst % 10 = 0")).withColumn("share", F.round("share", 9)), f"{E} SELECT n, touched, round(touched / n, 9) AS share FROM (SELECT (SELECT count(*) FROM (SELECT DISTINCT src, atype FROM edges)) AS n, (SELECT count(*) FROM (SELECT DISTINCT src, atype FROM edges WHERE dst % 10 = 0)) AS touched)")
add("edge_updates_by_shard", lambda s, d: workload.updates_by_shard(edges(s, d), 16), f"{E} SELECT src % 16 AS shard, count(DISTINCT (src, atype)) AS lists FROM edges GROUP BY 1")

# The merged view: of the edges, dst % 10 = 0 is the log and 1 is deleted.


def _merged(s, d) -> PropertyGraph:
    e = edges(s, d)
    return PropertyGraph(e.where("dst % 10 <> 0"), node_attrs(s, d), tombstones=e.where("dst % 10 = 1").select("src", "atype", "dst")).add_edges(e.where("dst % 10 = 0"))


LIVE = f"{E}, live AS (SELECT * FROM edges WHERE dst % 10 <> 1)"
add("edges_live", lambda s, d: _merged(s, d).live_edges(), f"{LIVE} SELECT {COLS} FROM live")
add("assoc_range_merged", lambda s, d: assoc.assoc_range(_merged(s, d).live_edges(), None, None, 1, 2), f"{LIVE} {_ranked_sql('true', 'rn BETWEEN 2 AND 3', 'live')}")
add("assoc_count_merged", lambda s, d: _merged(s, d).live_edges().groupBy("src", "atype").agg(F.count("*").alias("n")), f"{LIVE} SELECT src, atype, count(*) AS n FROM live GROUP BY src, atype")
add("assoc_add_merge", lambda s, d: assoc.assoc_range(_merged(s, d).add_edges(edges(s, d).where("atype = 5").withColumn("time", F.lit(9))).live_edges(), None, 5), f"{LIVE} SELECT {COLS} FROM live WHERE atype = 5 UNION ALL SELECT src, atype, dst, CAST(9 AS BIGINT), attr FROM edges WHERE atype = 5")
add("obj_add_merge", lambda s, d: _merged(s, d).add_nodes(table(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("order"), F.array("s_name", F.lit("new")).alias("attrs")), 1 << 40).live_attrs().where(f"node_id >= {1 << 40}").select("node_id", F.col("attr_idx").cast("long").alias("attr_idx"), "attr"), f"SELECT node_id, CAST(i AS BIGINT) AS attr_idx, CASE i WHEN 0 THEN s_name ELSE 'new' END AS attr FROM (SELECT CAST({1 << 40} + row_number() OVER (ORDER BY s_suppkey) - 1 AS BIGINT) AS node_id, s_name FROM supplier), (VALUES (0), (1)) v(i)")
add("assoc_union_all", lambda s, d: _merged(s, d).edges.unionByName(_merged(s, d).edge_delta), f"{E} SELECT {COLS} FROM edges")
add("edge_set_diff", lambda s, d: edge_set_diff(edges(s, d).where("dst % 10 <> 0"), edges(s, d).where("dst % 10 <> 1")), f"{E}, l AS (SELECT * FROM edges WHERE dst % 10 <> 0), r AS (SELECT * FROM edges WHERE dst % 10 <> 1) SELECT *, 'left' AS side FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r) UNION ALL SELECT *, 'right' AS side FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l)")

# Keyed links over a log made of events.


def op_log(s, d) -> DataFrame:
    op = F.when(F.col("event_id") % 7 == 0, F.lit("H")).when(F.col("event_id") % 7 == 1, F.lit("X")).otherwise(F.lit("U"))
    return table(s, d, "events").select(F.col("event_id").cast("long").alias("seq"), op.alias("op"), F.col("user_id").cast("long").alias("id1"), event_code().alias("link_type"), (F.col("event_id") % 20).cast("long").alias("id2"), F.lit(1).cast("byte").alias("visibility"), (F.col("event_id") % 3).cast("int").alias("version"), micros("ts").alias("time"), F.col("props").alias("data"))


def _links(s, d):
    return links.resolve(op_log(s, d))


_CODE = "CASE event_type " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(EVENT_TYPES)) + " END"
_LOG = f"log AS (SELECT CAST(event_id AS BIGINT) AS seq, CASE event_id % 7 WHEN 0 THEN 'H' WHEN 1 THEN 'X' ELSE 'U' END AS op, CAST(user_id AS BIGINT) AS id1, CAST({_CODE} AS BIGINT) AS link_type, CAST(event_id % 20 AS BIGINT) AS id2, CAST(event_id % 3 AS INTEGER) AS version, epoch_us(ts) AS time, props AS data FROM events)"


def _resolved_sql(log: str = "log") -> str:
    return f"""SELECT id1, link_type, id2, CAST(CASE WHEN h > u THEN 0 ELSE 1 END AS TINYINT) AS visibility, version, time, data FROM (
      SELECT id1, link_type, id2, max(seq) FILTER (op = 'U') AS u, max(seq) FILTER (op = 'X') AS x, max(seq) FILTER (op = 'H') AS h,
        arg_max(version, seq) FILTER (op = 'U') AS version, arg_max(time, seq) FILTER (op = 'U') AS time, arg_max(data, seq) FILTER (op = 'U') AS data
      FROM {log} GROUP BY id1, link_type, id2) WHERE u > coalesce(x, -1)"""


LB = f"WITH {_LOG}, links AS ({_resolved_sql()})"
LINK = "id1, link_type, id2, visibility, version, time, data"
NEWEST = "PARTITION BY id1, link_type ORDER BY time DESC, id2"
_NEW = "SELECT CAST(c_custkey + 1000000 AS BIGINT) AS seq, CAST(c_custkey % 50 AS BIGINT) AS id1, CAST(c_custkey % 5 AS BIGINT) AS link_type, CAST(c_custkey % 23 AS BIGINT) AS id2, CAST(7 AS INTEGER) AS version, CAST(c_custkey AS BIGINT) AS time, 'new' AS data FROM customer WHERE c_custkey <= 100"


def _new_links(s, d):
    k = F.col("c_custkey").cast("long")
    return table(s, d, "customer").where("c_custkey <= 100").select((k + 1000000).alias("seq"), (k % 50).alias("id1"), (k % 5).alias("link_type"), (k % 23).alias("id2"), F.lit(1).cast("byte").alias("visibility"), F.lit(7).alias("version"), k.alias("time"), F.lit("new").alias("data"))


def _log_with(op: str) -> str:
    return f"log2 AS (SELECT * FROM log UNION ALL SELECT seq, '{op}' AS op, id1, link_type, id2, version, time, data FROM ({_NEW}))"


add("lb_add_link", lambda s, d: links.resolve(links.add_link(op_log(s, d), _new_links(s, d))[0]), f"WITH {_LOG}, {_log_with('U')} {_resolved_sql('log2')}")
add("lb_update_link", lambda s, d: links.update_link(op_log(s, d), _new_links(s, d))[1], f"{LB} SELECT seq, id1, link_type, id2, EXISTS (SELECT 1 FROM links l WHERE l.id1 = n.id1 AND l.link_type = n.link_type AND l.id2 = n.id2) AS found FROM ({_NEW}) n")
add("lb_delete_link", lambda s, d: links.resolve(links.delete_link(op_log(s, d), _new_links(s, d), expunge=True)), f"WITH {_LOG}, {_log_with('X')} {_resolved_sql('log2')}")
add("lb_hide_link", lambda s, d: links.resolve(links.delete_link(op_log(s, d), _new_links(s, d))), f"WITH {_LOG}, {_log_with('H')} {_resolved_sql('log2')}")
def _one_link(found: DataFrame) -> DataFrame:
    r = found.agg(F.min(F.struct(*links.KEY)).alias("k")).first().k
    return links.get_link(found, r.id1, r.link_type, r.id2)


add("lb_get_link", lambda s, d: _one_link(_links(s, d)), f"{LB} SELECT {LINK} FROM links WHERE (id1, link_type, id2) IN (SELECT min((id1, link_type, id2)) FROM links)")
add("lb_multiget_link", lambda s, d: links.multiget_links(_links(s, d), _new_links(s, d)), f"{LB} SELECT {LINK} FROM links WHERE (id1, link_type, id2) IN (SELECT (id1, link_type, id2) FROM ({_NEW}))")
add("lb_get_link_list", lambda s, d: links.link_list(_links(s, d)), f"{LB} SELECT {LINK}, CAST(rn - 1 AS BIGINT) AS pos FROM (SELECT *, row_number() OVER ({NEWEST}) AS rn FROM links WHERE visibility = 1) WHERE rn <= 10000")
_MID = "(SELECT CAST((min(epoch_us(ts)) + max(epoch_us(ts))) // 2 AS BIGINT) FROM events)"


def _mid(s, d) -> int:
    r = table(s, d, "events").agg(F.min(micros("ts")).alias("a"), F.max(micros("ts")).alias("b")).first()
    return (r.a + r.b) // 2


add("lb_get_link_range", lambda s, d: links.link_list(_links(s, d), None, None, None, _mid(s, d), 1, 2), f"{LB} SELECT {LINK}, CAST(rn - 1 AS BIGINT) AS pos FROM (SELECT *, row_number() OVER ({NEWEST}) AS rn FROM links WHERE visibility = 1 AND time <= {_MID}) WHERE rn BETWEEN 2 AND 3")
add("lb_count_links", lambda s, d: links.count_links(_links(s, d)), f"{LB} SELECT id1, link_type, count(*) FILTER (visibility = 1) AS n FROM links GROUP BY id1, link_type")
add("lb_count_table", lambda s, d: links.count_table(_links(s, d)), f"{LB} SELECT id1 AS id, link_type, count(*) AS count, max(time) AS time, CAST(max(version) AS BIGINT) AS version FROM links WHERE visibility = 1 GROUP BY id1, link_type")
add("lb_bulk_load", lambda s, d: links.bulk_load(_links(s, d), _new_links(s, d).drop("seq").dropDuplicates(["id1", "link_type", "id2"]).withColumns({"time": F.lit(1).cast("long")})), f"{LB} SELECT {LINK} FROM links WHERE (id1, link_type, id2) NOT IN (SELECT (id1, link_type, id2) FROM ({_NEW})) UNION ALL SELECT DISTINCT id1, link_type, id2, CAST(1 AS TINYINT), version, CAST(1 AS BIGINT), data FROM ({_NEW})")
add("lb_history_page", lambda s, d: links.history_page(_links(s, d), _links(s, d).where("visibility = 1").groupBy("id1", "link_type").agg(F.min_by("time", F.struct("time", "id2")).alias("lo"), F.max("time").alias("last_time")).drop("lo"), 2), f"{LB} SELECT {LINK} FROM (SELECT *, row_number() OVER ({NEWEST}) AS rn FROM links WHERE visibility = 1) WHERE rn BETWEEN 2 AND 3")


def _nodes(s, d):
    k = F.col("c_custkey").cast("long")
    return table(s, d, "customer").select(k.alias("id"), (k % 3).cast("int").alias("type"), F.lit(0).cast("long").alias("version"), F.lit(0).alias("time"), F.col("c_name").alias("data"))


_N = "SELECT CAST(c_custkey AS BIGINT) AS id, CAST(c_custkey % 3 AS INTEGER) AS type, CAST(0 AS BIGINT) AS version, CAST(0 AS INTEGER) AS time, c_name AS data FROM customer"
_NODE_ROWS = lambda s, d: table(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("order"), F.lit(9).alias("type"), F.lit(1).cast("long").alias("version"), F.lit(2).alias("time"), F.col("s_name").alias("data"))
_ADDED = "SELECT CAST(5000000 + row_number() OVER (ORDER BY s_suppkey) - 1 AS BIGINT) AS id, CAST(9 AS INTEGER) AS type, CAST(1 AS BIGINT) AS version, CAST(2 AS INTEGER) AS time, s_name AS data FROM supplier"
add("lb_add_node", lambda s, d: links.add_nodes(_nodes(s, d), _NODE_ROWS(s, d).where("order <= 1"), 5_000_000), f"{_N} UNION ALL SELECT * FROM ({_ADDED.replace('FROM supplier', 'FROM supplier WHERE s_suppkey <= 1')})")
add("lb_bulk_add_nodes", lambda s, d: links.add_nodes(_nodes(s, d), _NODE_ROWS(s, d), 5_000_000), f"{_N} UNION ALL SELECT * FROM ({_ADDED})")
add("lb_get_node", lambda s, d: links.get_node(_nodes(s, d), 1, [1, 2, 3, 4, 7]), f"SELECT * FROM ({_N}) WHERE type = 1 AND id IN (1, 2, 3, 4, 7)")
add("lb_update_node", lambda s, d: links.update_nodes(_nodes(s, d), _nodes(s, d).where("id % 2 = 0").select("id", F.lit(1).alias("type"), F.lit(5).cast("long").alias("version"), F.lit(6).alias("time"), F.lit("upd").alias("data"))), f"SELECT id, type, CASE WHEN id % 2 = 0 AND type = 1 THEN CAST(5 AS BIGINT) ELSE version END AS version, CASE WHEN id % 2 = 0 AND type = 1 THEN 6 ELSE time END AS time, CASE WHEN id % 2 = 0 AND type = 1 THEN 'upd' ELSE data END AS data FROM ({_N})")
add("lb_delete_node", lambda s, d: links.delete_nodes(_nodes(s, d), _nodes(s, d).where("id % 5 = 0").select("id", F.lit(2).alias("type"))), f"SELECT * FROM ({_N}) WHERE NOT (id % 5 = 0 AND type = 2)")

# Text and key-value search.

add("text_search", lambda s, d: search.text_search(table(s, d, "part"), "p_partkey", "p_name", "a"), "SELECT p_partkey, CAST(i AS BIGINT) AS off FROM (SELECT p_partkey, p_name, unnest(range(length(p_name))) AS i FROM part) WHERE substr(p_name, i + 1, 1) = 'a'")
add("kv_search", lambda s, d: search.kv_search(table(s, d, "documents"), "doc_id", "text", "ing"), "SELECT DISTINCT doc_id FROM documents WHERE contains(text, 'ing')")
add("kv_get", lambda s, d: search.kv_get(table(s, d, "part").select("p_partkey", "p_name"), table(s, d, "supplier").select((F.col("s_suppkey") * 3).alias("p_partkey")), "p_partkey", "p_name"), "SELECT s_suppkey * 3 AS p_partkey, coalesce(p_name, '') AS p_name FROM supplier LEFT JOIN part ON p_partkey = s_suppkey * 3")
add("text_extract", lambda s, d: table(s, d, "documents").select("doc_id", search.extract(F.col("text"), 3, 10).alias("part"), search.extract_until(F.col("text"), 3, " ").alias("word"), search.skip_until(F.col("text"), 3, " ").alias("next")), "SELECT doc_id, substr(text, 4, 10) AS part, split_part(substr(text, 4), ' ', 1) AS word, CAST(CASE WHEN contains(substr(text, 4), ' ') THEN 3 + instr(substr(text, 4), ' ') ELSE length(text) END AS BIGINT) AS next FROM documents")
add("ngram_index", lambda s, d: search.ngram_index(table(s, d, "part"), "p_partkey", "p_name"), "SELECT p_partkey, substr(p_name, i + 1, 3) AS gram, CAST(i AS BIGINT) AS off FROM (SELECT p_partkey, p_name, unnest(range(length(p_name) - 2)) AS i FROM part WHERE length(p_name) >= 3)")
add("ngram_search", lambda s, d: search.indexed_search(search.ngram_index(table(s, d, "part"), "p_partkey", "p_name"), "p_partkey", "red "), "SELECT p_partkey FROM part WHERE contains(p_name, 'red ')")

# Statistics over latency samples made of events.


def samples(s, d) -> DataFrame:
    return table(s, d, "events").select((F.col("user_id") % 4).cast("int").alias("thread"), F.col("event_type").alias("op"), micros("ts").alias("ts"), F.floor(F.col("value") * 1000).alias("latency_us"), (F.col("event_id") % 50 == 0).alias("error"))


_S = "WITH samples AS (SELECT CAST(user_id % 4 AS INTEGER) AS thread, event_type AS op, epoch_us(ts) AS ts, CAST(floor(value * 1000) AS BIGINT) AS latency_us, event_id % 50 = 0 AS error FROM events)"


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _bucket_sql() -> str:
    cases = " ".join(f"WHEN latency_us < {high} THEN (latency_us - {low}) // {step} + {base}" for low, high, step, base in stats._bases())
    return f"CAST(CASE {cases} ELSE {stats.N_BUCKETS - 1} END AS BIGINT)"


_H = f"{_S}, counts AS (SELECT op, {_bucket_sql()} AS bucket, count(*) AS n FROM samples WHERE NOT error GROUP BY 1, 2), hist AS (SELECT op, bucket, n, CAST(sum(n) OVER (PARTITION BY op ORDER BY bucket) AS BIGINT) AS cumulative, CAST(sum(n) OVER (PARTITION BY op) AS BIGINT) AS total FROM counts)"
_BOUNDS = stats._bases()
_LOW = "CAST(CASE " + " ".join(f"WHEN bucket < {b + (h - l) // t} THEN (bucket - {b}) * {t} + {l}" for l, h, t, b in _BOUNDS) + f" ELSE {stats.STEPS[-1][1]} END AS BIGINT)"
_HIGH = "CAST(CASE " + " ".join(f"WHEN bucket < {b + (h - l) // t} THEN (bucket - {b} + 1) * {t} + {l}" for l, h, t, b in _BOUNDS) + " END AS BIGINT)"
add("latency_summary", lambda s, d: _rounded(stats.latency_summary(samples(s, d)), "mean_us", "p50", "p95", "p99", digits=3), f"{_S} SELECT op, count(*) AS n, min(latency_us) AS min_us, max(latency_us) AS max_us, round(avg(latency_us), 3) AS mean_us, round(quantile_cont(latency_us, 0.5), 3) AS p50, round(quantile_cont(latency_us, 0.95), 3) AS p95, round(quantile_cont(latency_us, 0.99), 3) AS p99 FROM samples WHERE NOT error GROUP BY op")
add("latency_histogram", lambda s, d: stats.latency_histogram(samples(s, d)), f"{_H} SELECT op, bucket, n, cumulative FROM hist")
add("latency_percentile_bucket", lambda s, d: stats.latency_percentile_bucket(samples(s, d), 95), f"{_H}, p AS (SELECT op, min(bucket) AS bucket FROM hist WHERE cumulative * 100 >= total * 95 GROUP BY op) SELECT op, bucket, {_LOW} AS low_us, {_HIGH} AS high_us FROM p")
add("latency_mean", lambda s, d: _rounded(stats.latency_mean(samples(s, d)), "mean_us", digits=3), f"{_S} SELECT op, round(avg(latency_us), 3) AS mean_us FROM samples GROUP BY op")
add("throughput", lambda s, d: _rounded(stats.throughput(samples(s, d)), "seconds", "per_second"), f"{_S} SELECT op, n, round(seconds, 6) AS seconds, round(n / seconds, 6) AS per_second FROM (SELECT op, count(*) AS n, (max(ts) - min(ts)) / 1e6 AS seconds FROM samples GROUP BY op)")
add("phase_filter", lambda s, d: stats.phase_filter(samples(s, d), 10**12, 10**12), f"{_S} SELECT thread, op, ts, latency_us, error FROM samples WHERE ts - (SELECT min(ts) FROM samples) >= 1000000000000 AND ts - (SELECT min(ts) FROM samples) < 2000000000000")
add("freq_cdf", lambda s, d: _rounded(stats.freq_cdf(samples(s, d).withColumn("v", F.floor(F.col("latency_us") / 1000)), "v"), "cdf", digits=9), f"{_S} SELECT value, n, round(sum(n) OVER (ORDER BY value) / sum(n) OVER (), 9) AS cdf FROM (SELECT latency_us // 1000 AS value, count(*) AS n FROM samples GROUP BY 1)")
add("time_weighted_avg", lambda s, d: _rounded(stats.time_weighted_avg(table(s, d, "events").select("user_id", "event_id", micros("ts").alias("ts"), F.floor("value").alias("v")), "user_id", "ts", "v", "event_id"), "average"), "SELECT user_id, round(CASE WHEN sum(dt) > 0 THEN sum(v * dt) / sum(dt) END, 6) AS average FROM (SELECT user_id, CAST(floor(value) AS BIGINT) AS v, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) - epoch_us(ts) AS dt FROM events) WHERE dt IS NOT NULL GROUP BY user_id")
add("stat_describe", lambda s, d: _rounded(stats.describe(table(s, d, "part"), "p_size").select("n", F.col("total").cast("long").alias("total"), "mean", "stddev", "median", "mode", "p90", "low", "high"), "mean", "stddev", "median"), "SELECT (SELECT p_size FROM part GROUP BY p_size ORDER BY count(*) DESC, p_size LIMIT 1) AS mode, (SELECT p_size FROM (SELECT p_size, row_number() OVER (ORDER BY p_size) - 1 AS i, count(*) OVER () AS n FROM part) WHERE i = CAST(floor(0.9 * (n - 1)) AS BIGINT)) AS p90, count(p_size) AS n, CAST(sum(p_size) AS BIGINT) AS total, round(avg(p_size), 6) AS mean, round(stddev_samp(p_size), 6) AS stddev, round(quantile_cont(p_size, 0.5), 6) AS median, min(p_size) AS low, max(p_size) AS high FROM part")
add("stat_percentile", lambda s, d: stats.ranked_percentile(table(s, d, "part"), "p_size", 0.9), "SELECT p_size AS value FROM (SELECT p_size, row_number() OVER (ORDER BY p_size) - 1 AS i, count(*) OVER () AS n FROM part) WHERE i = CAST(floor(0.9 * (n - 1)) AS BIGINT)")
add("stat_mode", lambda s, d: stats.mode(table(s, d, "part"), "p_size"), "SELECT n, min(value) AS value FROM (SELECT p_size AS value, count(*) AS n FROM part GROUP BY 1) GROUP BY n ORDER BY n DESC LIMIT 1")
add("stat_correlation", lambda s, d: _rounded(stats.correlation(table(s, d, "lineitem"), "l_quantity", "l_extendedprice"), "correlation"), "SELECT round(abs(corr(l_quantity, l_extendedprice)), 6) AS correlation FROM lineitem")
_TCASE = "CASE WHEN n - 1 > 120 THEN 1.96 " + " ".join(f"WHEN n - 1 >= {k} THEN {stats.T95[k]}" for k in sorted(stats.T95, reverse=True)) + " END"
add("stat_confidence", lambda s, d: _rounded(stats.confidence_interval(table(s, d, "part"), "p_size", "p_brand"), "mean", "half_width"), f"SELECT p_brand, n, round(mean, 6) AS mean, round({_TCASE} * sd / sqrt(n), 6) AS half_width FROM (SELECT p_brand, count(p_size) AS n, avg(p_size) AS mean, stddev_samp(p_size) AS sd FROM part GROUP BY p_brand)")

# Scalar functions over small ids.


def _ids(s, n: int = 1000) -> DataFrame:
    return s.range(n).select(F.col("id").alias("i"))


_I = "(SELECT CAST(range AS BIGINT) AS i FROM range(1000))"


def _i():
    return F.col("i")


add("fn_num_digits", lambda s, d: _ids(s).select("i", fn.num_digits(-_i() * _i()).alias("digits")), f"SELECT i, CAST(length(CAST(i * i AS STRING)) AS BIGINT) AS digits FROM {_I}")
add("fn_pad", lambda s, d: _ids(s).select("i", fn.pad(_i(), 5).alias("padded"), fn.unpad(fn.pad(_i(), 5)).alias("back")), f"SELECT i, lpad(CAST(i AS STRING), 5, '0') AS padded, i AS back FROM {_I}")
add("fn_decode_multi", lambda s, d: _ids(s).select("i", F.posexplode(fn.decode_multi(F.concat(fn.pad(_i(), 4), fn.pad(_i() + 1, 4), fn.pad(_i() * 3, 4)), 4)).alias("pos", "value")), f"SELECT i, CAST(p AS INTEGER) AS pos, CAST(CASE p WHEN 0 THEN i WHEN 1 THEN i + 1 ELSE i * 3 END AS BIGINT) AS value FROM {_I}, (VALUES (0), (1), (2)) v(p)")
add("fn_base64int", lambda s, d: _ids(s).select("i", fn.base64_int(_i() * 7919).alias("digits"), fn.base64_int_decode(fn.base64_int(_i() * 7919)).alias("back")), f"SELECT i, CASE WHEN i = 0 THEN '0' ELSE ltrim(list_aggregate(list_transform([24, 18, 12, 6, 0], lambda k: substr('{fn.ALPHABET}', CAST(((i * 7919) >> k) & 63 AS BIGINT) + 1, 1)), 'string_agg', ''), '0') END AS digits, i * 7919 AS back FROM {_I}")
add("fn_format_attrs", lambda s, d: _ids(s).select("i", fn.length_header(F.array(_i().cast("string"), F.lit("x")), ",").alias("line"), F.size(fn.split_attrs(fn.format_attrs(F.array(_i().cast("string"), F.lit("")), ","), ",")).cast("long").alias("n")), f"SELECT i, length(CAST(i AS STRING)) || ',1,' || i || ',x' AS line, CAST(2 AS BIGINT) AS n FROM {_I}")
add("fn_fix_width", lambda s, d: table(s, d, "part").select("p_partkey", fn.fix_width(F.col("p_name"), 9).alias("fixed")), "SELECT p_partkey, rpad(substr(p_name, 1, 9), 9, '|') AS fixed FROM part")
add("fn_shard", lambda s, d: _ids(s).select("i", fn.shard(_i(), 40).alias("shard"), fn.host(_i(), 40, 10).alias("host")), f"SELECT i, i % 40 AS shard, i % 40 % 10 AS host FROM {_I}")
add("fn_local_id", lambda s, d: _ids(s).select("i", fn.local_id(_i(), 40).alias("local"), fn.global_id(fn.local_id(_i(), 40), fn.shard(_i(), 40), 40).alias("back")), f"SELECT i, i // 40 AS local, i AS back FROM {_I}")
add("fn_ngram_hash", lambda s, d: search.ngram_index(table(s, d, "supplier"), "s_suppkey", "s_name").select("gram", fn.ngram_hash(F.col("gram"), 3).alias("h")).distinct(), "SELECT DISTINCT gram, CAST(ascii(gram) * 65536 + ascii(substr(gram, 2)) * 256 + ascii(substr(gram, 3)) AS BIGINT) AS h FROM (SELECT substr(s_name, i + 1, 3) AS gram FROM (SELECT s_name, unnest(range(length(s_name) - 2)) AS i FROM supplier WHERE length(s_name) >= 3))")
add("fn_pack", lambda s, d: _ids(s).select("i", fn.pack(_i(), _i() * 2).alias("packed")), f"SELECT i, i * 4294967296 + i * 2 AS packed FROM {_I}")
add("fn_latency_bucket", lambda s, d: _ids(s).select((_i() * 12347).alias("latency_us"), stats.latency_bucket(_i() * 12347).alias("bucket")), f"SELECT latency_us, {_bucket_sql()} AS bucket FROM (SELECT i * 12347 AS latency_us FROM {_I})")
add("fn_transpose_perm", lambda s, d: _ids(s).select("i", fn.transpose_permutation(_i(), 1000, 7).alias("to")), f"SELECT i, CAST((i % 7) * 142 + least(i % 7, 6) + i // 7 AS BIGINT) AS to FROM {_I}")
add("fn_invertible_perm", lambda s, d: _ids(s).select("i", fn.rotation_inverse(fn.rotation_permutation(_i(), 1000, 7, 3), 1000, 7, 3).alias("back")), f"SELECT i, i AS back FROM {_I}")
add("fn_parse_query", lambda s, d: _ids(s).select(*fn.parse_query(F.concat_ws(",", _i(), _i() + 1, F.lit(0), F.lit(9)), ["node", "atype", "off", "len"])), f"SELECT i AS node, i + 1 AS atype, CAST(0 AS BIGINT) AS off, CAST(9 AS BIGINT) AS len FROM {_I}")
add("fn_parse_edge", lambda s, d: _ids(s).select(*fn.parse_edge(F.concat_ws(" ", _i(), _i() + 1, (_i() / 2).cast("string")))), f"SELECT i, i + 1 AS j, i / 2 AS cost FROM {_I}")

# Algorithms, on the undirected graph of customers, suppliers, nations and regions.


def _geo(s, d) -> DataFrame:
    e = edges(s, d).where("atype IN (3, 4, 5)").select(F.col("src").alias("i"), F.col("dst").alias("j"), (F.col("src") % 7 + 1).cast("double").alias("cost"))
    return algo.undirected(e)


START = 5  # region 0
_GEO = f"WITH RECURSIVE {EDGES_SQL}, geo AS (SELECT src AS i, dst AS j, CAST(src % 7 + 1 AS DOUBLE) AS cost FROM edges WHERE atype IN (3, 4, 5) UNION SELECT dst, src, CAST(src % 7 + 1 AS DOUBLE) FROM edges WHERE atype IN (3, 4, 5))"
_WALK = "walk AS (SELECT CAST({start} AS BIGINT) AS node, CAST({start} AS BIGINT) AS pred, CAST(0 AS INTEGER) AS dist, CAST(0 AS DOUBLE) AS total, CAST(0 AS DOUBLE) AS top UNION ALL SELECT j, i, dist + 1, total + cost, greatest(top, cost) FROM walk JOIN geo ON i = node WHERE j <> pred OR dist = 0)".format(start=START)
add("bfs_levels", lambda s, d: algo.bfs(_geo(s, d), START), f"{_GEO}, {_WALK} SELECT node, dist, pred FROM walk")
add("sssp_sum", lambda s, d: algo.shortest_paths(_geo(s, d), START).select("node", "dist"), f"{_GEO}, {_WALK} SELECT node, total AS dist FROM walk")
add("sssp_minimax", lambda s, d: algo.shortest_paths(_geo(s, d), START, F.greatest).select("node", "dist"), f"{_GEO}, {_WALK} SELECT node, top AS dist FROM walk")
add("trace_path", lambda s, d: algo.trace_path(algo.bfs(_geo(s, d), START), START, (_geo(s, d).join(algo.bfs(_geo(s, d), START).where("dist = 2").select(F.col("node").alias("i")), "i").agg(F.max("i").alias("i")).first().i)), f"{_GEO}, {_WALK}, last AS (SELECT max(node) AS node FROM walk WHERE dist = 2) SELECT CAST(w.dist AS BIGINT) AS step, w.node FROM walk w, last WHERE w.node = last.node OR w.dist = 0 OR w.node = (SELECT pred FROM walk x WHERE x.node = last.node)")
_REGION = "home AS (SELECT n_nationkey * 8 + 4 AS node, n_regionkey AS r FROM nation UNION ALL SELECT DISTINCT n_regionkey * 8 + 5, n_regionkey FROM nation UNION ALL SELECT c_custkey * 8, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT s_suppkey * 8 + 3, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey), sized AS (SELECT CAST(node AS BIGINT) AS node, CAST(min(node) OVER (PARTITION BY r) AS BIGINT) AS component, count(*) OVER (PARTITION BY r) AS n FROM home)"
add("connected_components", lambda s, d: connected_components(_geo(s, d).select("i", "j")), f"WITH {_REGION} SELECT node, component FROM sized")
add("largest_component", lambda s, d: algo.largest_component(_geo(s, d)), f"WITH {_REGION} SELECT node FROM sized WHERE component = (SELECT component FROM sized ORDER BY n DESC, component LIMIT 1)")
add("largest_connected_subgraph", lambda s, d: algo.largest_connected_subgraph(_geo(s, d)).select("i", "j"), f"{_GEO}, {_REGION} SELECT i, j FROM geo WHERE i IN (SELECT node FROM sized WHERE component = (SELECT component FROM sized ORDER BY n DESC, component LIMIT 1))")
add("induced_subgraph", lambda s, d: algo.induced_subgraph(_geo(s, d), s.range(100).select((F.col("id") * 4).alias("node"))), f"{_GEO} SELECT i, j, cost FROM geo WHERE i % 4 = 0 AND j % 4 = 0 AND i < 400 AND j < 400")


def _labels(s, d):
    return table(s, d, "nation").select((F.col("n_nationkey").cast("long") * 8 + 4).alias("node"), F.col("n_name").alias("label"))


_NATION = "NATION_7"
add("graph_find_label", lambda s, d: algo.find_label(_labels(s, d), _NATION), f"SELECT CAST(n_nationkey * 8 + 4 AS BIGINT) AS node FROM nation WHERE n_name = '{_NATION}'")
add("graph_remove_node", lambda s, d: algo.remove_nodes(_geo(s, d), s.createDataFrame([(START,), (4,)], "node long")), f"{_GEO} SELECT i, j, cost FROM geo WHERE i NOT IN (5, 4) AND j NOT IN (5, 4)")
add("graph_map_labels", lambda s, d: algo.map_labels(_labels(s, d), "label", F.lower), "SELECT CAST(n_nationkey * 8 + 4 AS BIGINT) AS node, lower(n_name) AS label FROM nation")
add("graph_add_edges", lambda s, d: algo.add_edges(_geo(s, d), s.createDataFrame([(4, 12, 1.5), (4, 5, 9.0)], "i long, j long, cost double")), f"{_GEO} SELECT i, j, cost FROM geo WHERE (i, j) NOT IN ((4, 12), (4, 5)) UNION ALL VALUES (4, 12, CAST(1.5 AS DOUBLE)), (4, 5, CAST(9 AS DOUBLE))")

# Streams, run over what is there.


def _stream_edges(s, d):
    path, checkpoint = oplog.fresh(s, "stream-edges")
    rows = oplog.stream_table(s, d, "events").select((F.col("user_id").cast("long") * 8).alias("src"), (event_code() + 6).alias("atype"), (F.col("event_id").cast("long") * 8 + 6).alias("dst"), micros("ts").alias("time"), F.col("props").alias("attr"))
    return oplog.append_log(rows, path, checkpoint)


def _stream_nodes(s, d):
    path, checkpoint = oplog.fresh(s, "stream-nodes")
    rows = oplog.stream_table(s, d, "part").select((F.col("p_partkey").cast("long") * 8 + 2).alias("node_id"), F.posexplode(F.array("p_name", "p_brand")).alias("attr_idx", "attr"))
    return oplog.append_log(rows, path, checkpoint)


def _stream_log(s, d, name: str):
    op = F.when(F.col("event_id") % 7 == 0, F.lit("H")).when(F.col("event_id") % 7 == 1, F.lit("X")).otherwise(F.lit("U"))
    path, checkpoint = oplog.fresh(s, name)
    rows = oplog.stream_table(s, d, "events").select(F.col("event_id").cast("long").alias("seq"), op.alias("op"), F.col("user_id").cast("long").alias("id1"), event_code().alias("link_type"), (F.col("event_id") % 20).cast("long").alias("id2"), F.lit(1).cast("byte").alias("visibility"), (F.col("event_id") % 3).cast("int").alias("version"), micros("ts").alias("time"), F.col("props").alias("data"))
    return rows, path, checkpoint


add("stream_assoc_add", _stream_edges, f"{E} SELECT {COLS} FROM edges WHERE atype >= 6")
add("stream_obj_add", _stream_nodes, f"{A} SELECT node_id, attr_idx, attr FROM node_attr WHERE node_id % 8 = 2 AND attr_idx < 2")
add("stream_delete_link", lambda s, d: links.resolve(oplog.append_log(*_stream_log(s, d, "stream-links"))), f"WITH {_LOG} {_resolved_sql()}")


def _stream_last(s, d):
    rows, path, checkpoint = _stream_log(s, d, "stream-last")
    return oplog.last_writer(rows, ["id1", "link_type", "id2"], "seq", path, checkpoint).select("id1", "link_type", "id2", "seq", "op", "time", "data")


add("stream_last_writer", _stream_last, f"WITH {_LOG} SELECT id1, link_type, id2, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(time, seq) AS time, arg_max(data, seq) AS data FROM log GROUP BY id1, link_type, id2")

from tessera.plans import generated, more  # noqa: E402

generated.register(add)
more.register(add)
