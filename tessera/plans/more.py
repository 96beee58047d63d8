"""Queries of graphs with cycles, key-value logs, node stores, files and shards, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import generators as gen
from tessera.operators import algorithms as algo
from tessera.operators import assoc, kv, links
from tessera.plans.generated import floor, ids, u
from tessera.session import scratch_path
from tessera.sources import text
from tessera.sources.derived import EDGES_SQL, edges, table

E = f"WITH {EDGES_SQL}"
START = 8 * 1 + 3  # supplier 1
ROUNDS = 16  # of relaxations in SQL, more than the graph's paths need


def trade(s, sf) -> DataFrame:
    """i, j, cost: parts and the suppliers that delivered them, both ways; a graph with many circles and competing paths."""
    p, q = F.col("l_partkey").cast("long"), F.col("l_suppkey").cast("long")
    pairs = table(s, sf, "lineitem").select((p * 8 + 2).alias("i"), (q * 8 + 3).alias("j"), ((p * 7 + q * 13) % 11 + 1).cast("double").alias("cost"))
    return algo.undirected(pairs)


_TRADE = "trade AS MATERIALIZED (SELECT DISTINCT i, j, cost FROM (SELECT CAST(l_partkey * 8 + 2 AS BIGINT) AS i, CAST(l_suppkey * 8 + 3 AS BIGINT) AS j, CAST((l_partkey * 7 + l_suppkey * 13) % 11 + 1 AS DOUBLE) AS cost FROM lineitem) UNION SELECT DISTINCT CAST(l_suppkey * 8 + 3 AS BIGINT), CAST(l_partkey * 8 + 2 AS BIGINT), CAST((l_partkey * 7 + l_suppkey * 13) % 11 + 1 AS DOUBLE) FROM lineitem)"


def relaxed(step: str) -> str:
    """SQL for least distances from START by rounds of relaxation; ``step`` extends dist by cost."""
    out = f"WITH {_TRADE}, r0 AS (SELECT CAST({START} AS BIGINT) AS node, CAST(0 AS DOUBLE) AS dist)"
    for k in range(ROUNDS):
        out += f", r{k + 1} AS MATERIALIZED (SELECT node, min(dist) AS dist FROM (SELECT * FROM r{k} UNION ALL SELECT j, {step} FROM r{k} JOIN trade ON i = node) GROUP BY node)"
    return out


_LEVELS = f"{relaxed('dist + 1')}, levels AS (SELECT node, CAST(r{ROUNDS}.dist AS INTEGER) AS dist, CASE WHEN node = {START} THEN node ELSE (SELECT min(t.i) FROM trade t JOIN r{ROUNDS} p ON p.node = t.i WHERE t.j = r{ROUNDS}.node AND p.dist = r{ROUNDS}.dist - 1) END AS pred FROM r{ROUNDS})"


def _farthest(s, sf) -> DataFrame:
    levels = algo.bfs(trade(s, sf), START)
    end = levels.agg(F.max(F.struct("dist", "node")).alias("x")).first().x.node  # one row
    return algo.trace_path(levels, START, end)


_FARTHEST = f"""{_LEVELS.replace('WITH ', 'WITH RECURSIVE ', 1)}, walk AS (SELECT node, dist, pred FROM levels WHERE (dist, node) = (SELECT max((dist, node)) FROM levels)
  UNION ALL SELECT l.node, l.dist, l.pred FROM walk w JOIN levels l ON l.node = w.pred WHERE w.node <> {START}) SELECT CAST(dist AS BIGINT) AS step, node FROM walk"""


def _kv_log(s, sf) -> DataFrame:
    return table(s, sf, "part").select(F.col("p_partkey").cast("long").alias("seq"), F.lit("I").alias("op"), (F.col("p_partkey") % 97).cast("long").alias("key"), F.col("p_name").alias("value"))


def _kv_requests(s, sf) -> DataFrame:
    return table(s, sf, "supplier").select((F.col("s_suppkey") + 10_000_000).cast("long").alias("seq"), (F.col("s_suppkey") * 3).cast("long").alias("key"), F.col("s_name").alias("value"))


_KV = "log AS (SELECT CAST(p_partkey AS BIGINT) AS seq, 'I' AS op, CAST(p_partkey % 97 AS BIGINT) AS key, p_name AS value FROM part)"
_ASKED = "asked AS (SELECT CAST(s_suppkey + 10000000 AS BIGINT) AS seq, CAST(s_suppkey * 3 AS BIGINT) AS key, s_name AS value FROM supplier)"
_CURRENT = "SELECT key, value FROM (SELECT key, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM {} GROUP BY key) WHERE op = 'I'"


def _kv_appended(s, sf) -> DataFrame:
    return kv.current(kv.append(_kv_log(s, sf), _kv_requests(s, sf).select("seq", "value"), 1000))


def _suppliers(s, sf) -> DataFrame:
    return table(s, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("order"), F.lit(9).alias("type"), F.lit(1).cast("long").alias("version"), F.lit(2).alias("time"), F.col("s_name").alias("data"))


def _reset(s, sf) -> DataFrame:
    nodes = _suppliers(s, sf).withColumnRenamed("order", "id")
    return links.NodeStore(nodes, 1).reset(100).add(_suppliers(s, sf)).add(_suppliers(s, sf)).nodes


_RESET = "SELECT CAST(100 + k * n + row_number() OVER (PARTITION BY k ORDER BY s_suppkey) - 1 AS BIGINT) AS id, CAST(9 AS INTEGER) AS type, CAST(1 AS BIGINT) AS version, CAST(2 AS INTEGER) AS time, s_name AS data FROM (SELECT s_suppkey, s_name, unnest(range(2)) AS k, count(*) OVER () AS n FROM supplier)"


def _counts(s, sf) -> DataFrame:
    return table(s, sf, "events").groupBy(F.col("user_id").cast("long").alias("id"), F.length("event_type").cast("long").alias("link_type")).agg(F.count("*").alias("count"), F.max("event_id").cast("long").alias("time"), F.lit(0).cast("long").alias("version"))


def _more_counts(s, sf) -> DataFrame:
    return table(s, sf, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.lit(4).cast("long").alias("link_type"), F.lit(7).cast("long").alias("count"), F.lit(8).cast("long").alias("time"), F.lit(9).cast("long").alias("version"))


_COUNTS = "old AS (SELECT CAST(user_id AS BIGINT) AS id, CAST(length(event_type) AS BIGINT) AS link_type, count(*) AS count, CAST(max(event_id) AS BIGINT) AS time, CAST(0 AS BIGINT) AS version FROM events GROUP BY 1, 2)"


def _node_lines(s, sf) -> DataFrame:
    """Parts written as one node file and read again, numbered by line."""
    path = scratch_path(s, "nodes")
    table(s, sf, "part").orderBy("p_partkey").select(F.array("p_name", "p_brand").alias("attrs")).coalesce(1).transform(lambda df: text.write_nodes_csv(df, path) or df)
    return text.read_nodes_csv(s, path, 2).select("node_id", F.get("attrs", 0).alias("name"), F.get("attrs", 1).alias("brand"))


def _shards(s, sf) -> DataFrame:
    path = scratch_path(s, "shards")
    text.write_shards(edges(s, sf).select("src", "atype"), path, "src", 16)
    back = text.coalesce_shards(s.read.parquet(path), 3)
    return back.groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources")).withColumn("shard", F.col("shard").cast("long"))


def _stats_csv(s, sf) -> DataFrame:
    path = scratch_path(s, "stats")
    text.write_stats_csv(table(s, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").cast("long").alias("top")), path)
    return text.read_stats_csv(s, path, "event_type string, n long, top long")


def _mapped(s, sf) -> DataFrame:
    labels = table(s, sf, "nation").select((F.col("n_nationkey").cast("long") * 8 + 4).alias("node"), F.col("n_name").alias("label"))
    nodes, costs = algo.map_graph(labels, trade(s, sf), F.lower, lambda c: c * 2)
    return costs.join(F.broadcast(nodes.agg(F.min("label").alias("least"))), F.lit(True))


def _corpus(s, sf) -> DataFrame:
    rows = s.range(500).select("id")
    return gen.from_corpus(rows, F.col("id"), table(s, sf, "part"), "p_partkey", "p_name")


def register(add: Callable[..., None]) -> None:
    add("bfs_cyclic", lambda s, sf: algo.bfs(trade(s, sf), START), f"{_LEVELS} SELECT node, dist, pred FROM levels")
    add("sssp_sum_cyclic", lambda s, sf: algo.shortest_paths(trade(s, sf), START).select("node", "dist"), f"{relaxed('dist + cost')} SELECT node, dist FROM r{ROUNDS}")
    add("sssp_minimax_cyclic", lambda s, sf: algo.shortest_paths(trade(s, sf), START, F.greatest).select("node", "dist"), f"{relaxed('greatest(dist, cost)')} SELECT node, dist FROM r{ROUNDS}")
    add("trace_path_cyclic", _farthest, _FARTHEST)
    add("graph_map", _mapped, f"WITH {_TRADE} SELECT i, j, cost * 2 AS cost, (SELECT min(lower(n_name)) FROM nation) AS least FROM trade")
    add("assoc_by_time", lambda s, sf: assoc.by_time(edges(s, sf), None, None, 1), f"{E} SELECT src, atype, dst, time, attr FROM edges WHERE time >= 1")
    add("kv_insert", lambda s, sf: kv.current(kv.insert(_kv_log(s, sf), _kv_requests(s, sf))), f"WITH {_KV}, {_ASKED}, both_ AS (SELECT * FROM log UNION ALL SELECT seq, 'I', key, value FROM asked) {_CURRENT.format('both_')}")
    add("kv_append", _kv_appended, f"WITH {_KV}, {_ASKED}, both_ AS (SELECT * FROM log UNION ALL SELECT seq, 'I', 999 + row_number() OVER (ORDER BY seq), value FROM asked) {_CURRENT.format('both_')}")
    add("kv_remove", lambda s, sf: kv.current(kv.remove(_kv_log(s, sf), _kv_requests(s, sf))[0]), f"WITH {_KV}, {_ASKED}, both_ AS (SELECT * FROM log UNION ALL SELECT seq, 'R', key, NULL FROM asked) {_CURRENT.format('both_')}")
    add("kv_removed", lambda s, sf: kv.remove(_kv_log(s, sf), _kv_requests(s, sf))[1], f"WITH {_KV}, {_ASKED} SELECT seq, key, key IN (SELECT key FROM log) AS removed FROM asked")
    add("lb_reset_node_store", _reset, _RESET)
    add("lb_bulk_counts", lambda s, sf: links.add_bulk_counts(_counts(s, sf), _more_counts(s, sf)), f"WITH {_COUNTS}, more AS (SELECT CAST(c_custkey AS BIGINT) AS id, CAST(4 AS BIGINT) AS link_type, CAST(7 AS BIGINT) AS count, CAST(8 AS BIGINT) AS time, CAST(9 AS BIGINT) AS version FROM customer) SELECT * FROM old WHERE (id, link_type) NOT IN (SELECT (id, link_type) FROM more) UNION ALL SELECT * FROM more")
    add("read_node_lines", _node_lines, "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS node_id, p_name AS name, p_brand AS brand FROM part")
    add("edge_shards", _shards, f"{E} SELECT src % 16 AS shard, count(*) AS n, count(DISTINCT src) AS sources FROM edges GROUP BY 1")
    add("stats_csv", _stats_csv, "SELECT event_type, count(*) AS n, CAST(max(event_id) AS BIGINT) AS top FROM events GROUP BY 1")
    add("gen_from_corpus", _corpus, f"SELECT id, p_name FROM (SELECT id, {floor(u('id', 10) + ' * (SELECT count(*) FROM part)')} AS place FROM {ids(500)}) JOIN (SELECT p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS r FROM part) ON r = place")
