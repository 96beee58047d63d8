"""Queries of generators, distributions and mixes, with SQL that makes the same draws from MD5 digests."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import distributions as dist
from tessera.functions import generators as gen
from tessera.operators import assoc, stats
from tessera.plans import workload
from tessera.sources.derived import ATTRS_SQL, EDGES_SQL, GRAPH_SQL, edges, micros, node_attrs, table
from tessera.streaming import oplog

E = f"WITH {EDGES_SQL}"


def u(key: str, seed: int | str) -> str:
    """SQL for ``generators.uniform``."""
    return f"(CAST('0x' || substr(md5('{seed}:' || CAST({key} AS STRING)), 1, 13) AS BIGINT) / CAST({1 << 52} AS DOUBLE))"


def keys(*parts: str) -> str:
    return "concat_ws(':', " + ", ".join(f"CAST({p} AS STRING)" for p in parts) + ")"


def d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def ids(n: int, name: str = "id", first: int = 0) -> str:
    return f"(SELECT CAST(range AS BIGINT) AS {name} FROM range({first}, {first + n}))"


def floor(x: str) -> str:
    return f"CAST(floor({x}) AS BIGINT)"


def zipf_sql(draw: str, z: dist.Zipf) -> str:
    n, zn, z2 = z.max - z.min, dist.harmonic(z.max - z.min, z.shape), 1 + 0.5**z.shape
    eta, alpha = (1 - (2 / n) ** (1 - z.shape)) / (1 - z2 / zn), 1 / (1 - z.shape)
    return f"least(CASE WHEN {draw} * {d(zn)} < 1 THEN 0 WHEN {draw} * {d(zn)} < {d(z2)} THEN 1 ELSE {floor(f'{n} * pow({d(eta)} * {draw} - {d(eta)} + 1, {d(alpha)})')} END, {n - 1}) + {z.min}"


def normal_sql(draw: str) -> str:
    y, p = f"ln({draw} / (1 - {draw}))", 1.5976 / 0.07056
    q = f"(-{y} / {d(0.07056)})"
    root = f"sqrt({q} * {q} / 4 + {d(p**3 / 27)})"
    return f"(cbrt(-{q} / 2 + {root}) + cbrt(-{q} / 2 - {root}))"


def drawn(source: str, key: str, seed: int, n: int) -> str:
    """SQL for the n rows with the smallest draws, numbered by them."""
    return f"(SELECT * EXCLUDE (draw), {floor(f'draw * {1 << 52}')} AS req_id FROM (SELECT *, {u(key, seed)} AS draw FROM {source}) ORDER BY draw LIMIT {n})"


def chosen(mix: dict[str, float], draw: str) -> str:
    out, upto = "", 0.0
    for op, share in mix.items():
        upto += share
        out += f" WHEN {draw} * 100 < {d(upto)} THEN '{op}'"
    return f"CASE{out} ELSE '{op}' END"


N_DRAWS = 5000
_LISTS = "SELECT DISTINCT src, atype FROM edges"


def _draws(s, kind: dist.Distribution, digits: int | None = None) -> DataFrame:
    value = kind.quantile(gen.uniform(F.col("id"), 1))
    return s.range(N_DRAWS).select("id", (value if digits is None else F.round(value, digits)).alias("value"))


def _assocs_sql(n: int, nodes: int, atypes: int, t_max: int, seed: int = 13) -> str:
    pick = lambda salt, upto: floor(f"{u('id', seed + salt)} * {upto}")
    return f"SELECT {pick(0, nodes)} AS src, {pick(1, atypes)} AS atype, {pick(2, nodes)} AS dst, {pick(3, t_max)} AS time, '' AS attr FROM {ids(n)}"


def _links_sql(count: str, n: int, seed: int = 3) -> str:
    return f"SELECT id1, ({floor(u('id1', seed) + f' * {n}')} + k) % {n} + 1 AS id2, CAST(1 AS BIGINT) AS link_type, k AS time, CAST(0 AS INTEGER) AS version FROM (SELECT id1, unnest(range(CAST(least({count}, {n}) AS BIGINT))) AS k FROM {ids(n, 'id1', 1)})"


#: SQL for ``distributions.LINK_COUNTS`` and ``ACCESS``.
COUNTS_SQL: dict[str, Callable[[int, int], str]] = {
    "const": lambda n, k: f"CAST({k} AS BIGINT)",
    "reciprocal": lambda n, k: f"CAST(ceil({n} / id1) AS BIGINT)",
    "multiples": lambda n, k: f"CAST(CASE WHEN id1 % {k} = 0 THEN {k} ELSE 0 END AS BIGINT)",
    "exponential": lambda n, k: "CAST(CASE WHEN id1 & (id1 - 1) = 0 THEN id1 ELSE 0 END AS BIGINT)",
    "perfect_squares": lambda n, k: "CAST(CASE WHEN pow(floor(sqrt(id1)), 2) = id1 THEN floor(sqrt(id1)) ELSE 0 END AS BIGINT)",
}
ACCESS_SQL: dict[str, Callable[[int, int], str]] = {
    "round_robin": lambda n, k: f"r % {n}",
    "reciprocal": lambda n, k: f"CAST(ceil({n} / ceil(v * {n})) AS BIGINT) - 1",
    "multiple": lambda n, k: floor(f"v * ceil({n} / {d(float(k))})") + f" * {k}",
    "power": lambda n, k: floor(f"pow(v, {k}) * {n}"),
    "perfect_power": lambda n, k: f"CAST(pow(floor(pow(v * {n}, {d(1 / k)})), {k}) AS BIGINT)",
}


def _gnm_sql(n: int, m: int, seed: int = 23) -> str:
    total, surplus = n * (n - 1) // 2, int(m * 1.5 + 10 * math.sqrt(m) + 10)
    start = "(i * (2 * {n} - i - 1) // 2)".replace("{n}", str(n))
    # The rows of the upper triangle, and the pair's place in its own.
    return f"""WITH pairs AS (SELECT DISTINCT {floor(u('id', seed) + f' * {total}')} AS p FROM {ids(surplus)}), chosen AS (SELECT p FROM pairs ORDER BY {u('p', seed + 1)}, p LIMIT {m}),
      firsts AS (SELECT i, {start} AS a FROM {ids(n - 1, 'i')})
      SELECT i, p - a + i + 1 AS j FROM chosen ASOF JOIN firsts ON chosen.p >= firsts.a"""


def _degree_sql(stubs: str, seed: int = 29) -> str:
    return f"""SELECT DISTINCT i, j FROM (SELECT min(node) AS i, max(node) AS j, count(*) AS n FROM (SELECT node, row_number() OVER (ORDER BY {u(keys('node', 'k'), seed)}) - 1 AS p FROM ({stubs})) GROUP BY p // 2) WHERE n = 2 AND i < j"""


def _geometric_sql(n: int, degree: float, seed: int = 37) -> str:
    radius = math.sqrt(degree / (math.pi * n))
    cost = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
    return f"WITH points AS (SELECT id AS node, {u('id', seed)} AS x, {u('id', seed + 1)} AS y FROM {ids(n)}) SELECT a.node AS i, b.node AS j, round({cost}, 9) AS cost FROM points a JOIN points b ON a.node < b.node AND {cost} <= {d(radius)}"


def _payload_sql(n: int, motif: bytes, uniqueness: float, seed: int = 5) -> str:
    stream = lambda salt: f"list_aggregate(list_transform(range(CAST(greatest(size, 1) - 1 AS BIGINT) // 16 + 1), lambda b: md5('{seed}{salt}:' || id || ':' || b)), 'string_agg', '')"
    byte = lambda digits: f"CAST('0x' || substr({digits}, CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER)"
    at = f"CASE WHEN {byte('c')} < {d(uniqueness * 256)} THEN upper(substr(n, CAST(2 * i + 1 AS BIGINT), 2)) ELSE substr('{motif.hex().upper()}', CAST(i % {len(motif)} * 2 + 1 AS BIGINT), 2) END"
    return f"SELECT id, size, coalesce(list_aggregate(list_transform(range(size), lambda i: {at}), 'string_agg', ''), '') AS data FROM (SELECT id, size, {stream('n')} AS n, {stream('c')} AS c FROM (SELECT id, id % 64 AS size FROM {ids(n)}))"


def _hex_payloads(s) -> DataFrame:
    return gen.payloads(s.range(200).select("id", (F.col("id") % 64).alias("size")), "id", "size", motif=b"abc", uniqueness=0.25).withColumn("data", F.hex("data"))


def _augmented(s) -> DataFrame:
    return gen.augment_out_degree(gen.random_assocs(s, 500, 200, 1, 10), s.range(200).select(F.col("id").alias("node")), 5, 200)


_AUGMENTED = f"""WITH have AS ({_assocs_sql(500, 200, 1, 10)}), short AS (SELECT id AS src, 5 - count(DISTINCT dst) AS need FROM {ids(200)} LEFT JOIN have ON src = id GROUP BY id HAVING count(DISTINCT dst) < 5),
  offers AS (SELECT src, need, k, ({floor(u('src', 19) + ' * 200')} + k) % 200 AS dst FROM (SELECT *, unnest(range(11)) AS k FROM short))
  SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY k) AS rn FROM offers o WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.src = o.src AND h.dst = o.dst)) WHERE rn <= need"""


def _operations(s, mix: dict[str, float]) -> DataFrame:
    return workload.operations(s, 10_000, mix)


def _operations_sql(mix: dict[str, float]) -> str:
    return f"SELECT id AS req_id, {chosen(mix, u('id', 41))} AS op FROM {ids(10_000)}"


def _access(s) -> DataFrame:
    draws = s.range(2000).select(F.col("id").alias("r"), gen.uniform(F.col("id"), 3).alias("v"))
    return draws.select("r", *(f(F.col("r"), F.col("v"), 1000, 2).alias(name) for name, f in dist.ACCESS.items()))


def _counts(s) -> DataFrame:
    return s.range(1, 1001).select(F.col("id").alias("id1")).select("id1", *(f(F.col("id1"), 1000, 10).alias(name) for name, f in dist.LINK_COUNTS.items()))


def _chosen_id2(s) -> DataFrame:
    """Targets of operations, half of them ones that the load gave, with how many links each id1 has."""
    each = s.range(1, 1001).select(F.col("id").alias("id1"), gen.uniform(F.col("id"), 4).alias("v"), (F.col("id") % 4).alias("n"))
    return each.select("id1", gen.choose_id2(F.col("id1"), F.col("v"), F.col("n"), 1000, 0.5).alias("id2"))


def _blended(s) -> DataFrame:
    draws = s.range(2000).select("id", *(gen.uniform(F.col("id"), k).alias(f"v{k}") for k in (5, 6, 7)))
    own = dist.ACCESS["power"]
    return draws.select("id", workload.blended_id(F.col("v5"), own(F.col("id"), F.col("v6"), 1000, 3), F.floor(F.col("v7") * 1000), 0.7).alias("chosen"))


def _samples(s, sf) -> DataFrame:
    return table(s, sf, "events").select((F.col("user_id") % 4).cast("int").alias("thread"), F.col("event_type").alias("op"), micros("ts").alias("ts"), F.floor(F.col("value") * 1000).alias("latency_us"), (F.col("event_id") % 50 == 0).alias("error"))


_SAMPLES = "(SELECT CAST(user_id % 4 AS INTEGER) AS thread, event_type AS op, epoch_us(ts) AS ts, CAST(floor(value * 1000) AS BIGINT) AS latency_us, event_id % 50 = 0 AS error FROM events)"


def register(add: Callable[..., None]) -> None:
    v = u("id", 1)
    draws = lambda value: f"SELECT id, {value} AS value FROM {ids(N_DRAWS)}"
    zipf, nodes = dist.Zipf(0, 1000, 0.8), dist.Zipf(0, 100, 0.6)
    add("gen_uniform", lambda s, sf: _draws(s, dist.Uniform(10, 20)), draws(f"{floor(f'{v} * 10')} + 10"))
    add("gen_zipf", lambda s, sf: _draws(s, zipf), draws(f"CAST({zipf_sql(v, zipf)} AS BIGINT)"))
    add("gen_geometric", lambda s, sf: _draws(s, dist.Geometric(1, 129, 0.382)), draws(f"CAST(least(greatest(ceil(ln(1 - {v}) / {d(math.log(1 - 0.382))}), 1), 128) AS BIGINT)"))
    add("gen_lognormal", lambda s, sf: _draws(s, dist.LogNormal(0, 1024, 128, 1.0)), draws(f"CAST(greatest(0, least(1023, floor(exp({normal_sql(v)} + {d(math.log(128))})))) AS BIGINT)"))
    add("gen_empirical", lambda s, sf: _draws(s, dist.Empirical(((0, 0.0), (1, 0.5), (10, 1.0))), 9), draws(f"round(CASE WHEN {v} <= 0 THEN 0 WHEN {v} <= 0.5 THEN {v} * 2 ELSE 1 + ({v} - 0.5) * 18 END, 9)"))
    add("gen_exponential", lambda s, sf: _draws(s, dist.Exponential(3.0), 9), draws(f"round(-ln(1 - {v}) * 3, 9)"))
    add("gen_powerlaw", lambda s, sf: _draws(s, dist.PowerLaw(2.5), 6), draws(f"round(pow(1 - {v}, {d(1 / (1 - 2.5))}), 6)"))
    add("gen_link_counts", lambda s, sf: _counts(s), f"SELECT id1, {', '.join(f(1000, 10) + ' AS ' + name for name, f in COUNTS_SQL.items())} FROM {ids(1000, 'id1', 1)}")
    add("gen_access", lambda s, sf: _access(s), f"SELECT r, {', '.join(f(1000, 2) + ' AS ' + name for name, f in ACCESS_SQL.items())} FROM (SELECT id AS r, {u('id', 3)} AS v FROM {ids(2000)})")
    add("gen_id2_chooser", lambda s, sf: _chosen_id2(s), f"SELECT id1, CASE WHEN v < 0.5 AND n > 0 THEN ({floor(u('id1', 3) + ' * 1000')} + {floor('v / 0.5 * n')}) % 1000 + 1 ELSE {floor('(v - 0.5) / 0.5 * 1000')} + 1 END AS id2 FROM (SELECT id1, {u('id1', 4)} AS v, id1 % 4 AS n FROM {ids(1000, 'id1', 1)})")
    add("gen_blended_ids", lambda s, sf: _blended(s), f"SELECT id, CASE WHEN {u('id', 5)} < 0.7 THEN {floor('pow(' + u('id', 6) + ', 3) * 1000')} ELSE {floor(u('id', 7) + ' * 1000')} END AS chosen FROM {ids(2000)}")
    add("gen_links", lambda s, sf: gen.links(s, 1000), _links_sql(COUNTS_SQL["reciprocal"](1000, 10), 1000))
    add("gen_links_by_class", lambda s, sf: gen.links(s, 1000, "multiples"), _links_sql(COUNTS_SQL["multiples"](1000, 10), 1000))
    add("gen_payloads", lambda s, sf: _hex_payloads(s), _payload_sql(200, b"abc", 0.25))
    add("gen_nodes", lambda s, sf: gen.random_nodes(s, 500, 4, 8, nodes), f"SELECT node_id, CAST(attr_idx AS INTEGER) AS attr_idx, lpad(CAST(CAST({zipf_sql(u(keys('node_id', 'attr_idx'), 9), nodes)} AS BIGINT) AS STRING), 8, '0') AS attr FROM (SELECT id AS node_id, unnest(range(4)) AS attr_idx FROM {ids(500)})")
    add("gen_assocs", lambda s, sf: gen.random_assocs(s, 5000, 500, 5, 10**6), _assocs_sql(5000, 500, 5, 10**6))
    pick = lambda seed, upto: floor(u(keys("src", "atype"), seed) + f" * {upto}")
    add("gen_log_assocs", lambda s, sf: gen.assocs_in_lists(assoc.assoc_lists(edges(s, sf)), 0.1, 500, 10**6), f"{E} SELECT src, atype, {pick(18, 500)} AS dst, {pick(19, 10**6)} AS time, '' AS attr FROM ({_LISTS}) WHERE {u(keys('src', 'atype'), 17)} < 0.1")
    add("gen_augmented", lambda s, sf: _augmented(s), _AUGMENTED)
    add("gen_gnm", lambda s, sf: gen.gnm(s, 300, 1000), _gnm_sql(300, 1000))
    add("gen_regular", lambda s, sf: gen.regular_graph(s, 300, 4), _degree_sql(f"SELECT id AS node, unnest(range(1, 5)) AS k FROM {ids(300)}", 31))
    add("gen_geometric_graph", lambda s, sf: gen.geometric_graph(s, 1000, 6.0)[1].withColumn("cost", F.round("cost", 9)), _geometric_sql(1000, 6.0))
    few = "(SELECT src, atype FROM edges GROUP BY src, atype HAVING count(*) <= 10)"
    by_list = keys("src", "atype")
    add("gen_list_requests", lambda s, sf: workload.list_requests(edges(s, sf), 200, max_degree=10), f"{E} SELECT req_id, src, atype FROM {drawn(few, by_list, 43, 200)}")
    add("gen_range_requests", lambda s, sf: workload.range_requests(edges(s, sf), 200), f"{E} SELECT req_id, src, atype, CAST(0 AS INTEGER) AS off, CAST(1000 AS INTEGER) AS len FROM {drawn(f'({_LISTS})', by_list, 43, 200)}")
    at = lambda pick: floor(f"{pick}({u('req_id', 48)}, {u('req_id', 49)}) * (b - a)")
    add("gen_time_requests", lambda s, sf: workload.time_requests(edges(s, sf), 200), f"{E} SELECT req_id, src, atype, a + {at('least')} AS t_low, a + {at('greatest')} AS t_high, CAST(1000 AS INTEGER) AS \"limit\" FROM {drawn(f'({_LISTS})', by_list, 47, 200)}, (SELECT min(time) AS a, max(time) AS b FROM edges)")
    add("gen_get_requests", lambda s, sf: assoc.assoc_get_batch(edges(s, sf), workload.get_requests(edges(s, sf), 200)), f"{E} SELECT req_id, src, atype, dst, time, attr FROM {drawn('(SELECT DISTINCT src, atype, dst FROM edges)', keys('src', 'atype', 'dst'), 53, 200)} JOIN edges USING (src, atype, dst)")
    pairs = "(SELECT DISTINCT attr_idx, attr AS key FROM node_attr WHERE attr <> '')"
    add("gen_node_requests", lambda s, sf: workload.node_requests(node_attrs(s, sf), 100), f"WITH {ATTRS_SQL} SELECT req_id, attr_idx, key FROM {drawn(pairs, keys('attr_idx', 'key'), 59, 100)}")
    some = drawn("(SELECT DISTINCT src, dst FROM edges)", keys("src", "dst"), 61, 100)
    add("gen_neighbor_node_requests", lambda s, sf: workload.neighbor_node_requests(edges(s, sf), node_attrs(s, sf), 100), f"{GRAPH_SQL} SELECT req_id, src, attr_idx, key FROM (SELECT req_id, src, attr_idx, attr AS key, row_number() OVER (PARTITION BY req_id, src ORDER BY attr_idx, attr) AS rn FROM {some} JOIN node_attr ON node_id = dst WHERE attr <> '') WHERE rn = 1")
    add("mix_links", lambda s, sf: _operations(s, workload.LINK_MIX), _operations_sql(workload.LINK_MIX))
    add("mix_reads", lambda s, sf: _operations(s, workload.mix_with_updates()), _operations_sql(workload.mix_with_updates()))
    add("mix_primitives", lambda s, sf: _operations(s, workload.PRIMITIVE_MIX), _operations_sql(workload.PRIMITIVE_MIX))
    add("arrival_times", lambda s, sf: oplog.arrival_times(s, 2000, 10.0).withColumn("at", F.round("at", 6)), f"SELECT i, round(sum(gap) OVER (ORDER BY i), 6) AS at FROM (SELECT id AS i, -ln(1 - {u('id', 11)}) / 10 AS gap FROM {ids(2000)})")
    add("reservoir_sample", lambda s, sf: stats.reservoir_sample(_samples(s, sf), 20), f"SELECT thread, op, ts, latency_us, error FROM (SELECT *, row_number() OVER (PARTITION BY op ORDER BY {u(keys('thread', 'op', 'ts', 'latency_us', 'error'), 7)}) AS rn FROM {_SAMPLES}) WHERE rn <= 20")
