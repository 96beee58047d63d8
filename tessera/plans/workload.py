"""Request mixes and the queries that make them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.generators import key_of, uniform

#: Percentages of the link-store mix, of the time-ordered read mix, and of the primitive mix.
LINK_MIX = {"getlinklist": 50.71, "getnode": 12.93, "addlink": 8.99, "updatelink": 8.01, "updatenode": 7.37, "countlink": 4.89, "deletelink": 2.99, "addnode": 2.57, "deletenode": 1.01, "getlink": 0.53}
READ_MIX = {"assoc_range": 40.9, "obj_get": 28.9, "assoc_get": 15.7, "assoc_count": 11.7, "assoc_time_range": 2.8}
WRITE_SHARE = 0.2
WRITE_MIX = {"assoc_add": 76.0, "obj_add": 24.0}
PRIMITIVE_MIX = {q: 20.0 for q in ("neighbors", "neighbors_atype", "neighbors_attr", "nodes", "edge_attrs")}


def mix_with_updates() -> dict[str, float]:
    reads = {q: p * (100 - WRITE_SHARE) / 100 for q, p in READ_MIX.items()}
    return reads | {q: p * WRITE_SHARE / 100 for q, p in WRITE_MIX.items()}


def choose(mix: dict[str, float], u: Column) -> Column:
    """An operation by cumulative percentages, which must add up to 100."""
    if abs(sum(mix.values()) - 100) > 1e-6:
        raise ValueError(f"percentages add up to {sum(mix.values())}")
    out, upto = None, 0.0
    for op, share in mix.items():
        upto += share
        out = F.when(u * 100 < upto, F.lit(op)) if out is None else out.when(u * 100 < upto, F.lit(op))
    return out.otherwise(F.lit(op))


def operations(spark: SparkSession, n: int, mix: dict[str, float], seed: int = 41) -> DataFrame:
    """req_id, op."""
    return spark.range(n).select(F.col("id").alias("req_id"), choose(mix, uniform(F.col("id"), seed)).alias("op"))


def blended_id(u_blend: Column, correlated: Column, uncorrelated: Column, share: float) -> Column:
    """An id that follows the link counts with probability ``share``, and its own distribution otherwise."""
    return F.when(u_blend < share, correlated).otherwise(uncorrelated)


def _drawn(df: DataFrame, n: int, key: Column, seed: int) -> DataFrame:
    """n rows in the order of seeded draws, numbered by req_id."""
    taken = df.withColumn("__u", uniform(key, seed)).orderBy("__u").limit(n)
    return taken.withColumn("req_id", F.floor(F.col("__u") * (1 << 52)).cast("long")).drop("__u")


def list_requests(edges: DataFrame, n: int, seed: int = 43, max_degree: int | None = None) -> DataFrame:
    """req_id, src, atype of lists that aren't empty, and have at most ``max_degree`` edges."""
    lists = edges.groupBy("src", "atype").agg(F.count("*").alias("n"))
    if max_degree is not None:
        lists = lists.where(F.col("n") <= max_degree)
    return _drawn(lists.select("src", "atype"), n, key_of("src", "atype"), seed)


def range_requests(edges: DataFrame, n: int, off: int = 0, length: int = 1000, seed: int = 43, max_degree: int | None = None) -> DataFrame:
    return list_requests(edges, n, seed, max_degree).select("req_id", "src", "atype", F.lit(off).alias("off"), F.lit(length).alias("len"))


def time_requests(edges: DataFrame, n: int, limit: int = 1000, seed: int = 47) -> DataFrame:
    """Ranges between two times of the edges' whole span; one scan finds the span."""
    span = edges.agg(F.min("time").alias("a"), F.max("time").alias("b"))
    lists = list_requests(edges, n, seed).join(F.broadcast(span))
    u, v = (uniform(F.col("req_id"), seed + k) for k in (1, 2))
    at = lambda x: (F.col("a") + F.floor(x * (F.col("b") - F.col("a")))).cast("long")
    return lists.select("req_id", "src", "atype", at(F.least(u, v)).alias("t_low"), at(F.greatest(u, v)).alias("t_high"), F.lit(limit).alias("limit"))


def get_requests(edges: DataFrame, n: int, seed: int = 53) -> DataFrame:
    """One edge that exists for each request, whatever its time, so that none is empty."""
    some = _drawn(edges.select("src", "atype", "dst").distinct(), n, key_of("src", "atype", "dst"), seed)
    return some.select("req_id", "src", "atype", F.array("dst").alias("dst_set"), F.lit(-(1 << 62)).alias("t_low"), F.lit(1 << 62).alias("t_high"))


def node_requests(attrs: DataFrame, n: int, seed: int = 59) -> DataFrame:
    """attr_idx, key pairs that at least one node has."""
    return _drawn(attrs.where("attr <> ''").select("attr_idx", F.col("attr").alias("key")).distinct(), n, key_of("attr_idx", "key"), seed)


def neighbor_node_requests(edges: DataFrame, attrs: DataFrame, n: int, seed: int = 61) -> DataFrame:
    """src, attr_idx, key where some neighbour of src has the attribute."""
    some = _drawn(edges.select("src", "dst").distinct(), n, key_of("src", "dst"), seed)
    joined = some.join(attrs.where("attr <> ''"), some.dst == attrs.node_id)
    return joined.groupBy("req_id", "src").agg(F.min(F.struct("attr_idx", "attr")).alias("a")).select("req_id", "src", "a.attr_idx", F.col("a.attr").alias("key"))


def update_coverage(lists: DataFrame, updated: DataFrame) -> DataFrame:
    """n lists, n touched by updates (src, atype), and the share."""
    hit = updated.select("src", "atype").distinct().withColumn("hit", F.lit(1))
    joined = lists.select("src", "atype").distinct().join(hit, ["src", "atype"], "left")
    return joined.agg(F.count("*").alias("n"), F.count("hit").alias("touched")).withColumn("share", F.col("touched") / F.col("n"))


def updates_by_shard(edges: DataFrame, shards: int) -> DataFrame:
    """shard and the number of distinct lists that its edges belong to."""
    return edges.select(F.pmod("src", F.lit(shards)).alias("shard"), "src", "atype").distinct().groupBy("shard").agg(F.count("*").alias("lists"))
