"""Connected components of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component: the smallest node that can be reached, for every node of an edge.

    ``edges`` has two columns of one orderable type; loops and repeats do no
    harm, rows with a null are left out. Large-star and small-star rounds
    alternate until the edges stay the same, in a number of rounds that grows
    with the logarithm of the size and not with a path's length. A hub's edges
    meet only in joins, which Spark can split, and in partial aggregates. Every
    round ends in a written table, so lineage stays short and lost executors
    cost one round at most.
    """
    a, b = edges.columns[:2]
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = materialize(pairs.where("u = v").select("u", "v").distinct(), "component-loops")
    state, seen = materialize(_small_star(pairs.where("u <> v")), "components"), None
    for _ in range(max_rounds):
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 31) - 1)))).first()
        if mark == seen:
            break
        seen = mark
        state = materialize(_small_star(_large_star(state)), "components")
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    found = state.union(state.select(F.col("v").alias("u"), "v")).union(nodes)
    return found.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
