"""Graph algorithms over edges (i, j, cost) as joins to a fixpoint.

Every round is written to the shared folder, so lineage stays short and a lost
executor costs one round. Frontiers and distances stay distributed.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import connected_components
from tessera.session import materialize, scratch_path


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, once; the cheapest of repeated ones."""
    both = edges.select("i", "j", "cost").union(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "cost"))
    return both.groupBy("i", "j").agg(F.min("cost").alias("cost"))


def bfs(edges: DataFrame, start: int, max_rounds: int | None = None) -> DataFrame:
    """node, dist, pred of the nodes that can be reached; pred is the smallest id among the possible ones, the start's is itself.

    Runs until no node is new; with ``max_rounds`` it raises where that isn't enough.
    """
    spark = edges.sparkSession
    steps = materialize(edges.select(F.col("i").alias("node"), "j").repartition("node"), "bfs-edges")
    frontier = spark.createDataFrame([(start, 0, start)], "node long, dist int, pred long")
    path = scratch_path(spark, "bfs-seen")
    for dist in count(1):
        frontier.write.mode("append").parquet(path)
        seen = spark.read.schema(frontier.schema).parquet(path)
        reached = frontier.select("node").join(steps, "node").groupBy("j").agg(F.min("node").alias("pred"))
        frontier = materialize(reached.join(seen.select(F.col("node").alias("j")), "j", "left_anti").select(F.col("j").alias("node"), F.lit(dist).alias("dist"), "pred"), "bfs")
        if frontier.isEmpty():
            return seen
        _go_on(dist, max_rounds)


def _go_on(rounds: int, limit: int | None) -> None:
    if limit is not None and rounds >= limit:
        raise RuntimeError(f"not finished after {limit} rounds")


def shortest_paths(edges: DataFrame, start: int, combine: Callable[[Column, Column], Column] = lambda d, c: d + c, zero: float = 0.0, max_rounds: int | None = None) -> DataFrame:
    """node, dist, pred under non-negative costs; a negative one raises. ``combine`` extends a path by an edge: a sum, or F.greatest for minimax paths.

    Only nodes whose distance fell take part in the next round, until none does;
    with ``max_rounds`` it raises where that isn't enough.
    """
    spark = edges.sparkSession
    steps = materialize(edges.select("i", "j", "cost").repartition("i"), "paths-edges")
    if not steps.where("cost < 0").isEmpty():
        raise ValueError("a cost is negative")
    best = changed = spark.createDataFrame([(start, zero, start)], "node long, dist double, pred long")
    for done in count(1):
        offers = changed.join(steps, changed.node == steps.i).select(F.col("j").alias("node"), combine(F.col("dist"), F.col("cost")).cast("double").alias("dist"), F.col("i").alias("pred"))
        offers = offers.groupBy("node").agg(F.min(F.struct("dist", "pred")).alias("o"))
        b = best.select("node", F.col("dist").alias("old"))
        better = offers.join(b, "node", "left").where(F.col("old").isNull() | (F.col("o.dist") < F.col("old"))).select("node", "o.dist", "o.pred")
        changed = materialize(better, "paths")
        if changed.isEmpty():
            return best
        _go_on(done, max_rounds)
        best = materialize(best.join(changed.select("node"), "node", "left_anti").unionByName(changed), "paths-best")


def trace_path(paths: DataFrame, start: int, end: int) -> DataFrame:
    """step, node from start to end; empty if end can't be reached.

    By doubling: each round knows every node's 2 ** k-th predecessor and adds as
    many nodes to the path as it has, so a path of n nodes takes log2(n) rounds.
    Predecessors that lead in a circle raise.
    """
    jump = materialize(paths.select("node", F.col("pred").alias("up")), "trace-jumps")
    found = materialize(jump.where(F.col("node") == end).select("node", F.lit(0).cast("long").alias("back")), "trace")
    nodes = jump.count()
    for k in count():
        if found.isEmpty() or not found.where(F.col("node") == start).isEmpty():
            break
        if 1 << k > 2 * nodes:
            raise RuntimeError("the predecessors don't lead to the start")
        found = materialize(found.unionByName(found.join(jump, "node").select(F.col("up").alias("node"), (F.col("back") + F.lit(1 << k)).alias("back"))), "trace")
        ahead = jump.select(F.col("node").alias("up"), F.col("up").alias("next"))
        jump = materialize(jump.join(ahead, "up").select("node", F.col("next").alias("up")), "trace-jumps")
    last = found.where(F.col("node") == start).agg(F.min("back").alias("last"))
    return found.join(F.broadcast(last), F.col("back") <= F.col("last")).select((F.col("last") - F.col("back")).alias("step"), "node").distinct()


def induced_subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends among the nodes (node)."""
    ids = nodes.select("node").distinct()
    return edges.join(ids.withColumnRenamed("node", "i"), "i", "left_semi").join(ids.withColumnRenamed("node", "j"), "j", "left_semi").select(*edges.columns)


def components(edges: DataFrame) -> DataFrame:
    return connected_components(edges.select("i", "j"))


def largest_component(edges: DataFrame) -> DataFrame:
    """node of the largest component; of equal ones that with the smallest id."""
    found = materialize(components(edges), "largest")
    sizes = found.groupBy("component").agg(F.count("*").alias("n"))
    best = sizes.agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("component"))
    return found.join(best, "component", "left_semi").select("node")


def largest_connected_subgraph(edges: DataFrame) -> DataFrame:
    return induced_subgraph(edges, largest_component(edges))


def find_label(nodes: DataFrame, label: Column | str) -> DataFrame:
    return nodes.where(F.col("label") == label).select("node")


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """A simple graph's edges with more of them; an edge that is there takes the new cost."""
    return edges.join(more.select("i", "j"), ["i", "j"], "left_anti").select("i", "j", "cost").unionByName(more.select("i", "j", "cost"))


def remove_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Without the nodes and all their edges."""
    ids = nodes.select("node").distinct()
    return edges.join(ids.withColumnRenamed("node", "i"), "i", "left_anti").join(ids.withColumnRenamed("node", "j"), "j", "left_anti").select(*edges.columns)


def map_graph(nodes: DataFrame, edges: DataFrame, node_label: Callable[[Column], Column], edge_cost: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, label) and edges (i, j, cost) with both functions applied."""
    return map_labels(nodes, "label", node_label), map_labels(edges, "cost", edge_cost)


def map_labels(df: DataFrame, column: str, mapper: Callable[[Column], Column]) -> DataFrame:
    return df.withColumn(column, mapper(F.col(column)))
