"""Primitive node and neighbour queries over node attributes (node_id, attr_idx, attr) and edges.

A missing attribute is an empty string, and a search for the empty string finds
the nodes whose slot is empty or absent. Matches are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.assoc import newest_first, of_list


def get_attribute(attrs: DataFrame, requests: DataFrame, attr_idx: int) -> DataFrame:
    """node_id, attr for every requested node_id."""
    found = attrs.where(F.col("attr_idx") == attr_idx).select("node_id", "attr")
    return requests.select("node_id").join(found, "node_id", "left").select("node_id", F.coalesce("attr", F.lit("")).alias("attr"))


def get_neighbors(edges: DataFrame, src: int, atype: int | None = None) -> DataFrame:
    """dst, a bag."""
    return of_list(edges, src, atype).select("dst")


def get_neighbors_ordered(edges: DataFrame, src: int, atype: int) -> DataFrame:
    """pos, dst of one list, newest first."""
    return of_list(edges, src, atype).select((F.row_number().over(newest_first()).cast("long") - 1).alias("pos"), "dst")


def get_edge_attrs(edges: DataFrame, src: int, atype: int) -> DataFrame:
    return of_list(edges, src, atype).select((F.row_number().over(newest_first()).cast("long") - 1).alias("pos"), "attr")


def with_attr(attrs: DataFrame, attr_idx: int, key: str) -> DataFrame:
    """node_id of the nodes whose attribute equals key."""
    if key == "":
        filled = attrs.where((F.col("attr_idx") == attr_idx) & (F.col("attr") != "")).select("node_id")
        return attrs.select("node_id").distinct().join(filled, "node_id", "left_anti")
    return attrs.where((F.col("attr_idx") == attr_idx) & (F.col("attr") == key)).select("node_id").distinct()


def filter_nodes(ids: DataFrame, attrs: DataFrame, attr_idx: int, key: str) -> DataFrame:
    """The rows of ids (node_id, ...) whose node has the attribute; duplicates stay."""
    return ids.join(with_attr(attrs, attr_idx, key), "node_id", "left_semi")


def get_neighbors_attr(edges: DataFrame, attrs: DataFrame, src: int, attr_idx: int, key: str, atype: int | None = None) -> DataFrame:
    """dst of src's edges whose target has the attribute, a bag."""
    return filter_nodes(of_list(edges, src, atype).select(F.col("dst").alias("node_id")), attrs, attr_idx, key).select(F.col("node_id").alias("dst"))


def get_neighbors_attr_batch(edges: DataFrame, attrs: DataFrame, requests: DataFrame, attr_idx: int, key: str, atype: int | None = None) -> DataFrame:
    """src, dst for every requested src: two semi-joins, of which Spark broadcasts what it measures to be small."""
    asked = of_list(edges, None, atype).join(requests.select("src").distinct(), "src", "left_semi")
    return filter_nodes(asked.select("src", F.col("dst").alias("node_id")), attrs, attr_idx, key).select("src", F.col("node_id").alias("dst"))


def get_nodes(attrs: DataFrame, *conditions: tuple[int, str]) -> DataFrame:
    """node_id of the nodes that meet all conditions (attr_idx, key)."""
    out = None
    for attr_idx, key in conditions:
        found = with_attr(attrs, attr_idx, key)
        out = found if out is None else out.intersect(found)
    return out


def get_nodes_union(attrs: DataFrame, *conditions: tuple[int, str]) -> DataFrame:
    out = None
    for attr_idx, key in conditions:
        found = with_attr(attrs, attr_idx, key)
        out = found if out is None else out.union(found)
    return out.distinct()


def obj_get(attrs: DataFrame, requests: DataFrame) -> DataFrame:
    """node_id, attr_idx, attr of the requested nodes; empty attributes after the last filled one are left out, those between stay."""
    asked = attrs.join(requests.select("node_id").distinct(), "node_id", "left_semi")
    last = F.max(F.when(F.col("attr") != "", F.col("attr_idx"))).over(Window.partitionBy("node_id"))
    return asked.withColumn("last", last).where(F.col("attr_idx") <= F.col("last")).select("node_id", "attr_idx", "attr")


def num_nodes(attrs: DataFrame) -> DataFrame:
    return attrs.agg(F.count_distinct("node_id").alias("n"))


def num_edges(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("n"))


def neighbor_pattern_join(edges: DataFrame, attrs: DataFrame, attr_idx: int, key: str) -> DataFrame:
    """src, atype, dst of the pattern n -> m where m has the attribute."""
    found = attrs.where((F.col("attr_idx") == attr_idx) & (F.col("attr") == key)).select(F.col("node_id").alias("dst"))
    return edges.join(found, "dst").select("src", "atype", "dst")
