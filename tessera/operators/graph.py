"""The merged view of an immutable base, tombstones and a mutation log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.assoc import EDGE


@dataclass
class PropertyGraph:
    """Edges and node attributes with their deltas. Every read goes through the live views."""

    edges: DataFrame
    attrs: DataFrame | None = None
    edge_delta: DataFrame | None = None
    tombstones: DataFrame | None = None
    node_delta: DataFrame | None = None

    def base_edges(self) -> DataFrame:
        """The base without deleted edges; a tombstone removes all base edges with its src, atype and dst."""
        if self.tombstones is None:
            return self.edges.select(*EDGE)
        return self.edges.join(self.tombstones.select("src", "atype", "dst").distinct(), ["src", "atype", "dst"], "left_anti").select(*EDGE)

    def live_edges(self) -> DataFrame:
        base = self.base_edges()
        return base if self.edge_delta is None else base.unionByName(self.edge_delta.select(*EDGE))

    def live_attrs(self) -> DataFrame:
        return self.attrs if self.node_delta is None else self.attrs.unionByName(self.node_delta)

    def add_edges(self, more: DataFrame) -> PropertyGraph:
        return PropertyGraph(self.edges, self.attrs, more if self.edge_delta is None else self.edge_delta.unionByName(more), self.tombstones, self.node_delta)

    def delete_edges(self, keys: DataFrame) -> PropertyGraph:
        """Without the edges that exist now under the keys (src, atype, dst), logged ones included."""
        keys = keys.select("src", "atype", "dst")
        left = None if self.edge_delta is None else self.edge_delta.join(keys.distinct(), ["src", "atype", "dst"], "left_anti")
        return PropertyGraph(self.edges, self.attrs, left, keys if self.tombstones is None else self.tombstones.select("src", "atype", "dst").union(keys), self.node_delta)

    def add_nodes(self, arrays: DataFrame, next_id: int) -> PropertyGraph:
        """Nodes from rows (order, attrs); ids follow from ``next_id`` in that order, numbered by range and not in one task."""
        numbered = number_rows(arrays, "order", next_id)
        more = numbered.select(F.col("id").alias("node_id"), F.posexplode("attrs").alias("attr_idx", "attr"))
        return PropertyGraph(self.edges, self.attrs, self.edge_delta, self.tombstones, more if self.node_delta is None else self.node_delta.unionByName(more))

    def compact(self, path: str, buckets: int | None = None) -> PropertyGraph:
        """The live edges rewritten, dealt by source and sorted as lists are read, as the new base."""
        live = self.live_edges()
        dealt = live.repartition(buckets, "src") if buckets else live.repartition("src")
        dealt.sortWithinPartitions("src", "atype", F.desc("time"), "dst", "attr").write.mode("overwrite").parquet(path)
        return PropertyGraph(live.sparkSession.read.schema(live.schema).parquet(path), self.live_attrs() if self.attrs is not None else None)


def range_bucket(df: DataFrame, by: str) -> Column:
    """The number of a row's range of ``by``: as many ranges of about equal size as there are shuffle partitions.

    Bounds are approximate quantiles, which only numbers have; other types make one range.
    """
    if df.schema[by].dataType.typeName() not in ("byte", "short", "integer", "long", "float", "double"):
        return F.lit(0)
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted(set(df.stat.approxQuantile(by, [i / n for i in range(1, n)], 0.25 / n)))
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(by))) if bounds else F.lit(0)


def number_rows(df: DataFrame, by: str, start: int = 0, out: str = "id") -> DataFrame:
    """Consecutive numbers from ``start`` in the order of ``by``: ranges are numbered apart and offset by the rows before them."""
    dealt = df.withColumn("__r", range_bucket(df, by))
    counts = dealt.groupBy("__r").agg(F.count("*").alias("__n"))
    before = counts.select("__r", F.coalesce(F.sum("__n").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__r").orderBy(by))
    return dealt.join(F.broadcast(before), "__r").withColumn(out, rank.cast("long") + F.col("__before") + F.lit(start - 1)).drop("__r", "__before")


def edge_set_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """The edges that one bag has more often than the other, with the side that has them."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).union(right.exceptAll(left).withColumn("side", F.lit("right")))
