"""Association lists: the edges of one (src, atype), newest first.

Lists are never materialised. Order inside a list is time descending, then dst
and attr. ``None`` for src, atype, off, length or a bound means any. Offsets,
lengths and limits hold for each list apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIST = ["src", "atype"]
EDGE = ["src", "atype", "dst", "time", "attr"]


def newest_first(*keys: str):
    return Window.partitionBy(*(keys or LIST)).orderBy(F.desc("time"), "dst", "attr")


def of_list(edges: DataFrame, src: int | None = None, atype: int | None = None) -> DataFrame:
    """The lists of a source and type; the predicates reach the scan."""
    for name, value in (("src", src), ("atype", atype)):
        if value is not None:
            edges = edges.where(F.col(name) == value)
    return edges


def between(edges: DataFrame, low: int | None, high: int | None) -> DataFrame:
    """Both bounds are included."""
    if low is not None:
        edges = edges.where(F.col("time") >= low)
    if high is not None:
        edges = edges.where(F.col("time") <= high)
    return edges


def ranked(edges: DataFrame) -> DataFrame:
    """The edges with pos, from 0, in their list."""
    return edges.withColumn("pos", F.row_number().over(newest_first()).cast("long") - 1)


def _slice(edges: DataFrame, off: int | None, length: int | None) -> DataFrame:
    """Positions off .. off + length - 1 of each list. The upper bound alone lets Spark keep only so many rows a list before the sort."""
    off = off or 0
    if not off and length is None:
        return edges.select(*EDGE)
    out = edges.withColumn("rn", F.row_number().over(newest_first()))
    if length is not None:
        out = out.where(F.col("rn") <= off + length)
    return out.where(F.col("rn") > off).select(*EDGE)


def assoc_range(edges: DataFrame, src=None, atype=None, off: int | None = None, length: int | None = None) -> DataFrame:
    return _slice(of_list(edges, src, atype), off, length)


def assoc_get(edges: DataFrame, src=None, atype=None, dst: Sequence[int] | DataFrame = (), low=None, high=None) -> DataFrame:
    """Edges to any of ``dst`` (ids, or a DataFrame of one column) within the bounds; no ids, no rows."""
    found = between(of_list(edges, src, atype), low, high)
    if isinstance(dst, DataFrame):
        return found.join(dst.toDF("dst"), "dst", "left_semi").select(*EDGE)
    return found.where(F.col("dst").isin(list(dst)) if len(dst) else F.lit(False)).select(*EDGE)


def assoc_count(edges: DataFrame, src=None, atype=None) -> DataFrame:
    return of_list(edges, src, atype).agg(F.count("*").alias("n"))


def assoc_time_range(edges: DataFrame, src=None, atype=None, low=None, high=None, limit: int | None = None) -> DataFrame:
    return _slice(between(of_list(edges, src, atype), low, high), 0, limit)


def by_time(edges: DataFrame, src=None, atype=None, low=None, high=None) -> DataFrame:
    """All edges within the bounds in one order, newest first: sorted by ranges, so no task holds them all."""
    return between(of_list(edges, src, atype), low, high).orderBy(F.desc("time"), "src", "atype", "dst", "attr").select(*EDGE)


def assoc_lists(edges: DataFrame, src=None, atype=None) -> DataFrame:
    return of_list(edges, src, atype).select(*LIST).distinct()


# Batches: a DataFrame of requests with req_id answers many calls in one join.


def _requested(edges: DataFrame, requests: DataFrame) -> DataFrame:
    return edges.join(requests, LIST)


def _per_request() -> Column:
    return F.row_number().over(newest_first("req_id"))


def assoc_range_batch(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: req_id, src, atype, off, len. Different slices of one list may be asked for at once."""
    found = _requested(edges, requests).withColumn("rn", _per_request())
    return found.where((F.col("rn") > F.col("off")) & (F.col("rn") <= F.col("off") + F.col("len"))).select("req_id", *EDGE)


def assoc_time_range_batch(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: req_id, src, atype, t_low, t_high, limit."""
    found = _requested(edges, requests).where(F.col("time").between(F.col("t_low"), F.col("t_high")))
    return found.withColumn("rn", _per_request()).where(F.col("rn") <= F.col("limit")).select("req_id", *EDGE)


def assoc_get_batch(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: req_id, src, atype, dst_set, t_low, t_high."""
    wanted = requests.withColumn("dst", F.explode(F.array_distinct("dst_set"))).drop("dst_set")
    return edges.join(wanted, [*LIST, "dst"]).where(F.col("time").between(F.col("t_low"), F.col("t_high"))).select("req_id", *EDGE)


def assoc_count_batch(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """req_id, n; a list without edges counts 0."""
    # Only the requested lists are counted.
    counts = edges.join(requests.select(*LIST).distinct(), LIST, "left_semi").groupBy(*LIST).agg(F.count("*").alias("n"))
    return requests.join(counts, LIST, "left").select("req_id", F.coalesce("n", F.lit(0)).alias("n"))


def list_headers(edges: DataFrame) -> DataFrame:
    """Per list: edge count, newest and oldest time, and the digits that its times and ids take."""

    def digits(column: str) -> Column:
        return F.length(F.max(F.abs(column)).cast("string")).cast("long")

    return edges.groupBy(*LIST).agg(F.count("*").alias("n"), F.max("time").alias("newest"), F.min("time").alias("oldest"), digits("time").alias("time_digits"), digits("dst").alias("dst_digits"))


def build_lists(edges: DataFrame) -> DataFrame:
    """One row a list with its edges as an array, for consumers that need lists nested."""
    item = F.struct((-F.col("time")).alias("t"), "dst", "attr")
    return edges.groupBy(*LIST).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["dst"].alias("dst"), (-x["t"]).alias("time"), x["attr"].alias("attr"))).alias("edges"))
