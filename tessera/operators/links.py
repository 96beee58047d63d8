"""Keyed links and nodes over an operation log; the last writer wins.

Log rows: seq, op (A or U: upsert, H: hide, X: expunge), id1, link_type, id2,
visibility, version, time, data. A hidden link is still found by its key; lists
and counts leave it out. An upsert replaces every field and undoes hiding.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["id1", "link_type", "id2"]
LINK = [*KEY, "visibility", "version", "time", "data"]
DEFAULT_LIMIT = 10_000
HIDDEN, VISIBLE = 0, 1


def _upsert() -> Column:
    return F.col("op").isin("A", "U")


def resolve(log: DataFrame) -> DataFrame:
    """The links that the log leaves, one row a key: one aggregate, so a hot key costs each task one row."""
    payload = F.struct("visibility", "version", "time", "data")
    by_key = log.groupBy(*KEY).agg(
        F.max(F.when(_upsert(), F.struct("seq", payload.alias("p")))).alias("u"),
        F.max(F.when(F.col("op") == "X", F.col("seq"))).alias("x"),
        F.max(F.when(F.col("op") == "H", F.col("seq"))).alias("h"),
    )
    alive = by_key.where(F.col("u").isNotNull() & (F.col("u.seq") > F.coalesce("x", F.lit(-1))))
    visible = F.when(F.col("h") > F.col("u.seq"), F.lit(HIDDEN)).otherwise(F.col("u.p.visibility")).cast("byte")
    return alive.select(*KEY, visible.alias("visibility"), "u.p.version", "u.p.time", "u.p.data")


def operation(requests: DataFrame, op: str) -> DataFrame:
    """Requests as log rows; columns that the operation doesn't set become null."""
    out = requests.withColumn("op", F.lit(op))
    kinds = {"visibility": "byte", "version": "int", "time": "long", "data": "string"}
    return out.withColumns({c: F.lit(VISIBLE if c == "visibility" else None).cast(k) for c, k in kinds.items() if c not in out.columns}).select("seq", "op", *LINK)


def of_keys(log: DataFrame, requests: DataFrame) -> DataFrame:
    """The log's rows of the requested keys: a few keys then cost no resolving of the whole log."""
    return log.join(requests.select(*KEY).distinct(), KEY, "left_semi")


def add_link(log: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log with upserts, and for each request whether its key is new."""
    known = resolve(of_keys(log, requests)).select(*KEY, F.lit(True).alias("found"))
    answer = requests.select("seq", *KEY).join(known, KEY, "left").select("seq", *KEY, F.col("found").isNull().alias("added"))
    return log.unionByName(operation(requests, "A")), answer


def update_link(log: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As add_link; the answer says whether the key was found."""
    out, answer = add_link(log, requests)
    return out, answer.select("seq", *KEY, (~F.col("added")).alias("found"))


def delete_link(log: DataFrame, requests: DataFrame, expunge: bool = False) -> DataFrame:
    return log.unionByName(operation(requests, "X" if expunge else "H"))


def get_link(links: DataFrame, id1: int, link_type: int, id2: int) -> DataFrame:
    return links.where((F.col("id1") == id1) & (F.col("link_type") == link_type) & (F.col("id2") == id2))


def multiget_links(links: DataFrame, requests: DataFrame) -> DataFrame:
    """The links of the requested keys, hidden ones too."""
    return links.join(requests.select(*KEY).distinct(), KEY, "left_semi")


def _newest() -> Column:
    return F.row_number().over(Window.partitionBy("id1", "link_type").orderBy(F.desc("time"), "id2"))


def link_list(links: DataFrame, id1: int | None = None, link_type: int | None = None, low=None, high=None, offset: int = 0, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Visible links in the time range, newest first, after ``offset`` and up to ``limit`` in each list; pos counts from 0."""
    found = links.where(F.col("visibility") == VISIBLE)
    for condition in ((F.col("id1") == id1) if id1 is not None else None, (F.col("link_type") == link_type) if link_type is not None else None, (F.col("time") >= low) if low is not None else None, (F.col("time") <= high) if high is not None else None):
        if condition is not None:
            found = found.where(condition)
    out = found.withColumn("rn", _newest()).where(F.col("rn") <= offset + limit).where(F.col("rn") > offset)
    return out.select(*LINK, (F.col("rn").cast("long") - 1).alias("pos"))


def history_page(links: DataFrame, last: DataFrame, limit: int) -> DataFrame:
    """The next page of each list in ``last`` (id1, link_type, last_time): links up to that time, without the newest of those."""
    found = links.where(F.col("visibility") == VISIBLE).join(last, ["id1", "link_type"]).where(F.col("time") <= F.col("last_time"))
    return found.withColumn("rn", _newest()).where((F.col("rn") > 1) & (F.col("rn") <= 1 + limit)).select(*LINK)


def count_links(links: DataFrame) -> DataFrame:
    return links.groupBy("id1", "link_type").agg(F.count_if(F.col("visibility") == VISIBLE).alias("n"))


def count_table(links: DataFrame) -> DataFrame:
    """id, link_type, count, time, version of the visible links of each list."""
    return links.where(F.col("visibility") == VISIBLE).groupBy(F.col("id1").alias("id"), "link_type").agg(F.count("*").alias("count"), F.max("time").alias("time"), F.max("version").cast("long").alias("version"))


def bulk_load(links: DataFrame, more: DataFrame) -> DataFrame:
    """Links with a batch of new ones; a key in both takes the batch's."""
    keys = more.select(*KEY).distinct()
    return links.join(keys, KEY, "left_anti").select(*LINK).unionByName(more.select(*LINK))


# Nodes: id, type, version, time, data. A call with another type than the node's finds nothing.


def add_nodes(nodes: DataFrame, more: DataFrame, next_id: int, order: str = "order") -> DataFrame:
    """Nodes with new ones, whose ids count from ``next_id`` in the given order."""
    from tessera.operators.graph import number_rows

    return nodes.unionByName(number_rows(more, order, next_id).select(*nodes.columns))


def get_node(nodes: DataFrame, kind: int, ids) -> DataFrame:
    return nodes.where((F.col("type") == kind) & F.col("id").isin(list(ids)))


def update_nodes(nodes: DataFrame, updates: DataFrame) -> DataFrame:
    """Nodes with the payload of the updates that match them by id and type."""
    u = updates.select("id", "type", F.col("version").alias("v2"), F.col("time").alias("t2"), F.col("data").alias("d2"), F.lit(True).alias("hit"))
    joined = nodes.join(u, ["id", "type"], "left")
    return joined.select("id", "type", *(F.when(F.col("hit"), F.col(n)).otherwise(F.col(o)).alias(o) for o, n in (("version", "v2"), ("time", "t2"), ("data", "d2"))))


def delete_nodes(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """Without the nodes of the keys (id, type); their links stay."""
    return nodes.join(keys.select("id", "type").distinct(), ["id", "type"], "left_anti")


@dataclass
class NodeStore:
    """Nodes and the id that the next one gets."""

    nodes: DataFrame
    next_id: int

    def reset(self, start_id: int) -> NodeStore:
        """An empty store whose ids count from ``start_id``."""
        return NodeStore(self.nodes.limit(0), start_id)

    def add(self, more: DataFrame, order: str = "order") -> NodeStore:
        """With new nodes in the given order; their number moves the next id on."""
        return NodeStore(add_nodes(self.nodes, more, self.next_id, order), self.next_id + more.count())


#: How many links a loader is asked to hand over at once.
BULK_LOAD_BATCH = 1024


def add_bulk_counts(counts: DataFrame, more: DataFrame) -> DataFrame:
    """A count table (id, link_type, count, time, version) with a batch of counts; one that is there is replaced."""
    return counts.join(more.select("id", "link_type").distinct(), ["id", "link_type"], "left_anti").select(*counts.columns).unionByName(more.select(*counts.columns))
