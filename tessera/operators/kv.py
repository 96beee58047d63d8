"""Key-value pairs over a log of inserts and removals; the last writer wins.

Log rows: seq, op (I: insert, R: remove), key, value. A removed key can be
inserted again. ``append`` gives new values the next keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import number_rows

LOG = ["seq", "op", "key", "value"]


def current(log: DataFrame) -> DataFrame:
    """key, value of what the log leaves: one aggregate, so a hot key costs each task one row."""
    last = log.groupBy("key").agg(F.max(F.struct("seq", "op", "value")).alias("r"))
    return last.where("r.op = 'I'").select("key", "r.value")


def insert(log: DataFrame, pairs: DataFrame) -> DataFrame:
    """The log with pairs (seq, key, value)."""
    return log.unionByName(pairs.withColumn("op", F.lit("I")).select(*LOG))


def append(log: DataFrame, values: DataFrame, next_key: int, order: str = "seq") -> DataFrame:
    """The log with values (seq, value), whose keys count from ``next_key`` in the given order."""
    return insert(log, number_rows(values, order, next_key, "key"))


def remove(log: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log without the requested keys (seq, key), and for each request whether its key was there."""
    known = current(log.join(requests.select("key").distinct(), "key", "left_semi")).select("key", F.lit(True).alias("known"))
    answer = requests.select("seq", "key").join(known, "key", "left").select("seq", "key", F.col("known").isNotNull().alias("removed"))
    gone = requests.select("seq", F.lit("R").alias("op"), "key", F.lit(None).cast(log.schema["value"].dataType).alias("value"))
    return log.unionByName(gone), answer
