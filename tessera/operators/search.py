"""Substring search and extraction over texts and key-value tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_search(df: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """key and off for each place, overlapping ones too, where the query starts; offsets count characters from 0."""
    n = F.length(F.lit(query))
    last = F.length(text) - n
    hits = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substring(F.col(text), i + 1, n) == F.lit(query))
    found = df.where(F.contains(F.col(text), F.lit(query)))
    return found.select(key, F.explode(hits).alias("off")).select(key, F.col("off").cast("long").alias("off"))


def kv_search(df: DataFrame, key: str, value: str, query: str) -> DataFrame:
    """Keys whose value contains the query."""
    return df.where(F.contains(F.col(value), F.lit(query))).select(key).distinct()


def kv_get(df: DataFrame, requests: DataFrame, key: str, value: str) -> DataFrame:
    """key and value of each request; empty if the key is absent."""
    return requests.select(key).join(df.select(key, value), key, "left").select(key, F.coalesce(value, F.lit("")).alias(value))


def extract(text: Column, off: int, length: int) -> Column:
    return F.substring(text, off + 1, length)


def extract_until(text: Column, off: int, delimiter: str) -> Column:
    """From off to before the next delimiter, or the end."""
    return F.substring_index(F.substring(text, F.lit(off + 1), F.length(text)), delimiter, 1)


def skip_until(text: Column, off: int, delimiter: str) -> Column:
    """The offset after the next delimiter, or the end."""
    at = F.locate(delimiter, text, off + 1)
    return F.when(at > 0, at - 1 + len(delimiter)).otherwise(F.length(text)).cast("long")


def ngram_index(df: DataFrame, key: str, text: str, n: int = 3) -> DataFrame:
    """key, gram, off of every n-gram; texts shorter than n have none."""
    grams = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(F.col(text), i, F.lit(n)))
    return df.where(F.length(text) >= n).select(key, F.posexplode(grams).alias("off", "gram")).select(key, "gram", F.col("off").cast("long").alias("off"))


def indexed_search(index: DataFrame, key: str, query: str, n: int = 3) -> DataFrame:
    """Keys that hold the query, from the index alone: all of its n-grams at the right distances."""
    wanted = [(i, query[i : i + n]) for i in range(len(query) - n + 1)]
    hits = index.where(F.col("gram").isin([g for _, g in wanted])).withColumn("shift", F.explode(F.array(*(F.when(F.col("gram") == g, F.lit(i)) for i, g in wanted)))).where("shift is not null")
    return hits.groupBy(key, (F.col("off") - F.col("shift")).alias("start")).agg(F.count_distinct("shift").alias("n")).where(F.col("n") == len(wanted)).select(key).distinct()
