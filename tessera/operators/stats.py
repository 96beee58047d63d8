"""Latency and distribution statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.generators import key_of, uniform
from tessera.operators.graph import range_bucket

#: Bucket edges in microseconds: 100 us steps below 1 ms, 1 ms steps below 100 ms, 100 ms steps below 1 s, 1 s steps below 10 s, then one bucket.
STEPS = [(0, 1_000, 100), (1_000, 100_000, 1_000), (100_000, 1_000_000, 100_000), (1_000_000, 10_000_000, 1_000_000)]


def _bases() -> list[tuple[int, int, int, int]]:
    out, base = [], 0
    for low, high, step in STEPS:
        out.append((low, high, step, base))
        base += (high - low) // step
    return out


N_BUCKETS = sum((h - l) // s for l, h, s in STEPS) + 1


def latency_bucket(us: Column) -> Column:
    out = None
    for low, high, step, base in _bases():
        value = F.floor((us - low) / step) + base
        out = F.when(us < high, value) if out is None else out.when(us < high, value)
    return out.otherwise(F.lit(N_BUCKETS - 1)).cast("long")


def bucket_bounds(bucket: Column) -> tuple[Column, Column]:
    """The bucket's lower bound and its upper bound, excluded; the last has none (null)."""
    low = high = None
    for a, b, step, base in _bases():
        n, start = (b - a) // step, (bucket - base) * step + a
        low = F.when(bucket < base + n, start) if low is None else low.when(bucket < base + n, start)
        high = F.when(bucket < base + n, start + step) if high is None else high.when(bucket < base + n, start + step)
    return low.otherwise(F.lit(STEPS[-1][1])).cast("long"), high.cast("long")


def latency_summary(samples: DataFrame) -> DataFrame:
    """op, n, min, max, mean, p50, p95, p99 of the samples without error."""
    # Spark's percentile aggregates counts of distinct values; latencies in whole microseconds have a bounded number of those.
    ok = samples.where(~F.col("error"))
    p = [F.percentile("latency_us", q / 100).alias(f"p{q}") for q in (50, 95, 99)]
    return ok.groupBy("op").agg(F.count("*").alias("n"), F.min("latency_us").alias("min_us"), F.max("latency_us").alias("max_us"), F.avg("latency_us").alias("mean_us"), *p)


def latency_histogram(samples: DataFrame) -> DataFrame:
    """op, bucket, n, cumulative. At most N_BUCKETS rows an op meet in the window."""
    counts = samples.where(~F.col("error")).groupBy("op", latency_bucket(F.col("latency_us")).alias("bucket")).agg(F.count("*").alias("n"))
    return counts.withColumn("cumulative", F.sum("n").over(Window.partitionBy("op").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))


def latency_percentile_bucket(samples: DataFrame, percent: float) -> DataFrame:
    """op and the first bucket that at least ``percent`` of the samples don't exceed, with its bounds."""
    total = F.sum("n").over(Window.partitionBy("op"))
    found = latency_histogram(samples).withColumn("total", total).where(F.col("cumulative") * 100 >= F.col("total") * percent).groupBy("op").agg(F.min("bucket").alias("bucket"))
    low, high = bucket_bounds(F.col("bucket"))
    return found.select("op", "bucket", low.alias("low_us"), high.alias("high_us"))


def latency_mean(samples: DataFrame) -> DataFrame:
    """Means by thread merged by their counts."""
    by_thread = samples.groupBy("op", "thread").agg(F.count("latency_us").alias("n"), F.avg("latency_us").alias("mean"))
    return by_thread.groupBy("op").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean_us"))


def throughput(samples: DataFrame) -> DataFrame:
    """op, n, seconds from first to last, per_second."""
    agg = samples.groupBy("op").agg(F.count("*").alias("n"), ((F.max("ts") - F.min("ts")) / 1e6).alias("seconds"))
    return agg.withColumn("per_second", F.when(F.col("seconds") > 0, F.col("n") / F.col("seconds")))


def reservoir_sample(samples: DataFrame, size: int, seed: int = 7, by: str = "op") -> DataFrame:
    """At most ``size`` rows of each group, drawn uniformly; Spark keeps only so many a group before the shuffle.

    A row's draw comes from its values, so it is the same in every run; rows that repeat each other are drawn together.
    """
    draw = uniform(key_of(*samples.columns), seed)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(draw))
    return samples.withColumn("sample_rank", rank).where(F.col("sample_rank") <= size).drop("sample_rank")


def phase_filter(samples: DataFrame, warm_up_us: int, measure_us: int) -> DataFrame:
    """The samples of the measured phase: after the warm-up, before the cool-down."""
    start = samples.agg(F.min("ts").alias("t0"))
    elapsed = F.col("ts") - F.col("t0")
    return samples.join(F.broadcast(start)).where((elapsed >= warm_up_us) & (elapsed < warm_up_us + measure_us)).drop("t0")


def describe(df: DataFrame, column: str) -> DataFrame:
    """n, total, mean, stddev (n - 1), median, low, high, mode and p90, the value at index int(0.9 * (n - 1)).

    Order statistics come from counts of distinct values, summed by ranges, and not from a list of them in one task.
    """
    x = F.col(column)
    plain = df.agg(F.count(x).alias("n"), F.sum(x).alias("total"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("stddev"), F.min(x).alias("low"), F.max(x).alias("high"))
    counts = df.where(x.isNotNull()).groupBy(x.alias("value")).agg(F.count("*").alias("n"))
    upto = cumulative(counts, "value", "n").select("value", F.col("n").alias("times"), "upto")
    at = lambda index: F.min(F.when(F.col("upto") > index, F.col("value")))
    last = F.col("n") - 1
    order = upto.join(F.broadcast(plain.select("n")), F.lit(True)).agg(
        ((at(F.floor(last / 2)) + at(F.ceil(last / 2))) / 2).alias("median"), at(F.floor(F.lit(0.9) * last)).alias("p90"), F.max_by("value", F.struct("times", -F.col("value"))).alias("mode")
    )
    return plain.join(F.broadcast(order), F.lit(True)).select("n", "total", "mean", "stddev", "median", "mode", "p90", "low", "high")


def ranked_percentile(df: DataFrame, column: str, p: float) -> DataFrame:
    """The value at index int(p * (n - 1)) of the sorted values, from counts of distinct values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    upto = cumulative(counts, "value", "n")
    total = counts.agg(F.sum("n").alias("total"))
    return upto.join(F.broadcast(total)).where(F.col("upto") > F.floor(F.lit(p) * (F.col("total") - 1))).agg(F.min("value").alias("value"))


def cumulative(counts: DataFrame, by: str, n: str) -> DataFrame:
    """``counts`` with upto, the sum of n over all values up to a row's: ranges of values are summed apart first."""
    dealt = counts.withColumn("__r", range_bucket(counts, by))
    totals = dealt.groupBy("__r").agg(F.sum(n).alias("__n"))
    before = totals.select("__r", F.coalesce(F.sum("__n").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.sum(n).over(Window.partitionBy("__r").orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.join(F.broadcast(before), "__r").withColumn("upto", own + F.col("__before")).drop("__r", "__before")


def mode(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value; of equally frequent ones the smallest."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.agg(F.max("n").alias("n")).join(counts, "n").groupBy("n").agg(F.min("value").alias("value"))


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.abs(F.corr(a, b)).alias("correlation"))


#: Two-sided 95 % Student-t quantiles by degrees of freedom, and the normal quantile beyond them.
T95 = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228, 15: 2.131, 20: 2.086, 30: 2.042, 60: 2.0, 120: 1.98}
T95_LIMIT = 1.96


def t_quantile(df: Column) -> Column:
    """The tabulated quantile of the largest tabulated degrees of freedom up to ``df``."""
    out = F.when(df > 120, F.lit(T95_LIMIT))
    for k in sorted(T95, reverse=True):
        out = out.when(df >= k, F.lit(T95[k]))
    return out


def confidence_interval(df: DataFrame, column: str, by: str) -> DataFrame:
    """by, n, mean, half_width of the 95 % interval of each group's mean."""
    agg = df.groupBy(by).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"))
    return agg.select(by, "n", "mean", (t_quantile(F.col("n") - 1) * F.col("sd") / F.sqrt("n")).alias("half_width"))


def freq_cdf(df: DataFrame, column: str) -> DataFrame:
    """value, n, cdf of the distinct values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return cumulative(counts, "value", "n").join(F.broadcast(total)).select("value", "n", (F.col("upto") / F.col("total")).alias("cdf"))


def time_weighted_avg(df: DataFrame, key: str, ts: str, value: str, tie: str) -> DataFrame:
    """key and the mean of value weighted by how long it held, until the next ts of the key."""
    nxt = F.lead(ts).over(Window.partitionBy(key).orderBy(ts, tie))
    held = df.select(key, (nxt - F.col(ts)).alias("dt"), F.col(value).alias("v")).where("dt is not null")
    return held.groupBy(key).agg(F.when(F.sum("dt") > 0, F.sum(F.col("v") * F.col("dt")) / F.sum("dt")).alias("average"))
