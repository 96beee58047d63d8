"""Mutation logs as streams: appends, deletes and last-writer-wins state.

Every micro-batch is written under its number, so a batch that runs again
replaces itself; what a reader sees is each batch once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.generators import uniform
from tessera.session import scratch_path


def _run(stream: DataFrame, handle, checkpoint: str) -> None:
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def append_log(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Everything the stream has now, appended to a delta table at ``path``; run again, it goes on where it stopped."""

    def handle(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    _run(stream, handle, checkpoint)
    return stream.sparkSession.read.schema(stream.schema).parquet(path).select(*stream.columns)


def last_writer(stream: DataFrame, keys: list[str], seq: str, path: str, checkpoint: str) -> DataFrame:
    """The newest row of each key by ``seq``. Late rows are harmless: order is by seq, not arrival.

    Each batch keeps its own newest rows; reading takes the newest over all batches.
    """
    rest = [c for c in stream.columns if c not in keys]

    def newest(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys).agg(F.max(F.struct(seq, *(c for c in rest if c != seq))).alias("__r")).select(*keys, *(F.col(f"__r.{c}").alias(c) for c in rest))

    def handle(batch: DataFrame, epoch: int) -> None:
        newest(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    _run(stream, handle, checkpoint)
    kept = stream.sparkSession.read.schema(stream.schema).parquet(path).select(*stream.columns)
    return newest(kept)


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    pattern = f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet"  # a pattern, since a stream reads folders or patterns and not single files
    return spark.readStream.schema(schema).parquet(pattern)


def fresh(spark: SparkSession, name: str) -> tuple[str, str]:
    """Paths for a log and its checkpoint."""
    return scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")


def arrival_times(spark: SparkSession, n: int, rate: float, seed: int = 11, chunks: int = 32) -> DataFrame:
    """i and at (seconds): Poisson arrivals; gaps are summed within ranges of i and then over ranges."""
    gaps = spark.range(n).select(F.col("id").alias("i"), (-F.log(1 - uniform(F.col("id"), seed)) / rate).alias("gap"), F.floor(F.col("id") * chunks / max(n, 1)).alias("c"))
    before = gaps.groupBy("c").agg(F.sum("gap").alias("s")).select("c", F.coalesce(F.sum("s").over(Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("b"))
    own = F.sum("gap").over(Window.partitionBy("c").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return gaps.join(F.broadcast(before), "c").select("i", (own + F.col("b")).alias("at"))
