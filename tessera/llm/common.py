"""What several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, as doc_id and text; other columns, whatever their names, are left behind."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


ARROW_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's 10,000 rows, for rows that hold texts; a setting of the caller's own stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(ARROW_ROWS))


def slices(batch: pa.RecordBatch, chars: int, text: str = "text") -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of about ``chars`` bytes of text, so that a worker's memory follows neither batch nor row count."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    first = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > chars:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield batch.slice(first)


def text_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """With the id a key for a row: rows with the same id and text share it and are treated alike."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def columns(df: DataFrame) -> list[Column]:
    """All columns of a table, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def boxed(df: DataFrame, *more: Column) -> DataFrame:
    """The caller's row in one column, ``row``, so that no name of it can clash with those beside it; ``row.*`` gives it back."""
    return df.select(F.struct(*columns(df)).alias("row"), *more)


BITMAP_BITS = 1 << 26
_ROW_BITS = 1 << 12


def bitmap_of(keys: DataFrame, key: str) -> DataFrame:
    """A bitmap of hashed keys as 64 longs a row: BITMAP_BITS bits at most, so 8 MB, however many keys there are."""
    at = F.pmod(F.col(key), F.lit(BITMAP_BITS))
    words = keys.select((at / _ROW_BITS).cast("int").alias("bucket"), (at % _ROW_BITS / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("bits"))
    words = words.groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))
    found = words.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    return materialize(found.select("bucket", F.transform(F.sequence(F.lit(0), F.lit(_ROW_BITS // 64 - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))).alias("words")), "bitmap")


def in_bitmap(df: DataFrame, bitmap: DataFrame, key: str, others: bool = False) -> DataFrame:
    """The rows whose key may be in the bitmap (``others``: those whose key surely isn't); what follows must still join exactly."""
    at = F.pmod(F.col(key), F.lit(BITMAP_BITS))
    b = bitmap.select(F.col("bucket").alias("__bitmap_bucket"), F.col("words").alias("__bitmap_words"))
    joined = df.join(F.broadcast(b), (at / _ROW_BITS).cast("int") == F.col("__bitmap_bucket"), "left")
    may = F.coalesce(F.getbit(F.get("__bitmap_words", (at % _ROW_BITS / 64).cast("int")), (at % 64).cast("int")) == 1, F.lit(False))
    return joined.where(~may if others else may).drop("__bitmap_bucket", "__bitmap_words")


def may_be_in(df: DataFrame, bitmap: DataFrame, key: Column, *more: Column) -> DataFrame:
    """``row`` (the caller's row), ``may``: whether its hashed key may be in the bitmap; and ``more`` columns."""
    boxes = boxed(df, F.pmod(key, F.lit(BITMAP_BITS)).alias("at"), *more).alias("l")
    joined = boxes.join(F.broadcast(bitmap.alias("b")), (F.col("l.at") / _ROW_BITS).cast("int") == F.col("b.bucket"), "left")
    bit = F.getbit(F.get("b.words", (F.col("l.at") % _ROW_BITS / 64).cast("int")), (F.col("l.at") % 64).cast("int"))
    return joined.select("l.*", F.coalesce(bit == 1, F.lit(False)).alias("may")).drop("at")


HOT_ROWS = 4  # rows of one key for each shuffle partition


def join_hot(many: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """Inner join by a key that any share of ``many`` may hold.

    Keys with more than ``HOT_ROWS`` rows of ``many`` a shuffle partition are
    dealt over that many salts, and their rows of ``few`` are repeated for each:
    a fourth as many at most as those of ``many``, for each of the key's own
    in ``few``. A bitmap of 8 MB says on both sides which keys these are; a key
    that it names wrongly is only dealt needlessly.
    """
    salts = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = F.xxhash64(F.col(key))
    hot = many.groupBy(key).count().where(F.col("count") > HOT_ROWS * salts).select(hashed.alias("k"))
    bitmap = bitmap_of(hot, "k")
    salt = F.when(F.col("may"), F.pmod(F.xxhash64("row"), F.lit(salts))).otherwise(F.lit(0).cast("long"))
    left = may_be_in(many, bitmap, hashed, F.col(key).alias("key")).select("row", "key", salt.alias("salt")).alias("l")
    every = F.when(F.col("may"), F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    right = may_be_in(few, bitmap, hashed, F.col(key).alias("key")).select("row", "key", F.explode(every).alias("salt")).alias("r")
    others = [F.col("r.row")[c].alias(c) for c in few.columns if c != key]
    return left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.salt") == F.col("r.salt"))).select("l.row.*", *others)
