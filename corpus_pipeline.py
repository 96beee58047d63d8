"""A corpus from raw documents to packed sequences, in stages that call the operators of tessera.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. Null and empty texts, repeated rows and empty
tables are treated as the stage's operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language, lines, packing, pii, simhash
from tessera.llm.common import boxed, columns
from tessera.session import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null texts, texts without a letter and narrow margins go."""
    model = language.learn(docs.where(~language.held_out()))
    judged = language.identify(docs.select(F.struct(*columns(docs)).alias("row"), "text"), model, ["row"])
    return judged.where(~F.col("rejected")).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line repeats or nearly repeats; those of which nothing is left go.

    A document that had no line with a word before stays as it is.
    """
    cleaned = lines.dedup_lines(docs)
    text = F.col("row.text")
    left = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")) != ""
    touched = F.col("repeated") + F.col("near") > 0
    row = F.when(touched, F.col("row").withField("n_chars", F.length(text).cast("long"))).otherwise(F.col("row"))
    return cleaned.where(left | ~touched).select(row.alias("row")).select("row.*")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group similar to 0.8 or more in five-word shingles.

    Rows that repeat an id and a text count as copies too: one stays. Documents
    without a word are no copies of each other, but of those that share an id
    one stays.
    """
    groups = simhash.near_groups(docs)
    # A document shares its id with its group's: the text of the smallest hash stays where several rows do.
    keep = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(F.min("h").alias("h")).alias("k")
    keyed = boxed(docs, F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")).alias("d")
    joined = keyed.join(keep, F.col("d.id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.t") == F.col("k.h")), "left_semi")
    return joined.dropDuplicates(["id", "t"]).select("row.*")


def pii_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and secrets replaced by their kind in brackets."""
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*columns(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of at most 2048 tokens."""
    return packing.pack_digests(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("pii_masking", pii_masking),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; what one returns is written as Parquet and read again as the next one's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Compression, sampled dictionaries and fingerprints have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None
