"""Seeded generators of nodes, links, graphs and payloads.

Draws are MD5 digests of a seed and a row's key, so they are the same wherever a
row is computed, and any SQL engine with MD5 can give them too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.distributions import LINK_COUNTS, Distribution


def key_of(*parts: str | Column) -> Column:
    """One string of several columns."""
    return F.concat_ws(":", *((F.col(p) if isinstance(p, str) else p).cast("string") for p in parts))


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from a key: the first 52 bits of a digest of seed and key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / float(1 << 52)


def id2_of(id1: Column, k: Column, n: int, seed: int = 3) -> Column:
    """The k-th target of id1 among 1 .. n, spread over the range without repeats while k < n."""
    return F.pmod(F.floor(uniform(id1, seed) * n).cast("long") + k, F.lit(n)) + 1


def links(spark: SparkSession, n: int, mode: str = "reciprocal", k: int = 10, link_type: int = 1, seed: int = 3) -> DataFrame:
    """id1, id2, link_type, time, version of every id's links, as many as ``mode`` gives it."""
    count = F.least(LINK_COUNTS[mode](F.col("id1"), n, k), F.lit(n))
    each = spark.range(1, n + 1).select(F.col("id").alias("id1")).withColumn("c", count).where("c > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    return each.select("id1", id2_of(F.col("id1"), F.col("k"), n, seed).alias("id2"), F.lit(link_type).cast("long").alias("link_type"), F.col("k").alias("time"), F.lit(0).alias("version"))


def choose_id2(id1: Column, u: Column, n_links: Column, n: int, p_existing: float, seed: int = 3) -> Column:
    """A target for an operation on id1: with probability ``p_existing`` one that the load gave it."""
    existing = id2_of(id1, F.floor(u / p_existing * n_links).cast("long"), n, seed)
    return F.when((u < p_existing) & (n_links > 0), existing).otherwise(F.floor((u - p_existing) / max(1e-12, 1 - p_existing) * n).cast("long") + 1)


def payloads(df: DataFrame, key: str, size: str, seed: int = 5, motif: bytes | None = None, uniqueness: float = 1.0, low: int = 0, high: int = 256) -> DataFrame:
    """``df`` with data: bytes from low to high - 1 drawn by the row's key, uniform, or a motif of which a share is replaced by noise.

    Digests give sixteen bytes each; the share is taken in 256ths.
    """

    def stream(salt: str) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.greatest(F.col(size), F.lit(1)) - 1) / 16))
        return F.array_join(F.transform(blocks, lambda b: F.md5(F.concat_ws(":", F.lit(f"{seed}{salt}"), F.col(key).cast("string"), b.cast("string")))), "")

    def byte(digits: Column, i: Column) -> Column:
        return F.conv(F.substring(digits, (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("int")

    def data(x: Column) -> Column:
        def at(i: Column) -> Column:
            noise = F.floor(byte(x["noise"], i) * (high - low) / 256).cast("int") + low
            if motif is None:
                return noise
            return F.when(byte(x["choice"], i) < uniqueness * 256, noise).otherwise(F.element_at(F.array(*map(F.lit, motif)), (i % len(motif) + 1).cast("int")))

        each = F.transform(F.sequence(F.lit(0), F.col(size).cast("int") - 1), lambda i: F.lpad(F.hex(at(i)), 2, "0"))
        return F.unhex(F.array_join(each, ""))

    streams = F.array(F.struct(stream("n").alias("noise"), (F.lit("") if motif is None else stream("c")).alias("choice")))
    return df.withColumn("data", F.when(F.col(size) > 0, F.get(F.transform(streams, data), 0)).otherwise(F.lit(b"")))


def random_nodes(spark: SparkSession, n: int, attrs: int, width: int, distinct: Distribution, seed: int = 9) -> DataFrame:
    """node_id, attr_idx, attr: values are ranks of a distribution, written in ``width`` characters."""
    each = spark.range(n).select(F.col("id").alias("node_id"), F.explode(F.sequence(F.lit(0), F.lit(attrs - 1))).alias("attr_idx"))
    rank = distinct.quantile(uniform(key_of("node_id", "attr_idx"), seed))
    return each.select("node_id", "attr_idx", F.lpad(rank.cast("string"), width, "0").alias("attr"))


def from_corpus(df: DataFrame, key: Column, corpus: DataFrame, by: str, value: str, seed: int = 10) -> DataFrame:
    """``df`` with value: for each row one of the corpus's values, every row of it as likely as another. ``by`` orders the corpus."""
    from tessera.operators.graph import number_rows

    numbered = number_rows(corpus.select(by, value), by, 0, "corpus_row").select("corpus_row", value)
    n = numbered.count()
    return df.withColumn("corpus_row", F.floor(uniform(key, seed) * n).cast("long")).join(numbered, "corpus_row").drop("corpus_row")


def random_assocs(spark: SparkSession, n: int, nodes: int, atypes: int, t_max: int, seed: int = 13) -> DataFrame:
    i = F.col("id")

    def pick(salt: int, upto: int) -> Column:
        return F.floor(uniform(i, seed + salt) * upto).cast("long")

    return spark.range(n).select(pick(0, nodes).alias("src"), pick(1, atypes).alias("atype"), pick(2, nodes).alias("dst"), pick(3, t_max).alias("time"), F.lit("").alias("attr"))


def assocs_in_lists(lists: DataFrame, share: float, nodes: int, t_max: int, seed: int = 17) -> DataFrame:
    """One new edge for about ``share`` of the existing lists (src, atype)."""
    u = uniform(key_of("src", "atype"), seed)
    return lists.where(u < share).select("src", "atype", F.floor(uniform(key_of("src", "atype"), seed + 1) * nodes).cast("long").alias("dst"), F.floor(uniform(key_of("src", "atype"), seed + 2) * t_max).cast("long").alias("time"), F.lit("").alias("attr"))


def augment_out_degree(edges: DataFrame, nodes: DataFrame, minimum: int, n: int, seed: int = 19) -> DataFrame:
    """src, dst that bring every node's out-degree to ``minimum``, none of them there already."""
    have = edges.groupBy("src").agg(F.count_distinct("dst").alias("d"))
    short = nodes.select(F.col("node").alias("src")).join(have, "src", "left").withColumn("need", F.lit(minimum) - F.coalesce("d", F.lit(0))).where("need > 0")
    offers = short.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2 * minimum)))).select("src", "need", "k", F.pmod(F.floor(uniform(F.col("src"), seed) * n).cast("long") + F.col("k"), F.lit(n)).alias("dst"))
    new = offers.join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    return new.withColumn("rn", F.row_number().over(Window.partitionBy("src").orderBy("k"))).where(F.col("rn") <= F.col("need")).select("src", "dst")


def gnm(spark: SparkSession, n: int, m: int, seed: int = 23) -> DataFrame:
    """i < j: m different edges of all n * (n - 1) / 2, drawn uniformly: the pairs with the smallest draws of a surplus."""
    total = n * (n - 1) // 2
    if m > total:
        raise ValueError("more edges than pairs")
    if m * 3 >= total:  # dense: every pair gets a draw
        pairs = spark.range(total).select(F.col("id").alias("p"))
    else:
        surplus = int(m * 1.5 + 10 * math.sqrt(m) + 10)
        pairs = spark.range(surplus).select(F.floor(uniform(F.col("id"), seed) * total).cast("long").alias("p")).distinct()
    chosen = pairs.orderBy(uniform(F.col("p"), seed + 1), "p").limit(m)
    # Pair p lies in the row i of the upper triangle that starts at i * (2n - i - 1) / 2.
    b = F.lit(2.0 * n - 1)
    i0 = F.floor((b - F.sqrt(b * b - 8.0 * F.col("p"))) / 2).cast("long")
    start = lambda i: F.floor(i * (2 * n - i - 1) / 2).cast("long")
    i1 = F.when(start(i0) > F.col("p"), i0 - 1).when(start(i0 + 1) <= F.col("p"), i0 + 1).otherwise(i0)
    return chosen.select(i1.alias("i"), (F.col("p") - start(i1) + i1 + 1).alias("j"))


def degree_graph(spark: SparkSession, degrees: DataFrame, seed: int = 29) -> DataFrame:
    """i < j: stubs of nodes (node, degree) paired in random order; loops and repeats are dropped, so degrees are upper bounds."""
    from tessera.operators.graph import number_rows

    stubs = degrees.where("degree > 0").select("node", F.explode(F.sequence(F.lit(1), F.col("degree").cast("int"))).alias("k"))
    shuffled = number_rows(stubs.withColumn("u", uniform(key_of("node", "k"), seed)), "u", 0, "p")
    pairs = shuffled.groupBy(F.floor(F.col("p") / 2).alias("e")).agg(F.min("node").alias("i"), F.max("node").alias("j"), F.count("*").alias("n"))
    return pairs.where("n = 2 and i < j").select("i", "j").distinct()


def regular_graph(spark: SparkSession, n: int, d: int, seed: int = 31) -> DataFrame:
    return degree_graph(spark, spark.range(n).select(F.col("id").alias("node"), F.lit(d).alias("degree")), seed)


def geometric_graph(spark: SparkSession, n: int, mean_degree: float, seed: int = 37) -> tuple[DataFrame, DataFrame]:
    """Points (node, x, y) in the unit square, and edges (i < j, cost) up to the radius that gives the mean degree.

    Points meet in the grid cells of the radius' size around them, never all pairs.
    """
    radius = math.sqrt(mean_degree / (math.pi * n))
    points = spark.range(n).select(F.col("id").alias("node"), uniform(F.col("id"), seed).alias("x"), uniform(F.col("id"), seed + 1).alias("y"))
    cell = lambda c: F.floor(F.col(c) / radius)
    home = points.select("node", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    around = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    others = home.withColumn("o", F.explode(around)).select(F.col("node").alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"), (F.col("cx") + F.col("o.a")).alias("cx"), (F.col("cy") + F.col("o.b")).alias("cy"))
    cost = F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))
    edges = home.join(others, ["cx", "cy"]).where(F.col("node") < F.col("j")).select(F.col("node").alias("i"), "j", cost.alias("cost")).where(F.col("cost") <= radius)
    return points, edges
