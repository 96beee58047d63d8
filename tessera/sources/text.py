"""Text readers and writers for edges, nodes, requests and labelled graphs. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOT_BASE = 1  # per-slot delimiters start at this code point


def read_assoc(spark: SparkSession, path: str) -> DataFrame:
    """"src dst atype time attr", where attr is the rest of the line and may be missing."""
    p = F.split("value", " ", 5)
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(*(F.get(p, i).cast("long").alias(n) for i, n in ((0, "src"), (2, "atype"), (1, "dst"), (3, "time"))), F.coalesce(F.get(p, 4), F.lit("")).alias("attr"))


def write_assoc(edges: DataFrame, path: str) -> None:
    edges.select(F.concat_ws(" ", "src", "dst", "atype", "time", "attr").alias("value")).write.mode("overwrite").text(path)


def read_edge_list(spark: SparkSession, path: str, sep: str = " ", comment: str = "#") -> DataFrame:
    return spark.read.csv(path, sep=sep, comment=comment, schema="src long, dst long")


def read_nodes_csv(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """node_id by line within one file, counted from 0, and attrs.

    Blocks of a file are read apart: a line's number is its place in its block
    and the lines of the blocks before it, of which there is one row a block.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n")).select("file", "block", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))
    numbered = lines.withColumn("rank", rank).join(blocks, ["file", "block"])
    return numbered.select((F.col("rank") - 1 + F.col("before")).cast("long").alias("node_id"), F.slice(F.split("value", ","), 1, columns).alias("attrs"))


def write_nodes_csv(nodes: DataFrame, path: str) -> None:
    nodes.select(F.array_join("attrs", ",").alias("value")).write.mode("overwrite").text(path)


def format_slots(attrs, slots: int):
    """Each attribute after its slot's own delimiter, with a last delimiter at the end."""
    values = F.concat(attrs, F.array_repeat(F.lit(""), F.greatest(F.lit(slots) - F.size(attrs), F.lit(0))))
    return F.concat(*(F.concat(F.lit(chr(SLOT_BASE + i)), F.get(values, i)) for i in range(slots)), F.lit(chr(SLOT_BASE + slots)))


def parse_slots(line, slots: int):
    return F.transform(F.sequence(F.lit(1), F.lit(slots)), lambda i: F.get(F.split(line, "[" + "".join(f"\\x{SLOT_BASE + k:02x}" for k in range(slots + 1)) + "]"), i))


def read_kv_pointers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="key long, offset long")


def read_list_set(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """(src, atype) pairs."""
    return spark.read.csv(path, sep=sep, schema="src long, atype long").distinct()


def write_delimited(df: DataFrame, path: str, sep: str = "\x02") -> None:
    """For bulk importers that take one unusual separator."""
    df.write.mode("overwrite").csv(path, sep=sep, header=True)


def read_labelled_edges(spark: SparkSession, path: str) -> DataFrame:
    """"i j cost" lines; others are left out."""
    from tessera.functions.scalar import parse_edge

    return spark.read.text(path).select(*parse_edge(F.col("value"))).where("i is not null and j is not null and cost is not null")


def write_labelled_edges(edges: DataFrame, path: str) -> None:
    edges.select(F.concat_ws(" ", "i", "j", "cost").alias("value")).write.mode("overwrite").text(path)


def to_neato(edges: DataFrame, limit: int = 10_000) -> str:
    """A small graph in Graphviz's language; larger ones are refused."""
    rows = edges.select("i", "j").orderBy("i", "j").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} edges")
    return "graph g {\n" + "".join(f"  {r.i} -- {r.j};\n" for r in rows) + "}\n"


#: Fields of request lines by query.
QUERY_FIELDS = {
    "neighbors": ["node"], "obj_get": ["node"], "neighbors_atype": ["node", "atype"], "edge_attrs": ["node", "atype"], "assoc_count": ["node", "atype"],
    "assoc_range": ["node", "atype", "off", "len"], "assoc_time_range": ["node", "atype", "t_low", "t_high", "limit"], "assoc_get": ["node", "atype", "t_low", "t_high"],
}


def read_requests(spark: SparkSession, path: str, query: str) -> DataFrame:
    """A request file as a DataFrame; "assoc_get" also has dst_set, "neighbors_attr" attr_idx and attr, "nodes" attr and key pairs."""
    from tessera.functions.scalar import parse_query

    lines = spark.read.text(path).where(F.trim("value") != "")
    parts = F.split("value", ",")
    if query == "neighbors_attr":
        p = F.split("value", ",", 3)
        return lines.select(F.get(p, 0).cast("long").alias("node"), F.get(p, 1).cast("int").alias("attr_idx"), F.get(p, 2).alias("attr"))
    if query == "nodes":
        p = F.split("value", "\x02")
        return lines.select(F.get(p, 0).cast("int").alias("attr1"), F.get(p, 1).alias("key1"), F.get(p, 2).cast("int").alias("attr2"), F.get(p, 3).alias("key2"))
    fields = parse_query(F.col("value"), QUERY_FIELDS[query])
    if query == "assoc_get":
        fields.append(F.transform(F.slice(parts, F.lit(5), F.greatest(F.size(parts) - 4, F.lit(0))), lambda x: x.cast("long")).alias("dst_set"))
    return lines.select(*fields)


def read_properties(spark: SparkSession, path: str) -> dict[str, str]:
    """key = value lines; # starts a comment. Later keys win. Configuration files are small."""
    out = {}
    for row in spark.read.text(path).collect():
        line = row.value.split("#", 1)[0].strip()
        if "=" in line:
            key, value = line.split("=", 1)
            out[key.strip()] = value.strip()
    return out


def write_stats_csv(stats: DataFrame, path: str) -> None:
    """A table of statistics as CSV with a header."""
    stats.write.mode("overwrite").csv(path, header=True)


def read_stats_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def write_shards(df: DataFrame, path: str, key: str, shards: int) -> None:
    """A folder for each shard of the key; shards may be of any size.

    Writing folders sorts a task's rows by shard. Adaptive execution cuts a large
    shard into tasks of its advisory size and puts small ones together, so that
    no task's rows grow with the table.
    """
    df.withColumn("shard", F.pmod(F.col(key), F.lit(shards))).hint("rebalance", "shard").write.mode("overwrite").partitionBy("shard").parquet(path)


PART_ROWS = 4 << 20


def coalesce_shards(df: DataFrame, parts: int, rows: int = PART_ROWS) -> DataFrame:
    """Neighbouring parts put together without a shuffle, to ``parts`` or to as many as leave each about ``rows`` rows at most."""
    return df.coalesce(max(parts, -(-df.count() // rows)))
