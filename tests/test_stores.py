"""Key-value logs, node stores and node files."""

from pyspark.sql import functions as F

from tessera.operators import assoc, kv, links
from tessera.sources import text


def test_removed_keys_can_be_inserted_again(spark):
    log = spark.createDataFrame([(1, "I", 5, "a"), (2, "I", 6, "b")], "seq long, op string, key long, value string")
    log, answer = kv.remove(log, spark.createDataFrame([(3, 5), (4, 9)], "seq long, key long"))
    assert {r.key: r.removed for r in answer.collect()} == {5: True, 9: False}
    assert [tuple(r) for r in kv.current(log).collect()] == [(6, "b")]
    log = kv.append(kv.insert(log, spark.createDataFrame([(5, 5, "c")], "seq long, key long, value string")), spark.createDataFrame([(7, "y"), (6, "x")], "seq long, value string"), 100)
    assert sorted(tuple(r) for r in kv.current(log).collect()) == [(5, "c"), (6, "b"), (100, "x"), (101, "y")]


def test_reset_gives_ids_anew(spark):
    more = spark.createDataFrame([(2, 1, "b"), (1, 1, "a")], "order long, type int, data string")
    nodes = spark.createDataFrame([(1, 1, "old")], "id long, type int, data string")
    store = links.NodeStore(nodes, 2).add(more)
    assert sorted(tuple(r) for r in store.nodes.collect()) == [(1, 1, "old"), (2, 1, "a"), (3, 1, "b")]
    store = store.reset(50).add(more)
    assert store.next_id == 52 and sorted(r.id for r in store.nodes.collect()) == [50, 51]


def test_node_files_are_numbered_over_blocks(spark, tmp_path):
    (tmp_path / "n.csv").write_text("".join(f"name{i},{i * 7}\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = text.read_nodes_csv(spark, str(tmp_path / "n.csv"), 2)
        assert spark.read.text(str(tmp_path / "n.csv")).rdd.getNumPartitions() > 1
        assert sorted((r.node_id, *r.attrs) for r in got.collect()) == [(i, f"name{i}", str(i * 7)) for i in range(20_000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_whole_result_by_time(spark):
    rows = [(1, 0, 5, 10, ""), (2, 1, 6, 30, ""), (1, 1, 7, 20, ""), (1, 0, 4, 30, "")]
    edges = spark.createDataFrame(rows, "src long, atype long, dst long, time long, attr string")
    assert [(r.time, r.src) for r in assoc.by_time(edges, low=11).collect()] == [(30, 1), (30, 2), (20, 1)]


def test_a_large_shard_is_dealt_over_tasks(spark, tmp_path):
    path, name = str(tmp_path / "shards"), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "64k")
    try:
        # All but 100 rows are in shard 1.
        df = spark.range(0, 400_000, 1, 16).select(F.when(F.col("id") < 100, F.col("id") * 4).otherwise(F.col("id") * 4 + 1).alias("src"))
        text.write_shards(df, path, "src", 4)
    finally:
        spark.conf.set(name, before)
    back = spark.read.parquet(path)
    assert sorted(back.groupBy("shard").count().collect()) == [(0, 100), (1, 399_900)]
    assert back.distinct().count() == 400_000 and back.where("shard != src % 4").count() == 0
    files = back.groupBy(F.input_file_name().alias("file"), "shard").count().where("shard = 1").collect()
    assert len(files) > 4 and max(r["count"] for r in files) < 100_000


def test_parts_of_shards_have_a_bound_of_rows(spark):
    df = spark.range(0, 10_000, 1, 50)
    small, large = text.coalesce_shards(df, 3), text.coalesce_shards(df, 3, 1000)
    assert small.rdd.getNumPartitions() == 3 and large.rdd.getNumPartitions() == 10
    assert sorted(r.id for r in large.collect()) == list(range(10_000))
