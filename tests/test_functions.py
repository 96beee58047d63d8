from pyspark.sql import functions as F

from tessera.functions import distributions as dist
from tessera.functions import generators as gen
from tessera.functions import scalar as fn
from tessera.operators import stats
from tessera.plans import workload
from tessera.sources import text


def test_permutations_are_bijections(spark):
    for n, groups, shift in ((1000, 7, 3), (64, 8, 5), (10, 3, 0)):
        df = spark.range(n).select("id", fn.rotation_permutation(F.col("id"), n, groups, shift).alias("p"), fn.transpose_permutation(F.col("id"), n, groups).alias("t"))
        got = df.withColumn("back", fn.rotation_inverse(F.col("p"), n, groups, shift)).collect()
        assert {r.p for r in got} == {r.t for r in got} == set(range(n)) and all(r.back == r.id for r in got)


def test_base64_and_buckets(spark):
    values = [0, 1, 63, 64, 4095, 10**12]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert [r.b for r in df.select(fn.base64_int_decode(fn.base64_int(F.col("v"))).alias("b")).collect()] == values
    edges = [0, 99, 100, 999, 1000, 99_999, 100_000, 999_999, 1_000_000, 9_999_999, 10_000_000]
    df = spark.createDataFrame([(v,) for v in edges], "v long").withColumn("b", stats.latency_bucket(F.col("v")))
    low, high = stats.bucket_bounds(F.col("b"))
    for r in df.select("v", low.alias("lo"), high.alias("hi")).collect():
        assert r.lo <= r.v and (r.hi is None or r.v < r.hi)


def test_distributions(spark):
    n = 20_000
    for kind, mean in ((dist.Uniform(10, 20), 14.5), (dist.Geometric(1, 129, 0.382), 1 / 0.382), (dist.Exponential(3.0), 3.0), (dist.Empirical(((0, 0.0), (1, 0.5), (10, 1.0))), 3.0)):
        got = spark.range(n).select(kind.quantile(gen.uniform(F.col("id"), 5)).alias("v")).agg(F.avg("v").alias("m"), F.min("v").alias("lo")).first()
        assert abs(got.m - mean) < 0.05 * mean + 0.05, kind
    z = dist.Zipf(0, 100, 0.8)
    pdf = spark.range(100).select(F.sum(z.pdf(F.col("id"))).alias("total"), F.max(z.cdf(F.col("id"))).alias("top")).first()
    assert abs(pdf.total - 1) < 1e-9 and abs(pdf.top - 1) < 1e-9
    draws = spark.range(n).select(z.quantile(gen.uniform(F.col("id"), 6)).alias("v")).groupBy("v").count().collect()
    counts = {r.v: r["count"] for r in draws}
    assert min(counts) >= 0 and max(counts) < 100 and abs(counts[0] / n - 1 / dist.harmonic(100, 0.8)) < 0.02
    ln = dist.LogNormal(0, 4096, 128, 1.0)
    assert abs(spark.range(n).select(ln.choose(3).alias("v")).agg(F.percentile("v", 0.5)).first()[0] - 128) < 8
    same = spark.range(50).select(gen.uniform(F.col("id"), 1).alias("u"))
    assert same.collect() == same.repartition(3).orderBy("u").collect() or sorted(same.collect()) == sorted(same.repartition(3).collect())


def test_generators(spark):
    g = gen.gnm(spark, 50, 200).collect()
    assert len({tuple(r) for r in g}) == 200 and all(0 <= r.i < r.j < 50 for r in g)
    assert len(gen.gnm(spark, 10, 45).collect()) == 45
    pts, edges = gen.geometric_graph(spark, 300, 6.0)
    p = {r.node: (r.x, r.y) for r in pts.collect()}
    radius = (6.0 / (3.141592653589793 * 300)) ** 0.5
    want = {(i, j) for i in p for j in p if i < j and (p[i][0] - p[j][0]) ** 2 + (p[i][1] - p[j][1]) ** 2 <= radius**2}
    assert {(r.i, r.j) for r in edges.collect()} == want
    have = gen.random_assocs(spark, 200, 50, 1, 10)
    more = gen.augment_out_degree(have, spark.range(50).select(F.col("id").alias("node")), 6, 50)
    total = have.select("src", "dst").distinct().union(more).distinct().groupBy("src").count().collect()
    assert len(total) == 50 and all(r["count"] >= 6 for r in total)
    data = gen.payloads(spark.range(3).select("id", F.lit(12).alias("size")), "id", "size", motif=b"abc", uniqueness=0.0)
    assert {bytes(r.data) for r in data.collect()} == {b"abcabcabcabc"}
    ops = {r.op: r["count"] / 20_000 for r in workload.operations(spark, 20_000, workload.LINK_MIX).groupBy("op").count().collect()}
    assert all(abs(ops[op] * 100 - share) < 1.5 for op, share in workload.LINK_MIX.items())


def test_text_formats(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2, 3, 4, "a b c"), (1, 2, 5, 6, "")], "src long, atype long, dst long, time long, attr string")
    text.write_assoc(edges, str(tmp_path / "e"))
    assert sorted(text.read_assoc(spark, str(tmp_path / "e")).collect()) == sorted(edges.collect())
    (tmp_path / "n.csv").write_text("a,b\nc,d\n")
    assert [(r.node_id, r.attrs) for r in text.read_nodes_csv(spark, str(tmp_path / "n.csv"), 2).orderBy("node_id").collect()] == [(0, ["a", "b"]), (1, ["c", "d"])]
    (tmp_path / "l.txt").write_text("# note\n1 2\n3 4\n")
    assert sorted(tuple(r) for r in text.read_edge_list(spark, str(tmp_path / "l.txt")).collect()) == [(1, 2), (3, 4)]
    (tmp_path / "q.txt").write_text("1,2,3,4,5,6\n7,8,9,10\n")
    assert [r.dst_set for r in text.read_requests(spark, str(tmp_path / "q.txt"), "assoc_get").orderBy("node").collect()] == [[5, 6], []]
    row = spark.createDataFrame([(["x", "y"],)], "attrs array<string>").select(text.format_slots(F.col("attrs"), 4).alias("line"))
    assert row.select(text.parse_slots(F.col("line"), 4).alias("a")).first().a == ["x", "y", "", ""]
    assert text.to_neato(spark.createDataFrame([(1, 2)], "i long, j long")) == "graph g {\n  1 -- 2;\n}\n"
