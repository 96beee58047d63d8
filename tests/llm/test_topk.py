import duckdb
import numpy as np
from pyspark.sql import functions as F

from tessera.llm import topk


def clip(x):
    return max(-(2**63 - 1), min(2**63 - 1, x))


def brute(rows, k, is_query):
    ok = [(i, [clip(int(np.floor(64 * x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if is_query(q):
            scored = sorted((-clip(sum(x * y for x, y in zip(a, b, strict=False))), i) for i, b in ok if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def run(spark, rows, k=3, block=8192):
    """``block``: bytes of queries for each width of 8."""
    df = spark.createDataFrame([(i, v, 1.0, "x") for i, v in rows], "vec_id long, embedding array<double>, norm2 double, v string")
    return sorted(tuple(r) for r in topk.top_k(df, lambda c: F.col(c) % 2 == 0, k=k, query_bytes=block * 8).collect())


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [-1.0, 0.51]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [9.0, 9.0]), (8, [3.0]), (9, []), (10, [0.0, 0.0]), (11, [1.0, 2.0])]
    assert run(spark, rows) == brute(rows, 3, lambda i: i % 2 == 0)
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []


def test_skewed_lengths_blocks_and_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=8) * rng.exponential(2)).tolist()) for i in range(400)]
    rows += [(1000 + i, [0.5] * 8) for i in range(200)]
    assert run(spark, rows, k=5, block=100) == brute(rows, 5, lambda i: i % 2 == 0)


def test_a_task_that_meets_short_vectors_first(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=8) * (0.1 if i % 3 == 0 else 20)).tolist()) for i in range(300)]
    real = topk.materialize

    def ascending(df, name):
        # Many small files that one task reads in ascending order of length.
        return real(df.repartitionByRange(8, "norm2").sortWithinPartitions("norm2"), name).coalesce(1).sortWithinPartitions("norm2") if name == "topk-vectors" else real(df, name)

    monkeypatch.setattr(topk, "materialize", ascending)
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 16)
    assert run(spark, rows, k=5) == brute(rows, 5, lambda i: i % 2 == 0)


def test_large_components(spark):
    rows = [(i, [float(2**20 + i), float(-(2**19) * i)]) for i in range(12)]
    assert run(spark, rows) == brute(rows, 3, lambda i: i % 2 == 0)


def test_components_and_scores_beyond_a_long(spark):
    rng = np.random.default_rng(5)
    big = [1e10, 1e17, 1e300, -1e300, -1e17, 3.0, 2.0**40, -(2.0**45) - 0.5]
    rows = [(i, rng.choice(big, 4).tolist()) for i in range(60)] + [(100 + i, rng.normal(size=4).tolist()) for i in range(10)]
    with np.errstate(over="ignore"):
        assert run(spark, rows, k=4, block=16) == brute(rows, 4, lambda i: i % 2 == 0)


def test_products_at_the_bounds():
    rng = np.random.default_rng(6)
    a = np.concatenate([rng.integers(-(2**62), 2**62, (20, 3)), rng.integers(-(2**31), 2**31, (20, 3)), [[2**31, 2**31, 0], [-(2**63 - 1), 1, 0], [2**63 - 1, -1, 1]]]).astype(np.int64)
    b = np.concatenate([a, [[2**31, 2**31, -1], [1, 0, 0], [1, 1, 1]]]).astype(np.int64)
    want = [[clip(sum(int(x) * int(y) for x, y in zip(p, q, strict=True))) for q in b] for p in a]
    assert topk._products(a, b).tolist() == want


def test_many_files_in_few_tasks(spark):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=8) * (0.01 if i % 3 else 30)).tolist()) for i in range(1500)]
    want = brute(rows, 20, lambda i: i % 2 == 0)
    names = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"]
    before = [spark.conf.get(n) for n in names]
    try:
        for files in ("64", "211"):
            spark.conf.set(names[0], files)
            spark.conf.set(names[1], "false")
            assert run(spark, rows, k=20) == want
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)


def test_repeated_ids_are_dealt_over_blocks(spark):
    rows = [(4, [float(i), 1.0]) for i in range(40)] + [(5, [2.0, 3.0])]
    assert run(spark, rows, k=3, block=2) == brute(rows, 3, lambda i: i % 2 == 0)


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(tuple(r) for r in topk.op5_exact_topk(spark, sf).collect()) == sorted(duckdb.sql(topk.OP5_SQL).fetchall())
