import pytest

from tessera.operators import algorithms as algo


@pytest.mark.parametrize("search", [algo.bfs, algo.shortest_paths])
def test_no_partial_result_beyond_the_bound(spark, search):
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(5)], "i long, j long, cost double")
    assert search(edges, 0, max_rounds=6).count() == 6
    with pytest.raises(RuntimeError):
        search(edges, 0, max_rounds=3)


def test_negative_costs_raise(spark):
    with pytest.raises(ValueError):
        algo.shortest_paths(spark.createDataFrame([(0, 1, -1.0)], "i long, j long, cost double"), 0)


def test_long_path_and_circle(spark):
    paths = spark.createDataFrame([(0, 0), *((i, i - 1) for i in range(1, 40)), (50, 51), (51, 50)], "node long, pred long")
    assert sorted(tuple(r) for r in algo.trace_path(paths, 0, 39).collect()) == [(i, i) for i in range(40)]
    assert algo.trace_path(paths, 0, 99).count() == 0
    assert [tuple(r) for r in algo.trace_path(paths, 0, 0).collect()] == [(0, 0)]
    with pytest.raises(RuntimeError):
        algo.trace_path(paths, 0, 50)


def test_competing_paths(spark):
    edges = spark.createDataFrame([(0, 1, 5.0), (0, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (1, 0, 1.0), (3, 2, 0.0)], "i long, j long, cost double")
    assert {r.node: (r.dist, r.pred) for r in algo.shortest_paths(edges, 0).collect()} == {0: (0.0, 0), 1: (3.0, 3), 2: (1.0, 0), 3: (2.0, 2)}
    assert {r.node: r.dist for r in algo.bfs(edges, 0).collect()} == {0: 0, 1: 1, 2: 1, 3: 2}
