from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.operators.components import connected_components


def brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        parent[b] = a
    return {x: min(y for y in parent if find(y) == find(x)) for x in parent}


def run(spark, edges):
    return {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=25))
def test_random_graphs(spark, edges):
    assert run(spark, edges) == brute(edges)


def test_long_path(spark):
    edges = [(i, i + 1) for i in range(200)] + [(900, 900), (None, 5)]
    assert run(spark, edges) == brute(edges[:-1])
