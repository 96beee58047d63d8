"""Two small graphs with known answers, and the rules of the merged view."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import assoc, links, primitives
from tessera.operators.graph import PropertyGraph, number_rows
from tessera.sources import schema

E1, E2, E3 = (0, 2, 1, 41842148, "a b"), (0, 2, 1618, 93244, "sup"), (0, 2, 1, 9324, "suc")
E4, E5 = (0, 0, 2, 9324, "fourth one"), (6, 1, 1, 111111, "abcd")


@pytest.fixture(scope="module")
def graph(spark):
    return spark.createDataFrame([E1, E2, E3, E4, E5], schema.EDGE)


def rows(df):
    return sorted(tuple(r) for r in df.select("src", "atype", "dst", "time", "attr").collect())


@pytest.mark.parametrize(
    ("call", "want"),
    [
        ((0, None, None, None), [E4, E1, E2, E3]), ((0, None, None, 1), [E4, E1]), ((0, None, 1, None), [E2, E3]), ((None, 1, None, None), [E5]),
        ((None, None, None, None), [E4, E1, E2, E3, E5]), ((0, 0, 0, 1), [E4]), ((0, 2, 0, 2), [E1, E2]), ((0, 2, 2, 1), [E3]), ((6, 1, 0, 1), [E5]), ((0, 0, 100, 1), []),
    ],
)
def test_assoc_range(graph, call, want):
    assert rows(assoc.assoc_range(graph, *call)) == sorted(want)


@pytest.mark.parametrize(
    ("call", "want"),
    [
        ((0, 2, [1618], 1435055631064, 1436667356522), []), ((0, 2, [1618], 9324, 93245), [E2]), ((0, 2, [1, 1618], 9324, 93245), [E2, E3]), ((0, 2, [1, 1618], None, 93245), [E2, E3]),
        ((0, 2, [1, 1618], 9324, None), [E1, E2, E3]), ((None, None, [1, 1618], 100000, None), [E1, E5]), ((None, None, [1, 1618], None, 100000), [E2, E3]), ((None, None, [], None, None), []),
    ],
)
def test_assoc_get(graph, call, want):
    assert rows(assoc.assoc_get(graph, *call)) == sorted(want)


@pytest.mark.parametrize(
    ("call", "want"),
    [
        ((6, 1, 1, 99999999, 10), [E5]), ((0, 0, 0, 1, 10), []), ((0, 2, 900, 93244, 2), [E2, E3]), ((0, 2, 900, 93244, 1), [E2]), ((0, 2, None, 99999999999, 1), [E1]),
        ((0, 2, None, 99999999999, 100), [E1, E2, E3]), ((None, None, None, 999999999, 2), [E4, E1, E2, E5]), ((None, None, 9324, 9324, None), [E4, E3]),
    ],
)
def test_assoc_time_range(graph, call, want):
    assert rows(assoc.assoc_time_range(graph, *call)) == sorted(want)


def test_counts_and_neighbors(graph):
    calls = [((0, 0), 1), ((0, 2), 3), ((6, 1), 1), ((None, None), 5), ((None, 2), 3), ((0, None), 4), ((1618, None), 0), ((5, 1), 0)]
    assert all(assoc.assoc_count(graph, *c).first().n == n for c, n in calls)
    assert sorted(r.dst for r in primitives.get_neighbors(graph, 0).collect()) == [1, 1, 2, 1618]
    assert [r.dst for r in primitives.get_neighbors_ordered(graph, 0, 2).orderBy("pos").collect()] == [1, 1618, 1]
    assert [r.attr for r in primitives.get_edge_attrs(graph, 0, 2).orderBy("pos").collect()] == ["a b", "sup", "suc"]


@pytest.fixture(scope="module")
def attrs(spark):
    texts = {0: ["Winter", "is", "coming"], 1: ["is", "Winter", "here"], 2: ["George", "R", "R", "Martin", "writes", "too", "damn", "slow"]}
    return spark.createDataFrame([(n, i, a) for n, xs in texts.items() for i, a in enumerate(xs)], schema.NODE_ATTR)


def test_attribute_search(spark, graph, attrs):
    def nodes(*conditions):
        return {r.node_id for r in primitives.get_nodes(attrs, *conditions).collect()}

    assert nodes((0, "Geo")) == nodes((7, "slo")) == nodes((0, "Win"), (1, "is")) == set()
    assert nodes((7, "slow")) == {2} and nodes((0, "Winter")) == {0} and nodes((0, "George"), (3, "Martin")) == {2}
    assert nodes((0, "Winter"), (3, "")) == {0} and nodes((2, "R"), (5, "too")) == {2} and nodes((2, "R"), (6, "too")) == set()
    asked = spark.createDataFrame([(10,), (0,)], "node_id long")
    assert {r.node_id: r.attr for r in primitives.get_attribute(attrs, asked, 0).collect()} == {10: "", 0: "Winter"}
    near = lambda i, k: sorted(r.dst for r in primitives.get_neighbors_attr(graph, attrs, 0, i, k).collect())
    assert near(1, "Winter") == [1, 1] and near(0, "George") == [2] and near(0, "Win") == []


def test_obj_get_trims_the_end(spark):
    a = spark.createDataFrame([(1, 0, "x"), (1, 1, ""), (1, 2, "y"), (1, 3, ""), (2, 0, "")], schema.NODE_ATTR)
    got = primitives.obj_get(a, spark.createDataFrame([(1,), (2,), (3,)], "node_id long")).collect()
    assert sorted((r.node_id, r.attr_idx, r.attr) for r in got) == [(1, 0, "x"), (1, 1, ""), (1, 2, "y")]


def test_merged_view(spark, graph, tmp_path):
    more = spark.createDataFrame([(0, 2, 7, 10**9, "new")], schema.EDGE)
    g = PropertyGraph(graph).add_edges(more).delete_edges(spark.createDataFrame([(0, 2, 1), (6, 1, 9)], "src long, atype long, dst long"))
    assert rows(assoc.assoc_range(g.live_edges(), 0, 2)) == sorted([more.first(), E2])
    again = g.add_edges(spark.createDataFrame([E1], schema.EDGE))
    assert rows(again.live_edges()) == sorted([tuple(more.first()), E1, E2, E4, E5])
    assert rows(again.compact(str(tmp_path / "g")).live_edges()) == rows(again.live_edges())


def test_slices_make_the_list(graph):
    parts = [r for off in range(4) for r in rows(assoc.assoc_range(graph, 0, 2, off, 1))]
    assert sorted(parts) == rows(assoc.assoc_range(graph, 0, 2))


def test_number_rows(spark):
    df = spark.range(1000).select((F.col("id") * 3).alias("k")).repartition(7)
    assert sorted((r.k, r.id) for r in number_rows(df, "k", 10).collect()) == [(3 * i, 10 + i) for i in range(1000)]


def link(seq, op, id2=1124, visibility=1, time=1994, data=b"\x01"):
    return (seq, op, 1123, 321, id2, visibility, 1, time, data)


def test_link_life(spark):
    log, counts = [], []
    for op in (link(1, "A"), link(2, "X"), link(3, "A"), link(4, "H"), link(5, "U", data=bytes(range(256)))):
        log.append(op)
        found = links.resolve(spark.createDataFrame(log, schema.LINK_OP))
        counts.append(sum(r.n for r in links.count_links(found).collect()))
        if op[1] == "H":
            assert links.get_link(found, 1123, 321, 1124).first().visibility == 0
    assert counts == [1, 0, 1, 0, 1]
    assert bytes(links.get_link(found, 1123, 321, 1124).first().data) == bytes(range(256))


def test_link_lists(spark):
    t = 10_000_000
    log = [link(i, "A", id2, v, time) for i, (id2, v, time) in enumerate([(1, 1, t + 1), (2, 1, t), (3, 0, t - 2), (4, 1, t + 3)])]
    found = links.resolve(spark.createDataFrame(log, schema.LINK_OP))
    times = lambda **o: [r.time for r in links.link_list(found, 1123, 321, **o).orderBy("pos").collect()]
    assert times() == [t + 3, t + 1, t] and times(offset=1, limit=2) == [t + 1, t] and times(low=t + 1, high=t + 2) == [t + 1]
