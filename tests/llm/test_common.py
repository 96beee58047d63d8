from tessera.llm import common


def test_join_hot_is_an_inner_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    rows = [(b"hot", i % 7, None if i % 3 else "x") for i in range(300)] + [(b"cold", 1, "y"), (b"alone", 2, "z"), (None, 3, "z")]
    many = spark.createDataFrame(rows, "k binary, row int, may string")
    few = spark.createDataFrame([(b"hot", 1), (b"hot", 1), (b"hot", 2), (b"cold", 5), (b"none", 6), (None, 7)], "k binary, salt int")
    want = sorted((str(a + (c,)) for a in rows for b, c in [(b"hot", 1), (b"hot", 1), (b"hot", 2), (b"cold", 5)] if a[0] == b))
    got = [(bytes(r.k), r.row, r.may, r.salt) for r in common.join_hot(many, few, "k").collect()]
    assert sorted(map(str, got)) == want
    assert common.join_hot(many.limit(0), few, "k").collect() == []
    assert common.join_hot(many, few.limit(0), "k").collect() == []
