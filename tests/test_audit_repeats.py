from cupola.plans import queries


def test_repeated_keys_of_a_split_are_counted(spark, sf, monkeypatch):
    rows = [("a", "train"), ("a", "train"), ("b", "train"), ("b", "od_test"), ("c", "ft"), ("d", "ft"), ("d", "ft"), ("d", "ft")]
    monkeypatch.setattr(queries, "_classes", lambda spark, sf: spark.createDataFrame(rows, "key string, split string"))
    assert [tuple(r) for r in queries.audit_keys_disjoint(spark, sf).collect()] == [(1, 2)]
