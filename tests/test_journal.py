from pyspark.sql import functions as F

from clausework.operators import journal as J


def test_latest_and_upsert(spark, rows):
    old = spark.createDataFrame([(1, "a", None, 1), (2, "b", "x", 2), (3, None, "n", 1)], "id int, k string, v string, t int")
    new = spark.createDataFrame([(9, "a", "new", 5), (10, None, "m", 2), (11, "c", "c", 1)], old.schema)
    assert rows(J.latest_rows(old.unionByName(new), ["k"], ["t"]), "k", "v") == [("a", "new"), ("b", "x"), ("c", "c"), (None, "m")]
    assert rows(J.upsert(old, new, ["k"], "id", ["t"]), "id", "k", "v") == [(1, "a", "new"), (11, "c", "c"), (2, "b", "x"), (3, None, "m")]


def test_new_ids_follow_the_order(spark):
    old = spark.createDataFrame([(41,), (7,)], "id bigint")
    new = spark.createDataFrame([(i, f"{997 * i % 1000:04d}") for i in range(1000)], "x int, t string")
    got = J.with_new_ids(old, new, "id", ["t"]).orderBy("t").collect()
    assert [r.id for r in got] == list(range(42, 1042))
    assert J.with_new_ids(old.limit(0), new.limit(3), "id", ["t"]).agg(F.max("id")).first()[0] == 3


def test_votes(spark, rows):
    votes = [("p", 1, "ok"), ("p", 2, "manual"), ("p", 3, "ok"), ("q", 1, "a"), ("q", 2, "b"), ("r", 1, "y"), ("r", 2, "x"), ("r", 3, "x"), ("r", 4, "y")]
    df = spark.createDataFrame(votes, "k string, n int, v string")
    assert rows(J.majority(df, ["k"], "v", "n"), "k", "winner") == [("p", "ok"), ("q", None), ("r", "y")]


def test_consensus(spark, rows):
    items = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 2, "a"), (1, 3, "b"), (2, 1, "c")], "k int, run int, item string")
    runs = spark.createDataFrame([(1, 3), (2, 2)], "k int, n_runs int")
    assert rows(J.consensus(items, ["k"], "item", "run", runs), "k", "item") == [(1, "a"), (2, "c")]


def test_longest_prefix(spark, rows):
    names = spark.createDataFrame([("gpt-5.4-mini-x",), ("gpt-5.4",), ("other",), (None,)], "m string")
    prices = spark.createDataFrame([("gpt-5.4", 2.5), ("gpt-5.4-mini", 0.75)], "p string, price double")
    assert rows(J.longest_prefix(names, "m", prices, "p", 20), "m", "price") == [("gpt-5.4", 2.5), ("gpt-5.4-mini-x", 0.75), ("other", None), (None, None)]
