from datetime import datetime as dt

from clausework.operators.integrity import orphan_references, orphans_by_period

CHILD = "row_id bigint, ref_key bigint, seen_at timestamp, ref_key_note string"


def frames(spark, children, parents, deleted):
    c = spark.createDataFrame([(*r, "x") for r in children], CHILD)
    p = spark.createDataFrame(parents, "ref_key bigint, seen_at timestamp")
    d = spark.createDataFrame([(k,) for k in deleted], "ref_key bigint")
    return [("t", c)], p, d


def test_reasons_and_repeats(spark, rows):
    a, b = dt(2024, 1, 31), dt(2024, 2, 1)
    children = [(1, 10, b), (2, 11, b), (3, 12, a), (4, 13, b), (4, 13, a), (5, None, a), (6, 14, a), (7, 15, None), (8, 15, b)]
    parents = [(10, a), (12, b), (13, a), (13, b), (14, b), (14, a)]
    found = orphan_references(*frames(spark, children, parents, [11, 10]))
    assert rows(found, "row_id", "reason", "period") == [(2, "deleted", "2024-02"), (3, "late", "2024-01"), (7, "missing", None), (8, "missing", "2024-02")]


def test_earliest_delivery_decides_on_both_sides(spark, rows):
    a, b, c = dt(2024, 1, 1), dt(2024, 2, 1), dt(2024, 3, 1)
    found = orphan_references(*frames(spark, [(1, 1, c), (1, 1, a), (2, 1, c)], [(1, c), (1, b)], []))
    assert rows(found, "row_id", "reason", "period") == [(1, "late", "2024-01")]


def test_hot_key_and_counts(spark, rows):
    children = [(i, 7 if i % 3 else i, dt(2024, 5, 1)) for i in range(3000)]
    found = orphan_references(*frames(spark, children, [(i, dt(2024, 1, 1)) for i in range(0, 3000, 6)], []))
    want = {i for i, k, _ in children if k == 7 or k % 6}
    assert {r.row_id for r in found.collect()} == want
    total = orphans_by_period(found).collect()
    assert sum(r.n_rows for r in total) == len(want)


def test_empty_tables(spark):
    assert orphan_references(*frames(spark, [], [], [])).count() == 0
    assert orphan_references(*frames(spark, [(1, 1, None)], [], [])).count() == 1
