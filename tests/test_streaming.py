from clausework.streaming import journal as J


def test_upserts_by_batch(spark, rows, tmp_path):
    schema = "id int, k string, v string, t int"
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a", "x", 1), (2, "b", "y", 1)], schema).coalesce(1).write.parquet(source)
    go = lambda: J.upsert_stream(J.read_stream(spark, source, schema, 1), target, str(tmp_path / "cp"), ["k"], "id", ["t"]).awaitTermination()
    go()
    assert rows(J.latest_version(spark, target), "id", "v") == [(1, "x"), (2, "y")]
    spark.createDataFrame([(3, "a", "z", 2)], schema).coalesce(1).write.mode("append").parquet(source)
    go()
    assert rows(J.latest_version(spark, target), "id", "k", "v") == [(1, "a", "z"), (2, "b", "y")]
    untouched = {p.parent.name for p in (tmp_path / "out").glob("part=*/version=1")}
    assert len(untouched) == 1  # only the part of the key that came again
    assert rows(J.latest_version(spark, target, before=1), "id", "v") == [(1, "x"), (2, "y")]
    assert J.drop_old_versions(spark, target, keep=1) == 1
    assert rows(J.latest_version(spark, target), "id", "k", "v") == [(1, "a", "z"), (2, "b", "y")]
