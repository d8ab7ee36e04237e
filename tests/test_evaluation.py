from clausework.operators import evaluation as E
from clausework.sources import files as S
from clausework.sources import models as M
from pyspark.sql import functions as F


def shares(spark, have, quota, floor):
    df = spark.createDataFrame(list(have.items()), "s string, n int")
    return {r.s: r.share for r in E.allocate(df, "s", "n", quota, floor).collect()}


def test_quota(spark):
    got = shares(spark, {"a": 100, "b": 3, "c": 50}, 10, 4)
    assert sum(got.values()) == 10 and got["b"] == 3
    assert shares(spark, {"a": 1, "b": 2}, 10, 4) == {"a": 1, "b": 2}
    assert sum(shares(spark, {"a": 9, "b": 9, "c": 9}, 7, 4).values()) == 7


def test_stratified_is_repeatable(spark, rows):
    df = spark.createDataFrame([(i, i % 2) for i in range(50)], "id int, s int")
    a = rows(E.stratified(df, ["s"], "id", 3, 1))
    assert a == rows(E.stratified(df.repartition(7), ["s"], "id", 3, 1)) and len(a) == 12


def test_files(spark, tmp_path):
    chunks = spark.createDataFrame([("a:0000", "r", True, "текст")], "chunk_id string, regulation_id string, is_table boolean, text string")
    S.write_chunks(chunks, str(tmp_path / "c"))
    back = S.read_chunks(spark, str(tmp_path / "c")).first()
    assert back.text == "текст" and back.part is None
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.bin").write_bytes(b"abc")
    digest = spark.sql("select sha2('abc', 256)").first()[0]
    m = S.manifest(spark, [{"id": "1", "file": "x.bin", "size_bytes": 3, "sha256": digest}, {"id": "2", "file": "x.bin", "size_bytes": 4, "sha256": digest}, {"id": "3", "file": "y", "size_bytes": 1}])
    assert {r.id: r.problem for r in S.verify_files(spark, m, str(tmp_path / "f")).collect()} == {"1": None, "2": "size", "3": "missing"}


def test_snapshot_is_immutable(spark, tmp_path):
    df = spark.range(3)
    S.write_snapshot(df, str(tmp_path), "run1")
    try:
        S.write_snapshot(df, str(tmp_path), "run1")
    except Exception as e:
        assert "exist" in str(e).lower()
    else:
        raise AssertionError("a second run of one name must fail")


def test_drift_and_seal(spark, rows):
    old = spark.createDataFrame([("a", 1, 2.0), ("b", 1, None)], "k string, x int, y double")
    new = spark.createDataFrame([("a", 1, 3.0), ("c", 1, None)], old.schema)
    assert rows(S.drift(old, new, ["k"])) == [("a", "y", 2.0, 3.0), ("b", "x", 1.0, None), ("c", "x", None, 1.0)]
    df = spark.createDataFrame([("a", None), ("b", "c")], "x string, y string")
    assert S.corpus_seal(df, ["x", "y"]) == S.corpus_seal(df.repartition(3), ["x", "y"]) != S.corpus_seal(df.limit(1), ["x", "y"])


def test_only_unknown_prompts_are_asked(spark, rows):
    requests = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "bb")], "id int, prompt string").withColumn("key", M.request_key("m", F.col("prompt")))
    cache = requests.where("id = 1").select("key", F.lit("kept").alias("answer"))
    assert rows(M.answer_all(requests, cache, lambda ps: [p.upper() for p in ps]), "id", "answer") == [(1, "kept"), (2, "BB"), (3, "BB")]
