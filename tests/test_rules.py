import random

import pytest
from pyspark.sql import functions as F

from clausework.functions import labels as N
from clausework.functions import text as T
from clausework.operators import boxes as B
from clausework.operators import evaluation as E
from clausework.operators import segments as S


def test_nutrition_in_all_forms(spark):
    texts = [
        "Энергетическая ценность 470 кДж / 111 ккал / Жиры 1.6 / Углеводы 15 / Белки 8.2",
        "64/268 ккал кДж 1 г белки 0,2 г жиры 16,3 г углеводы",
        "127 ккал",
        "111 кДж / 470 ккал",
        "без чисел",
        None,
    ]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "k int, t string, fat_ int")
    got = {r.k: r for r in N.nutrition(df, "t").collect()}
    assert (got[0].kcal, got[0].kj, got[0].kcal_counted, got[0].kj_counted) == (111.0, 470.0, 107.2, 453.6) and 3 < got[0].kcal_off < 4
    assert (got[1].protein, got[1].fat, got[1].carbs, got[1].kcal, got[1].kj) == (1.0, 0.2, 16.3, 64.0, 268.0)
    assert (got[2].kcal, got[2].kj) == (127.0, None) and (got[3].kcal, got[3].kj) == (111.0, 470.0)
    assert got[4].kcal is None and got[5].protein is None


def test_codes_with_a_boundary(spark):
    rows = [("E322 и е471", "е322", True), ("E3221", "е322", False), ("Е160a", "е160а", True), ("E160", "е160а", False), ("кофе322", "е322", False), ("e 322.", "е322", True)]
    df = spark.createDataFrame(rows, "t string, code string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", F.regexp_like(F.lower("t"), N.code_pattern(F.col("code")))).collect())


def test_blocks_against_a_loop(spark):
    def loop(lines, span):
        out, i = [], 0
        while i < len(lines):
            if lines[i].startswith("S"):
                end = next((j for j in range(i + 1, min(i + span, len(lines) - 1) + 1) if lines[j].startswith("E")), None)
                if end is not None:
                    i = end + 1
                    continue
            out.append(lines[i])
            i += 1
        return out

    random.seed(7)
    data = [(i, [random.choice("SEabc") for _ in range(random.randint(0, 14))]) for i in range(200)]
    df = spark.createDataFrame(data, "k int, lines array<string>")
    got = {r.k: r.kept for r in df.select("k", S.drop_blocks(F.col("lines"), "^S", "^E", 4).alias("kept")).collect()}
    assert all(got[k] == loop(lines, 4) for k, lines in data)


def test_halves_against_recursion(spark):
    def cut(a, b):
        if b - a <= 0.1 + 1e-9:
            return [(a, b)]
        half = (b - a + 0.01) / 2
        return cut(a, a + half) + cut(b - half, b)

    random.seed(3)
    data = [(i, *sorted((random.random(), random.random()))) for i in range(60)] + [(99, 0.2, 0.3), (98, 0.5, 0.5)]
    df = spark.createDataFrame(data, "k int, a double, b double")
    got = {r.k: [(p.a, p.b) for p in r.p] for r in df.select("k", B.halved(F.col("a"), F.col("b"), 0.1, 0.01).alias("p")).collect()}
    for k, a, b in data:
        assert [tuple(round(x, 9) for x in p) for p in got[k]] == [tuple(round(x, 9) for x in p) for p in cut(a, b)]


def test_greedy_drop_against_a_loop(spark):
    random.seed(5)
    pairs = sorted({(p, *sorted(random.sample(range(12), 2))) for p in range(6) for _ in range(14)})
    got = {(r.box_id) for r in B.dropped_greedily(spark.createDataFrame([(p, p * 100 + a, p * 100 + b) for p, a, b in pairs], "p int, id_1 bigint, id_2 bigint"), ["p"]).collect()}
    want = set()
    for p in range(6):
        kept = []
        for x in range(12):
            if any((p, y, x) in pairs for y in kept):
                want.add(p * 100 + x)
            else:
                kept.append(x)
    assert got == want


def test_ground_truth_with_seals(spark):
    rows = spark.createDataFrame([(1, "a", "ru"), (2, " ", None)], "id int, t string, lang string")
    tests = {"no text": F.trim("t") == "", "no language": F.col("lang").isNull()}
    got = {r.id: r for r in E.ground_truth(rows, "id", ["t", "lang"], tests).collect()}
    assert got[1].problems == "" and got[2].problems == "no text|no language"
    seals = spark.createDataFrame([(1, got[1].seal), (2, got[2].seal)], "id int, expected string")
    assert E.ground_truth(rows, "id", ["t", "lang"], tests, seals).count() == 2
    with pytest.raises(Exception, match="seal broken: 2"):
        E.ground_truth(rows.withColumn("t", F.when(F.col("id") == 2, "changed").otherwise(F.col("t"))), "id", ["t", "lang"], tests, seals).collect()


def test_prefixes_and_folding(spark):
    r = spark.range(1).select(S.prefixes(F.lit("1.2.10")).alias("p"), S.prefixes(F.lit("")).alias("e"), S.prefixes(F.lit(None).cast("string")).alias("n"), T.fold_look_alikes(F.lit("bhkmtY")).alias("f")).first()
    assert r.p == ["1", "1.2", "1.2.10"] and r.e == [""] and r.n is None and r.f == "внкмтУ"
