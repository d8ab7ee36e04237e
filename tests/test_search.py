import math
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from clausework.operators import search as S

DATA = Path("/root/testdata/sf0.001")


def brute_bm25(docs, query):
    n = len(docs)
    lengths = {d: len(w) for d, w in docs.items()}
    mean = sum(lengths.values()) / n
    df = Counter(t for w in docs.values() for t in set(w))
    raw = {t: math.log(n - k + 0.5) - math.log(k + 0.5) for t, k in df.items()}
    avg = sum(raw.values()) / len(raw)
    idf = {t: v if v >= 0 else 0.25 * avg for t, v in raw.items()}
    out = {}
    for d, w in docs.items():
        tf = Counter(w)
        s = sum(idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * lengths[d] / mean)) for t in query if tf[t])
        if round(s, 6) > 0:
            out[d] = round(s, 6)
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


def test_bm25_is_the_formula(spark):
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(30)] + ["the"] * 30
    docs = {f"d{i:02d}": random.choices(vocabulary, k=random.randint(1, 25)) for i in range(40)}
    corpus = spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()] + [("e", None)], "id string, text string")
    queries = spark.createDataFrame([(1, "w1 w2 the"), (2, "w3 w3 w9"), (3, "nothing"), (4, None)], "query int, text string")
    docs["e"] = []
    got = S.Bm25(corpus, "id", "text").search(queries, 5).orderBy("query", "rank").collect()
    for q, words in ((1, ["w1", "w2", "the"]), (2, ["w3", "w3", "w9"])):
        assert [(r.doc, r.score) for r in got if r.query == q] == brute_bm25(docs, words)[:5]
    assert {r.query for r in got} == {1, 2}


def test_filters(spark):
    corpus = spark.createDataFrame([("a", "x y"), ("b", "x"), ("c", "z")], "id string, text string")
    queries = spark.createDataFrame([(1, "x")], "query int, text string")
    index = S.Bm25(corpus, "id", "text")
    only = spark.createDataFrame([("b",)], "doc string")
    assert [r.doc for r in index.search(queries, 5, allowed=only).collect()] == ["b"]
    assert index.search(queries, 5, allowed=only.limit(0)).count() == 0


def test_cosine_and_fusion(spark, rows):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 2.0]), (4, [0.0, 0.0]), (5, None)], "doc int, embedding array<double>")
    q = v.where("doc in (1, 4)").withColumnRenamed("doc", "query")
    assert rows(S.cosine_top_k(q, v, 2, skip_self=True), "query", "doc", "score", "rank") == [(1, 2, 0.707107, 1), (1, 3, 0.0, 2)]
    a = spark.createDataFrame([(1, "x", 1)], "query int, doc string, rank int")
    assert S.rrf([a, a]).first().score == round(2 / 61, 8)
    long = spark.createDataFrame([(1, d, r) for d, r in (("a", 1), ("b", 2), ("c", 3))] + [(1, "a", 1), (1, "c", 2), (1, "b", 3)], a.schema)
    assert S.rrf([long], k=2).orderBy("rank").first().doc == "a" and S.rrf([long], k=2).count() == 2


def test_metrics(spark):
    first = spark.createDataFrame([(1, 1), (2, None), (3, 4), (4, 10)], "query int, rank int")
    assert tuple(S.hit_metrics(first).first()) == (4, 0.25, 0.25, 0.5, 0.75, 0.3375)
    ranking = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query int, doc string, rank int")
    got = S.first_hit(ranking, F.col("doc") == "b", spark.createDataFrame([(1,), (2,)], "query int"))
    assert {(r.query, r.rank) for r in got.collect()} == {(1, 2), (2, None)}


def test_three_forms_of_a_noun_share_a_token(spark):
    from clausework.functions import text as T

    # pairs of the published Snowball vocabulary
    pairs = "вавиловка вавиловк;вагонов вагон;вагоном вагон;важнейшие важн;важнейшими важн;важничал важнича;важность важност;валандался валанда;валериановых валерианов;падающая пада;падение паден;пакостей пакост;палачество палачеств;павильонам павильон;п п;па па"
    assert all(T.stem(word) == want for word, want in (p.split() for p in pairs.split(";")))
    rows = spark.createDataFrame([("наклейку",), ("наклейке",), ("наклейками",), ("e322",), ("label",), (None,)], "raw string")
    got = {r.raw: r.term for r in T.stemmed(rows, "raw", "term").collect()}
    assert got["наклейку"] == got["наклейке"] == got["наклейками"] == "наклейк"
    assert got["e322"] == "е322" and got["label"] == "label" and None not in got


def test_a_query_and_its_rewrites(spark):
    corpus = spark.createDataFrame([("a", "сахар и соль"), ("b", "соли много"), ("c", "масло"), ("a", "сахар и соль")], "id string, text string")
    index = S.Bm25(corpus, "id", "text")
    assert index.numbers()[:2] == (3.0, 2.0)
    texts = spark.createDataFrame([(1, 0, "соль"), (1, 1, "масло"), (2, 0, "нет такого")], "query int, variant int, text string")
    lists = index.search(texts, 5)
    assert {(r.query, r.variant, r.doc) for r in lists.collect()} == {(1, 0, "a"), (1, 0, "b"), (1, 1, "c")}
    fused = S.run_search("hybrid", index, texts)
    assert {r.doc for r in fused.where("query = 1").collect()} == {"a", "b", "c"}
    one = texts.where("variant = 0").drop("variant")
    assert S.run_search("bm25", index, one).count() == 2 and S.run_search("vector", index, one).where("rank = 1 and query = 1").count() == 1


def test_hits_by_address_or_id_and_unknown_ids(spark):
    import pytest

    addresses = spark.createDataFrame([("a", "s1"), ("b", "s1"), ("c", None), ("d", None)], "doc string, address string")
    ranking = spark.createDataFrame([(1, "d", 1), (1, "b", 2), (2, "d", 1), (2, "c", 2)], "query int, doc string, rank int")
    gold = spark.createDataFrame([(1, "a"), (2, "c")], "query int, doc string")
    got = {(r.query, r.doc): r.is_hit for r in S.hits(ranking, gold, addresses).collect()}
    assert got == {(1, "d"): False, (1, "b"): True, (2, "d"): False, (2, "c"): True}
    for bad_ranking, bad_gold in ((ranking.withColumn("doc", F.lit("zz")), gold), (ranking, gold.withColumn("doc", F.lit("zz")))):
        with pytest.raises(Exception, match="unknown id: zz"):
            S.hits(bad_ranking, bad_gold, addresses).collect()


def test_cosine_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(90)]
    v = spark.createDataFrame(data, "doc int, embedding array<double>")
    q = v.where("doc % 3 = 0").withColumnRenamed("doc", "query")
    monkeypatch.setattr(S, "QUERY_BLOCK", 7)
    monkeypatch.setattr(S, "VECTOR_BLOCK", 11)
    got = {(r.query, r.rank): r.doc for r in S.cosine_top_k(q, v, 4).collect()}
    m = np.array([x for _, x in data])
    cos = np.round(m @ m.T / np.linalg.norm(m, axis=1)[:, None] / np.linalg.norm(m, axis=1), 6)
    for i in range(0, 90, 3):
        want = sorted(range(90), key=lambda d: (-cos[i, d], d))[:4]
        assert [got[i, r] for r in range(1, 5)] == want


def test_many_queries_in_blocks(spark, monkeypatch):
    random.seed(8)
    vocabulary = [f"w{i}" for i in range(60)] + ["the"] * 40 + ["of"] * 20
    docs = {f"d{i:03d}": random.choices(vocabulary, k=random.randint(1, 30)) for i in range(150)}
    docs |= {f"c{i:02d}": docs["d007"] for i in range(20)}  # ties
    corpus = spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()] + [("e", None)], "id string, text string")
    asked = {i: random.choices([*vocabulary, "unknown"], k=random.randint(1, 9)) for i in range(40)} | {40: docs["d007"], 41: ["unknown"]}
    queries = spark.createDataFrame([(i, " ".join(w)) for i, w in asked.items()] + [(42, None)], "query int, text string")
    docs["e"] = []
    index = S.Bm25(corpus, "id", "text")
    joined = index.search(queries, 5)
    for name, value in (("MANY", 0), ("ASKED_BLOCK", 17), ("DOC_BLOCK", 50), ("SCORE_ROWS", 6), ("SCORE_COLUMNS", 16), ("DENSE", 0.1)):
        monkeypatch.setattr(S, name, value)
    found = index.search(queries, 5)
    # no row for each query, term and document: 2.8 billion for r11_hits over 90,000 chunks
    assert "CoGroup" in found._jdf.queryExecution().toString() and "CoGroup" not in joined._jdf.queryExecution().toString()
    got = {}
    for r in found.orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.doc, r.score))
    assert got == {q: want for q, w in asked.items() if (want := brute_bm25(docs, w)[:5])}
    only = spark.createDataFrame([("d003",), ("e",)], "doc string")
    assert {r.doc for r in index.search(queries, 5, allowed=only).collect()} == {"d003"}
    assert index.search(queries, 5, allowed=only.limit(0)).count() == 0
    several = queries.withColumn("variant", F.col("query") % 2).withColumn("query", F.col("query").cast("string"))
    assert {(int(r.query), r.doc, r.score) for r in index.search(several, 5).collect()} == {(q, d, x) for q, found in got.items() for d, x in found}


def test_best_of_matrices():
    import numpy as np

    rng = np.random.default_rng(4)
    scores = rng.integers(0, 12, (30, 200)) / 4 + rng.choice([0, 4e-7, 6e-7], (30, 200))
    rounded = np.round(scores, 6)
    for ties in (False, True):
        best = S._Best(30, 5, -np.inf, ties)
        for first, last in ((0, 3), (3, 40), (40, 41), (41, 200)):
            best.add(scores[:, first:last], first)
        for i in range(30):
            want = sorted(range(200), key=lambda d: (-rounded[i, d], d))
            want = [d for d in want if rounded[i, d] >= rounded[i, want[4]]] if ties else want[:5]
            assert list(best.column[best.row == i]) == want and list(best.score[best.row == i]) == list(rounded[i, want])


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_methods_side_by_side(spark, monkeypatch):
    import duckdb

    from clausework.plans import search as plans

    con = duckdb.connect()
    con.execute(f"create view chunks as select * from read_parquet('{DATA}/chunks.parquet')")
    want = sorted(con.execute(f"select query, bm25, vector, hybrid from ({plans.SQL['r13_methods']})").fetchall(), key=str)
    calls, cosine = [], S.cosine_top_k
    monkeypatch.setattr(S, "cosine_top_k", lambda *a, **b: calls.append(1) or cosine(*a, **b))
    monkeypatch.setattr(S, "MANY", 0)
    got = plans.r13_methods(spark, str(DATA)).select("query", "bm25", "vector", "hybrid").collect()
    assert sorted((tuple(r) for r in got), key=str) == want and want
    assert len(calls) == 1  # all pairs of questions and vectors meet once, not once for each method that needs their list


def test_the_index_has_a_row_a_document(spark):
    from clausework.functions import text as T

    texts = [(1, "Наклейку E322, наклейки Ёлка ёлка e12a"), (2, None), (3, ""), (1, "Наклейку E322, наклейки Ёлка ёлка e12a")]
    index = S.Bm25(spark.createDataFrame(texts, "id int, text string"), "id", "text")
    got = {r.doc: (r.length, dict(zip(r.terms, r.tfs, strict=True))) for r in index.index.collect()}
    assert got == {1: (6, {"наклейк": 2, "е322": 1, "елк": 2, "e12a": 1}), 2: (0, {}), 3: (0, {})} and index.index.count() == 3
    raw = spark.createDataFrame([(w,) for w in ("e322", "ёлка", "e12a", "падение", "label")], "raw string")
    assert all(r.term == T.search_form(r.raw) for r in T.stemmed(raw, "raw", "term").collect())
