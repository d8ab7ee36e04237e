import random

from pyspark.sql import functions as F

from clausework.operators import boxes as B
from clausework.operators import guards as G
from clausework.operators import segments as S
from clausework.plans import layout as L


def test_pack_against_brute_force(spark):
    random.seed(2)
    texts = ["\n".join("x" * random.randint(0, 40) for _ in range(random.randint(1, 30))) for _ in range(40)] + ["", "y" * 200]

    def brute(lines, limit):
        parts, open_ = [], None
        for line in lines:
            if open_ is not None and len(open_) + 1 + len(line) <= limit:
                open_ += "\n" + line
            else:
                parts += [open_] if open_ is not None else []
                open_ = line
        return parts + [open_]

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", S.pack(S.lines_of(F.col("t")), 60).alias("p")).collect():
        assert r.p == brute(r.t.split("\n"), 60)
    assert spark.createDataFrame([(None,)], "t string").select(S.pack(S.lines_of(F.col("t")), 60)).first()[0] is None


def test_windows_and_cleaning(spark):
    df = spark.createDataFrame([("\n".join(map(str, range(40))),)], "t string")
    w = df.select(F.explode(S.windows(S.lines_of(F.col("t")))).alias("w")).select("w.*").collect()
    assert [len(r.rows) for r in w] == [30, 19] and w[1].rows[:7] == ["0", "1", "2", "3", "4", "5", "27"]
    kept, dropped = S.clean_lines(S.lines_of(F.lit("a\n\n 12 \nb license c")), ["license"], [r"\d+$"])
    r = df.select(kept.alias("k"), dropped.alias("d")).first()
    assert r.k == ["a"] and [(x.line, x.rule) for x in r.d] == [("12", r"pattern \d+$"), ("b license c", "text license")]


def test_islands(spark, rows):
    df = spark.createDataFrame([("k", 1, "1", 1), ("k", 2, "1", 2), ("k", 3, "2", None), ("k", 4, "1", 1), ("k", 5, "1", 2)], "k string, n int, c string, part int")
    here = df.select("k", "n", F.struct("c", "part").alias("here"))
    got = S.islands(S.Ordered(here, ["k"], ["n"]).previous("here", "before"), (F.col("here.c") == F.col("before.c")) & (F.col("here.part") == F.col("before.part") + 1))
    assert rows(got, "n", "island") == [(1, 1), (2, 1), (3, 2), (4, 3), (5, 3)]
    df = spark.createDataFrame([("a1", 1, 1), ("a2", 1, 2), ("x", 2, None), ("b1", 2, 1), ("b2", 2, 2)], "id string, c int, part int").withColumn("n", F.monotonically_increasing_id()).withColumn("k", F.lit(1))
    here = df.select("k", "n", F.struct("c", "part").alias("here"))
    got = S.islands(S.Ordered(here, ["k"], ["n"]).previous("here", "before"), (F.col("here.c") == F.col("before.c")) & (F.col("here.part") == F.col("before.part") + 1))
    assert [r.island for r in got.orderBy("n").collect()] == [1, 1, 2, 3, 3]


def test_order_over_partitions(spark):
    random.seed(2)
    data = [(["a", "a", "a", "b", None][random.randrange(5)], i, random.choice([None, None, i])) for i in range(300)]
    df = spark.createDataFrame(data, "k string, n int, v int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ordered = S.Ordered(df, ["k"], ["n"])
        assert ordered.rows.select("_part").distinct().count() > 2
        got = ordered.carry(F.col("v"), "last").previous("v", "before").running(F.lit(1), "place").done().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    last, before, place, want = {}, {}, {}, set()
    for k, n, v in sorted(data, key=lambda r: r[1]):
        place[k] = place.get(k, 0) + 1
        last[k] = last.get(k) if v is None else v
        want.add((k, n, v, last[k], before.get(k), place[k]))
        before[k] = v
    assert {(r.k, r.n, r.v, r["last"], r.before, r.place) for r in got} == want


def test_near_pairs_against_all_pairs(spark):
    random.seed(4)
    words = list({"".join(random.choice("abc") for _ in range(random.randint(3, 9))) for _ in range(160)})
    a = spark.createDataFrame([(1, w) for w in words[:80]], "k int, word string")
    b = spark.createDataFrame([(1, w) for w in words[80:]] + [(2, words[0])], "k int, word string")
    got = {(r.word_1, r.word_2, r.distance) for r in G.near_pairs(a, b, ["k"]).collect()}

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row, last = [i], row
            for j, e in enumerate(y, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != e)))
        return row[-1]

    want = {(x, y, d) for x in words[:80] for y in words[80:] if len(x) >= 5 and len(y) >= 5 and x != y and (d := distance(x, y)) <= 2}
    assert got == want


def test_word_guards(spark):
    df = spark.createDataFrame([(["importer", "импортёр", "тест"], ["exporter", "импортёр", "exporter"], "importerte ст")], "a array<string>, b array<string>, s string")
    r = df.select(G.missing_words(F.col("a"), F.col("b"), F.col("s")).alias("m"), G.invented_words(F.col("b"), F.col("a"), F.col("s")).alias("i"), G.coverage(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2))).alias("c")).first()
    assert r.m == ["тест"] and r.i == ["exporter", "exporter"] and r.c == 0.5


def test_boxes(spark, rows):
    schema = "p int, box_id int, x0 double, y0 double, x1 double, y1 double"
    df = spark.createDataFrame([(1, 1, 0.1, 0.1, 0.3, 0.2), (1, 2, 0.1, 0.205, 0.3, 0.3), (1, 3, 0.7, 0.7, 0.9, 0.9), (2, 4, None, 0.0, 1.0, 1.0), (2, 5, 0.0, 0.0, 1.0, 1.0)], schema)
    merged = rows(B.merge_close(df, ["p"], 0.008), "p", "box_id", "x0", "y0", "x1", "y1", "n")
    assert merged == [(1, 1, 0.1, 0.1, 0.3, 0.3, 2), (1, 3, 0.7, 0.7, 0.9, 0.9, 1), (2, 5, 0.0, 0.0, 1.0, 1.0, 1)]
    twice = df.unionByName(df.where("box_id = 3").withColumn("box_id", F.lit(6)))
    assert rows(B.overlapping(twice, ["p"], 0.5), "id_1", "id_2", "iou") == [(3, 6, 1.0)]
    box = spark.range(1).select(B.normalize(F.lit(90.0), F.lit(10.0), F.lit(20.0), F.lit(-5.0)).alias("b")).first().b
    assert tuple(box) == (0.2, 0.0, 0.9, 0.1)


def test_words_of_all_alphabets_are_assigned_until_none_is_free(spark, tmp_path):
    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row, last = [i], row
            for j, e in enumerate(y, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != e)))
        return row[-1]

    first = "молодой Hалейте қышқылы crème wordab wordaa стабилизатор"
    second = "молотый Налейте қышкылы creme wordaс wordxy стабилизатоp"
    schema = "source_sha256 string, read_no int, region_id string, text string, region_key long"
    spark.createDataFrame([("s", 1, "r", first, 1), ("s", 2, "r", second, 2)], schema).write.parquet(str(tmp_path / "regions.parquet"))
    a, b = first.lower().split(), second.lower().split()
    edges = sorted((distance(x, y), x, y) for x in a for y in b if x != y and len(x) >= 5 and len(y) >= 5 and distance(x, y) <= 2)
    got = L.j17_near_words(spark, str(tmp_path)).collect()
    assert sorted((r.distance, r.word_1, r.word_2) for r in got) == edges
    want, used = set(), set()
    for n, x, y in edges:
        if ("a", x) not in used and ("b", y) not in used:
            used |= {("a", x), ("b", y)}
            want.add((x, y, n))
    best = L.j17_nearest(spark, str(tmp_path)).collect()
    assert {(r.word_1, r.word_2, r.distance) for r in best} == want
    assert ("wordab", "wordxy", 2) in want and ("wordaa", "wordaс", 1) in want
    assert {r.word_1 for r in best if r.kind == "homoglyph"} == {"hалейте", "стабилизатор"}


def test_every_later_read_and_every_block_is_compared(spark, tmp_path):
    schema = "source_sha256 string, read_no int, region_id string, text string, region_key long"
    data = [("s", 1, "r1", "склад їжа құқық", 1), ("s", 1, "r2", "только первый", 2), ("s", 2, "r1", "склад їжа құқық", 3), ("s", 2, "r3", "новый блок стоит здесь 12345", 4), ("s", 3, "r1", "склад", 5), ("s", 4, "r1", None, 6), ("t", 1, "r1", "один раз", 7)]
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "regions.parquet"))
    d = str(tmp_path)
    key = lambda r: (r.read_no, r.region_id)
    missing = {key(r): (r.missing, r.coverage) for r in L.j15_word_anti(spark, d).collect()}
    assert missing == {(2, "r1"): ("", 1.0), (2, "r2"): ("первый|только", 0.0), (2, "r3"): ("", None), (3, "r1"): ("їжа|құқық", 0.3333), (3, "r2"): ("первый|только", 0.0), (4, "r1"): ("склад|їжа|құқық", 0.0), (4, "r2"): ("первый|только", 0.0)}
    invented = {key(r): r.invented for r in L.j16_invented(spark, d).collect()}
    assert invented == dict.fromkeys(missing, "") | {(2, "r3"): "новый|блок|стоит|здесь|12345"}
    diff = {key(r): (r.only_first, r.only_second, r.common) for r in L.j30_diff(spark, d).collect()}
    assert diff[2, "r3"] == (0, 5, 0) and diff[3, "r1"] == (2, 0, 1)
    assert {key(r) for r in L.j18_digit_runs(spark, d).collect() if r.unconfirmed == "12345"} == {(2, "r3")}
    assert {key(r) for r in L.c05_assess(spark, d).collect() if "words invented" in r.reason} == {(2, "r3")}
    assert {(r.source_sha256, r.read_no): (r.n, r.manual) for r in L.c06_guards(spark, d).collect()} == {("s", 2): (3, 2), ("s", 3): (2, 2), ("s", 4): (2, 2)}
