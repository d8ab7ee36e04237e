from pyspark.sql import functions as F

from clausework.functions import text as T


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first()[0]


def test_normal_forms(spark):
    assert one(spark, T.norm_text, "  Ёлка  и\nЁЖ ") == "елка и еж"
    assert one(spark, T.question_key, "Где «E511»?") == "где e511"
    assert one(spark, T.norm_text, None) is None


def test_codes_and_tokens(spark):
    assert one(spark, T.additive_codes, "эмульгатор E322, Е 471 и краситель е160a; вода, E322") == ["е322", "е471", "е160а"]
    assert one(spark, T.tokens, "E511 e") == one(spark, T.tokens, "Е511 e") == ["е511", "e"]
    assert one(spark, T.digit_runs, "4607070 255215 и 123") == ["4607070255215"]


def test_numbers_times_hashes(spark):
    assert one(spark, T.number, "1,6") == 1.6 and one(spark, T.number, "x") is None
    assert str(one(spark, T.parse_time, "2024-05-01T10:20:30.5")) == "2024-05-01 10:20:30" and one(spark, T.parse_time, "1.5.24") is None
    assert len(one(spark, lambda x: T.short_hash(x, F.lit("a")), "b")) == 16


def test_ean13(spark):
    for code in ("4607070255215", "8805957025951"):
        assert one(spark, T.ean13_digit, code[:12]) == int(code[12])


def test_scripts_and_tails(spark):
    assert one(spark, T.is_mixed_script, "мaма") is True and one(spark, T.is_mixed_script, "мама") is False
    assert one(spark, T.fold_look_alikes, "Mолоко") == "Молоко"
    assert one(spark, T.tail_sentence, "Первое предложение было здесь. Да.") == "Первое предложение было здесь. Да."


def test_queries_take_the_whole_text(spark, tmp_path):
    from clausework.plans import layout, text

    d = str(tmp_path)
    spark.createDataFrame([(1, "Їжа, що є"), (2, "жа що"), (3, "ЇЖА,  що є")], "doc_id int, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "құқықтар crème Größe")], "region_key int, text string").write.parquet(f"{d}/regions.parquet")
    spark.createDataFrame([("a:1", "Перше речення. Їжа зберігається — у «сухому» місці за кімнатної температури.")], "chunk_id string, text string").write.parquet(f"{d}/chunks.parquet")
    md5 = {r.doc_id: r.norm_md5 for r in text.f01_norm(spark, d).collect()}
    assert md5[1] == md5[3] != md5[2]
    assert md5[1] == __import__("hashlib").md5("їжа, що є".encode()).hexdigest()
    assert text.f05_words(spark, d).first().n_words == 3
    assert layout.t07_tail_sentence(spark, d).first().tail == "Їжа зберігається — у «сухому» місці за кімнатної температури."
