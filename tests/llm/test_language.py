import random

from pyspark.sql import functions as F

from clausework.llm import language as L

SENTENCES = {
    "ru": ["Изготовитель обязан указать состав продукта на лицевой стороне упаковки крупным шрифтом.", "После вскрытия томатная паста хранится не дольше четырнадцати суток в сухом месте."],
    "uk": ["Виробник зобов'язаний вказати склад продукту на лицьовому боці упаковки великим шрифтом.", "Після відкриття томатна паста зберігається не довше чотирнадцяти діб у сухому місці."],
    "en": ["The manufacturer must print the list of ingredients on the front of the pack in bold.", "After opening, the tomato paste keeps for fourteen days in a dry and cool place."],
    "de": ["Der Hersteller muss die Liste der Zutaten auf der Vorderseite der Packung fett drucken.", "Nach dem Öffnen ist das Tomatenmark trocken gelagert noch vierzehn Tage haltbar."],
    "fr": ["Le fabricant doit imprimer la liste des ingrédients sur la face avant de façon lisible.", "Après ouverture, le concentré de tomate se garde quatorze jours dans un endroit sec."],
}


def corpus(n=400):
    random.seed(3)
    out = []
    for i in range(n):
        lang = random.choice(list(SENTENCES))
        parts = [random.choice(SENTENCES[lang]) for _ in range(random.randint(1, 4))]
        label = lang if random.random() > 0.1 else random.choice(["ru", "en", "", None, "und"])
        foreign = None
        if i % 5 == 0:
            foreign = random.choice([x for x in SENTENCES if x != lang])
            parts.insert(random.randint(0, len(parts)), random.choice(SENTENCES[foreign]))
        out.append((i, " ".join(parts), label, f"s{i % 7}" if i % 11 else None, lang, foreign))
    return out


def test_languages_and_segments(spark):
    data = corpus()
    df = spark.createDataFrame([(a, b, c, d, "x") for a, b, c, d, _, _ in data] + [(1001, None, "ru", "s1", "x"), (1002, " ", None, "s1", "x"), (1003, "12,5|7 %", "en", None, "x")], "doc_id bigint, text string, lang string, source string, confidence string")
    segments = L.language_segments(df).cache()
    by = {}
    for r in segments.collect():
        by.setdefault(r.doc_id, []).append(r)
    right = sum(set(r.lang for r in by[i]) == {lang, foreign or lang} for i, _, _, _, lang, foreign in data)
    assert right >= 0.97 * len(data)
    assert all(0.0 <= r.confidence <= 1.0 for v in by.values() for r in v)
    for i in (1001, 1002, 1003):
        assert len(by[i]) == 1 and by[i][0].lang is None and by[i][0].confidence == 0.0
    found = {(r.doc_id, r.lang) for r in L.foreign_languages(segments).collect()}
    want = set()
    for i, _, label, _, lang, foreign in data:
        want |= {(i, x) for x in (lang, foreign) if x and x != (label or None)}
    assert len(found ^ want) <= 0.03 * len(want)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")
    assert L.language_segments(df).count() == 0


def test_labels(spark):
    labels = ["ru", "RU", "ru-RU", "rus", "русский", "Russian", "UK", "uk-UA", "en_US", "English", "kaz", "und", "zxx", "-", "", None, "n/a", "es-MX"]
    df = spark.createDataFrame([(x,) for x in labels], "l string").select("l", L.language_of_label(F.col("l")).alias("x"))
    assert [r.x for r in df.collect()] == ["ru"] * 6 + ["uk", "uk", "en", "en", "kk"] + [None] * 6 + ["es"]


def test_sentences():
    assert len(L.sentences("Дата 25.10.2024 и 3.5 мм. Вторая фраза.\n\nТретья")) == 3
    assert len(L.sentences("one serving is small. it keeps well.")) == 2
    assert L.words_of("Партия K12-3, 45 г") == ["партия", "k12-3", "г"]


def test_priors_are_shrunk_to_the_group(spark):
    data = []
    for i in range(600):
        group = ["kz", "de"][i % 2]
        data.append((i, " ".join(random.Random(i).sample(SENTENCES["ru" if group == "kz" else "de"], 2)), "ru" if group == "kz" else "de", f"host{i % 40}.{group}", group))
    data += [(9001, "Контракт", None, "new.kz", "kz"), (9002, "Kontrakt", None, "new.de", "de")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, source_group string")
    rows = df.select("doc_id", "text", L.language_of_label(F.col("lang")).alias("labelled"), "source", "source_group")
    evidence = L._evidence(rows, L.fit_model(rows))
    priors, _ = L._priors(evidence)
    of = {r.source: r.prior for r in priors.collect()}
    ru, de = L.LANGUAGES.index("ru"), L.LANGUAGES.index("de")
    assert of["host0.kz"][ru] > 0.9 and of["host1.de"][de] > 0.9
    # a host of one document has the prior of its group, not that of the corpus
    assert of["new.kz"][ru] > 0.85 and of["new.de"][de] > 0.85


def test_salted_priors_are_the_same(spark):
    data = corpus(120)
    df = spark.createDataFrame([(a, b, c, d) for a, b, c, d, _, _ in data], "doc_id bigint, text string, lang string, source string")
    rows = df.select("doc_id", "text", L.language_of_label(F.col("lang")).alias("labelled"), "source", F.lit(None).cast("string").alias("source_group"))
    evidence = L._evidence(rows, L.fit_model(rows)).cache()
    priors, _ = L._priors(evidence)
    sent, salted = (sorted(map(str, L._with_priors(evidence, priors, most).collect())) for most in (10**6, 0))
    assert sent == salted and len(sent) == 120


def test_slices_by_bytes():
    import pyarrow as pa

    from clausework.llm.arrow import per_batch

    batch = pa.RecordBatch.from_pydict({"k": list(range(7)), "t": ["x" * 10, None, "y" * 90, "z" * 5, "", "w" * 200, "v"]})
    parts = list(per_batch(lambda b: b, rows=3, size=100)([batch, batch.slice(0, 0)]))
    assert [k for p in parts for k in p["k"].to_pylist()] == list(range(7))
    assert all(p.num_rows <= 3 for p in parts) and [p["k"].to_pylist() for p in parts if p.num_rows and (p["t"].to_pylist()[0] or "")[:1] == "w"] == [[5]]
