import random

from clausework.llm import scans as S

BODY = ["Изготовитель подтверждает состав продукта протоколом испытаний, оформленным заранее.", "Образцы хранятся в сухом месте, а формула приводится без скобок.", "Надписи выполняются чётко и не закрываются элементами оформления упаковки.", "Требование пункта не распространяется на продукцию для собственных нужд."]
HEADER = "Собрание правил Союза"


def wrap(text, width=60):
    lines, line = [], ""
    for w in text.split():
        if line and len(line) + 1 + len(w) > width:
            lines.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return [*lines, line]


def corpus():
    random.seed(1)
    rows, truth = [], {}
    for d in range(12):
        scanned = d % 2
        for k in range(20):
            lines = wrap(" ".join(random.choice(BODY) for _ in range(6)))
            kinds = set()
            if scanned and k % 4 == 0:
                lines.insert(len(lines) // 2, HEADER if k % 8 else f"{HEADER}   стр. {k}")
                kinds.add("header")
            if scanned and k % 5 == 1:
                lines.insert(2, random.choice([f"- {k} -", f"Страница {k} из 90", str(k)]))
                kinds.add("page")
            if scanned and k % 3 == 2:
                i = next(i for i, x in enumerate(lines[1:], 1) if x[:1].islower() and len(x.split()[0]) > 7 and not S.is_page_line(lines[i - 1]) and HEADER not in lines[i - 1])
                w = lines[i].split()[0]
                lines[i - 1] += " " + w[:4] + random.choice("-¬­")
                lines[i] = w[4:] + lines[i][len(w) :]
                kinds.add("hyphen")
            text = "\n".join(lines)
            if scanned and k % 6 == 3:
                for a, b in random.sample([("скобок", "ск0бок"), ("продукта", "пpодукта"), ("формула", "форнула"), ("месте", "rnесте")], 4):
                    if a in text:
                        text = text.replace(a, b, 1)
                        kinds.add("misread")
                        break
            rows.append((f"doc{d}:{k:04d}", text, False, f"П {d}", "Об упаковке", "x"))
            truth[f"doc{d}:{k:04d}"] = kinds
    return rows, truth


SCHEMA = "chunk_id string, text string, is_table boolean, regulation_id string, regulation_name string, noise string"


def test_planted_noise_is_found_and_repaired(spark):
    data, truth = corpus()
    df = spark.createDataFrame(data + [("z:0000", None, None, None, None, "x"), ("z:0001", "", None, None, None, "x"), data[3]], SCHEMA)
    got = {r.chunk_id: r for r in S.repair_scans(df).collect()}
    assert {k: set(v.noise) for k, v in got.items() if k[0] == "d"} == truth
    assert got["z:0000"].text is None and got["z:0001"].text == "" and got["z:0000"].noise == []
    whole = {w for s in BODY for w in s.split()}
    for k, r in got.items():
        if k[0] == "d":
            assert set(r.text.split()) <= whole and r.text.count(" ") > 30


def test_empty_table(spark):
    assert S.repair_scans(spark.createDataFrame([], SCHEMA)).count() == 0


def test_page_lines():
    for line in ("5", "- 32 -", "— 33 —", "стр. 19", "Страница 14 из 206", "26 / 50", "[46]", "   20", "с. 7"):
        assert S.is_page_line(line), line
    for line in ("29.", "40,9 мг", "№ 75-", "47/2021", "- 32", "100г", "", "мм."):
        assert not S.is_page_line(line), line


def test_words_and_codes():
    known = {"содержание": 5000, "пункта": 900, "какао-порошка": 500, "мука": 100, "муки": 3000, "л": 10}
    reader = S.Reader(known)
    assert [reader.right(w) for w in ("с0держание", "еодержание", "пуl-lкта", "пунк7а")] == ["содержание", "содержание", "пункта", "пункта"]
    assert [reader.right(w) for w in ("мука", "100г", "3-й", "ph-метром", "зумямуска", "e322")] == [None] * 6
    kept, divided = S.join_divided(["гиб-", "3", "рида и", "прибор A5-", "98 цел"], [None, "page", None, None, None])
    assert divided and kept == ["гибрида", "и", "прибор A5-", "98 цел"]


def test_misread_words_follow_the_exact_counts(spark):
    known = {"испытаниях": 16, "испьпаниях": 1, "испытанияx": 1, "плёнок": 23, "плёпок": 300, "масел": 15, "мясел": 1, "м0сел": 1, "содержание": 5000, "содержпние": 20, "содержвние": 26, "форнула": 2, "формула": 41, "ск0бок": 1, "скобок": 15, "пуl-lкта": 1, "пункта": 900, "e322": 7}
    filler = {f"слово{c}": 10**7 for c in "абв"}  # the size of the corpus changes nothing
    for words in (known, known | filler):
        got = {r.word: r.right for r in S.misread_words(spark.createDataFrame(list(words.items()), "word string, n bigint")).collect()}
        reader = S.Reader(words)
        assert got == {w: right for w in words if (right := reader.right(w))}
        assert got["испытанияx"] == "испытаниях" and got["ск0бок"] == "скобок" and got["содержпние"] == "содержание"
        assert "плёнок" not in got and "содержвние" not in got


def test_compounds_and_bare_values_stay(spark):
    texts = ["Масса какао-порошка и двух- или трёх слоёв указана в ведомости", "Масса какао-\nпорошка указана в ведо-\nмости и двух-\nили трёх слоёв"]
    texts += [f"Текст пункта стоит здесь\n{n}\nи идёт дальше" for n in (3, 2016, 4, 5, 1, 7)]
    df = spark.createDataFrame([(f"d:{i:04d}", t) for i, t in enumerate(texts)] + [("e:0000", "Год\n1999\nстоит один")], "chunk_id string, text string")
    got = {r.chunk_id: r for r in S.repair_scans(df).collect()}
    assert got["d:0001"].noise == ["hyphen"] and got["d:0001"].text == "Масса какао-порошка указана в ведомости и двух- или трёх слоёв"
    assert {k for k, r in got.items() if "page" in r.noise} == {"d:0002", "d:0004", "d:0005", "d:0007"}
    assert "2016" in got["d:0003"].text and "1999" in got["e:0000"].text


def test_right_forms_by_a_join_are_the_same(spark):
    data, _ = corpus()
    df = spark.createDataFrame(data, SCHEMA)
    sent, joined = (sorted((r.chunk_id, tuple(r.noise), r.text) for r in S.repair_scans(df, most).collect()) for most in (S.MOST_SENT, 0))
    assert sent == joined and any("misread" in x for _, x, _ in joined) and any("hyphen" in x for _, x, _ in joined)


def test_headers_misread_in_every_chunk_are_repeated(spark):
    forms = ["Собрание правил Союза", "С0брание правил Союза", "Собрапие правил Союза", "Собрание праввл Союза"]
    body = "изготовитель подтверждает состав продукта протоколом испытаний\nи хранит его в сухом месте не менее трёх лет со дня выпуска"
    rows = [(f"d:{i:04d}", f"1. Первый пункт, {body}\n{f}\nи далее {body}.", False, None, None, "x") for i, f in enumerate(forms)]
    got = {r.chunk_id: r for r in S.repair_scans(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all("header" in r.noise and "Союза" not in r.text for r in got.values())
    assert S.header_look("С0брание правил Союза") == S.header_look("Собрапие правил Союза") != S.header_look("Собрание законов Союза")


def test_a_header_with_a_wrong_letter_at_each_end():
    headers = S.Headers(["собрание правил союза и сообщества"])
    assert S.is_header_line("Сорание правил Союза и сообществв", headers, "", "")
    assert not S.is_header_line("Собрание жителей дома и соседей", headers, "", "")


def test_many_copies_and_a_chunk_without_position(spark):
    rows = [("d:0001", "Текст пункта о со-\nставе продукта", False, None, None, "x")] * 40 + [("nopos", "Состав продукта", None, None, None, "x"), (None, "Состав", None, None, None, "x")]
    got = S.repair_scans(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 3 and {r.chunk_id: r.noise for r in got}["d:0001"] == ["hyphen"]
