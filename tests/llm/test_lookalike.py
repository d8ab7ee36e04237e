import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from clausework.llm.chars import canonical, skeleton, stable
from clausework.llm.lookalike import canonical_texts, look_alike_classes, look_alike_pairs


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="еёйaо́̈̆각각ÅK​Ａ１　x \n", max_size=30))
def test_stable_is_a_normal_form(text):
    out = stable(text)
    assert stable(out) == out and unicodedata.is_normalized("NFC", out)
    assert stable(unicodedata.normalize("NFD", text)) == out
    assert stable("​".join(text)) == stable(unicodedata.normalize("NFC", stable(text)))


def test_what_is_one_look_and_what_is_not():
    assert skeleton("СОСТАВ: е") == skeleton("COCTAB: e") == skeleton("ＣＯＣＴＡＢ：　e")
    assert skeleton("ﬂour­") == skeleton("flour")
    for a, b in (("еж", "ёж"), ("Соль", "соль"), ("a.", "a,"), ("a\nb", "a b"), ("5 г", "6 г"), ("№", "No"), ("2", "²")):
        assert skeleton(a) != skeleton(b)


def test_mixed_words_go_home():
    assert canonical("Соcтав yксyс") == "Состав уксус"
    assert canonical("Іngrédiеnts") == "Ingrédients"
    assert canonical("E322 и соль") == "E322 и соль"


def test_pairs_against_brute_force(spark):
    base = ["Соль", "Coль", "соль", "Со​ль", "", None, "　Соль", " Соль", "ＳＯＬＴ", "SОLT", "SALT"]
    data = [(i, ["s", "t", None][i % 3], base[i % len(base)], "clash") for i in range(150)] + [(0, "s", "Соль", "clash")]
    df = spark.createDataFrame(data, "region_key bigint, source_sha256 string, text string, skeleton string")
    got = {(r.key_1, r.key_2) for r in look_alike_pairs(df).collect()}
    ok = [(k, s, t) for k, s, t, _ in set(data) if s is not None and t]
    want = {(a[0], b[0]) for a in ok for b in ok if a[0] < b[0] and a[1] == b[1] and a[2] != b[2] and skeleton(a[2]) == skeleton(b[2])}
    assert got == want and want
    assert look_alike_pairs(df.limit(0)).count() == 0
    classes = {r.row_key: r for r in look_alike_classes(df).collect()}
    links = {k: sum(k in p for p in want) for p in want for k in p}
    assert {k: r.n_links for k, r in classes.items()} == links
    one = lambda k: min([k, *(x for p in want if k in p for x in p), *(o[0] for o in ok if any(o[1:] == m[1:] for m in ok if m[0] == k))])
    assert {k: r.class_id for k, r in classes.items()} == {k: one(k) for k in classes}


def test_many_copies_and_one_variant(spark):
    copies = spark.range(20000).selectExpr("id as region_key", "'s' as source_sha256", "'Состав' as text")
    df = copies.unionByName(spark.createDataFrame([(-5, "s", "Cостав"), (-6, "t", "Cостав")], "region_key bigint, source_sha256 string, text string"))
    pairs = look_alike_pairs(df)
    assert pairs.count() == 20000 and pairs.where("key_1 = -5").count() == 20000
    classes = look_alike_classes(df)
    assert classes.count() == 20001 and classes.where("class_id <> -5").count() == 0


def test_marks_on_letters_of_either_script():
    assert skeleton("ещё её") == skeleton("eщe\u0308 eё") and skeleton("їжа") == skeleton("ïжа")
    assert canonical("eщe\u0308") == "ещё"
    assert skeleton("ё") != skeleton("е")


def test_forms_of_nulls(spark, rows):
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "x" * 70000 + "​", 9)], "region_key bigint, text string, canonical int")
    got = {r.region_key: r for r in canonical_texts(df).collect()}
    assert got[1].canonical is None and got[2].skeleton == "" and got[3].canonical == "x" * 70000
