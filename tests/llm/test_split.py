from hypothesis import given, settings
from hypothesis import strategies as st

from clausework.llm.split import cut_points, split_oversized

texts = st.text(alphabet="аб .;\n!)—🍓", min_size=0, max_size=400)


@settings(max_examples=300, deadline=None)
@given(texts, st.integers(5, 60), st.integers(0, 4))
def test_pieces_cover_the_text(text, limit, overlap):
    spans = cut_points(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b), (c, d) in zip(spans, spans[1:], strict=False):
        assert a < c <= b < d and b - c <= overlap
    assert all(b - a <= limit for a, b in spans)
    rebuilt, end = "", 0
    for a, b in spans:
        rebuilt += text[end:b]
        end = b
    assert rebuilt == text


def test_natural_ends_come_first():
    text = "Первое предложение. Второе предложение.\n" * 20
    spans = cut_points(text, 100, 20)
    assert all(text[b - 1] == "\n" for _, b in spans)
    assert cut_points("x" * 250, 100, 10) == [(0, 100), (90, 190), (180, 250)]
    words = cut_points("слово " * 60, 100, 20)
    assert all(b == 360 or ("слово " * 60)[b] == " " for _, b in words)


def test_rows(spark, rows):
    long = "Пункт. " * 1000
    df = spark.createDataFrame([("a", f"  {long} ", 1), ("a", f"  {long} ", 1), ("b", "short", 2), ("c", None, 3), ("d", "", 4), ("e", " \n\xa0", 5), ("f", "x" * 3500, 6)], "chunk_id string, text string, piece_no int")
    got = split_oversized(df)
    by = {}
    for r in got.orderBy("chunk_id", "piece_no").collect():
        by.setdefault(r.chunk_id, []).append(r)
    assert {k: len(v) for k, v in by.items()} == {"a": 3, "b": 1, "c": 1, "d": 1, "e": 1, "f": 1}
    assert by["c"][0].text is None and by["d"][0].text == by["e"][0].text == ""
    assert "".join(r.text[r.overlap :] for r in by["a"]) == long.strip()
    assert all(len(r.text) <= 3500 and r.overlap <= 200 for v in by.values() for r in v if r.text)
    assert split_oversized(df.limit(0)).count() == 0
