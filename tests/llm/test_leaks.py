import random

from clausework.llm import leaks as L

WORDS = "партию отгрузила причём на коробке закрыли наклейкой размером кто подпишет акт если отдел забраковал банок из".split()
ITEM = "Кто подпишет акт K6943-48, если отдел рекламы забраковал 256 банок из-за сухого молока, а ООО «Самсан» молчит с 21.03.2025?"


def brute(docs, items, run=L.RUN):
    out = set()
    for d, text in docs:
        stream = " ".join(L.read(text).split()) if text else ""
        squeezed, starts, ends = "", {0}, set()
        for w in stream.split():
            starts.add(len(squeezed))
            squeezed += w
            ends.add(len(squeezed))
        for i, item in items:
            words = L.read(item).split() if item else []
            for k in range(max(1, len(words) - run + 1)):
                window = "".join(words[k : k + run])
                at = squeezed.find(window) if window else -1
                while at >= 0:
                    if at in starts and at + len(window) in ends:
                        out.add((d, i))
                    at = squeezed.find(window, at + 1)
    return out


def find(docs, items, **more):
    w = L.Windows(items, **more)
    ids, found, _, _ = L._find_in_batch(w, [d for d, _ in docs], [t for _, t in docs])
    return set(zip(ids, found, strict=True))


def test_against_brute_force():
    random.seed(6)
    items = [(i, " ".join(random.choices(WORDS, k=random.randint(3, 30)))) for i in range(25)] + [(98, None), (99, "?!")]
    docs = []
    for d in range(300):
        text = random.choices(WORDS, k=random.randint(0, 60))
        if d % 2:
            source = random.choice(items[:25])[1].split()
            a = random.randint(0, len(source) - 1)
            text[random.randint(0, len(text)) :] = source[a : a + random.randint(1, 25)]
        docs.append((d, " ".join(text)))
    docs += [(1000, None), (1001, ""), (1002, "...")]
    want = brute(docs, items)
    assert find(docs, items) == want and len(want) > 20


def test_what_does_not_count():
    long = "Начало. " + ITEM + " Конец."
    forms = [
        long.upper(),
        long.replace(" ", "   "),
        long.replace("рекламы", "рек-\nламы"),
        long.replace("отдел", "<b>от</b>дел").replace("банок", "**банок**"),
        long.replace("а", "a").replace("о", "​o"),
        "\n> ".join(long.split()),
    ]
    for f in forms:
        assert find([(1, f)], [(7, ITEM)]) == {(1, 7)}
    assert find([(1, "MIT GROSSER STRASSE")], [(7, "mit großer Straße")]) == {(1, 7)}


def test_what_does_count():
    words = ITEM.split()
    broken = " слово ".join(" ".join(words[i : i + 5]) for i in range(0, len(words), 5))
    assert find([(1, broken)], [(7, ITEM)]) == set()
    assert find([(1, "отделы рекламы забраковали")], [(7, "отделы рекламы забраковал")]) == set()
    assert find([(1, " ".join(reversed(words)))], [(7, ITEM)]) == set()
    assert find([(1, words[0]), (2, " ".join(words[1:]))], [(7, "Кто подпишет")]) == set()


def test_edits_are_found_with_the_recall_asked_for():
    random.seed(8)
    items = [(i, " ".join(random.choices(WORDS, k=14))) for i in range(30)]
    docs = []
    for d in range(300):
        i, text = random.choice(items)
        at = random.randrange(len(text))
        docs.append((d, text[:at] + random.choice("абв") + text[at + 1 :], i))
    got = find([(d, t) for d, t, _ in docs], items, max_edits=2, recall=0.95)
    assert sum((d, i) in got for d, _, i in docs) >= 0.9 * len(docs)


def test_recall_with_every_kind_of_edit():
    random.seed(5)
    letters = "абвгдеиклмнопрст"
    kinds = {
        "replaced": lambda t, p: t[:p] + random.choice(letters) + t[p + 1 :],
        "inserted": lambda t, p: t[:p] + random.choice(letters) + t[p:],
        "deleted": lambda t, p: t[:p] + t[p + 1 :],
    }
    word = lambda: "".join(random.choices(letters, k=random.randint(3, 9)))
    items = [(i, " ".join(word() for _ in range(random.randint(12, 20)))) for i in range(60)]
    windows = L.Windows(items, max_edits=2)
    for first in kinds:
        for second in [None, *kinds]:
            docs = []
            for d in range(150):
                i, text = random.choice(items)
                text = " ".join(text.split()[:12])
                for kind in filter(None, (first, second)):
                    text = kinds[kind](text, random.choice([p for p, c in enumerate(text) if c != " "]))
                docs.append((d, f"{word()} {word()} {text} {word()} {word()}", i))
            ids, found, _, _ = L._find_in_batch(windows, [d for d, _, _ in docs], [t for _, t, _ in docs])
            got = set(zip(ids, found, strict=True))
            assert sum((d, i) in got for d, _, i in docs) >= 0.9 * len(docs), (first, second)


def test_distance_is_exact_for_what_meets():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    random.seed(9)
    items = [(i, " ".join(random.choices(WORDS, k=14))) for i in range(20)]
    docs = []
    for d in range(200):
        text = list(random.choice(items)[1])
        for _ in range(random.randint(0, 3)):
            text[random.randrange(len(text))] = random.choice("абв ")
        docs.append((d, "".join(text)))
    w = L.Windows(items, max_edits=2)
    ids, found, _, edits = L._find_in_batch(w, [d for d, _ in docs], [t for _, t in docs])
    by_item = {i: {t for t, of in zip(w.texts, w.items, strict=True) if i in of} for i, _ in items}
    least = {}
    for d, text in docs:
        words = L.read(text).split()
        runs = {"".join(words[a:b]) for a in range(len(words)) for b in range(a + 1, len(words) + 1)}
        for i, mine in by_item.items():
            least[d, i] = min(distance(x, r) for x in mine for r in runs if abs(len(x) - len(r)) <= 2) if any(abs(len(x) - len(r)) <= 2 for x in mine for r in runs) else 9
    assert all(e == least[k] for k, e in zip(zip(ids, found, strict=True), edits, strict=True))
    near = {k for k, e in least.items() if e <= 2}
    assert len(near) > 30 and len(near & set(zip(ids, found, strict=True))) >= 0.9 * len(near)


def test_short_windows_allow_fewer_edits():
    assert find([(1, "кот")], [(7, "кит")], max_edits=2) == set()
    assert find([(1, "кит")], [(7, "кит")], max_edits=2) == {(1, 7)}
    assert find([(1, "x")], [(8, None), (9, "?!")], max_edits=2) == set()


def test_rows(spark, rows):
    docs = spark.createDataFrame([(1, ITEM, 5), (1, ITEM, 5), (2, None, 5), (3, "", 5), (4, "иное " * 30000 + ITEM, 5)], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(7, ITEM, "ru", "a", "b"), (8, None, "ru", "a", "b"), (9, "нигде этого нет", "ru", "a", "b")], "item_id bigint, item_text string, lang string, category string, style string")
    leaks = L.leaked_items(docs, items)
    assert rows(leaks, "doc_id", "item_id") == [(1, 7), (4, 7)]
    assert rows(L.item_report(leaks, items), "item_id", "n_documents") == [(7, 2), (8, 0), (9, 0)]
    assert L.leaked_items(docs.limit(0), items).count() == L.leaked_items(docs, items.limit(0)).count() == 0
