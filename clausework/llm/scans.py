"""Repair of text from scanned pages: running headers, page numbers, divided words, misread letters.

Headers are lines that stand alone, as at the edge of a page, and come again in other chunks of the same document,
each letter counted as any other that a scanner takes for it; page numbers rise along the document; what a divided or
misread word should be is decided by the vocabulary of the whole corpus.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import reduce
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread
from .arrow import per_batch

#: A line is a header of its document if it stands alone in so many chunks of it.
HEADER_CHUNKS = 2
#: Part of a header's letters that a cut-off line must still have; likeness that a garbled one must have.
HEADER_PART, HEADER_LIKE = 0.45, 0.88
#: How many times more frequent the right word must be: for look-alike letters, and for any one letter.
LIKELY, SURE = 20, 200
LEAST_COUNT = 15
#: Chunks of one document that are repaired in one task.
DOCUMENT_BLOCK = 5000
#: Right forms of misread and divided words that are sent to all tasks; with more of them each chunk gets its own by a join.
MOST_SENT = 500_000
#: What a scanner writes for one letter. First groups of signs, then single signs, then letters of
#: the same alphabet that resemble each other.
GROUPS = [(")(", "ж"), ("l-l", "н"), ("rn", "м"), ("ii", "й"), ("io", "ю"), ("ьi", "ы"), ("/i", "л"), ("|1", "и"), ("|", "л")]
SINGLES = dict(zip("0873465acekmopxyhtbiA", "овтзчбзасекморхунтвіа", strict=False)) | {"5": "б", "9": "д"}
ALIKE = [("и", "н"), ("с", "е"), ("л", "п"), ("м", "н"), ("г", "т"), ("д", "л"), ("ц", "п"), ("ш", "щ"), ("з", "э"), ("ь", "ъ"), ("о", "а"), ("н", "п"), ("и", "й"), ("б", "в"), ("ё", "е")]
_PAGE = re.compile(
    r"^\s*(?P<open>[-–—\[(]\s*)?(?:(?:стр|страница|с|лист|л|page|p|seite|бет)\b\.?\s*)?\d{1,4}(?:\s*(?:из|of|von)\s*\d{1,4}|\s+/\s+\d{1,4})?(?P<close>\s*[-–—\])])?\s*$",
    re.IGNORECASE,
)
_NUMBER_LEFT = re.compile(r"^\d{1,5}\s{2,}")
_NUMBER_RIGHT = re.compile(r"\s{2,}(?:(?:стр|страница|с|лист|л|page|p)\b\.?\s*)?\d{1,5}$", re.IGNORECASE)
_ENDS = re.compile(r"[.;:!?,»)]\s*$")
_STOP = re.compile(r"[.!?:]\s*$")
_TITLE_START = re.compile(r"^[«\"„(]?(?=[^\W\d_a-zа-яё])[^\W\d_]{2,}(?!\w)|^[«\"„(]?[^\W\d_a-zа-яё] ")
_HYPHENS = {"-", "\u00ac", "\u2010", "\u00ad"}
_CONTINUES = re.compile(r"^\s*[^\W_]?[a-zа-яё|/0-9]")
_WORD = re.compile(r"(?:\)\((?=\w)|[^\s«»\"“”„(),;:!?])+")
_SIGNS = ".-—–'"
_WORD_END, _WORD_START = re.compile(r"\w+\Z"), re.compile(r"\w+")
_CYRILLIC = re.compile("[а-яё]")
_STRANGE = re.compile("[a-z0-9|/()]")
_ENTRY = re.compile(r"^\s*(?:\d+(?:\.\d+)*[.)]|[а-яёa-z]\)|[-–—•]\s|Приложение\b)")
_WITHIN = {}
for _a, _b in ALIKE:
    _WITHIN.setdefault(_a, []).append(_b)
    _WITHIN.setdefault(_b, []).append(_a)


def _classes_of_letters() -> dict[int, str]:
    """Each letter as one letter for all that a scanner may take it for."""
    of: dict[str, str] = {}
    for a, b in ALIKE:
        for c in [c for c, x in of.items() if x == of.get(b, b)] + [b]:
            of[c] = of.get(a, a)
    return {ord(c): x for c, x in of.items()}


_OF_CLASS = _classes_of_letters()
_INSIDE = re.compile(r"(?<=[^\W\d_])[0-9|]+|[0-9|]+(?=[^\W\d_])")


def is_page_line(line: str) -> bool:
    """A line that holds a page number only, with or without words for page, bars or brackets."""
    m = _PAGE.match(line) if len(line) <= 60 else None
    return m is not None and (m["open"] is None) == (m["close"] is None)


def header_key(line: str) -> str:
    """The line without a page number at its ends, digits masked, in lower case."""
    line = _NUMBER_RIGHT.sub("", _NUMBER_LEFT.sub("", line.strip()))
    return re.sub(r"\d+", "#", line).lower()


def _unscanned(line: str) -> str:
    """The line with digits inside words as the letters that they stand for."""
    return _INSIDE.sub(lambda m: "".join(SINGLES.get(c, c) for c in m[0]), line)


def header_look(line: str) -> str:
    """The key of a line in which letters that a scanner mixes up are one letter."""
    line = _NUMBER_RIGHT.sub("", _NUMBER_LEFT.sub("", line.strip())).lower()
    for group, letter in GROUPS:
        line = line.replace(group, letter)
    line = _unscanned(line)
    line = "".join(SINGLES.get(c, c) if "a" <= c <= "z" else c for c in line)
    return re.sub(r"\d+", "#", line).translate(_OF_CLASS)


def _letters(text: str) -> str:
    return re.sub(r"[\W\d_]+", "", text.lower())


def standing_lines(text: str, is_table: bool) -> dict[str, tuple[int, int, str | None]]:
    """For each key that could be a header: (occurrences, those that stand alone, the key's look if any does).

    A line stands alone if the text does not flow through it. It does flow where a stop ends the line or there was
    no room for the next word, and where the line starts a sentence that the next line goes on with. The first
    line of a table is its own head, and a line of cells is none. A page number beside it sets a line apart.
    """
    lines = text.split("\n")
    content = [i for i, line in enumerate(lines) if line.strip() and not is_page_line(line)]
    width = median(len(lines[i]) for i in content) if content else 0
    out: dict[str, tuple[int, int, str | None]] = {}
    for n, i in enumerate(content):
        line = lines[i].strip()
        bare = _NUMBER_RIGHT.sub("", _NUMBER_LEFT.sub("", line))
        if "|" in line or not 8 <= len(line) <= 150 or not _TITLE_START.match(bare):
            continue
        numbered = bare != line
        alone = not (n == 0 and is_table) and (numbered or not _ENDS.search(bare) or bare.startswith("«"))
        if alone and n + 1 < len(content) and not numbered:
            following = lines[content[n + 1]].strip()
            before = lines[content[n - 1]] if n else ""
            sentence = (not n or _STOP.search(before)) and following[:1].islower() and not _ENTRY.match(following)
            alone = "|" in following or (not sentence and len(line) + 1 + len(following.split()[0]) <= width)
        key = header_key(line)
        a, b, look = out.get(key) or (0, 0, None)
        out[key] = a + 1, b + alone, look or (header_look(line) if alone else None)
    return out


_LINES = pa.schema(
    [("document", pa.string()), ("chunk_id", pa.string()), ("text_hash", pa.int64()), ("position", pa.string()), ("key", pa.string()), ("look", pa.string())]
    + [("n", pa.int32()), ("alone", pa.int32()), ("line", pa.int32()), ("number", pa.int32()), ("bare", pa.bool_())]
)


def special_lines(chunks: DataFrame) -> DataFrame:
    """The lines of each chunk that may be headers (with a ``key``) or page numbers (with a ``number``), written once.

    ``chunks``: ``chunk_id``, ``document``, ``text``, ``text_hash``, ``is_table``. One pass over the texts.
    """

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for *key, text, is_table in zip(*(batch[c].to_pylist() for c in ("document", "chunk_id", "text_hash", "position", "text", "is_table")), strict=True):
            out.extend((*key, k, look, n, alone, None, None, None) for k, (n, alone, look) in standing_lines(text, bool(is_table)).items())
            out.extend((*key, None, None, None, None, i, int(re.search(r"\d+", x)[0]), x.strip().isdigit()) for i, x in enumerate(text.split("\n")) if is_page_line(x))
        columns = list(zip(*out, strict=True)) or [[]] * len(_LINES)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _LINES.types, strict=True)], _LINES.names)

    rows = spread(chunks.where("text is not null and text <> ''").select("document", "chunk_id", "text_hash", F.regexp_extract("chunk_id", r":([^:]*)$", 1).alias("position"), "text", "is_table"))
    schema = "document string, chunk_id string, text_hash bigint, position string, key string, look string, n int, alone int, line int, number int, bare boolean"
    return cut(rows.mapInArrow(per_batch(find), schema).distinct())


def document_headers(lines: DataFrame) -> DataFrame:
    """(document, headers): the keys of the running headers of each document that has any. ``lines``: :func:`special_lines`.

    Lines of one look are counted together, so that a header that is misread here and there is repeated all the same.
    Looks are counted by (document, look) before anything is gathered; what is gathered is a few keys a document.
    """
    keys = lines.where("key is not null").groupBy("document", "key").agg(F.max("look").alias("look"), F.count("*").alias("n_chunks"), F.sum("n").alias("n"), F.sum("alone").alias("alone"))
    looks = keys.where("look is not null").groupBy("document", "look").agg(F.sum("n_chunks").alias("n_chunks"), F.sum("n").alias("n"), F.sum("alone").alias("alone"), F.collect_set("key").alias("keys"))
    headers = looks.where((F.col("n_chunks") >= HEADER_CHUNKS) & (F.col("alone") >= HEADER_CHUNKS) & (2 * F.col("alone") >= F.col("n")))
    return headers.groupBy("document").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("keys")))).alias("headers"))


class Headers:
    """The headers of a document, made ready for comparison."""

    def __init__(self, keys: list[str]):
        self.keys = set(keys)
        self.known = [(x, Counter(x)) for x in sorted({_letters(k) for k in keys})]

    def like(self, letters: str) -> bool:
        """True if the letters are a header cut off, or one with a few letters misread."""
        counts = None
        for known, of_known in self.known:
            if len(letters) >= max(8, HEADER_PART * len(known)) and known.startswith(letters):
                return True
            if abs(len(known) - len(letters)) > 0.15 * len(known):
                continue
            counts = counts or Counter(letters)
            if _alike(known, letters, HEADER_LIKE, of_known, counts):
                return True
        return False


def is_header_line(line: str, headers: Headers, title: str, reverse_title: str) -> bool:
    """One of the document's headers, whole, cut off or garbled; or a line of its number and name only."""
    first = line.lstrip(" \t0123456789«\"„(")[:1]
    if not first.isupper() or "|" in line:
        return False
    if not headers.keys and not title:
        return False
    key = header_key(line)
    if len(key) < 8:
        return False
    if key in headers.keys:
        return True
    letters = _letters(key)
    for known in (title, reverse_title):
        if len(known) >= 12 and len(letters) >= HEADER_PART * len(known) and (known.startswith(letters) or (abs(len(known) - len(letters)) <= 0.15 * len(known) and _alike(known, letters, HEADER_LIKE + 0.05, Counter(known), Counter(letters)))):
            return True
    if not headers.known:
        return False
    plain = _unscanned(line.strip().lstrip("0123456789 "))
    return _TITLE_START.match(plain) is not None and headers.like(_letters(plain) if plain != line else letters)


def _alike(known: str, letters: str, least: float, of_known: Counter[str], of_letters: Counter[str]) -> bool:
    """Likeness of at least ``least``; letters that both have in any order bound it from above and spare most lines the comparison."""
    both = sum(min(n, of_letters[c]) for c, n in of_known.items())
    return 2 * both >= least * (len(known) + len(letters)) and SequenceMatcher(None, known, letters).ratio() >= least


def _divided(line: str) -> bool:
    """True if the line ends with a letter and a hyphen of any kind."""
    end = line.rstrip()
    return end[-1:] in _HYPHENS and end[-2:-1].isalpha()


def _last_word(line: str) -> re.Match | None:
    return next(reversed(list(_WORD.finditer(line))), None)


def join_divided(lines: list[str], noise: list[str | None], choose: Callable[[str, str], str | None] = lambda a, b: "") -> tuple[list[str], bool]:
    """The lines without noise, divided words joined to the line they begin on; whether there was one.

    ``choose`` gets the two parts in lower case and gives what stands between them: nothing, the word's own hyphen,
    or a hyphen and a blank where they are two words and stay on their lines; None leaves both parts out. Signs that
    only divide (¬ and the soft hyphen) are not asked about, except to leave the parts out.
    """
    kept = [line for line, kind in zip(lines, noise, strict=True) if kind is None]
    divided, k = False, 0
    while k < len(kept):
        m = _divided(kept[k])
        after = next((j for j in range(k + 1, len(kept)) if kept[j].strip()), None) if m else None
        if after is not None and _CONTINUES.match(kept[after]):
            first, _, rest = kept[after].lstrip().partition(" ")
            if _CYRILLIC.search(first.lower()) or not any(c.isdigit() for c in first):
                stem, sign = kept[k].rstrip()[:-1], kept[k].rstrip()[-1]
                last, begin = _last_word(stem), _WORD.search(first)
                between = choose(last[0].lower().strip(_SIGNS), begin[0].lower().strip(_SIGNS)) if last and begin else ""
                if sign not in "-\u2010":
                    between = between and ""
                if between == "- ":
                    k += 1
                    continue
                divided |= between == ""
                kept[k] = stem[: last.start()] if between is None else stem + between + first
                if rest.strip():
                    kept[after] = rest
                else:
                    del kept[after]
                if _divided(kept[k]):
                    continue
        k += 1
    return kept, divided


def page_numbers(lines: DataFrame) -> DataFrame:
    """(document, chunk_id, text_hash, line): the bare numbers that are page numbers. ``lines``: :func:`special_lines`.

    They must belong to the longest sequence of numbers of page lines that does not fall over the chunks of the
    document, in the order of position and line; a number alone in its document is none. What is gathered for a
    document is a few numbers.
    """

    def rising(group: pa.Table) -> pa.Table:
        group = group.sort_by([(x, "ascending") for x in ("number_at", "position", "chunk_id", "text_hash", "line")])
        numbers, ends, at, before = group["number"].to_pylist(), [], [], []
        for i, n in enumerate(numbers):
            k = bisect_right(ends, n)
            before.append(at[k - 1] if k else -1)
            ends[k : k + 1], at[k : k + 1] = [n], [i]
        kept, i = [], at[-1]
        while i >= 0:
            kept.append(i)
            i = before[i]
        return group.take(pa.array(kept if len(kept) > 1 else [], pa.int64())).select(["document", "chunk_id", "text_hash", "line", "bare"])

    numbers = lines.where("number is not null").select("document", "chunk_id", "text_hash", "position", "line", "number", "bare", F.expr("try_cast(position as bigint)").alias("number_at"))
    pages = numbers.groupBy("document").applyInArrow(rising, "document string, chunk_id string, text_hash bigint, line int, bare boolean")
    return pages.where("bare").drop("bare")


def words_in(text: str) -> list[str]:
    """Words with a letter, in lower case, signs inside kept."""
    return [w for w in map(_core, _WORD.findall(text.lower())) if w]


def _core(raw: str) -> str:
    """The word in a token, or nothing."""
    w = raw.strip(_SIGNS)
    return w if len(w) > 1 and any(map(str.isalpha, w)) else ""


def _tokens(text: str) -> tuple[list[str], list[str], list[str]]:
    """(tokens between blanks, divided words, pairs of words with a hyphen and a blank) of a text, as they are counted.

    A divided word is its two parts with a line end between them and no token. Words never go over a blank: they are
    taken from the distinct tokens.
    """
    parts: list[str] = []
    lines = text.split("\n")
    kept, _ = join_divided(lines, ["page" if is_page_line(x) else None for x in lines], lambda a, b: parts.append(f"{a}\n{b}"))
    whole = "\n".join(kept).lower()
    pairs, at = [], whole.find("- ")
    while at >= 0:
        a, b = _WORD_END.search(whole, max(whole.rfind(" ", 0, at), 0), at), _WORD_START.match(whole, at + 2)
        if a and b:
            pairs.append(f"{a[0]}- {b[0]}")
        at = whole.find("- ", at + 2)
    return whole.split(), parts, pairs


def word_counts(chunks: DataFrame) -> DataFrame:
    """(word, n): every word of the corpus with its exact count, summed before the shuffle and written once.

    Divided words are not counted: they are rows of count 0 (joined), and their parts with a line end between them
    are rows too; so are pairs of words with a hyphen and a blank between them.
    """

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw: Counter[str] = Counter()
        out: Counter[str] = Counter()
        for text in batch["text"].to_pylist():
            tokens, parts, pairs = _tokens(text)
            raw.update(tokens)
            out.update(pairs)
            for both in parts:
                out[both] += 1
                if word := _core(both.replace("\n", "")):
                    out[word] += 0
        for token, n in raw.items():
            for w in _WORD.findall(token):
                if word := _core(w):
                    out[word] += n
        return pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], ["word", "n"])

    words = spread(chunks.where("text is not null and text <> ''").select("text")).mapInArrow(per_batch(count), "word string, n bigint")
    return cut(words.groupBy("word").agg(F.sum("n").alias("n")))  # read several times


def chunk_corrections(rows: DataFrame, right: DataFrame) -> DataFrame:
    """(document, block, chunk_id, text_hash, word, right): the corrections of the words that each chunk has, by a join."""

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for *key, text in zip(*(batch[c].to_pylist() for c in ("document", "block", "chunk_id", "text_hash", "text")), strict=True):
            tokens, parts, _ = _tokens(text)
            words = (w for token in set(tokens) for w in _WORD.findall(token))
            lines = text.split("\n")
            for k, line in enumerate(lines):
                if _divided(line) and (last := _last_word(line.rstrip()[:-1])):
                    # headers between the two parts are not known here: any of the next lines may go on
                    begins = (_WORD.search(x.lstrip().partition(" ")[0]) for x in lines[k + 1 : k + 6])
                    parts += [f"{last[0].lower().strip(_SIGNS)}\n{m[0].lower().strip(_SIGNS)}" for m in begins if m]
            joined = (part.replace("\n", between) for part in parts for between in ("", "-"))
            out.extend((*key, w) for w in {*map(_core, words), *parts, *map(_core, joined)} if w)
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
        columns = list(zip(*out, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["document", "block", "chunk_id", "text_hash", "word"])

    words = rows.where("text is not null and text <> ''").select("document", "block", "chunk_id", "text_hash", "text").mapInArrow(per_batch(find), "document string, block bigint, chunk_id string, text_hash bigint, word string")
    return words.join(right, "word").select("document", "block", "chunk_id", "text_hash", "word", "right").distinct()


def divided_words(counted: DataFrame) -> DataFrame:
    """(parts, between): the divided words that are not simply joined, by the counts of the joined, the hyphenated and the separate form."""
    parts = counted.where(F.col("word").contains("\n")).select(F.col("word").alias("parts"))
    forms = parts.withColumn("between", F.explode(F.array(F.lit(""), F.lit("-"), F.lit("- "))))
    forms = forms.withColumn("word", F.replace("parts", F.lit("\n"), F.col("between"))).join(counted, "word", "left")
    # at equal counts the shorter sign wins
    best = forms.groupBy("parts").agg(F.max_by("between", F.struct(F.coalesce("n", F.lit(0)), -F.length("between"))).alias("between"))
    return best.where("between <> ''")


def _look_alikes(word: str) -> list[str]:
    """The word with one letter replaced by another of the same look."""
    return [word[:i] + other + word[i + 1 :] for i, c in enumerate(word) for other in _WITHIN.get(c, ())]


def _right_forms(word: str) -> list[tuple[int, str, int]]:
    """(tier, form, ratio): what the word may be a misreading of, the form being at least ``ratio`` times as frequent."""
    if not _CYRILLIC.search(word):
        return []
    if _STRANGE.search(word):
        plain = [f for f in Reader._unscanned(word) if not _STRANGE.search(f)]
        return [(0, f, 2) for f in plain] + [(1, g, LIKELY) for f in plain if len(f) >= 5 and f.isalpha() for g in _look_alikes(f)]
    if len(word) < 4 or not word.replace("-", "").isalpha():
        return []
    return [(0, g, LIKELY) for g in _look_alikes(word)]


def misread_words(counted: DataFrame) -> DataFrame:
    """(word, right): each misread word of the corpus and what it should be, decided by the exact counts of both.

    Candidate forms are made once for each distinct word and joined with the counted words; any one letter may be
    wrong where the right word is ``SURE`` times as frequent (joined on the word without the letter at its place).
    The lowest tier wins, in it the most frequent form. The rules are those of :class:`Reader`.
    """

    def forms(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(w, n, *f) for w, n in zip(batch["word"].to_pylist(), batch["n"].to_pylist(), strict=True) for f in _right_forms(w)]
        columns = list(zip(*rows, strict=True)) or [[], [], [], [], []]
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["word", "n", "tier", "form", "ratio"])

    counted = counted.where(~F.col("word").rlike(r"\s"))
    right = counted.select(F.col("word").alias("form"), F.col("n").alias("n_form"))
    near = counted.mapInArrow(per_batch(forms), "word string, n bigint, tier int, form string, ratio int").join(right.where(F.col("n_form") >= LEAST_COUNT), "form")
    holes = lambda df, w: df.withColumn("i", F.explode(F.sequence(F.lit(1), F.length(w)))).withColumn("rest", F.expr(f"concat(substring({w}, 1, i - 1), substring({w}, i + 1))"))
    sure = holes(right.where((F.col("n_form") >= SURE) & (F.length("form") >= 5) & F.col("form").rlike(r"^\p{L}+$")), "form")
    plain = counted.where((F.length("word") >= 5) & F.col("word").rlike("[а-яё]") & ~F.col("word").rlike("[a-z0-9|/()]") & F.col("word").rlike(r"^[\p{L}-]+$"))
    any_letter = holes(plain, "word").join(sure, ["i", "rest"]).where("word <> form").withColumn("tier", F.lit(1)).withColumn("ratio", F.lit(SURE))
    columns = ["word", "n", "tier", "form", "ratio", "n_form"]
    found = near.select(*columns).unionByName(any_letter.select(*columns)).where(F.col("n_form") >= F.col("ratio") * F.greatest("n", F.lit(1)))
    return found.groupBy("word").agg(F.max_by("form", F.struct(-F.col("tier"), "n_form", "form")).alias("right"))


class Settled:
    """Gives the right form of the misread words that are already decided, and what stands in a divided word."""

    def __init__(self, right: dict[str, str]):
        self.right = right.get
        self.between = lambda a, b: right.get(f"{a}\n{b}", "")
        #: tokens as written that stay as they are
        self.settled: set[str] = set()

    def stays(self, line: str) -> bool:
        """True if no word of the line is misread."""
        new = set(line.split()) - self.settled
        for token in new:
            if any(self.right(core) for w in _WORD.findall(token.lower()) if len(core := w.strip(_SIGNS)) > 1):
                return False
            if len(self.settled) < 300_000:
                self.settled.add(token)
        return True


class Reader:
    """Decides what each word of a scan should be, by a dictionary of all words; :func:`misread_words` does so for a corpus."""

    def __init__(self, known: dict[str, int]):
        self.known = known
        self._memory: dict[str, str | None] = {}
        #: words as written that stay as they are
        self.settled: set[str] = set()
        #: word with one letter left out -> known words that have any letter there
        self._holes: dict[tuple[int, str], list[str]] = {}
        for w, n in known.items():
            if n >= SURE and len(w) >= 5 and w.isalpha():
                for i in range(len(w)):
                    self._holes.setdefault((i, w[:i] + w[i + 1 :]), []).append(w)

    def right(self, word: str) -> str | None:
        """The right form of a misread word, None if the word is right or nothing is known about it."""
        if word not in self._memory:
            if len(self._memory) > 300_000:
                self._memory.clear()
            self._memory[word] = self._find(word)
        return self._memory[word]

    def _find(self, word: str) -> str | None:
        count = self.known.get(word, 0)
        best, best_count = None, 0
        if not _CYRILLIC.search(word):
            return None
        if _STRANGE.search(word):
            for form in self._unscanned(word):
                n = self.known.get(form, 0)
                if n >= max(LEAST_COUNT, 2 * count) and n > best_count and not _STRANGE.search(form):
                    best, best_count = form, n
            if best is None:  # two letters misread in different ways
                plain = [f for f in self._unscanned(word) if len(f) >= 5 and f.isalpha() and not _STRANGE.search(f)]
                for right in filter(None, (self._like(f, count) for f in plain)):
                    if self.known[right] > best_count:
                        best, best_count = right, self.known[right]
            return best
        if len(word) < 4 or not word.replace("-", "").isalpha():
            return None
        best = self._like(word, count)
        if best is None and len(word) >= 5:
            for i in range(len(word)):
                for form in self._holes.get((i, word[:i] + word[i + 1 :]), ()):
                    n = self.known[form]
                    if form != word and n >= SURE * max(count, 1) and n > best_count:
                        best, best_count = form, n
        return best

    def _like(self, word: str, count: int) -> str | None:
        """The most frequent known word in which one letter is another of the same look, if it is far more frequent."""
        best, best_count = None, 0
        for form in _look_alikes(word):
            n = self.known.get(form, 0)
            if n >= max(LEAST_COUNT, LIKELY * max(count, 1)) and n > best_count:
                best, best_count = form, n
        return best

    @staticmethod
    def _unscanned(word: str) -> set[str]:
        """What the word may have been: groups of signs taken back, alone and together with single signs."""
        forms = {word}
        for group, letter in GROUPS:
            forms |= {f.replace(group, letter) for f in forms if group in f}
        forms |= {"".join(SINGLES.get(c, c) for c in f) for f in forms}
        return forms


def examine(text: str, headers: Headers, title: str, reverse_title: str, reader: Settled, pages: set[int]) -> tuple[list[str], str]:
    """(kinds of noise, repaired text) of a chunk."""
    lines = text.split("\n")
    noise = ["page" if is_page_line(x) and (i in pages or not x.strip().isdigit()) else "header" if is_header_line(x, headers, title, reverse_title) else None for i, x in enumerate(lines)]
    kinds = {k for k in noise if k}
    kept, divided = join_divided(lines, noise, reader.between)
    if divided:
        kinds.add("hyphen")

    def mend(m: re.Match) -> str:
        raw = m[0]
        core = raw.strip(_SIGNS)
        right = reader.right(core.lower()) if len(core) > 1 else None
        if right is None:
            return raw
        if m.start() and m.string[m.start() - 1] in "«\"“„" and not _STRANGE.search(core.lower()):
            return raw  # a name may be like a word
        kinds.add("misread")
        if core[:1].isupper() or (core[:1].isdigit() and m.start() == 0):
            right = right[0].upper() + right[1:]
        return raw.replace(core, right, 1)

    mended = [line if reader.stays(line) else _WORD.sub(mend, line) for line in kept]
    paragraphs: list[list[str]] = []
    for line in mended:
        stripped = line.strip()
        last = paragraphs[-1][-1] if paragraphs else ""
        flows = last and stripped and "|" not in stripped and "|" not in last and not _ENTRY.match(stripped)
        if flows:
            paragraphs[-1].append(stripped)
        else:
            paragraphs.append([stripped])
    return sorted(kinds), "\n".join(" ".join(p) for p in paragraphs)


_READERS: dict[int, Settled] = {}
_PARTS = ["document", "block", "chunk_id", "text_hash", "text", "regulation_id", "regulation_name", "headers", "line", "word", "right"]


def _tagged(rows: DataFrame) -> DataFrame:
    """Rows of any of the kinds that meet at a chunk, in the columns of all of them."""
    kinds = {"block": "bigint", "text_hash": "bigint", "headers": "array<string>", "line": "int"}
    return rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in _PARTS), F.lit("text" in rows.columns).alias("is_text"))


def repair_scans(chunks: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """(chunk_id, noise, text): the kinds of noise found in each chunk, sorted, and the repaired text.

    ``chunks``: ``chunk_id`` (document stem, a colon, a position), ``text``; with ``is_table``, ``regulation_id``
    and ``regulation_name``, heads of tables and lines of the document's own title are told apart too. Kinds:
    ``hyphen``, ``misread``, ``header``, ``page``. In the repaired text headers and page numbers are gone, divided
    words are whole, misread words right, and lines are joined to paragraphs; entries of lists, table rows and
    blank lines stay. Words that the corpus does not know are never changed.

    A null text has no noise and stays null, an empty one stays empty. Repeated rows of one id and text come out
    once. Further columns are dropped, an empty table gives no rows.

    The texts move once, to the task of their document and block of ``DOCUMENT_BLOCK`` positions, together with the
    document's headers and the chunk's page numbers as rows of their own; sorted, all that a chunk needs stands
    before it. The right forms of words go to all tasks up to ``most_sent``; beyond that they come as such rows too.
    """
    have = set(chunks.columns)
    column = lambda name, kind: (F.col(name) if name in have else F.lit(None)).cast(kind).alias(name)
    position = F.expr("try_cast(regexp_extract(chunk_id, ':([^:]*)$', 1) as bigint)")
    block = F.coalesce(F.floor(position / DOCUMENT_BLOCK), F.pmod(F.xxhash64("chunk_id"), F.lit(16))).cast("bigint").alias("block")
    rows = chunks.select(
        "chunk_id", "text", F.regexp_extract("chunk_id", r"^(.*?)(?::[^:]*)?$", 1).alias("document"), block, F.xxhash64("text").alias("text_hash"), column("is_table", "boolean"), column("regulation_id", "string"), column("regulation_name", "string")
    )
    counted = word_counts(chunks)
    right = cut(misread_words(counted).unionByName(divided_words(counted).withColumnsRenamed({"parts": "word", "between": "right"})))
    sent = None
    parts = [_tagged(rows)]
    if right.count() <= most_sent:
        sent = rows.sparkSession.sparkContext.broadcast(dict(zip(*(c.to_pylist() for c in right.toArrow().columns), strict=True)))
    else:
        parts.append(_tagged(chunk_corrections(rows, right)))
    lines = special_lines(rows)
    blocks = rows.select("document", "block").distinct()
    parts.append(_tagged(document_headers(lines).join(blocks, "document")))
    parts.append(_tagged(page_numbers(lines).withColumn("block", block)))
    together = reduce(DataFrame.unionByName, parts).repartition("document", "block").sortWithinPartitions("document", "block", F.col("chunk_id").asc_nulls_first(), "text_hash", "is_text")

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = None
        if sent is not None:
            common = _READERS.get(sent_id := id(sent.value))
            if common is None:
                _READERS.clear()
                common = _READERS[sent_id] = Settled(sent.value)
        of_block, headers, of_chunk, pages, words, done = None, Headers([]), None, set(), {}, False
        for batch in batches:
            ids, kinds, texts = [], [], []
            for r in zip(*(batch[c].to_pylist() for c in (*_PARTS, "is_text")), strict=True):
                document, at_block, chunk_id, text_hash, text, number, name, found_headers, line, word, right_form, is_text = r
                if of_block != (document, at_block):
                    of_block, headers, of_chunk = (document, at_block), Headers([]), None
                if found_headers is not None:
                    headers = Headers(found_headers)
                    continue
                if of_chunk != (chunk_id, text_hash):
                    of_chunk, pages, words, done = (chunk_id, text_hash), set(), {}, False
                if line is not None:
                    pages.add(line)
                if word is not None:
                    words[word] = right_form
                if not is_text or done:
                    continue
                done = True
                ids.append(chunk_id)
                if not text:
                    kinds.append([])
                    texts.append(text)
                    continue
                a, b = _letters(number or ""), _letters(name or "")
                found, mended = examine(text, headers, a + b if a and b else "", b + a if a and b else "", common or Settled(words), pages)
                kinds.append(found)
                texts.append(mended)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(kinds, pa.list_(pa.string())), pa.array(texts, pa.string())], ["chunk_id", "noise", "text"])

    return together.mapInArrow(repair, "chunk_id string, noise array<string>, text string")
