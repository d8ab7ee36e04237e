"""Evaluation texts that stand in training texts.

Items and documents are brought to streams of letters and digits as a reader sees them. Every run of ``RUN`` words
of an item (or the whole of a shorter one) is a window. The windows of items and those of documents at every word
start are embedded by the CGK random walk, which maps edit distance to Hamming distance; the walk goes through the
whole window. Keys of steps sampled over the whole walk put windows that are alike into one bucket, in several tables
for a target recall; every candidate is verified once, by a banded edit distance of a batch of candidates.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .arrow import per_batch
from .chars import BLANKS, INVISIBLE, TO_LATIN, WIDE, stable

RUN = 12
RECALL = 0.95
#: Steps of the walk that a key holds: for equal windows, and where windows may differ.
SAMPLES, SAMPLES_OF_EDITED = 16, 5
#: A window may differ in one letter for each so many letters of it, up to the edits allowed.
LETTERS_AN_EDIT = 12
#: Windows with random edits on which the number of tables is measured; most tables that are made.
PLANTED, MOST_TABLES = 400, 60
#: Characters of items that are sent to the executors at a time; more items are taken in blocks.
BLOCK_CHARS = 16 << 20
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>")
_MARK = re.compile("[̀-ͯᄀ-ᇿ]")


class _Reading(dict):
    """Table of ``str.translate``: a letter or digit as its reading, an invisible character as nothing, all else a blank.

    Letters of one look or of one letter in two cases have one reading: the closure over both is the lower-case
    Latin letter of the look.
    """

    def __missing__(self, point: int) -> str | None:
        c = chr(point)
        if c in INVISIBLE:
            out = None
        elif c in WIDE:
            out = "".join(filter(None, (self[ord(x)] for x in unicodedata.normalize("NFKC", c))))
        elif c in BLANKS or not (c.isalpha() or c.isdecimal()):
            out = " "
        else:
            out = "".join(_look(x) for x in c.casefold())
        self[point] = out
        return out


def _look(c: str) -> str:
    for x in (c, c.upper()):
        if x in TO_LATIN:
            return TO_LATIN[x].lower()
    return c


_READING = _Reading()


def read(text: str) -> str:
    """Letters and digits as they are read, everything else as blanks."""
    if "<" in text:
        text = _TAG.sub("", text)
    if _MARK.search(text):
        text = stable(text)
    return text.translate(_READING)


def _codes(read_text: str) -> np.ndarray:
    return np.frombuffer(read_text.encode("utf-16-le", "surrogatepass"), dtype=np.uint16)


class Windows:
    """The windows of a block of items and the tables that find them.

    ``tables`` is their number where it is known already; else as many are made as the target recall needs, measured
    on the windows themselves with ``max_edits`` random edits each. Windows without edits have equal keys in every
    table: one table finds all of them.
    """

    def __init__(self, items: list[tuple[int, str]], run: int = RUN, max_edits: int = 0, recall: float = RECALL, seed: int = 7, tables: int | None = None):
        self.max_edits = max_edits
        by_text: dict[str, set[int]] = {}
        for item_id, text in items:
            words = read(text).split() if text else []
            for k in range(max(1, len(words) - run + 1)):
                if words:
                    by_text.setdefault("".join(words[k : k + run]), set()).add(item_id)
        self.texts = sorted(by_text)
        self.items = [sorted(by_text[t]) for t in self.texts]
        codes = [_codes(t) for t in self.texts]
        self.lengths = np.array([len(c) for c in codes], dtype=np.int64)
        self.limits = np.minimum(max_edits, self.lengths // LETTERS_AN_EDIT)
        self.codes = _padded(codes, int(self.lengths.max(initial=0)))
        # the walk sees letters as one byte: those of the items, in order of appearance, and one for all others
        letters = np.unique(self.codes[self.codes > 0])
        self.byte = np.zeros(1 << 16, dtype=np.uint8)
        self.byte[letters] = 1 + np.arange(len(letters)) % 254
        self.tables: list[_Table] = []
        if not self.texts:
            return
        rng = np.random.default_rng(seed)
        if not max_edits:
            tables = 1
        missing = None if tables else self._planted(rng)
        while len(self.tables) < (tables or MOST_TABLES):
            self.tables.append(_Table(self.byte[self.codes], self.lengths, SAMPLES_OF_EDITED if max_edits else SAMPLES, not max_edits, rng))
            if missing is not None:
                missing = [(stream, w) for stream, w in missing if w not in self.tables[-1].candidates(self.byte[stream], np.zeros(1, np.int64))[1]]
                if len(missing) <= (1 - recall) * PLANTED:
                    break

    def _planted(self, rng: np.random.Generator) -> list[tuple[np.ndarray, int]]:
        """Windows with random edits, as streams of text that goes on behind them."""
        out = []
        for w in rng.choice(len(self.texts), PLANTED):
            code = self.codes[w, : self.lengths[w]].tolist()
            for _ in range(int(self.limits[w])):
                at, kind = int(rng.integers(len(code))), int(rng.integers(3))
                code[at : at + (kind != 0)] = [int(rng.choice(code))] if kind < 2 else []
            tail = self.codes[rng.choice(len(self.texts))]
            out.append((np.concatenate([np.array(code, np.uint16), tail]), int(w)))
        return out

    def find(self, stream: np.ndarray, starts: np.ndarray, ends: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, window, edits) of each candidate that verifies, each pair once.

        ``ends``: True behind the last letter of a word; ``border``: of each start the end of its text.
        """
        stream = np.concatenate([stream, np.zeros(self.codes.shape[1] + self.max_edits + 1, np.uint16)])
        ends = np.concatenate([ends, np.zeros(len(stream) + 1 - len(ends), bool)])
        letters = self.byte[stream]
        met = [np.zeros(0, np.int64)]
        for t in self.tables:
            at, w = t.candidates(letters, starts)
            met.append(at * len(self.texts) + w)
        pairs = np.unique(np.concatenate(met))
        at, w = pairs // max(1, len(self.texts)), pairs % max(1, len(self.texts))
        stop = border[np.searchsorted(starts, at)] if len(at) else at
        edits = np.concatenate([np.zeros(0, np.int64), *(self._edits(stream, at[i : i + 20_000], w[i : i + 20_000], ends, stop[i : i + 20_000]) for i in range(0, len(at), 20_000))])
        right = edits <= self.limits[w] if len(w) else np.zeros(0, bool)
        return at[right], w[right], edits[right]

    def _edits(self, stream: np.ndarray, at: np.ndarray, w: np.ndarray, ends: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The least edit distance between each window and a text that starts at its place and ends with a word there.

        All candidates go through the band of ``max_edits`` around the diagonal at the same time; a greater distance
        comes out as any greater number.
        """
        k, order = self.max_edits, np.argsort(-self.lengths[w], kind="stable")
        at, w, stop = at[order], w[order], stop[order]
        n = self.lengths[w]
        row = np.full((2 * k + 3, len(at)), 99, dtype=np.int16)  # one more on each side of the band
        for d in range(k + 1):
            row[k + 1 + d] = d
        for i in range(1, int(n.max(initial=0)) + 1):
            active = int(np.searchsorted(-n, -i, "right"))
            c, here = self.codes[w[:active], i - 1], at[:active] + i - 1
            for d in range(-k, k + 1):
                if i + d < 0:
                    continue
                b = k + 1 + d
                same = row[b, :active] + (stream[here + d] != c) if i + d > 0 else np.full(active, 99, np.int16)
                row[b, :active] = np.minimum(np.minimum(same, row[b + 1, :active] + 1), row[b - 1, :active] + 1)
        best = np.full(len(at), 99, dtype=np.int64)
        for d in range(-k, k + 1):
            end = at + n + d
            best = np.where((n + d > 0) & (end <= stop) & ends[np.maximum(end, 0)], np.minimum(best, row[k + 1 + d]), best)
        out = np.empty_like(best)
        out[order] = best
        return out


class _Table:
    """One table of the locality-sensitive hashing: the bits of the walk, the sampled steps, the windows' keys.

    The walk of a window goes on until the window is read to its end, about two steps a letter. Windows whose walks
    are about as long are a class, and a class samples steps of the whole of its shortest walk. A text does not know
    how long a window is: it walks once and has a key for each class.
    """

    def __init__(self, letters: np.ndarray, lengths: np.ndarray, samples: int, exact: bool, rng: np.random.Generator):
        most = 8 * letters.shape[1] + 64
        self.bits = rng.integers(0, 2, (most, 256), dtype=np.uint8)
        seen = np.zeros((len(lengths), most), dtype=np.uint8)
        at, walked = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        row = np.arange(len(lengths))
        padded = np.concatenate([letters, np.zeros((len(lengths), 1), np.uint8)], axis=1)
        for j in range(most):
            inside = at < lengths
            if not inside.any():
                break
            seen[:, j] = padded[row, np.minimum(at, letters.shape[1])]
            walked += inside
            at += np.where(inside, self.bits[j][seen[:, j]], 0)
        steps = np.array(sorted({int(round(1.2**i)) for i in range(80)}))
        of = steps[np.searchsorted(steps, walked, "right") - 1]
        # equal windows agree in every step: the first steps, in which most texts leave all windows, may be dense
        first = np.sort(rng.choice(16, 8, replace=False)) if exact else np.zeros(0, int)
        self.classes = []
        for s in np.unique(of).tolist():
            if s <= samples:
                at = np.arange(s)
            elif exact and s > 16:
                at = np.concatenate([first, 16 + np.sort(rng.choice(s - 16, min(s - 16, samples - 8), replace=False))])
            else:
                at = np.sort(rng.choice(s, samples, replace=False))
            members = np.flatnonzero(of == s)
            self.classes.append(_Class(s, at, seen[members], members))
        wanted = {c.at[i] + 1 for c in self.classes for i in range(2, len(c.at)) if len(c.at) > 3}
        self.checks = {j: [(c, c.hint(j)) for c in self.classes if c.steps >= j] for j in sorted(wanted)[:: max(1, len(wanted) // 16)]}
        self.last = max(c.steps for c in self.classes)

    def candidates(self, letters: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, window) wherever the keys of a text and of a window are the same."""
        letters = np.concatenate([letters, np.zeros(self.last + 1, np.uint8)])
        found_at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in range(0, len(starts), 1 << 16):
            begin = starts[a : a + (1 << 16)]
            at = begin.copy()
            keys = {c: np.zeros(len(begin), np.uint64) for c in self.classes}
            for j in range(self.last):
                seen = letters[at]
                for c, key in keys.items():
                    if j in c.sampled:
                        keys[c] = _mixed(key, seen)
                at += self.bits[j][seen]
                for c in [c for c in keys if c.steps == j + 1]:
                    hit, w = c.windows(keys.pop(c))
                    found_at.append(begin[hit])
                    found.append(w)
                if not keys:
                    break
                if j + 1 in self.checks:
                    alive = np.zeros(len(begin), bool)
                    for c, hint in self.checks[j + 1]:
                        if c in keys:
                            alive |= hint[_place(keys[c])] if hint is not None else True
                    if alive.sum() < 0.75 * len(begin):
                        begin, at = begin[alive], at[alive]
                        keys = {c: key[alive] for c, key in keys.items()}
                        if not len(begin):
                            break
        return np.concatenate(found_at), np.concatenate(found)


class _Class:
    """The windows of one table whose walks are about as long, by their keys."""

    def __init__(self, steps: int, at: np.ndarray, seen: np.ndarray, members: np.ndarray):
        self.steps, self.at, self.sampled, self._seen = steps, at, set(at.tolist()), seen
        key = self._key(steps)
        order = np.argsort(key, kind="stable")
        self.keys, self.ids = key[order], members[order]
        self.whole = self.hint(steps)

    def _key(self, steps: int) -> np.ndarray:
        key = np.zeros(len(self._seen), np.uint64)
        for j in self.at:
            if j < steps:
                key = _mixed(key, self._seen[:, j])
        return key

    def hint(self, steps: int) -> np.ndarray | None:
        """Which places the keys of the first ``steps`` steps have; None where nothing is sampled so far."""
        if not (self.at < steps).any():
            return None
        out = np.zeros(1 << 18, dtype=bool)
        out[_place(self._key(steps))] = True
        return out

    def windows(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, window) of equal keys."""
        maybe = np.flatnonzero(self.whole[_place(keys)])
        low, high = np.searchsorted(self.keys, keys[maybe], "left"), np.searchsorted(self.keys, keys[maybe], "right")
        n = high - low
        total = int(n.sum())
        if not total:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        within = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(maybe, n), self.ids[np.repeat(low, n) + within]


def _mixed(key: np.ndarray, letter: np.ndarray) -> np.ndarray:
    key = (key ^ letter) * np.uint64(0x9E3779B97F4A7C15)
    return key ^ (key >> np.uint64(29))


def _place(key: np.ndarray) -> np.ndarray:
    return ((key * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(46)).astype(np.int64)


def _padded(codes: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(codes), width), dtype=np.uint16)
    for row, code in zip(out, codes, strict=True):
        row[: len(code)] = code
    return out


def _find_in_batch(windows: Windows, ids: list, texts: list[str | None]) -> tuple[list, list[int], list[int], list[int]]:
    """(document, item, number of windows found, least edits) of a batch; the texts are laid end to end."""
    read_texts = [read(t) if t else "" for t in texts]
    flat = _codes(" ".join([" ", *read_texts, " "]))
    letter = flat != 32
    stream = flat[letter]
    place = np.cumsum(letter) - 1  # of each character, its place in the stream
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    starts = place[begins]
    ends = np.zeros(len(stream) + 1, dtype=bool)
    stops = letter.copy()
    stops[:-1] &= ~letter[1:]
    ends[place[stops] + 1] = True
    lengths = np.array([len(_codes(t)) + 1 for t in read_texts])
    bounds = np.concatenate([[2], 2 + np.cumsum(lengths)])  # of the flat text
    letters_before = np.concatenate([[0], np.cumsum(letter)])
    borders = letters_before[np.minimum(bounds, len(flat))]
    owner = np.searchsorted(borders, starts, "right") - 1
    at, found, edits = windows.find(stream, starts, ends, borders[owner + 1])
    text_of = owner[np.searchsorted(starts, at)] if len(at) else at
    best: dict[tuple[int, int], tuple[set[int], int]] = {}
    for k, w, e in zip(text_of.tolist(), found.tolist(), edits.tolist(), strict=True):
        for item in windows.items[w]:
            seen, least = best.get((k, item), (set(), e))
            seen.add(w)
            best[k, item] = seen, min(least, e)
    return [ids[k] for k, _ in best], [i for _, i in best], [len(s) for s, _ in best.values()], [e for _, e in best.values()]


def leaked_items(documents: DataFrame, items: DataFrame, run: int = RUN, max_edits: int = 0, recall: float = RECALL) -> DataFrame:
    """(doc_id, item_id, n_windows, edits): documents that hold at least ``run`` consecutive words of an item, or a shorter one whole.

    ``n_windows`` is the number of different windows of the item found, ``edits`` the least number of letters by
    which one of them differs. With ``max_edits`` a window may differ by so many letters inserted, deleted or
    replaced, but not by more than one in ``LETTERS_AN_EDIT``; each is then found with about the probability
    ``recall``, and with 0 every one is found. Case, punctuation, markup, spacing, line ends and the coding of
    characters do not count. Null, empty and wordless texts and items match nothing. Repeated rows of one id count
    as one. Empty tables give no rows; further columns are ignored.

    The items are the stated query set: they go to the executors in blocks of at most ``BLOCK_CHARS`` characters,
    and each block is one pass over the documents, which are read where they lie, whole and without a shuffle.
    """
    spark = documents.sparkSession
    wanted = items.select("item_id", F.col("item_text").alias("text")).where("text is not null")
    chars = wanted.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    schema = "doc_id bigint, item_id bigint, n_windows int, edits int"
    parts = []
    for b in range(blocks):
        block = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toPandas()
        rows = sorted(zip(block.item_id.tolist(), block.text.tolist(), strict=True))
        tables = len(Windows(rows, run, max_edits, recall).tables) if max_edits else 1
        sent = spark.sparkContext.broadcast(rows)

        def search(batch: pa.RecordBatch, sent=sent, b=b, tables=tables, token=uuid4().hex) -> pa.RecordBatch:
            windows = _windows((token, b, run, max_edits, tables), sent.value)
            columns = _find_in_batch(windows, batch["doc_id"].to_pylist(), batch["text"].to_pylist())
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "n_windows", "edits"])

        parts.append(spread(documents.select("doc_id", "text").where("text is not null")).mapInArrow(per_batch(search), schema))
    return reduce(DataFrame.unionByName, parts).groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.min("edits").alias("edits"))


_BUILT: dict[tuple, Windows] = {}


def _windows(key: tuple, items: list[tuple[int, str]]) -> Windows:
    """The windows of a block, built once in each worker process."""
    if key not in _BUILT:
        _BUILT.clear()
        _, _, run, max_edits, tables = key
        _BUILT[key] = Windows(items, run, max_edits, tables=tables)
    return _BUILT[key]


def item_report(leaks: DataFrame, items: DataFrame) -> DataFrame:
    """For every item the number of documents that hold it (0 too)."""
    counts = leaks.groupBy("item_id").agg(F.count("*").alias("n_documents"))
    return items.select("item_id", "lang", "category", "style").distinct().join(counts, "item_id", "left").fillna(0, ["n_documents"])
