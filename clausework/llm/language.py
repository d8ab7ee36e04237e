"""Languages of documents and of their segments by Bayesian fusion of evidence.

Three kinds of evidence give one posterior: the likelihood of the words (a smoothed word model over a character
model, fitted on a bounded sample of labelled rows), the declared label (how often documents of a language carry
each label) and the prior of the source (shrunk towards the prior of its group and of all documents). The last two
are counted by grouped aggregation over all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread
from .arrow import lists, per_batch
from .chars import canonical

LANGUAGES = ["ru", "uk", "kk", "en", "de", "fr", "es"]
#: The spellings of each language's name in labels (ISO 639 codes, English and own name).
SPELLINGS = {
    "ru": "ru rus russian русский",
    "uk": "uk ukr ukrainian українська",
    "kk": "kk kaz kazakh қазақ қазақша",
    "en": "en eng english",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano",
}
#: Labelled documents of each language on which the word model is fitted, at most (in expectation).
SAMPLE_DOCS = 1500
#: Sources whose priors go to all tasks; more of them are joined on (source, salt), in so many ways.
MOST_SOURCES, SALTS = 50_000, 16
#: Weight, in words, of the character model in the word model; in documents, of the wider prior in a source's.
WORD_PRIOR, SOURCE_PRIOR = 5.0, 20.0
#: One word never speaks by more than this for one language against another.
MOST_EVIDENCE = 6.0
#: A sentence with less evidence than this goes with the segment it stands in.
LEAST_EVIDENCE = 4.0
#: Words that a sentence needs to count as a sentence of a language.
SENTENCE_WORDS = 8
_SENTENCE = re.compile(r"(?<=[.!?…])[\"»”)\]*_`]*\s+(?=[\"«“„(\[*_`>¿¡-]*\s?[^\W\d_a-zа-яёіїєґәғқңөұүһß-öø-ÿœ])|\s*\n\s*\n\s*|(?<=[.!?…])[\"»”]?\s*\n")
#: In a text without capitals every full stop before a blank ends a sentence.
_LOOSE_SENTENCE = re.compile(r"(?<=[.!?…])[\"»”)\]*_`]*\s+|\s*\n\s*\n\s*")
_TOKEN = re.compile(r"[^\W_]+(?:['’ʼ-][^\W_]+)*")
_MARK_OR_HIDDEN = re.compile("[̀-ͯ­​-‏⁠﻿]")
_HYPHENATED = re.compile(r"(?<=[^\W\d_])[-­‐]\n(?=[^\W\d_])")


def language_of_label(label: Column) -> Column:
    """The language that a label names in any spelling (codes with regions too), else null."""
    name = F.lower(F.regexp_extract(F.trim(label), r"^([\p{L}]+)", 1))
    out = F.lit(None).cast("string")
    for language, names in SPELLINGS.items():
        out = F.when(name.isin(*names.split()), language).otherwise(out)
    return out


def tidy(text: str) -> str:
    """The text with its characters settled where that is needed; words divided at a line end are joined."""
    if _MARK_OR_HIDDEN.search(text):
        text = canonical(text)
    return _HYPHENATED.sub("", text) if "-\n" in text or "‐\n" in text else text


def sentences(text: str) -> list[str]:
    pattern = _LOOSE_SENTENCE if text.islower() else _SENTENCE
    return [s for s in pattern.split(tidy(text)) if s and not s.isspace()]


def words_of(sentence: str) -> list[str]:
    """Words with a letter, in lower case; codes and numbers are kept for the count only (with their digits)."""
    return [w for w in _TOKEN.findall(sentence.lower()) if not w.isdigit()]


class Model:
    """Word likelihoods of each language: counts smoothed by a character trigram model."""

    def __init__(self, counts: dict[tuple[str, str], float], languages: list[str] = LANGUAGES):
        """``counts``: (language, word) -> number of occurrences in the sample."""
        self.languages = languages
        k = {lang: i for i, lang in enumerate(languages)}
        self.word: dict[str, np.ndarray] = {}
        grams: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(languages)))
        contexts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(languages)))
        for (lang, word), n in counts.items():
            self.word.setdefault(word, np.zeros(len(languages)))[k[lang]] += n
        for word, n in self.word.items():
            marked = f"^^{word}$"
            seen = np.log1p(n)
            for i in range(len(marked) - 2):
                grams[marked[i : i + 3]] += seen
                contexts[marked[i : i + 2]] += seen
        self.total = np.maximum(1.0, sum(self.word.values(), np.zeros(len(languages))))
        self.grams, self.contexts = dict(grams), dict(contexts)
        self._known: dict[str, int] = {}
        self._rows: list[np.ndarray] = []
        self._stacked: np.ndarray | None = None

    def _characters(self, word: str) -> np.ndarray:
        """log P(word) by characters, for each language."""
        marked, out, none = f"^^{word}$", np.zeros(len(self.languages)), np.zeros(len(self.languages))
        for i in range(len(marked) - 2):
            out += np.log((self.grams.get(marked[i : i + 3], none) + 0.02) / (self.contexts.get(marked[i : i + 2], none) + 2.0))
        return out

    def row(self, word: str) -> int:
        """Place of the word's log likelihoods, centred and clipped; words with digits say nothing."""
        at = self._known.get(word)
        if at is None:
            if any(c.isdigit() for c in word):
                value = np.zeros(len(self.languages))
            else:
                seen = self.word.get(word, np.zeros(len(self.languages)))
                base = self._characters(word)
                if not seen.any():  # a name, or a form not met: a little evidence only
                    base = base / 4
                    value = base
                else:
                    value = np.log((seen + WORD_PRIOR * np.exp(np.maximum(base, -40))) / (self.total + WORD_PRIOR) + 1e-9)
                value = np.maximum(value, value.max() - MOST_EVIDENCE)
                value = value - value.mean()
            at = self._known[word] = len(self._rows)
            self._rows.append(value)
        return at

    def score(self, sentence_words: list[list[str]]) -> np.ndarray:
        """Summed log likelihoods, one row for each sentence."""
        out = np.zeros((len(sentence_words), len(self.languages)), dtype=np.float32)
        if sum(len(w) for w in sentence_words) + len(self._known) >= 300_000:
            self._known.clear()
            self._rows.clear()
            self._stacked = None
        rows = [self.row(w) for ws in sentence_words for w in ws]
        if rows:
            lengths = np.array([len(ws) for ws in sentence_words])
            table = self._table()
            filled = np.flatnonzero(lengths)
            out[filled] = np.add.reduceat(table[rows], np.concatenate([[0], np.cumsum(lengths[filled])[:-1]]), axis=0)
        return out

    def _table(self) -> np.ndarray:
        if self._stacked is None or len(self._stacked) != len(self._rows):
            self._stacked = np.array(self._rows, dtype=np.float32)
        return self._stacked


def _labelled_sample(documents: DataFrame, sample_docs: int) -> DataFrame:
    """Rows whose label names a language, thinned by a hash of the id to ``sample_docs`` of each language in expectation."""
    labelled = documents.where("labelled is not null and text is not null")
    share = {r["labelled"]: sample_docs / r["n"] for r in labelled.groupBy("labelled").agg(F.count("*").alias("n")).collect()}  # at most one row a language
    bar = F.lit(0.0)
    for lang, part in share.items():
        bar = F.when(F.col("labelled") == lang, min(1.0, part)).otherwise(bar)
    return labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < bar * 1_000_003)


def _count_words(sample: DataFrame, first: Model | None) -> dict[tuple[str, str], float]:
    """(language, word) counts of the sample: by the label, or by the language that ``first`` finds in each sentence."""
    sent = sample.sparkSession.sparkContext.broadcast(first)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, out = sent.value, Counter()
        for text, lang in zip(batch["text"].to_pylist(), batch["labelled"].to_pylist(), strict=True):
            parts = [words_of(s) for s in sentences(text)]
            best = [lang] * len(parts)
            if model is not None and parts:
                score = model.score(parts)
                best = [model.languages[k] for k in score.argmax(axis=1)]
            for words, of in zip(parts, best, strict=True):
                for w in words:
                    if w.isalpha() or not any(c.isdigit() for c in w):
                        out[of, w] += 1
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.string()), pa.array(list(out.values()), pa.int64())], ["lang", "word", "n"])

    counted = spread(sample.select("labelled", "text")).mapInArrow(per_batch(count), "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # the vocabulary of a bounded sample: a word met once only says no more than its characters do
    table = counted.where("n > 1").toArrow()
    return {(a, b): c for a, b, c in zip(*(table[x].to_pylist() for x in ("lang", "word", "n")), strict=True)}


def fit_model(documents: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A word model from a bounded sample of labelled rows.

    Labels are partly wrong and documents partly mixed, so the model fitted on the labels reads the sample once
    more, and its decision for each sentence gives the counts of the final model.
    """
    # written once: three readings of the texts for a hash that no scan can push down would be two too many
    sample = cut(_labelled_sample(documents, sample_docs).select("labelled", "text"))
    return Model(_count_words(sample, Model(_count_words(sample, None))))


def _evidence(documents: DataFrame, model: Model) -> DataFrame:
    """One row for each document: words and log likelihoods of each sentence (flattened), and the best language by text."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    token = uuid4().hex
    keep = ["doc_id", "labelled", "source", "source_group"]

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = _MODELS.setdefault(token, sent.value)
        parts = [[words_of(s) for s in sentences(t)] if t else [] for t in batch["text"].to_pylist()]
        flat = [p for ps in parts for p in ps]
        score = m.score(flat) if flat else np.zeros((0, len(LANGUAGES)), np.float32)
        counts = np.array([len(p) for p in parts])
        n_words = np.array([len(p) for p in flat], dtype=np.int32)
        owner = np.repeat(np.arange(len(parts)), counts)
        total = np.zeros((len(parts), len(LANGUAGES)))
        np.add.at(total, owner, score)
        best = [LANGUAGES[t.argmax()] if t.any() else None for t in total]
        return pa.RecordBatch.from_arrays(
            [*(batch[c] for c in keep), lists(n_words, counts), lists(score.ravel(), counts * len(LANGUAGES)), pa.array(best, pa.string())],
            [*keep, "n_words", "likelihoods", "by_text"],
        )

    schema = "doc_id bigint, labelled string, source string, source_group string, n_words array<int>, likelihoods array<float>, by_text string"
    return spread(documents.select(*keep, "text")).mapInArrow(per_batch(read), schema)


_MODELS: dict[str, Model] = {}


def _priors(evidence: DataFrame) -> tuple[DataFrame, dict[str, list[float]]]:
    """Prior of each source, shrunk to that of its group and of all; and for each label log P(label | language)."""
    counted = evidence.where("by_text is not null").groupBy("source", "source_group", "labelled", "by_text").agg(F.count("*").alias("n"))
    counted = cut(counted)
    by_label = {(r["labelled"], r["by_text"]): r["n"] for r in counted.groupBy("labelled", "by_text").agg(F.sum("n").alias("n")).collect()}  # labels x languages
    of_language = {lang: sum(n for (_, t), n in by_label.items() if t == lang) for lang in LANGUAGES}
    every = sum(of_language.values())
    overall = [(of_language[lang] + 1) / (every + len(LANGUAGES)) for lang in LANGUAGES]
    label_given = {
        str(label): [math.log((by_label.get((label, lang), 0) + 1) / (of_language[lang] + len(LANGUAGES) + 1)) for lang in LANGUAGES] for label in [None, *LANGUAGES]
    }
    per = lambda *keys: counted.groupBy(*keys).agg(*(F.sum(F.when(F.col("by_text") == lang, F.col("n")).otherwise(0)).alias(lang) for lang in LANGUAGES))
    shrunk = lambda part, wide: F.array(*((F.col(lang) + SOURCE_PRIOR * wide(i)) / (sum((F.col(x) for x in LANGUAGES), F.lit(0)) + SOURCE_PRIOR) for i, lang in enumerate(LANGUAGES))).alias(part)
    groups = per("source_group").select(F.col("source_group").alias("of_group"), shrunk("group_prior", lambda i: F.lit(overall[i])))
    sources = per("source", "source_group").join(groups, F.col("source_group").eqNullSafe(F.col("of_group")))
    return sources.select("source", "source_group", shrunk("prior", lambda i: F.col("group_prior")[i])), label_given


def _with_priors(evidence: DataFrame, priors: DataFrame, most_sources: int = MOST_SOURCES) -> DataFrame:
    """The evidence with the prior of its source. A source with a third of all documents is not one task."""
    if priors.count() <= most_sources:
        right, salted = F.broadcast(priors.withColumn("salt", F.lit(0))), evidence.withColumn("salt", F.lit(0))
    else:
        right = priors.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = evidence.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    same = F.col("e.source").eqNullSafe(F.col("p.source")) & F.col("e.source_group").eqNullSafe(F.col("p.source_group")) & (F.col("e.salt") == F.col("p.salt"))
    return salted.alias("e").join(right.alias("p"), same, "left").select("e.doc_id", "e.labelled", "e.n_words", "e.likelihoods", "p.prior")


def language_segments(documents: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Segments of each document with their language and its posterior probability.

    ``documents``: ``doc_id``, ``text``, ``lang`` (the label) and ``source``; where there is a column
    ``source_group`` (such as an address suffix), a source's prior is shrunk towards that of its group.
    Columns out: ``doc_id``, ``labelled`` (the language the label names, or null), ``main`` and ``main_confidence``
    (of the whole document), ``segment_no`` from 1, ``lang``, ``confidence``, ``n_sentences``, ``longest`` (words
    of the longest sentence of it).

    Consecutive sentences of one language are one segment; sentences with little evidence go with the segment they
    stand in. A document without words (null, empty, blank, only numbers) has one segment whose language is null
    with confidence 0. Repeated ids come out as often as they are there. Unknown, empty and null labels name no
    language; null sources share one prior. An empty table gives no rows.

    The texts are read once to count the labels, once for the bounded sample, which is written, and once for the rest,
    without a shuffle; the priors of the sources go to all tasks behind a check of their number, beyond which they are
    joined on (source, salt).
    """
    has_group = "source_group" in documents.columns
    rows = documents.select(
        "doc_id", "text", language_of_label(F.col("lang")).alias("labelled"), F.col("source").cast("string"), (F.col("source_group") if has_group else F.lit(None)).cast("string").alias("source_group")
    )
    model = fit_model(rows, sample_docs)
    evidence = cut(_evidence(rows, model))
    priors, label_given = _priors(evidence)
    joined = _with_priors(evidence, cut(priors))

    label_table = {k: np.array(v) for k, v in label_given.items()}

    def fuse(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.num_rows
        counts = np.diff(batch["n_words"].offsets.to_numpy())
        score = batch["likelihoods"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(LANGUAGES))
        n_words = batch["n_words"].flatten().to_numpy(zero_copy_only=False)
        prior = np.zeros((rows, len(LANGUAGES)))
        has = np.flatnonzero(np.asarray(batch["prior"].is_valid()))
        if len(has):
            prior[has] = np.log(batch["prior"].flatten().to_numpy(zero_copy_only=False)).reshape(-1, len(LANGUAGES))
        labels = batch["labelled"].to_pylist()
        base = prior + np.array([label_table[str(x)] for x in labels])
        return _fused(batch["doc_id"], labels, counts, n_words, score, base)

    return joined.mapInArrow(
        per_batch(fuse),
        "doc_id bigint, labelled string, main string, main_confidence double, segment_no int, lang string, confidence double, n_sentences int, longest int",
    )


def _posterior(log_weight: np.ndarray) -> np.ndarray:
    """Probabilities of each row."""
    w = np.exp(log_weight - log_weight.max(axis=1, keepdims=True))
    return w / w.sum(axis=1, keepdims=True)


def _fused(doc_ids: pa.Array, labels: list, counts: np.ndarray, n_words: np.ndarray, score: np.ndarray, base: np.ndarray) -> pa.RecordBatch:
    """The segments of a batch. ``score``: one row for each sentence; ``base``: prior and label of each document."""
    rows, size = len(counts), len(LANGUAGES)
    owner = np.repeat(np.arange(rows), counts)
    whole = np.zeros((rows, size))
    np.add.at(whole, owner, score)
    silent = ~whole.any(axis=1)
    whole_posterior = _posterior(whole + base)
    ordered = np.sort(score, axis=1)
    clear = ordered[:, -1] - ordered[:, -2] >= LEAST_EVIDENCE if len(score) else np.zeros(0, bool)
    own = np.where(clear, (score + base[owner]).argmax(axis=1), -1) if len(score) else np.zeros(0, int)
    # a sentence without clear evidence goes with the one before it in its document, the first ones with the next
    position = np.arange(len(own))
    last = np.maximum.accumulate(np.where(own >= 0, position, -1)) if len(own) else position
    first_of = np.concatenate([[0], np.cumsum(counts)])[:-1]
    follows = last >= first_of[owner] if len(own) else np.zeros(0, bool)
    after = np.minimum.accumulate(np.where(own >= 0, position, len(own))[::-1])[::-1] if len(own) else position
    end_of = first_of + counts
    precedes = after < end_of[owner] if len(own) else np.zeros(0, bool)
    lang = np.where(follows, own[np.maximum(last, 0)], np.where(precedes, own[np.minimum(after, max(len(own) - 1, 0))], whole_posterior.argmax(axis=1)[owner])) if len(own) else own
    lang = np.where(silent[owner], -1, lang)
    begins = np.ones(len(own), bool)
    begins[1:] = (owner[1:] != owner[:-1]) | (lang[1:] != lang[:-1])
    at = np.flatnonzero(begins)
    seg_owner, seg_lang = owner[at], lang[at]
    n_sentences = np.diff(np.concatenate([at, [len(own)]]))
    sums = np.add.reduceat(score, at, axis=0) if len(at) else np.zeros((0, size))
    sure = _posterior(sums + base[seg_owner])[np.arange(len(at)), np.maximum(seg_lang, 0)] if len(at) else np.zeros(0)
    mine = np.where((own == lang) & (own >= 0) | (~follows & ~precedes), n_words, 0) if len(own) else n_words
    longest = np.maximum.reduceat(mine, at) if len(at) else np.zeros(0, int)
    # documents without sentences have one segment of no language
    bare = np.flatnonzero(counts == 0)
    seg_owner = np.concatenate([seg_owner, bare])
    order = np.argsort(seg_owner, kind="stable")
    seg_owner = seg_owner[order]
    seg_lang = np.concatenate([seg_lang, np.full(len(bare), -1)])[order]
    sure = np.where(seg_lang < 0, 0.0, np.concatenate([sure, np.zeros(len(bare))])[order])
    n_sentences = np.concatenate([n_sentences, np.zeros(len(bare), int)])[order]
    longest = np.concatenate([longest, np.zeros(len(bare), int)])[order]
    number = np.arange(len(seg_owner)) - np.searchsorted(seg_owner, seg_owner, "left") + 1
    names = np.array([*LANGUAGES, None], dtype=object)
    main = np.where(silent, -1, whole_posterior.argmax(axis=1))
    main_sure = np.where(silent, 0.0, whole_posterior.max(axis=1))
    columns = {
        "doc_id": doc_ids.take(pa.array(seg_owner)),
        "labelled": pa.array([labels[k] for k in seg_owner.tolist()], pa.string()),
        "main": pa.array(names[main[seg_owner]].tolist(), pa.string()),
        "main_confidence": pa.array(main_sure[seg_owner], pa.float64()),
        "segment_no": pa.array(number, pa.int32()),
        "lang": pa.array(names[seg_lang].tolist(), pa.string()),
        "confidence": pa.array(sure, pa.float64()),
        "n_sentences": pa.array(n_sentences, pa.int32()),
        "longest": pa.array(longest, pa.int32()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def foreign_languages(segments: DataFrame, words: int = SENTENCE_WORDS) -> DataFrame:
    """(doc_id, lang): languages with a sentence of ``words`` words or more that are not the one the label names."""
    return segments.where(F.col("lang").isNotNull() & (F.col("longest") >= words) & ~F.col("lang").eqNullSafe(F.col("labelled"))).select("doc_id", "lang").distinct()
