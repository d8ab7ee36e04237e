"""Exact byte-pair encoding by dynamic programming over prefixes.

Every prefix of a piece of text has exactly one last token in its encoding. A token that ends at a position can
only be that last token if the last token of the prefix before it and the token itself stay two tokens when they
are encoded together. So one pass from left to right, with all vocabulary entries that end at each position from
an automaton and a test of pairs, finds the last token of every prefix; the back-pointers give the ids.
"""

from __future__ import annotations

import hashlib
import json
import os

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ..session import spread
from .arrow import lists, per_batch

#: Where the vocabulary files of public tokenizers lie on this machine; callers may pass another folder.
TOKENIZERS = "/opt/tokenizers"
#: A vocabulary file is sent to every executor; a larger one is refused.
MAX_VOCABULARY_BYTES = 64 << 20
#: The published splitting pattern of the byte-level vocabularies: no token crosses a piece.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces of which a worker keeps the encoding.
MEMORY = 400_000
NEVER = 1 << 30


def _byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """The vocabulary of a byte-level BPE file (``vocab`` and ordered ``merges``)."""

    def __init__(self, file: bytes):
        model = json.loads(file)["model"]
        names = _byte_names()
        self.id_of: dict[str, int] = {}
        for token, i in model["vocab"].items():
            if all(c in names for c in token):
                self.id_of["".join(chr(names[c]) for c in token)] = i  # bytes as the first 256 characters
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: (left, right) -> (order of the merge, id made); made id -> (order, left, right)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        vocab = model["vocab"]
        for order, (a, b) in enumerate(merges):
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            self.merge[left, right] = order, made
            self.parts.setdefault(made, (order, left, right))
        self._left: dict[int, list[tuple[int, int, int]]] = {}
        self._right: dict[int, list[tuple[int, int, int]]] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in self.id_of.items():
            part = self.parts.get(i)
            if (part is None and len(token) == 1) or (part is not None and self._apart(part[1], part[2], part[0])):
                self.automaton.add_word(token, (i, len(token)))
        self.automaton.make_automaton()
        self._memory: dict[str, bytes] = {}
        self._pieces = regex.compile(PIECES)

    def _edge(self, token: int, right: bool) -> list[tuple[int, int, int]]:
        """(sub-token, order of the merge that made it, order of the one that ends it) along one edge of the token's tree."""
        store = self._right if right else self._left
        if token not in store:
            out, end = [], NEVER
            while True:
                part = self.parts.get(token)
                out.append((token, part[0] if part else -1, end))
                if part is None:
                    break
                end, token = part[0], part[2] if right else part[1]
            store[out[0][0]] = out
            return out
        return store[token]

    def _apart(self, a: int, b: int, until: int = NEVER) -> bool:
        """True if no merge crosses the border of ``a`` and ``b`` before the merge number ``until``.

        A crossing merge joins a sub-token at the right edge of ``a`` with one at the left edge of ``b`` while both
        exist. Of two places for the same merge the left one goes first, so a merge that is as early as the one
        that ends the right-hand sub-token still crosses.
        """
        for x, born_x, end_x in self._edge(a, True):
            for y, born_y, end_y in self._edge(b, False):
                found = self.merge.get((x, y))
                if found is None:
                    continue
                order = found[0]
                if order < until and order < end_x and order <= end_y and max(born_x, born_y) < min(end_x, end_y):
                    return False
        return True

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of a piece that the splitting pattern leaves whole."""
        n = len(piece)
        last = [-1] * (n + 1)
        size = [0] * (n + 1)
        fits = self._fits
        at = 0
        for end, (token, length) in self.automaton.iter(piece.decode("latin-1")):  # of one end the longest first
            at = end + 1
            if last[at] >= 0:
                continue
            start = at - length
            if start:
                before = last[start]
                if before < 0:
                    continue
                pair = before, token
                ok = fits.get(pair)
                if ok is None:
                    if len(fits) >= 4 * MEMORY:
                        fits.clear()
                    ok = fits[pair] = self._apart(before, token)
                if not ok:
                    continue
            last[at], size[at] = token, length
        if n and last[n] < 0:
            raise ValueError("the vocabulary lacks a byte of the text")
        out, at = [], n
        while at:
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text as consecutive 32-bit integers; names of special tokens are plain text."""
        memory = self._memory
        pieces = self._pieces.findall(text)
        try:
            return b"".join([memory[p] for p in pieces])
        except KeyError:
            pass
        out = []
        for p in pieces:
            ids = memory.get(p)
            if ids is None:
                ids = np.array(self.encode_piece(p.encode("utf-8", "surrogatepass")), dtype=np.int32).tobytes()
                if len(memory) < MEMORY:
                    memory[p] = ids
            out.append(ids)
        return b"".join(out)


_ENCODERS: dict[str, Encoder] = {}


def encoder(file: bytes) -> Encoder:
    """The encoder of a file's content, built once in each worker process."""
    key = hashlib.sha256(file).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(file)
    return _ENCODERS[key]


def encode_texts(documents: DataFrame, tokenizer: str = "byte_bpe_50k.json", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids): the token ids of each document, special tokens neither added nor recognised.

    A null and an empty text give the empty list. Every row of ``documents`` comes out once, repeated ids too;
    further columns are dropped, an empty table gives no rows. Texts are encoded whole, each by itself, where they
    lie: nothing is shuffled. Each worker remembers the encoding of the pieces it has met (up to ``MEMORY``; rarer
    ones are encoded again).
    """
    path = os.path.join(folder, tokenizer)
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is too large to be sent to every executor")
    with open(path, "rb") as f:
        file = documents.sparkSession.sparkContext.broadcast(f.read())

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = encoder(file.value)
        ids = [coder.encode(t) if t else b"" for t in batch["text"].to_pylist()]
        flat = np.frombuffer(b"".join(ids), dtype=np.int32)
        return pa.RecordBatch.from_arrays([batch["doc_id"], lists(flat, [len(x) // 4 for x in ids])], ["doc_id", "ids"])

    return spread(documents.select("doc_id", "text")).mapInArrow(per_batch(encode), "doc_id bigint, ids array<int>")
