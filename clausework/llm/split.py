"""Splitting oversized texts at natural boundaries."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import per_batch, strip_unicode

LIMIT = 3500
OVERLAP = 200
#: Natural ends, the better first: a line end; the end of a sentence or of a list entry.
LINE_END = re.compile(r"\n")
SENTENCE_END = re.compile(r"[.!?…]+[)\]»\"'”’]*(?=\s)|[;:](?=\s)")
TOKEN = re.compile(r"\s*\S+|\s+")


def cut_points(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of each piece of ``text``, in code points.

    Tokens are words with the white space before them; the prefix sums of their lengths are the offsets at which
    a piece may end in need. Line ends and ends of sentences and entries are two sorted arrays of better offsets.
    For each piece a binary search finds the last offset within the limit: a line end, else a sentence end in the
    second half of the piece, else a word end, else a hard cut. The next piece starts at most ``overlap`` before
    the end, at the first natural boundary there, else at the first word, else exactly ``overlap`` before.
    """
    n = len(text)
    if n <= limit:
        return [(0, n)]
    words = [0, *accumulate(m.end() - m.start() for m in TOKEN.finditer(text))]
    lines = [m.end() for m in LINE_END.finditer(text)]
    sentences = [m.end() for m in SENTENCE_END.finditer(text)]
    natural = sorted({*lines, *sentences})
    pieces, start, least = [], 0, 1
    while n - start > limit:
        top = start + limit
        for bounds, floor in ((lines, start + limit // 2), (sentences, start + limit // 2), (natural, start), (words, start)):
            i = bisect_right(bounds, top) - 1
            if i >= 0 and bounds[i] > floor and bounds[i] >= least:
                end = bounds[i]
                break
        else:
            end = top
        pieces.append((start, end))
        least = end + 1  # each piece must add something to the one before
        back = max(start + 1, end - overlap)
        start = back
        for bounds in (natural, words):
            i = bisect_left(bounds, back)
            if i < len(bounds) and bounds[i] < end:
                start = bounds[i]
                break
    pieces.append((start, n))
    return pieces


def split_oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of at most ``limit`` code points: ``chunk_id``, ``piece_no`` from 1, ``n_pieces``, ``overlap``, ``text``.

    ``chunks``: ``chunk_id``, ``text``. White space at a text's ends is taken off first; then the pieces without
    their overlaps, joined, are the text. A text within the limit is one piece; a null text is one piece with a
    null text, an empty or blank text one piece with the empty text. Repeated rows of one id and text come out
    once. Ids that stand for several different texts keep the pieces of each. Further columns are dropped, an
    empty table gives no rows.

    Only the texts above the limit pass through Python; a text is cut by itself, so the work follows the number
    of rows and nothing is shuffled but the removal of repeated rows.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    texts = chunks.select("chunk_id", strip_unicode(F.col("text")).alias("text")).dropDuplicates(["chunk_id", "text"])
    small = texts.where(F.coalesce(F.char_length("text"), F.lit(0)) <= limit)
    whole = small.select("chunk_id", F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("overlap"), "text")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, numbers, counts, overlaps, pieces = [], [], [], [], []
        for chunk_id, text in zip(batch["chunk_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            spans = cut_points(text, limit, overlap)
            before = 0
            for k, (a, b) in enumerate(spans):
                ids.append(chunk_id)
                numbers.append(k + 1)
                counts.append(len(spans))
                overlaps.append(before - a if k else 0)
                pieces.append(text[a:b])
                before = b
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.string()), *(pa.array(x, pa.int32()) for x in (numbers, counts, overlaps)), pa.array(pieces, pa.string())],
            ["chunk_id", "piece_no", "n_pieces", "overlap", "text"],
        )

    large = texts.where(F.char_length("text") > limit)
    return whole.unionByName(large.mapInArrow(per_batch(cut), "chunk_id string, piece_no int, n_pieces int, overlap int, text string"))
