"""Checks of read text against an independent source: sets of words, digits, near words, boxes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Latin letters drawn like Cyrillic ones as capitals or small ones, in lower case as the words are.
LOOK_ALIKES = "abcehkmoptxy", "авсенкмортху"


def missing_words(source: Column, read: Column, squashed: Column) -> Column:
    """Words of ``source`` that were not read, not even inside the text without blanks; sorted."""
    return F.sort_array(F.filter(F.array_except(source, read), lambda w: ~squashed.contains(w)))


def invented_words(read: Column, source: Column, squashed: Column) -> Column:
    """Read words that the source lacks, repeated ones kept, in order."""
    return F.filter(read, lambda w: ~F.array_contains(source, w) & ~squashed.contains(w))


def coverage(missing: Column, source: Column) -> Column:
    """1 - missing / source; null without a source."""
    return 1 - F.size(missing) / F.nullif(F.size(source), F.lit(0))


def near_pairs(left: DataFrame, right: DataFrame, within: list[str], limit: int = 2, least: int = 5) -> DataFrame:
    """(within, word_1, word_2, distance): words of one group at most ``limit`` edits apart.

    ``left``, ``right``: ``within`` columns and ``word``. A word that is at most k edits from another shares one of
    its k + 1 pieces with it at a place shifted by at most k: the words are joined by (piece, length of the word,
    place), never all with all, and the edit distance is taken of what meets.
    """
    n = limit + 1
    words = left.select(*within, F.col("word").alias("word_1")).distinct().where(F.length("word_1") >= least)
    base = words.withColumn("len", F.length("word_1")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(limit))))
    base = base.withColumn("at", F.floor(F.col("len") * F.col("i") / n)).withColumn("size", F.floor(F.col("len") * (F.col("i") + 1) / n) - F.col("at"))
    base = base.withColumn("piece", F.expr("substring(word_1, int(at) + 1, int(size))"))
    # the other side offers its substrings of the piece's size around the piece's place, for every length it may meet
    other = right.select(*within, F.col("word").alias("word_2")).distinct().where(F.length("word_2") >= least)
    spread = other.withColumn("len", F.explode(F.sequence(F.greatest(F.length("word_2") - limit, F.lit(least)), F.length("word_2") + limit))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(limit))))
    spread = spread.withColumn("at", F.floor(F.col("len") * F.col("i") / n)).withColumn("size", F.floor(F.col("len") * (F.col("i") + 1) / n) - F.col("at"))
    spread = spread.withColumn("from", F.explode(F.sequence(F.greatest(F.col("at") - limit, F.lit(0)), F.col("at") + limit)))
    spread = spread.withColumn("piece", F.expr("substring(word_2, int(`from`) + 1, int(size))")).where(F.length("piece") == F.col("size"))
    met = base.select(*within, "word_1", "len", "i", "piece").join(spread.select(*within, "word_2", "len", "i", "piece").distinct(), [*within, "len", "i", "piece"])
    pairs = met.select(*within, "word_1", "word_2").distinct().where("word_1 <> word_2")
    return pairs.withColumn("distance", F.levenshtein("word_1", "word_2", limit)).where("distance >= 0")


def nearest(pairs: DataFrame, within: list[str]) -> DataFrame:
    """A 1:1 assignment of the words, nearest pairs first, ties by the words.

    A word whose nearest partner is taken gets the next free one; the result is that of taking the mutually nearest
    pairs again and again until no pair of free words is left. The assignment runs once for each group, over its
    pairs. Pairs that only differ in look-alike letters are named so.
    """

    def assign(group: pa.Table) -> pa.Table:
        group = group.sort_by([("distance", "ascending"), ("word_1", "ascending"), ("word_2", "ascending")])
        taken_1, taken_2, kept = set(), set(), []
        for i, (a, b) in enumerate(zip(group["word_1"].to_pylist(), group["word_2"].to_pylist(), strict=True)):
            if a not in taken_1 and b not in taken_2:
                taken_1.add(a)
                taken_2.add(b)
                kept.append(i)
        return group.take(pa.array(kept, pa.int64()))

    rows = pairs.select(*within, "word_1", "word_2", "distance")
    best = rows.groupBy(*within).applyInArrow(assign, rows.schema)
    fold = lambda w: F.translate(F.lower(w), *LOOK_ALIKES)
    return best.withColumn("kind", F.when(fold("word_1") == fold("word_2"), "homoglyph").otherwise("substitution"))
