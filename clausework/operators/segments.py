"""Ordered segmentation of texts into lines, clauses, parts and windows.

The order is inside one text, so most of this is done with array functions on the row that holds the text: no
shuffle, and no window whose partition would be one long document. What runs over the rows of a document, such as
carried headings and runs of parts, is done in range partitions (:class:`Ordered`).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no from 0, line)."""
    return rows.select(key, F.posexplode(lines_of(F.col(text))).alias("line_no", "line"))


def clean_lines(array: Column, substrings: list[str], patterns: list[str]) -> tuple[Column, Column]:
    """(kept, dropped) lines, stripped; a line that holds a substring or starts with a pattern is dropped with its
    rule's name, blank lines vanish."""
    stripped = F.transform(array, lambda x: F.trim(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")))
    full = F.filter(stripped, lambda x: F.length(x) > 0)

    def rule(x: Column) -> Column:
        out = F.lit(None).cast("string")
        for s in reversed(patterns):
            out = F.when(x.rlike("^(?:" + s + ")"), F.lit("pattern " + s)).otherwise(out)
        for s in reversed(substrings):
            out = F.when(x.contains(s), F.lit("text " + s)).otherwise(out)
        return out

    kept = F.filter(full, lambda x: rule(x).isNull())
    dropped = F.filter(F.transform(full, lambda x: F.struct(x.alias("line"), rule(x).alias("rule"))), lambda x: x["rule"].isNotNull())
    return kept, dropped


def drop_blocks(array: Column, start: str, end: str, span: int) -> Column:
    """Lines without the blocks from a line that matches ``start`` to the first line that matches ``end`` within ``span``.

    A start inside a block that is dropped already opens none; one without an end in reach stays, as does an end alone.
    """
    n = F.size(array)
    first = F.struct(F.lit(0).alias("at"), F.lit(0).alias("until"), F.array().cast("array<string>").alias("kept"))

    def step(s: Column, line: Column) -> Column:
        ends = F.filter(F.sequence(s["at"] + 1, F.least(s["at"] + span, n - 1)), lambda i: F.get(array, i).rlike(end))
        opens = (s["at"] >= s["until"]) & line.rlike(start) & (s["at"] + 1 < n)
        until = F.when(opens & (F.size(ends) > 0), F.get(ends, F.lit(0)) + 1).otherwise(s["until"])
        inside = s["at"] < until
        return F.struct((s["at"] + 1).alias("at"), until.alias("until"), F.when(inside, s["kept"]).otherwise(F.array_append(s["kept"], line)).alias("kept"))

    return F.aggregate(array, first, step)["kept"]


def segment_ids(rows: DataFrame, key: str, order: str, is_head: Column, name: str = "segment") -> DataFrame:
    """Rows with the number of heads up to them, 0 before the first."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(F.when(is_head, 1).otherwise(0)).over(w))


class Ordered:
    """Rows in the order of ``keys`` and ``order``, in range partitions: a long document is as many tasks as it needs.

    What a row needs of the rows before it (the last value, the previous row, a running sum) is found inside its
    partition; what comes from the partitions before is one row for each key and partition. The rows are written
    once, so that both parts see the same partitions. Ties in the order are broken by all other columns.
    """

    def __init__(self, rows: DataFrame, keys: list[str], order: list[str]):
        self.keys, self.rest = keys, [*order, *(c for c in rows.columns if c not in (*keys, *order))]
        by = [*keys, *order]
        ranged = rows.repartitionByRange(*(F.col(c) for c in by)).sortWithinPartitions(*keys, *self.rest)
        self.rows = cut(ranged.withColumn("_part", F.spark_partition_id()))

    def _inside(self) -> Window:
        return Window.partitionBy("_part", *self.keys).orderBy(*self.rest)

    def _before(self, ends: DataFrame, columns: dict[str, Column]) -> DataFrame:
        """``ends`` (a row for each part and key) with what the parts before give."""
        earlier = Window.partitionBy(*self.keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        return ends.select("_part", *self.keys, *(value.over(earlier).alias(name) for name, value in columns.items()))

    def _with(self, rows: DataFrame, ends: DataFrame) -> DataFrame:
        same = [rows[k].eqNullSafe(ends[k]) for k in ("_part", *self.keys)]
        condition = same[0]
        for x in same[1:]:
            condition = condition & x
        return rows.join(ends, condition, "left").drop(*(ends[k] for k in ("_part", *self.keys)))

    def carry(self, value: Column, name: str) -> Ordered:
        """The last non-null ``value`` up to each row."""
        inside = self.rows.withColumn(name, F.last(value, ignorenulls=True).over(self._inside().rowsBetween(Window.unboundedPreceding, 0)))
        ends = inside.groupBy("_part", *self.keys).agg(F.max_by(name, F.struct(F.col(name).isNotNull(), F.struct(*self.rest))).alias("_last"))
        before = self._before(ends, {"_carried": F.last("_last", ignorenulls=True)})
        return self._next(self._with(inside, before.toDF(*before.columns)).withColumn(name, F.coalesce(name, "_carried")).drop("_carried"), name)

    def previous(self, column: str, name: str) -> Ordered:
        """``column`` of the row before, of the same key."""
        inside = self.rows.withColumn(name, F.lag(column).over(self._inside())).withColumn("_first", F.row_number().over(self._inside()) == 1)
        ends = self.rows.groupBy("_part", *self.keys).agg(F.max_by(F.struct(F.col(column).alias("v")), F.struct(*self.rest)).alias("_last"))
        before = self._before(ends, {"_carried": F.last("_last")})
        found = F.when(F.col("_first"), F.col("_carried.v")).otherwise(F.col(name))
        return self._next(self._with(inside, before.toDF(*before.columns)).withColumn(name, found).drop("_carried", "_first"), name)

    def running(self, number: Column, name: str) -> Ordered:
        """The sum of ``number`` up to each row."""
        inside = self.rows.withColumn(name, F.sum(number).over(self._inside().rowsBetween(Window.unboundedPreceding, 0)))
        ends = self.rows.groupBy("_part", *self.keys).agg(F.sum(number).alias("_sum"))
        before = self._before(ends, {"_carried": F.sum("_sum")})
        return self._next(self._with(inside, before.toDF(*before.columns)).withColumn(name, F.col(name) + F.coalesce("_carried", F.lit(0))).drop("_carried"), name)

    def _next(self, rows: DataFrame, name: str) -> Ordered:
        out = object.__new__(Ordered)
        out.keys, out.rest, out.rows = self.keys, [*self.rest, name], rows
        return out

    def done(self) -> DataFrame:
        return self.rows.drop("_part")


def pack(array: Column, limit: int) -> Column:
    """Parts of whole lines, each of at most ``limit`` characters with the line ends; a longer line is a part of its own."""
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(None).cast("string").alias("open"))

    def put(acc: Column, line: Column) -> Column:
        joined = F.concat(acc["open"], F.lit("\n"), line)
        fits = acc["open"].isNotNull() & (F.length(joined) <= limit)
        closed = F.when(acc["open"].isNull() | fits, acc["parts"]).otherwise(F.concat(acc["parts"], F.array(acc["open"])))
        return F.struct(closed.alias("parts"), F.when(fits, joined).otherwise(line).alias("open"))

    done = F.aggregate(array, start, put)
    return F.when(done["open"].isNull(), done["parts"]).otherwise(F.concat(done["parts"], F.array(done["open"])))


def windows(array: Column, size: int = 30, step: int = 27, head: int = 6) -> Column:
    """Overlapping windows of lines: structs of ``window_no``, ``first``, ``rows``; all after the first repeat the head."""
    n = F.size(array)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))
    starts = F.filter(starts, lambda i: (i == 0) | (i + (size - step) < n))
    return F.when(n > 0, F.transform(starts, lambda i, k: F.struct(k.alias("window_no"), i.alias("first"), F.when(i == 0, F.slice(array, 1, size)).otherwise(F.concat(F.slice(array, 1, head), F.slice(array, i + 1, F.lit(size)))).alias("rows"))))


def positional_ids(rows: DataFrame, stem: str, order: list[str], name: str = "chunk_id") -> DataFrame:
    """``stem:0000`` onwards within each stem, in order."""
    numbered = Ordered(rows, [stem], order).running(F.lit(1), "_n").done()
    return numbered.withColumn(name, F.format_string("%s:%04d", F.col(stem), F.col("_n") - 1)).drop("_n")


def islands(rows: Ordered, follows: Column, name: str = "island") -> DataFrame:
    """Numbers of runs: a row starts a new run where ``follows`` (of its own columns and those of the row before) is not true."""
    return rows.running(F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1), name).done()


def prefixes(address: Column, separator: str = ".") -> Column:
    """The address and its beginnings, each up to a separator: 1.2.3 as 1.2.3, 1.2 and 1."""
    parts = F.split(address, re.escape(separator))
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), separator))
