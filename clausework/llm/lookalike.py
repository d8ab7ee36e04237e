"""Visually identical text with different characters."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread
from .arrow import per_batch
from .chars import canonical, skeleton


FORMS = {"canonical": canonical, "skeleton": skeleton}


def canonical_texts(rows: DataFrame, key: str = "region_key", text: str = "text", keep: tuple[str, ...] = (), forms: tuple[str, ...] = ("canonical", "skeleton")) -> DataFrame:
    """``key``, the columns of ``keep``, ``text`` and the ``forms`` (``canonical``, ``skeleton``): one row for each row.

    A null text has null forms, an empty one empty forms. Each text is settled by itself, without a shuffle.
    """
    wanted = spread(rows.select(key, *keep, F.col(text).alias("text")))

    def settle(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch["text"].to_pylist()
        made = [pa.array([None if t is None else FORMS[f](t) for t in texts], pa.string()) for f in forms]
        return pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *forms])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields)
    return wanted.mapInArrow(per_batch(settle), schema + "".join(f", {f} string" for f in forms))


def _rows_by_look(rows: DataFrame, key: str, within: str) -> DataFrame:
    """``row_key`` and two hashes, ``look`` (of ``within`` and the skeleton) and ``form`` (of the stored text), each row once.

    Written once: small rows that all joins read, so that each text is settled once.
    """
    hashed = lambda *parts: F.substring(F.unhex(F.sha2(F.concat_ws("\x00", *parts), 256)), 1, 16)
    wanted = rows.where(f"`{within}` is not null and text is not null and text <> ''")
    settled = canonical_texts(wanted, key, keep=(within,), forms=("skeleton",))
    return cut(settled.select(F.col(key).alias("row_key"), hashed(F.col(within).cast("string"), F.col("skeleton")).alias("look"), hashed(F.col("text")).alias("form")).distinct())


def _forms(by_look: DataFrame) -> DataFrame:
    """(look, form, n, first): the different texts of each look that has several, with their copies counted."""
    several = by_look.groupBy("look").agg(F.min("form").alias("a"), F.max("form").alias("b")).where("a <> b").select("look")
    return by_look.join(several, "look", "left_semi").groupBy("look", "form").agg(F.count("*").alias("n"), F.min("row_key").alias("first"))


def look_alike_classes(rows: DataFrame, key: str = "region_key", within: str = "source_sha256") -> DataFrame:
    """(row_key, class_id, first_of_form, n_rows, n_forms, n_links): the rows that look like a row of another stored text.

    ``class_id`` is the smallest key of the look within its ``within``, ``first_of_form`` that of the copies with the
    same stored text; two rows are linked if their class is the same and their form is not. ``n_links`` is the number
    of such rows. One row for each row, whatever the number of copies. Nulls and empty texts as in
    :func:`look_alike_pairs`.
    """
    by_look = _rows_by_look(rows, key, within)
    forms = _forms(by_look)
    classes = forms.groupBy("look").agg(F.min("first").alias("class_id"), F.sum("n").alias("n_rows"), F.count("*").alias("n_forms"))
    return (
        by_look.join(forms, ["look", "form"])
        .join(classes, "look")
        .select("row_key", "class_id", F.col("first").alias("first_of_form"), "n_rows", "n_forms", (F.col("n_rows") - F.col("n")).alias("n_links"))
    )


def look_alike_pairs(rows: DataFrame, key: str = "region_key", within: str = "source_sha256") -> DataFrame:
    """(key_1, key_2): rows of one ``within`` that look the same and are not equal as stored, the smaller key first.

    Null and empty texts and rows with a null ``within`` pair with nothing. A text of blanks only looks like any
    other with as many blanks. Repeated rows of one key come out once.

    The distinct texts of one look are paired, one row for each text, and each pair is expanded to the copies of both
    sides: copies of one text never meet, and N copies beside one variant are N rows and N comparisons.
    """
    by_look = _rows_by_look(rows, key, within)
    forms = _forms(by_look).select("look", "form")
    pairs = forms.withColumnRenamed("form", "form_1").join(forms.withColumnRenamed("form", "form_2"), "look").where("form_1 < form_2")
    side = lambda n: by_look.select("look", F.col("form").alias(f"form_{n}"), F.col("row_key").alias(f"row_{n}"))
    both = pairs.join(side(1), ["look", "form_1"]).join(side(2), ["look", "form_2"]).where("row_1 <> row_2")
    return both.select(F.least("row_1", "row_2").alias("key_1"), F.greatest("row_1", "row_2").alias("key_2")).distinct()
