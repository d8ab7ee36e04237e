"""References to records that do not exist, were deleted or came later."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ways into which the rows of one key are split in the join of rows and suspect keys.
SALTS = 16


def suspect_keys(children: list[tuple[str, DataFrame]], parents: DataFrame, deleted: DataFrame) -> DataFrame:
    """Keys that some row refers to and that are not among ``parents``, or came after such a row.

    ``children``: (table name, frame with ``ref_key``, ``seen_at``); ``parents``: ``ref_key``, ``seen_at``;
    ``deleted``: ``ref_key``. All are laid in long form under one key column with a tag each and grouped once;
    the tags are aggregated before the shuffle, so a key that holds a third of all rows is one row for each task.

    Columns out: ``ref_key``, ``has_parent``, ``parent_at``, ``was_deleted``.
    """
    none_at = F.lit(None).cast("timestamp")
    tagged = [c.select("ref_key", F.lit(0).alias("tag"), F.col("seen_at").alias("child_at"), none_at.alias("parent_at")) for _, c in children]
    tagged.append(parents.select("ref_key", F.lit(1).alias("tag"), none_at.alias("child_at"), F.col("seen_at").alias("parent_at")))
    tagged.append(deleted.select("ref_key", F.lit(2).alias("tag"), none_at.alias("child_at"), none_at.alias("parent_at")))
    grouped = (
        reduce(DataFrame.unionByName, tagged)
        .where("ref_key is not null")
        .groupBy("ref_key")
        .agg(
            F.max(F.when(F.col("tag") == 0, 1).otherwise(0)).alias("has_child"),
            F.max(F.when(F.col("tag") == 1, 1).otherwise(0)).alias("has_parent"),
            F.max(F.when(F.col("tag") == 2, 1).otherwise(0)).alias("was_deleted"),
            F.min("child_at").alias("child_at"),
            F.min("parent_at").alias("parent_at"),
        )
    )
    return grouped.where("has_child = 1 and (has_parent = 0 or child_at < parent_at)").select("ref_key", "has_parent", "parent_at", "was_deleted")


def orphan_references(children: list[tuple[str, DataFrame]], parents: DataFrame, deleted: DataFrame, salts: int = SALTS) -> DataFrame:
    """Rows whose reference leads nowhere: one row for each (table, row id), with the reason and the month.

    ``children``: (table name, frame with ``row_id``, ``ref_key``, ``seen_at``); the others as in
    :func:`suspect_keys`. Columns out: ``table_name``, ``row_id``, ``ref_key``, ``reason``, ``period``.

    ``reason`` is ``deleted`` or ``missing`` where the key has no parent, ``late`` where the parent came after
    the row. Repeated deliveries of a row or of a parent count with their earliest ``seen_at``. Null keys refer
    to nothing and do not come out. A null ``seen_at`` is never late, and its ``period`` is null. A key that was
    deleted and put back has a parent. Empty tables give no rows; further columns are ignored.

    The rows are joined with the suspect keys on key and salt (a function of the row id), so that a hot key is
    spread over ``salts`` tasks; the deduplication behind it needs no further shuffle, because it groups by a
    superset of the join's keys.
    """
    suspects = suspect_keys(children, parents, deleted).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = reduce(
        DataFrame.unionByName,
        [c.where("ref_key is not null").select(F.lit(name).alias("table_name"), "row_id", "ref_key", "seen_at") for name, c in children],
    ).withColumn("salt", F.pmod(F.hash("row_id"), F.lit(salts)))
    found = (
        rows.join(suspects, ["ref_key", "salt"])
        .groupBy("ref_key", "salt", "table_name", "row_id")
        .agg(
            F.min("seen_at").alias("seen_at"),
            F.max("has_parent").alias("has_parent"),
            F.max("was_deleted").alias("was_deleted"),
            F.max("parent_at").alias("parent_at"),
        )
        .where("has_parent = 0 or seen_at < parent_at")
    )
    return found.select(
        "table_name",
        "row_id",
        "ref_key",
        F.when(F.col("has_parent") == 1, "late").when(F.col("was_deleted") == 1, "deleted").otherwise("missing").alias("reason"),
        F.date_format("seen_at", "yyyy-MM").alias("period"),
    )


def orphans_by_period(orphans: DataFrame) -> DataFrame:
    """Counts of rows and of distinct keys for each table, reason and month."""
    by_key = orphans.groupBy("table_name", "reason", "period", "ref_key").agg(F.count("*").alias("n"))
    return by_key.groupBy("table_name", "reason", "period").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"))
