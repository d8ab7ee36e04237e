"""Journal tables: latest rows, upserts, new ids, backfill, votes, consensus, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def latest_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the last one by ``order`` (nulls first). Null keys are one key.

    An aggregate and not a window: rows are reduced before the shuffle, so a hot key is one row a task.
    """
    rest = [x for x in rows.columns if x not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*(F.struct(F.col(o).isNotNull(), F.col(o)) for o in order))).alias("row"))
    return best.select(*keys, *(F.col("row")[x].alias(x) for x in rest)).select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], id_column: str, order: list[str]) -> DataFrame:
    """The rows of ``old`` with those of ``new`` put in by key: the last row of a key wins and keeps the first id."""
    every = old.unionByName(new)
    first = every.groupBy(*keys).agg(F.min(id_column).alias(id_column))
    last = latest_rows(every, keys, order).drop(id_column)
    same = [last[k].eqNullSafe(first[k]) for k in keys]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return last.join(first, condition).select(first[id_column], *(last[x] for x in last.columns)).select(*old.columns)


def with_new_ids(old: DataFrame, new: DataFrame, id_column: str, order: list[str]) -> DataFrame:
    """``new`` with ids after the largest of ``old``, in the order of ``order``.

    Rows are range-partitioned by the order, counted for each partition, and numbered inside their partition after
    the counts of the ones before: no task sees all rows. The counts are one number a partition.
    """
    start = old.agg(F.coalesce(F.max(id_column), F.lit(0))).first()[0]
    ranged = new.repartitionByRange(*(F.col(o) for o in order)).sortWithinPartitions(*order)
    # written once: the numbers of a partition and its count must come from one and the same partitioning
    numbered = cut(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    counts = numbered.groupBy("_part").agg(F.count("*").alias("n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return numbered.join(F.broadcast(before), "_part").withColumn(id_column, F.lit(start) + 1 + F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def missing_children(parents: DataFrame, key: str, children: DataFrame, child_key: str) -> DataFrame:
    """Parents without a child."""
    return parents.join(children.select(F.col(child_key).alias(key)).distinct(), key, "left_anti")


def majority(votes: DataFrame, keys: list[str], vote: str, number: str) -> DataFrame:
    """(keys, winner, n_votes, n_winner): the most frequent vote, the earliest on a tie; null where none comes twice."""
    counted = votes.groupBy(*keys, vote).agg(F.count("*").alias("n"), F.min(number).alias("first"))
    best = counted.groupBy(*keys).agg(F.max_by(F.struct(F.col(vote).alias("v"), "n"), F.struct("n", -F.col("first"))).alias("best"), F.sum("n").alias("n_votes"))
    return best.select(*keys, F.when(F.col("best")["n"] > 1, F.col("best")["v"]).alias("winner"), "n_votes", F.col("best")["n"].alias("n_winner"))


def consensus(items: DataFrame, keys: list[str], item: str, run: str, runs: DataFrame) -> DataFrame:
    """Items that at least half of a key's runs (rounded up) have. ``runs``: keys and ``n_runs``."""
    seen = items.groupBy(*keys, item).agg(F.count_distinct(run).alias("n_seen"), F.min(run).alias("first_run"))
    return seen.join(runs, keys).where(F.col("n_seen") >= F.floor((F.col("n_runs") + 1) / 2))


def status_counts(status: Column, applicable: Column) -> list[Column]:
    """Counters of the statuses of rows that apply, and of those that do not."""
    own = lambda s: F.count_if(applicable & (status == s)).alias(f"n_{s}")
    return [own("violation"), own("manual"), own("ok"), F.count_if(~applicable).alias("n_na")]


def share(part: Column, whole: Column, digits: int = 3) -> Column:
    return F.round(F.try_divide(part, whole), digits)


def longest_prefix(rows: DataFrame, name: str, prefixes: DataFrame, prefix: str, longest: int) -> DataFrame:
    """``rows`` with the columns of the longest prefix of their name, null where none fits.

    Every name is expanded to its own prefixes up to ``longest`` characters and joined by equality, in place of a
    comparison of all names with all prefixes.
    """
    names = rows.select(name).where(F.col(name).isNotNull()).distinct()
    starts = names.withColumn(prefix, F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length(name), F.lit(longest))), lambda i: F.substring(F.col(name), F.lit(1), i))))
    rest = [x for x in prefixes.columns if x != prefix]
    best = starts.join(prefixes, prefix).groupBy(name).agg(F.max_by(F.struct(prefix, *rest), F.length(prefix)).alias("best"))
    return rows.join(best, name, "left").select(*rows.columns, F.col("best")[prefix].alias(prefix), *(F.col("best")[x].alias(x) for x in rest))
