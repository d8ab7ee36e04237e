"""Sampling, quotas and quality counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import short_hash


def seeded_order(key: str, seed: int) -> Column:
    """An order that any engine can repeat: the MD5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def stratified(rows: DataFrame, strata: list[str], key: str, size: int, seed: int) -> DataFrame:
    """The first ``size`` rows of each stratum in seeded order, with their place; the next ``size`` are its reserve.

    Spark cuts each partition to 2 x ``size`` rows a stratum before the shuffle.
    """
    w = Window.partitionBy(*strata).orderBy(seeded_order(key, seed), key)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= 2 * size).withColumn("reserve", F.col("place") > size)


def allocate(strata: DataFrame, name: str, available: str, quota: int, floor: int) -> DataFrame:
    """Shares of ``quota``: each stratum its floor (at most what it has), the rest in proportion by largest
    remainder, never above what is there; ties by name.

    One row a stratum comes in, so the windows over all of them are small. Where the floors alone exceed the
    quota, strata late in the alphabet give up one each in turn, from the last.
    """
    every = Window.partitionBy(F.lit(0))
    rows = strata.select(F.col(name), F.col(available).cast("bigint").alias("have")).withColumn("low", F.least("have", F.lit(floor)))
    rows = rows.withColumn("over", F.greatest(F.sum("low").over(every) - quota, F.lit(0)))
    after = Window.orderBy(F.desc(name)).rowsBetween(Window.unboundedPreceding, -1)
    # what exceeds the quota is taken off from the last stratum on
    rows = rows.withColumn("low", F.col("low") - F.least("low", F.greatest(F.col("over") - F.coalesce(F.sum("low").over(after), F.lit(0)), F.lit(0)))).drop("over")
    rows = rows.withColumn("left", F.lit(quota) - F.sum("low").over(every)).withColumn("room", F.col("have") - F.col("low"))
    exact = F.coalesce(F.try_divide(F.col("left") * F.col("room"), F.sum("room").over(every)), F.lit(0.0))
    rows = rows.withColumn("exact", F.least(exact, F.col("room").cast("double"))).withColumn("whole", F.floor("exact"))
    rows = rows.withColumn("rest", F.least(F.col("left"), F.sum("room").over(every)) - F.sum("whole").over(every))
    place = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("exact") - F.col("whole"), 9)), name))
    extra = F.when((place <= F.col("rest")) & (F.col("whole") < F.col("room")), 1).otherwise(0)
    return rows.withColumn("extra", extra).select(name, "have", (F.col("low") + F.col("whole") + F.col("extra")).alias("share"))


def duplicates(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Values that stand in several rows, with how many."""
    return rows.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def ground_truth(rows: DataFrame, key: str, fields: list[str], problems: dict[str, Column], seals: DataFrame | None = None) -> DataFrame:
    """(key, problems, seal): each row with what is wrong with it and the hash of its fields.

    ``seals``: key and ``expected``; a row whose seal is another one, or has none, is an error when it is met.
    """
    seal = short_hash(F.col(key).cast("string"), *(F.coalesce(F.col(f), F.lit("")) for f in fields))
    wrong = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in problems.items())))
    out = rows.select(key, F.array_join(wrong, "|").alias("problems"), seal.alias("seal"))
    if seals is None:
        return out
    checked = F.when(F.col("seal").eqNullSafe(F.col("expected")), F.col("seal")).otherwise(F.raise_error(F.concat(F.lit("seal broken: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))))
    return out.join(seals, key, "left").select(key, "problems", checked.cast("string").alias("seal"))
