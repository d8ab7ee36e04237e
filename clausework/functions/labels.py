"""Numbers and codes on labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import number

#: The parts of food and the energy of one gram of each, in kcal and in kJ.
PARTS = {"белки": (4, 17), "жиры": (9, 37), "углеводы": (4, 17)}
#: kJ in a kcal, and how far a stated pair may be from it.
RATIO, RATIO_OFF = 4.184, 0.6
_NUMBER = "([0-9]+(?:[.,][0-9]+)?)"
#: Energy in its three forms: kJ before kcal, a pair before its units, kcal alone.
ENERGY = [f"{_NUMBER} ?кдж[^0-9]{{0,6}}{_NUMBER} ?ккал", f"{_NUMBER} ?/ ?{_NUMBER} ?ккал[^0-9]{{0,3}}кдж", f"{_NUMBER} ?ккал"]


def forward(label: str) -> str:
    """The number behind a label."""
    return f"{label}[^0-9,;/]{{0,12}}{_NUMBER}"


def backward(label: str) -> str:
    """The number before a label, with nothing but its unit between."""
    return f"{_NUMBER}[^0-9,;/]{{0,8}}{label}"


def code_pattern(code: Column) -> Column:
    """A pattern of an additive code in either alphabet that no longer number fits."""
    digits = F.regexp_extract(code, "([0-9]+)", 1)
    letter = F.regexp_extract(code, "[0-9]([а-г]?)$", 1)
    suffix = F.when(letter == "", F.lit("")).otherwise(F.concat(F.lit("["), letter, F.translate(letter, "абвг", "abcd"), F.lit("]")))
    return F.concat(F.lit(r"(?:^|[^\p{L}\p{N}])[eе] ?"), digits, suffix, F.lit("(?![0-9])"))


def nutrition(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with protein, fat, carbs, kcal, kj, the energy counted from the parts, and the deviations in per cent.

    Labels stand before or behind their numbers: the direction that finds more of them counts for all, forward on a
    tie. A pair of energies that only fits turned round is turned. What cannot be parsed is null.
    """
    low = F.lower(F.col(text))
    take = lambda pattern, group=1: number(F.nullif(F.regexp_extract(low, pattern, group), F.lit("")))
    out = rows
    for i, label in enumerate(PARTS):
        out = out.withColumn(f"_f{i}", take(forward(label))).withColumn(f"_b{i}", take(backward(label)))
    found = lambda p: sum((F.col(f"{p}{i}").isNotNull().cast("int") for i in range(3)), F.lit(0))
    out = out.withColumn("_back", found("_b") > found("_f"))
    for i, name in enumerate(("protein", "fat", "carbs")):
        out = out.withColumn(name, F.when(F.col("_back"), F.col(f"_b{i}")).otherwise(F.col(f"_f{i}")))
    out = out.withColumn("_kj", take(ENERGY[0])).withColumn("_kcal", take(ENERGY[1]))
    kcal = F.when(F.col("_kj").isNotNull(), take(ENERGY[0], 2)).when(F.col("_kcal").isNotNull(), F.col("_kcal")).otherwise(take(ENERGY[2]))
    kj = F.when(F.col("_kj").isNotNull(), F.col("_kj")).when(F.col("_kcal").isNotNull(), take(ENERGY[1], 2))
    out = out.withColumn("_c", kcal).withColumn("_j", kj)
    fits = lambda a, b: F.coalesce(F.abs(F.try_divide(a, b) - RATIO) <= RATIO_OFF, F.lit(False))
    turned = fits(F.col("_c"), F.col("_j")) & ~fits(F.col("_j"), F.col("_c"))
    out = out.withColumn("kcal", F.when(turned, F.col("_j")).otherwise(F.col("_c"))).withColumn("kj", F.when(turned, F.col("_c")).otherwise(F.col("_j")))
    for name, at in (("kcal", 0), ("kj", 1)):
        total = sum((F.col(part) * grams[at] for part, grams in zip(("protein", "fat", "carbs"), PARTS.values(), strict=True)), F.lit(0))
        out = out.withColumn(f"{name}_counted", F.round(total, 1))
        out = out.withColumn(f"{name}_off", F.round(F.abs(F.col(name) - F.col(f"{name}_counted")) / F.nullif(F.col(f"{name}_counted"), F.lit(0.0)) * 100, 1))
    return out.drop(*(f"_{p}{i}" for p in "fb" for i in range(3)), "_back", "_kj", "_kcal", "_c", "_j")
