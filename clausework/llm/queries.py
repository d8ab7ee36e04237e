"""Queries of the problems 2 and 4 to 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .bpe import encode_texts
from .language import foreign_languages, language_segments
from .leaks import item_report, leaked_items
from .lookalike import canonical_texts, look_alike_classes, look_alike_pairs
from .scans import repair_scans
from .split import split_oversized


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The chunks that the splitter cuts."""
    pieces = split_oversized(table(spark, d, "chunks", ["chunk_id", "text"]))
    return pieces.where("n_pieces > 1 and piece_no = 1").select("chunk_id").distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(table(spark, d, "chunks", ["chunk_id", "text"]))


def p2_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the pieces of each chunk: none too long, each after the first starts with the end of the one
    before it, and without these overlaps they are the text."""
    pieces = split_oversized(table(spark, d, "chunks", ["chunk_id", "text"])).where("text is not null")
    one = pieces.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", "overlap", "text"))).alias("p"))  # a chunk's own pieces
    whole = F.array_join(F.transform("p", lambda x: F.substring(x["text"], x["overlap"] + 1, F.length(x["text"]))), "")
    laps = F.forall(F.filter(F.transform("p", lambda x, i: F.struct(x.alias("x"), F.get("p", i - 1).alias("before"))), lambda y: y["before"].isNotNull()), lambda y: (y["x"]["overlap"] <= 200) & y["before"]["text"].endswith(F.substring(y["x"]["text"], F.lit(1), y["x"]["overlap"])))
    return one.select("chunk_id", F.forall("p", lambda x: F.length(x["text"]) <= 3500).alias("short"), laps.alias("overlap"), F.md5(whole.cast("binary")).alias("md5"))


CHUNK_COLUMNS = ["chunk_id", "text", "is_table", "regulation_id", "regulation_name"]


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    return repair_scans(table(spark, d, "chunks", CHUNK_COLUMNS)).select("chunk_id", F.array_join("noise", "+").alias("noise"), "text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """One row for each chunk and kind of noise in it."""
    return repair_scans(table(spark, d, "chunks", CHUNK_COLUMNS)).select("chunk_id", F.explode("noise").alias("noise")).distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = look_alike_pairs(table(spark, d, "regions", ["region_key", "source_sha256", "text"]))
    return pairs.select(F.col("key_1").alias("region_key_1"), F.col("key_2").alias("region_key_2"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """Membership: each region that looks like another text, with its class and the number of its links."""
    return look_alike_classes(table(spark, d, "regions", ["region_key", "source_sha256", "text"])).withColumnRenamed("row_key", "region_key")


def p5_canonical(spark: SparkSession, d: str) -> DataFrame:
    return canonical_texts(table(spark, d, "regions", ["region_key", "text"])).drop("text")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents", ["doc_id", "text"]))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents", ["doc_id", "text"]), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p7_edits(spark: SparkSession, d: str) -> DataFrame:
    """The same with up to two letters inserted, deleted or replaced in a run of words, and how many they were."""
    leaks = leaked_items(table(spark, d, "documents", ["doc_id", "text"]), table(spark, d, "eval_items"), max_edits=2)
    return leaks.select("doc_id", "item_id", "edits")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    return item_report(_leaks(spark, d), table(spark, d, "eval_items"))


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    return language_segments(table(spark, d, "documents", ["doc_id", "text", "lang", "source"]))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return foreign_languages(p8_segments(spark, d))


QUERIES = {
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p2_rejoined": p2_rejoined,
    "p4_found": p4_found,
    "p4_repaired": p4_repaired,
    "p5_found": p5_found,
    "p5_classes": p5_classes,
    "p5_canonical": p5_canonical,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_edits": p7_edits,
    "p7_items": p7_items,
    "p8_found": p8_found,
    "p8_segments": p8_segments,
}
#: white space as the splitter takes it off: the separators 1C-1F beside the Unicode white space
_BLANKS = r"\s\x1c-\x1f\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_STRIPPED = rf"regexp_replace(text, '^[{_BLANKS}]+|[{_BLANKS}]+$', '', 'g')"
SQL = {
    "p2_found": f"select distinct chunk_id from chunks where length({_STRIPPED}) > 3500",
    "p2_rejoined": f"select distinct chunk_id, true as short, true as overlap, md5({_STRIPPED}) as md5 from chunks where text is not null",
}
