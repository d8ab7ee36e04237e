"""Files as tables: JSON lines, manifests with integrity checks, immutable snapshots, metric drift."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

CHUNK = t.StructType(
    [t.StructField(n, t.StringType()) for n in ("chunk_id", "regulation_id", "regulation_name", "edition", "section", "subsection", "clause", "appendix")]
    + [t.StructField("is_table", t.BooleanType()), t.StructField("part", t.IntegerType()), t.StructField("text", t.StringType())]
)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks as JSON lines under their declared schema; absent fields are null, broken lines are dropped."""
    return spark.read.schema(CHUNK).option("mode", "DROPMALFORMED").json(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """One JSON object a line; a null field is left out. An existing path is an error."""
    chunks.write.mode("errorifexists").json(path)


def read_config(path: str) -> dict:
    """A JSON configuration; a YAML one where a YAML library is there."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text)
    return json.loads(text)


def manifest(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """Rows of a manifest: id, title, file, size_bytes, sha256."""
    schema = "id string, title string, file string, size_bytes bigint, sha256 string"
    return spark.createDataFrame([tuple(e.get(k) for k in ("id", "title", "file", "size_bytes", "sha256")) for e in entries], schema)


def verify_files(spark: SparkSession, entries: DataFrame, folder: str) -> DataFrame:
    """The manifest with ``problem``: null, 'missing', 'size' or 'sha256'."""
    found = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "length", F.sha2("content", 256).alias("digest"))
    problem = F.when(F.col("digest").isNull(), "missing").when(F.col("length") != F.col("size_bytes"), "size").when(F.col("digest") != F.col("sha256"), "sha256")
    return entries.join(found, "file", "left").withColumn("problem", problem).drop("length", "digest")


def write_snapshot(rows: DataFrame, folder: str, run: str) -> str:
    """The rows of a run as a table of its own; a run that exists is an error."""
    path = f"{folder}/{run}"
    rows.write.mode("errorifexists").parquet(path)
    return path


def drift(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Long rows (keys, metric, old, new) of the numbers that differ between two tables of metrics."""
    metrics = [x for x in old.columns if x not in keys]
    long = lambda df, name: df.unpivot(keys, metrics, "metric", name)
    cast = lambda df: df.select(*keys, *(F.col(m).cast("double") for m in metrics))
    both = long(cast(old), "old").join(long(cast(new), "new"), [*keys, "metric"], "full")
    return both.where(~F.col("old").eqNullSafe(F.col("new")))


def corpus_seal(rows: DataFrame, columns: list[str]) -> str:
    """A hash of the rows that does not depend on their order: the sums of two halves of each row's hash."""
    digest = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(x).cast("string"), F.lit("\x00")) for x in columns)), 256)
    half = lambda a: F.sum(F.conv(F.substring(digest, a, 12), 16, 10).cast("decimal(38,0)")).alias(f"h{a}")
    row = rows.agg(F.count("*").alias("n"), half(1), half(13)).first()
    return f"{row['n']:x}-{int(row['h1'] or 0):x}-{int(row['h13'] or 0):x}"
