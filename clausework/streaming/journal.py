"""The journal as a stream: upserts by micro-batch, windowed counts with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.journal import upsert

#: Parts of a target by the hash of the key; a batch rewrites only those that it touches.
PARTS = 64


def read_stream(spark: SparkSession, folder: str, schema: str, files: int = 100) -> DataFrame:
    """Parquet files as they arrive in ``folder``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def counts_by_day(events: DataFrame, at: str, keys: list[str], late: str = "7 days") -> DataFrame:
    """Counts by day and keys; a day is final once the stream is ``late`` past it."""
    return events.withWatermark(at, late).groupBy(F.window(at, "1 day"), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), *keys, "n")


def latest_version(spark: SparkSession, target: str, schema: str | None = None, before: int | None = None) -> DataFrame:
    """The table as of the last batch (or of the last one ``before`` a number): of each part its last version."""
    reader = spark.read if schema is None else spark.read.schema(f"{schema}, part int, version bigint")
    every = reader.parquet(target).where(F.lit(True) if before is None else F.col("version") < before)
    last = every.groupBy("part").agg(F.max("version").alias("version"))  # partition columns only: at most PARTS rows
    return every.join(F.broadcast(last), ["part", "version"], "left_semi").drop("part", "version")


def upsert_stream(rows: DataFrame, target: str, checkpoint: str, keys: list[str], id_column: str, order: list[str]) -> StreamingQuery:
    """Keep ``target`` as the latest row of each key.

    The target is partitioned by the hash of the key; a batch writes the next version of the parts that it touches and
    leaves the others as they are. A batch that is run again after a failure reads the versions before its own and
    writes the same version again.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    part = F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int")

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        touched = [r[0] for r in batch.select(part.alias("part")).distinct().collect()]  # at most PARTS numbers
        old = latest_version(spark, target, schema, number).where(part.isin(touched)) if number else batch.limit(0)
        merged = upsert(old, batch, keys, id_column, order).withColumn("part", part).withColumn("version", F.lit(number).cast("bigint"))
        merged.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "version").parquet(target)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drop_old_versions(spark: SparkSession, target: str, keep: int = 2) -> int:
    """Delete all but the last ``keep`` versions of each part; their number. Readers of older versions must be through."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    dropped = 0
    for of_part in fs.listStatus(path(target)):
        if not of_part.getPath().getName().startswith("part="):
            continue
        versions = sorted((int(v.getPath().getName().split("=")[1]), v.getPath()) for v in fs.listStatus(of_part.getPath()) if v.getPath().getName().startswith("version="))
        for _, old in versions[:-keep]:
            fs.delete(old, True)
            dropped += 1
    return dropped
