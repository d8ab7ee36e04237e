"""Parquet tables by name."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """``name`` of ``folder``; with ``columns`` only these are read."""
    df = spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
    return df.select(*columns) if columns else df
