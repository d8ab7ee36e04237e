"""Models outside the engine (chat, embedding) behind a table of recorded answers.

A request is a row with a key; answers are rows with the same key. Only keys without an answer are sent to the
model, in Arrow batches, and what comes back is appended to the cache.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import short_hash


def request_key(model: str, prompt: Column, salt: str = "") -> Column:
    return short_hash(F.lit(model), F.lit(salt), F.coalesce(prompt, F.lit("")), length=24)


def cached(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with their answer, requests without one). ``requests``: ``key``, ...; ``cache``: ``key``, ``answer``."""
    known = cache.groupBy("key").agg(F.first("answer").alias("answer"))
    return requests.join(known, "key"), requests.join(known, "key", "left_anti")


#: Prompts that a model gets at a time.
BATCH = 64


def ask(requests: DataFrame, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """(key, answer) of ``requests`` (``key``, ``prompt``), each key once. ``model`` gets ``BATCH`` prompts at most, inside tasks."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                yield pa.RecordBatch.from_arrays([part["key"], pa.array(model(part["prompt"].to_pylist()), pa.string())], ["key", "answer"])

    return requests.select("key", "prompt").distinct().mapInArrow(run, "key string, answer string")


def answer_all(requests: DataFrame, cache: DataFrame, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """Every request with its answer, from the cache or else from the model."""
    hit, miss = cached(requests, cache)
    return hit.unionByName(miss.join(ask(miss, model), "key"))


def trigram_vectors(texts: list[str], dims: int = 128) -> list[str]:
    """A vector model where there is no better one: counts of hashed letter trigrams, of length 1, as JSON lists."""
    out = []
    for text in texts:
        marked, counts = f"  {' '.join(text.lower().split())} ", [0.0] * dims
        for i in range(len(marked) - 2):
            counts[zlib.crc32(marked[i : i + 3].encode("utf-8", "replace")) % dims] += 1.0
        norm = math.sqrt(sum(x * x for x in counts)) or 1.0
        out.append(json.dumps([x / norm for x in counts]))
    return out
