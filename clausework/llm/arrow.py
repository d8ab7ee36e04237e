"""Small helpers for functions that run inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_unicode(text: Column) -> Column:
    """``text`` without white space (in the Unicode sense, and the ASCII separators 1C-1F) at its ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def lists(values: np.ndarray, counts: list[int] | np.ndarray) -> pa.Array:
    """A list array of ``counts[i]`` values each."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def per_batch(function: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int = 1000, size: int = 8 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``function`` on slices of at most ``rows`` rows and about ``size`` bytes, so that what it needs beside a slice stays small.

    A row of more than ``size`` bytes is a slice of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False) for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type)]
            before = np.concatenate([[0], np.cumsum(np.sum(texts, axis=0, dtype=np.int64) if texts else np.zeros(batch.num_rows, np.int64))])
            at = 0
            while at < batch.num_rows:
                stop = min(at + rows, max(at + 1, int(np.searchsorted(before, before[at] + size, "right")) - 1))
                yield function(batch.slice(at, stop - at))
                at = stop

    return run
