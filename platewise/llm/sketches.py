"""Fixed-size summaries of whole tables: a bitmap of keys, and logarithmic counts of hashed tokens.

Both are sums over all rows, made in tasks, added up in tasks, and only then read: what reaches the driver and the
executors grows with the table up to a fixed size. Beyond that more rows make them coarser, never wrong: a bitmap has
no false negatives, and all documents see the same count of a token.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least and most counters of a count sketch (one byte each), and tokens for each counter between them.
COUNTERS, TOKENS_EACH = (1 << 20, 1 << 24), 32
#: Classes for each doubling of a count.
STEPS = 8
_SLICE = 1 << 13


def power_of_two(n: float, least: int, most: int) -> int:
    """The next power of two within bounds (powers of two themselves)."""
    return min(max(1 << max(0, int(n) - 1).bit_length(), least), most)


def bitmap(df: DataFrame, column: str, bits: int = 1 << 24) -> np.ndarray:
    """Packed bits, set at ``column mod bits`` for each row (``bits`` / 8 bytes)."""
    at = F.pmod(F.col(column), F.lit(bits))
    rows = df.select(at.alias("at")).groupBy(F.floor(F.col("at") / 64).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("x"))
    found = rows.toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found.column("w").to_numpy()] = found.column("x").to_numpy().view(np.uint64)
    return out


def in_bitmap(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each uint64 hash's bit is set (as ``bitmap`` places signed longs)."""
    at = hashes & np.uint64(len(table) * 64 - 1)
    return (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def count_classes(df: DataFrame, tokens: Callable[[pa.RecordBatch], Iterator[np.ndarray]], total: int) -> tuple[np.ndarray, float]:
    """For each counter, ``STEPS * log2(1 + count)`` of the tokens hashed to it (a byte), and the mean count; ``total`` tokens are
    expected. ``tokens`` gives the uint64 tokens of a batch. Tasks count into arrays of counters and send them in slices; each
    slice is added up in a task that holds the sums of its slices only."""
    counters = power_of_two(total / TOKENS_EACH, *COUNTERS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(counters, np.uint32)
        for batch in batches:
            for t in tokens(batch):
                at, n = np.unique((t & np.uint64(counters - 1)).astype(np.uint32), return_counts=True)
                sums[at] += n.astype(np.uint32)
        parts = sums.reshape(-1, _SLICE)
        most = parts.max(axis=1)
        used = np.flatnonzero(most)
        for i in range(0, len(used), 64):
            some = used[i : i + 64]
            # As 16 bits each where they suffice.
            raw = [parts[j].astype(np.uint16 if most[j] < 1 << 16 else np.uint32).tobytes() for j in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(raw, pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for j, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[j] = sums.get(j, 0) + np.frombuffer(counts, np.uint16 if len(counts) == 2 * _SLICE else np.uint32).astype(np.uint64)
        if sums:
            keys = sorted(sums)
            classes = [np.minimum(255, np.round(STEPS * np.log2(1.0 + sums[j].astype(float)))).astype(np.uint8).tobytes() for j in keys]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(classes, pa.binary()), pa.array([int(sums[j].sum()) for j in keys], pa.int64())], names=["slice", "classes", "total"])

    rows = df.mapInArrow(count, "slice int, counts binary").repartition("slice").mapInArrow(add, "slice int, classes binary, total long").toArrow()
    out, found = np.zeros(counters, np.uint8), 0
    for j, classes, n in zip(*(rows.column(k).to_pylist() for k in range(3)), strict=True):
        out[j * _SLICE : (j + 1) * _SLICE] = np.frombuffer(classes, np.uint8)
        found += n
    return out, found / counters
