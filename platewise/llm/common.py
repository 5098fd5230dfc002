"""Shared helpers: the cluster's shared folder, and vectorised hashing of the words in Arrow strings."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

SPACE_SEPARATORS = np.zeros(256, dtype=bool)
SPACE_SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but digits and lower-case letters (texts are lower-cased first).
ALNUM_SEPARATORS = np.zeros(256, dtype=bool)
ALNUM_SEPARATORS[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_GRAM_BASE = np.uint64(0xC2B2AE3D27D4EB4F)

#: Rows are taken together up to about so many bytes of text; a longer text is a row alone.
CHUNK_BYTES = 1 << 20
#: Bytes, or words of runs, hashed at a time: the temporary arrays (32 bytes for each) do not grow with a text or word.
BLOCK_BYTES = 1 << 17


#: Schemes for which Spark and pyarrow have different names.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run below ``spark.checkpoint.dir``. Where that is unset, a local master gets a temporary folder, and a
    cluster an error, as its executors share no local folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.platewise.scratch", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="platewise-")
        spark.conf.set("spark.platewise.scratch", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system for a path as Spark writes it, and the place in it."""
    scheme, colon, rest = path.partition(":")
    if scheme == "dbfs":
        return pafs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + colon + rest)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """In jobs that run inside, texts travel to Python in Arrow batches of at most so many rows: Spark counts rows, not
    bytes, and a batch stands in the memory of both sides. The session's own number is set back after them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(name)
    if not 0 < int(own) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, own)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Deletes tables that :func:`stored` wrote and nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over uint64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@functools.lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; a null is an empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about ``most`` bytes together (one row at least)."""
    if not batch.num_rows:
        return
    _, offs = string_buffers(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offs, offs[start] + most, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def word_spans(column: pa.Array, separators: np.ndarray = SPACE_SEPARATORS, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a string column and its rows' offsets in them; start and end of each word; each row's bounds in the words.

    Words are maximal runs of bytes outside ``separators``; with ``lower``, A-Z become a-z.
    """
    data, offs = string_buffers(column)
    b = _LOWER[data] if lower else data
    s, e = _spans(b, offs, separators)
    return b, offs, s, e, np.searchsorted(s, offs).astype(np.int64)


def _spans(b: np.ndarray, cuts: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of some bytes, where no word reaches over a cut."""
    inside = ~separators[b]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    firsts, lasts = cuts[cuts < len(b)], cuts[cuts > 0] - 1
    starts[firsts] = inside[firsts]
    ends[lasts] = inside[lasts]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def span_hashes(b: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from each start to its end, from running sums of powers. Spans ascend and do not overlap.

    Spans are hashed together up to a block; of a longer one, the sums of its blocks are joined."""
    out, at = np.empty(len(s), np.uint64), 0
    while at < len(s):
        end = max(at + 1, int(np.searchsorted(e, s[at] + BLOCK_BYTES, side="right")))
        low, high = int(s[at]), int(e[end - 1])
        if high - low <= BLOCK_BYTES:
            out[at:end] = _sums(b[low:high], s[at:end] - low, e[at:end] - low)
        else:
            total = 0
            for i in range(low, high, BLOCK_BYTES):
                part = b[i : min(i + BLOCK_BYTES, high)]
                total += int(_sums(part, np.zeros(1, np.int64), np.array([len(part)]))[0]) * pow(int(_BASE), i - low, 1 << 64)
            out[at] = total % (1 << 64)
        at = end
    return mix(out + (e - s).astype(np.uint64))


def _sums(b: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Sums of bytes times powers, from each start to its end, as if the span began at zero."""
    up, down = _powers(int(_BASE), BLOCK_BYTES + 1), _powers(int(_BASE_INVERSE), BLOCK_BYTES + 1)
    prefix = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=prefix[1:])
    return (prefix[e] - prefix[s]) * down[s]


def word_blocks(column: pa.Array, separators: np.ndarray, lower: bool = True) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """The bytes of a string column in blocks that end where no word can go on: each block's bytes, its place, and start and
    end in it of each word. A word longer than a block makes its block longer."""
    data, offs = string_buffers(column)
    at, size = 0, BLOCK_BYTES
    while at < len(data):
        b = data[at : at + size]
        b = _LOWER[b] if lower else b
        end = at + len(b)
        if end < len(data):
            end = int(offs[np.searchsorted(offs, end, side="right") - 1])
            # Most blocks have a separator near their end.
            for tail in (4096, len(b)):
                if len(breaks := np.flatnonzero(separators[b[-tail:]])):
                    end = max(end, at + max(0, len(b) - tail) + int(breaks[-1]) + 1)
                    break
            if end <= at:
                size *= 2
                continue
            b = b[: end - at]
        yield b, at, *_spans(b, offs[np.searchsorted(offs, at) : np.searchsorted(offs, end, side="right")] - at, separators)
        at, size = end, BLOCK_BYTES


def words_of(column: pa.Array, separators: np.ndarray = SPACE_SEPARATORS, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a string column, and the bounds of each row's words in them."""
    hashes, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for b, at, s, e in word_blocks(column, separators, lower):
        hashes.append(span_hashes(b, s, e))
        starts.append(s + at)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), string_buffers(column)[1]).astype(np.int64)


def text_part(data: np.ndarray) -> pa.Array:
    """A string column of one row from some bytes."""
    return pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, len(data)], np.int32)), pa.py_buffer(data.tobytes()))


def spaced_parts(column: pa.Array) -> Iterator[pa.Array]:
    """A column of one long text in parts of about :data:`CHUNK_BYTES` that end after white space; other columns as they are."""
    data, _ = string_buffers(column)
    if len(column) != 1 or len(data) <= CHUNK_BYTES:
        yield column
        return
    at, size = 0, CHUNK_BYTES
    while at < len(data):
        b = data[at : at + size]
        end = at + len(b)
        if end < len(data):
            breaks = np.flatnonzero(SPACE_SEPARATORS[b])
            if not len(breaks):
                size *= 2
                continue
            end = at + int(breaks[-1]) + 1
        yield text_part(data[at:end])
        at, size = end, CHUNK_BYTES


def grams_of(words: np.ndarray, bounds: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all runs of ``k`` words inside a row, and each row's bounds in them."""
    counts = np.maximum(np.diff(bounds) - k + 1, 0)
    out_bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    if len(words) < k:
        return np.zeros(0, np.uint64), out_bounds
    # No run begins at the last k - 1 words of a row.
    begins = np.ones(len(words), bool)
    for j in range(1, k):
        last = bounds[1:] - j
        begins[last[last >= bounds[:-1]]] = False
    out, at = np.empty(out_bounds[-1], np.uint64), 0
    for i in range(0, len(words) - k + 1, BLOCK_BYTES):
        n = min(BLOCK_BYTES, len(words) - k + 1 - i)
        total, factor = np.full(n, seed, dtype=np.uint64), np.ones(1, np.uint64)
        for j in range(k):
            total = total + words[i + j : i + j + n] * factor
            factor = factor * _GRAM_BASE
        part = total[begins[i : i + n]]
        out[at : at + len(part)] = mix(part)
        at += len(part)
    return out, out_bounds


def list_array(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """An Arrow list column from flat values and bounds."""
    flat = pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, type=kind)
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat)
