"""Benchmark decontamination by SimHash over item-sized windows.

For every item, windows of the item's length in words run over every text. A window's fingerprint is the SimHash of its
weighted shingles (five words; the weight is how often the shingle stands in the window). Fingerprints meet in a
multi-index: five blocks of the 64 bits, of which one at least differs in three bits or fewer whenever two
fingerprints are within ``RADIUS`` bits; the items' blocks are indexed with all such changes. What is found is
verified by the exact weighted Jaccard similarity of window and item.

A window that reaches the similarity must have most of its shingles from items of its own length, so windows are
fingerprinted only where a bitmap of those shingles says so. The bitmap has no false negatives, and its size
follows the benchmark's within fixed bounds, so this skips only windows that verification would refuse.

Windows carry no shingles: overlapping ones share a stretch of the text, which is stored once, so an item of any length costs
its text's length. A pair of stretch and item is verified at all its starting places in one pass (running sums).

Null and empty texts and items match nothing; an item of fewer than five words is one shingle of all its words.
Repeated rows and ids each count; rows with a null id are reported with a null id; items of one id and text are one.
Other columns, of whatever name, are not read; an empty table on either side finds nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm.common import ALNUM_SEPARATORS, grams_of, list_array, mix, slices, stored, words_of
from platewise.llm.sketches import bitmap, in_bitmap

K = 5
SIMILARITY = 0.75
RADIUS = 19
#: Bit positions of the blocks; RADIUS // 5 changes in the best block.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Lengths looked for in one pass over the texts.
LENGTHS_PER_PASS = 512
BITMAP_BITS = (1 << 22, 1 << 28)


def _shingles(words: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    return grams_of(words, bounds, min(K, length), seed=min(K, length))


def _of_length(grams: np.ndarray, length: int) -> np.ndarray:
    """Keys of shingles as those of items of one length."""
    return mix(grams + np.uint64(length * 0x9E3779B97F4A7C15 % 2**64))


def simhash(grams: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of the runs of ``n`` grams at ``starts``: bit by bit, the sign of the sum over the run."""
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out
    h = mix(grams ^ np.uint64(0x5BD1E9955BD1E995))
    low = int(starts.min())
    h = h[low : int(starts.max()) + n]
    for bit in range(64):
        sums = np.concatenate([[0], np.cumsum(((h >> np.uint64(bit)) & np.uint64(1)).astype(np.int32))])
        out |= (2 * (sums[starts - low + n] - sums[starts - low]) > n).astype(np.uint64) << np.uint64(bit)
    return out


def weighted_similarities(grams: np.ndarray, item: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of an item's bag of shingles and the windows of its size at ``starts``.

    A shingle that the item holds ``c`` times adds one at every place to the windows that reach it but not the ``c``-th such
    place before it, so the common weight of all windows is a running sum."""
    n = len(item)
    known, c = np.unique(item, return_counts=True)
    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
    places = np.flatnonzero(known[at] == grams)
    kind = at[places]
    order = np.argsort(kind, kind="stable")
    places, kind = places[order], kind[order]
    first = np.searchsorted(kind, np.arange(len(known)))
    rank = np.arange(len(kind)) - first[kind]
    back = np.arange(len(kind)) - c[kind]
    earlier = np.where(rank >= c[kind], places[np.maximum(back, 0)], -1)
    # Windows from ``low`` to the place itself hold this one and fewer than c before it.
    low = np.maximum(earlier + 1, places - n + 1)
    steps = np.zeros(len(grams) + 1, np.int64)
    np.add.at(steps, np.maximum(low, 0), 1)
    np.add.at(steps, places + 1, -1)
    common = np.cumsum(steps)[starts]
    return common / (2 * n - common)


def block_changes(width: int, most: int = RADIUS // len(BLOCKS)) -> np.ndarray:
    """All differences of a block in at most ``most`` bits."""
    return np.array([sum(1 << b for b in bits) for k in range(most + 1) for bits in combinations(range(width), k)], np.int64)


def item_table(benchmark: DataFrame) -> DataFrame:
    """item_id, length, fp, grams of every item that has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words, bounds = words_of(batch.column(1), ALNUM_SEPARATORS)
                ids, lengths, fps, grams = [], [], [], []
                for i, item in enumerate(batch.column(0).to_pylist()):
                    w = words[bounds[i] : bounds[i + 1]]
                    if len(w):
                        g, _ = _shingles(w, np.array([0, len(w)]), len(w))
                        ids.append(item)
                        lengths.append(len(w))
                        fps.append(simhash(g, np.zeros(1, np.int64), len(g))[0])
                        grams.append(g.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int32()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(grams, pa.list_(pa.int64()))], names=["item_id", "length", "fp", "grams"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "item_id long, length int, fp long, grams array<long>").withColumn("item", F.xxhash64("item_id", "grams"))


def item_index(items: DataFrame) -> DataFrame:
    """item, length, fp, block, value: every block of every item's fingerprint with all its changes."""
    parts = []
    for k, (at, width) in enumerate(BLOCKS):
        own = F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1))
        change = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in block_changes(width)]))
        parts.append(items.select("item", "length", F.col("fp").alias("item_fp"), F.lit(k).alias("block"), own.alias("own"), change.alias("change")).withColumn("value", F.col("own").bitwiseXOR(F.col("change"))).drop("own", "change"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def close_hits(sizes: list[int], needed: Callable[[int], int]) -> tuple[int, int]:
    """(run, hits): a window of any of the sizes that has the hits it needs holds a run of so many shingles with so many hits.
    The run is as long as the smallest window; of the disjoint runs in a window, one has no more than its share of misses."""
    run = min(sizes)
    return run, max(1, min(run - (n - needed(n)) // (n // run) for n in sizes))


def hits_needed(n: int, similarity: float) -> int:
    """Least common weight of two bags of weight ``n`` at the similarity."""
    return int(np.ceil(2 * n * similarity / (1 + similarity) - 1e-9))


STRETCHES = "row long, doc_id long, at long, starts array<int>, lengths array<int>, fps array<long>, grams array<long>"


def windows_of(df: DataFrame, table: np.ndarray, lengths: list[int], similarity: float = SIMILARITY) -> DataFrame:
    """The stretches of the texts (row, doc_id, the first word ``at``, and the shingles of one size) that are covered by windows which
    may reach the similarity with an item of their length, with those windows' starts in it, lengths and fingerprints. ``row``
    and ``stretch`` number the texts and the stretches, so this is to be stored before it is read twice."""
    known = df.sparkSession.sparkContext.broadcast((table, lengths))

    def stretches(own: np.ndarray, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """First and last shingle of each stretch of one text, and its windows."""
        starts, sizes, fps = [], [], []
        table, lengths = known.value
        for length in lengths:
            n = length - k + 1
            if min(K, length) != k or len(own) < n:
                continue
            hits = np.concatenate([[0], np.cumsum(in_bitmap(table, _of_length(own, length)))])
            s = np.flatnonzero(hits[n:] - hits[:-n] >= hits_needed(n, similarity))
            if len(s):
                starts.append(s)
                sizes.append(np.full(len(s), n))
                fps.append(simhash(own, s, n))
        if not starts:
            return
        start, size, fp = np.concatenate(starts), np.concatenate(sizes), np.concatenate(fps)
        order = np.argsort(start, kind="stable")
        start, size, fp = start[order], size[order], fp[order]
        reach = np.maximum.accumulate(start + size)
        cuts = [0, *(np.flatnonzero(start[1:] >= reach[:-1]) + 1).tolist(), len(start)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(start[a]), int(reach[b - 1]), start[a:b] - start[a], size[a:b] + k - 1, fp[a:b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in slices(whole, "text"):
                table, lengths = known.value
                words, bounds = words_of(batch.column(1), ALNUM_SEPARATORS)
                rows, ids, at, parts = [], [], [], []
                for k in sorted({min(K, n) for n in lengths}):
                    grams, gram_bounds = grams_of(words, bounds, k, seed=k)
                    owner = np.repeat(np.arange(batch.num_rows), np.diff(gram_bounds))
                    # Texts that have enough shingles of any items close together are looked at by length.
                    near, enough = close_hits([n - k + 1 for n in lengths if min(K, n) == k], lambda n: hits_needed(n, similarity))
                    sums = np.concatenate([[0], np.cumsum(in_bitmap(table, grams))])
                    for i in np.unique(owner[np.flatnonzero(sums[near:] - sums[:-near] >= enough)]) if len(grams) >= near else ():
                        own = grams[gram_bounds[i] : gram_bounds[i + 1]]
                        for a, b, start, length, fp in stretches(own, k):
                            rows.append(before + int(i))
                            ids.append(batch.column(0)[int(i)].as_py())
                            at.append(a)
                            parts.append((start.astype(np.int32), length.astype(np.int32), fp.view(np.int64), own[a:b].view(np.int64)))
                if ids:
                    lists = [list_array(np.concatenate(p), np.concatenate([[0], np.cumsum([len(x) for x in p])])) for p in zip(*parts, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (rows, ids, at)), *lists], names=["row", "doc_id", "at", "starts", "lengths", "fps", "grams"])
                before += batch.num_rows

    return df.select("doc_id", "text").mapInArrow(run, STRETCHES).withColumn("stretch", F.monotonically_increasing_id())


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, similarity, start (word of the best window), length of every item found in every document."""
    items = stored(item_table(benchmark), "items")
    shingles, lengths = items.agg(F.sum(F.size("grams")), F.array_sort(F.collect_set("length"))).first()
    out = None
    bits = min(max(1 << int(32 * (shingles or 1) - 1).bit_length(), BITMAP_BITS[0]), BITMAP_BITS[1])
    keys = items.select("length", "grams").mapInArrow(_item_keys, "key long")
    table = bitmap(keys, "key", bits)
    index = item_index(items)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for i in range(0, max(1, len(lengths)), LENGTHS_PER_PASS):
        stretches = stored(windows_of(rows, table, lengths[i : i + LENGTHS_PER_PASS], similarity), "stretches")
        windows = stretches.select("stretch", F.inline(F.arrays_zip("starts", "lengths", "fps"))).toDF("stretch", "start", "length", "fp")
        blocks = F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1)).alias("value")) for k, (at, width) in enumerate(BLOCKS)])
        near = windows.select("stretch", "start", "length", "fp", F.inline(blocks)).join(index, ["length", "block", "value"])
        near = near.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).groupBy("stretch", "item").agg(F.array_sort(F.collect_set("start")).alias("starts"))
        full = near.join(stretches.select("stretch", "row", "doc_id", "at", "grams"), "stretch").join(items.select("item", "item_id", "length", F.col("grams").alias("item_grams")), "item")
        scored = full.select("row", "doc_id", "item_id", "length", "at", "starts", "grams", "item_grams").mapInArrow(_score, SCORED)
        out = scored if out is None else out.unionByName(scored)
    best = out.filter(F.col("similarity") >= similarity).groupBy("row", "doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("before"), "length")).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.before")).alias("start"), F.col("best.length").alias("length"))


def _item_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the items' shingles: as they are, and as those of their item's length."""
    for batch in batches:
        for length, grams in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            g = grams.values.to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([g, _of_length(g, length)]).view(np.int64))], names=["key"])


SCORED = "row long, doc_id long, item_id long, length int, start long, similarity double"


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best window of each pair of stretch and item; of equal ones, the first."""
    for batch in batches:
        best, score = [], []
        for at, starts, grams, item in zip(batch.column(4).to_pylist(), *(batch.column(k) for k in (5, 6, 7)), strict=True):
            starts = starts.values.to_numpy()
            s = weighted_similarities(grams.values.to_numpy(), item.values.to_numpy(), starts)
            i = int(np.argmax(s))
            best.append(at + int(starts[i]))
            score.append(float(s[i]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(best, pa.int64()), pa.array(score, pa.float64())], names=["row", "doc_id", "item_id", "length", "start", "similarity"])


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: DuckDB SQL of the same rows: every window of an item's length that shares a shingle with it is compared in full.
ORACLE = r"""
WITH lower_case AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark
), w AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lower_case
), items AS (
  SELECT id AS item_id, len(w) AS length, least(5, len(w)) AS k, w FROM w WHERE kind = 'i' AND len(w) > 0
), ks AS (
  SELECT DISTINCT k FROM items
), ig AS (
  SELECT item_id, length, k, length - k + 1 AS n, unnest(list_transform(range(1, length - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS g FROM items
), ic AS (
  SELECT item_id, length, k, n, g, count(*) AS c FROM ig GROUP BY ALL
), dg AS (
  SELECT id AS doc_id, k, len(w) AS words, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS g,
    unnest(range(0, len(w) - k + 1)) AS pos FROM w, ks WHERE kind = 'd' AND len(w) >= k
), near AS (
  SELECT DISTINCT doc_id, item_id, length, k, n, unnest(range(greatest(0, pos - n + 1), least(pos, words - length) + 1)) AS start
  FROM dg JOIN ic USING (k, g)
), wc AS (
  SELECT near.doc_id, item_id, length, near.k, n, start, dg.g, count(*) AS c
  FROM near JOIN dg ON dg.doc_id = near.doc_id AND dg.k = near.k AND dg.pos BETWEEN start AND start + n - 1 GROUP BY ALL
), common AS (
  SELECT doc_id, item_id, wc.length, wc.n, start, sum(least(wc.c, ic.c)) AS common
  FROM wc JOIN ic USING (item_id, g) GROUP BY ALL
), scored AS (
  SELECT doc_id, item_id, common::DOUBLE / (2 * n - common)::DOUBLE AS similarity, start, length FROM common
)
SELECT doc_id, item_id, similarity, start, length::INT AS length FROM scored WHERE similarity >= 0.75
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1"""
