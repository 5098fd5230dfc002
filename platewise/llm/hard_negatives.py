"""Hard negatives of embeddings by angular triangle filtering.

Every row stores its angles to a few reference directions. The angle between an anchor and a row lies between the difference and
the sum of their angles to any one direction, so the directions together give an interval of its cosine; times both norms,
and rounded outwards, it bounds the score (the integer inner product). Rows stand in blocks of like label and like angles. An
anchor looks at a block only where the block's bounds overlap a score window that the anchor still has open:

1. for its positives, scores of at least the worst of its best so far;
2. for each positive, scores between half and 95 % of the positive's, and of at least the worst of the best so far.

Whatever overlaps is scored as integers and compared exactly, so the directions steer the work and never the result. They are
rows of a bounded sample (``SAMPLE``), each far from those before.

Each task takes a bounded group of its rows and streams the stored anchors past it, block by block, from the shared folder; it
sends the few best rows of each anchor, and Spark merges these by anchor. Anchors are not broadcast, and no row is shuffled. A task
that is lost reads its rows and the stored anchors again.

Rows with a null label, a null vector or a null or non-finite component take no part, and neither do rows with a null id, which
could not be named. Rows of one id are separate rows and separate anchors; none is a candidate of an anchor of its own id. Vectors of
different lengths are compared as if the shorter ones ended in zeros. Ties go to the smaller id. Anchors without a positive, and positives without
a negative, give no rows; an empty table gives none. Other columns, of whatever name, are not read. A component whose integer is
beyond 2^31 is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from platewise.llm.common import file_system, stored

SCALE = 256
LABELS = 10
ANCHOR_EVERY, RELABEL_EVERY = 50, 7
POSITIVES, NEGATIVES = 5, 3
#: Reference directions, and rows of the sample from which they are chosen.
DIRECTIONS, SAMPLE = 8, 1024
#: Rows in a block, anchors in a block, and rows of a task that are held at once.
BLOCK_ROWS, ANCHOR_ROWS, GROUP_ROWS = 512, 1024, 1 << 17
#: What rounding may do to an angle and, in shares of the norms, to a score.
ANGLE_SLACK, SCORE_SLACK = 1e-6, 1e-9
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max

PACKED = "label array<int>, id array<long>, width int, x binary, norm array<double>, angle array<double>"


def clean_rows(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, x) of the rows that take part: the label as mined, x = floor(256 * component)."""
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    label = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")).cast("int")
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("int"))
    return embeddings.filter(usable & finite).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), x.alias("x"))


def unit(x: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norms > 0, norms, 1)


def reference_directions(rows: DataFrame, most: int = DIRECTIONS, sample: int = SAMPLE) -> np.ndarray:
    """Unit vectors (rows) of a bounded sample by hash of the id, each the farthest from those before."""
    found = rows.select("vec_id", "x").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    width = max((len(r.x) for r in found), default=0)
    points = unit(np.array([list(r.x) + [0] * (width - len(r.x)) for r in found], float).reshape(len(found), width))
    points = points[np.abs(points).sum(axis=1) > 0] if width else points
    chosen: list[np.ndarray] = []
    nearest = np.full(len(points), -2.0)
    while len(points) and len(chosen) < most:
        i = int(np.argmin(nearest)) if chosen else 0
        if chosen and nearest[i] > 1 - 1e-9:
            break
        chosen.append(points[i])
        nearest = np.maximum(nearest, points @ points[i])
    return np.array(chosen).reshape(len(chosen), width)


def angles(x: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angles of each row to each direction (a row of zeros counts as orthogonal; its scores are 0)."""
    width = min(x.shape[1], directions.shape[1])
    return np.arccos(np.clip(unit(x.astype(float))[:, :width] @ directions[:, :width].T, -1, 1))


def pack(rows: DataFrame, directions: np.ndarray, each: int) -> DataFrame:
    """Blocks of ``each`` rows: labels, ids, integer vectors (32-bit, row after row, padded to the block's longest), norms and angles. Rows
    of a batch stand by label, nearest direction and angle to it."""

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, column = batch.num_rows, batch.column(2)
            sizes = np.asarray(column.value_lengths())
            width = int(sizes.max(initial=0))
            x = np.zeros((n, width), np.int32)
            x[np.arange(width) < sizes[:, None]] = np.asarray(column.flatten())
            label, ids = np.asarray(batch.column(1)), np.asarray(batch.column(0))
            angle = angles(x, directions)
            norm = np.linalg.norm(x.astype(float), axis=1)
            near = angle.argmin(axis=1) if angle.shape[1] else np.zeros(n, int)
            order = np.lexsort((ids, angle[np.arange(n), near] if angle.shape[1] else norm, near, label))
            for i in range(0, n, each):
                at = order[i : i + each]
                values = [label[at].tolist()], [ids[at].tolist()], [width], [x[at].tobytes()], [norm[at]], [angle[at].ravel()]
                kinds = pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["label", "id", "width", "x", "norm", "angle"])

    return rows.mapInArrow(block, PACKED)


class Block:
    """A block of packed rows, with the ranges of its labels, norms and angles."""

    def __init__(self, row: dict):
        self.label, self.id = np.asarray(row["label"], np.int32), np.asarray(row["id"], np.int64)
        n = len(self.id)
        self.x = np.frombuffer(row["x"], np.int32).reshape(n, row["width"])
        self.norm = np.asarray(row["norm"], float)
        self.angle = np.asarray(row["angle"], float).reshape(n, -1)
        self.low, self.high = self.angle.min(axis=0), self.angle.max(axis=0)


def score_bounds(anchors: Block, blocks: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that any row of each block (columns) can have with each anchor (rows), rounded outwards."""
    shape = (len(anchors.id), len(blocks))
    near, far = np.zeros(shape), np.full(shape, np.pi)
    for k in range(anchors.angle.shape[1]):
        a = anchors.angle[:, k, None]
        low, high = np.array([b.low[k] for b in blocks]), np.array([b.high[k] for b in blocks])
        np.maximum(near, np.maximum(a - high, low - a), out=near)
        np.minimum(far, np.minimum(a + high, 2 * np.pi - (a + low)), out=far)
    least_norm, most_norm = np.array([b.norm.min() for b in blocks]), np.array([b.norm.max() for b in blocks])
    top, bottom = np.cos(np.maximum(near - ANGLE_SLACK, 0)), np.cos(np.minimum(far + ANGLE_SLACK, np.pi))
    norm = anchors.norm[:, None]
    # Where a cosine is negative, the longest row has the least score.
    upper = norm * np.where(top > 0, most_norm, least_norm) * top
    lower = norm * np.where(bottom > 0, least_norm, most_norm) * bottom
    slack = 1 + SCORE_SLACK * norm * most_norm
    return np.floor(lower - slack), np.ceil(upper + slack)


def integer_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors: as doubles where every partial sum is an exact integer there, else as 64-bit integers."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width].astype(np.int64), b[:, :width].astype(np.int64)
    if width * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2**53:
        return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


class Best:
    """The best rows of each of many needs, by falling score and rising id. A new row must reach ``floor``, and where it only ties with
    the worst of a full need, have a smaller id than ``worst``."""

    def __init__(self, floor: np.ndarray, most: int):
        self.floor, self.worst, self.most = floor, np.full(len(floor), MOST), most
        self.need, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, need: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        better = (score > self.floor[need]) | (ids < self.worst[need])
        if not better.any():
            return
        need, score, ids = (np.concatenate([old, new[better]]) for old, new in ((self.need, need), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, need))
        need, score, ids = need[order], score[order], ids[order]
        first = np.flatnonzero(np.diff(need, prepend=-1))
        rank = np.arange(len(need)) - np.repeat(first, np.diff(first, append=len(need)))
        full, kept = rank == self.most - 1, rank < self.most
        self.floor[need[full]], self.worst[need[full]] = score[full], ids[full]
        self.need, self.score, self.id = need[kept], score[kept], ids[kept]


def near_of_label(anchors: Block, blocks: list[Block], most: int) -> Best:
    """The best rows of each anchor's label (needs are anchors)."""
    best = Best(np.full(len(anchors.id), LEAST), most)
    _, upper = score_bounds(anchors, blocks)
    for j in np.argsort(-upper.max(axis=0, initial=-np.inf), kind="stable"):
        b = blocks[j]
        at = np.flatnonzero((upper[:, j] >= best.floor) & np.isin(anchors.label, b.label))
        if len(at):
            s = integer_scores(anchors.x[at], b.x)
            good = (s >= best.floor[at, None]) & (anchors.label[at, None] == b.label) & (anchors.id[at, None] != b.id)
            i, k = np.nonzero(good)
            best.add(at[i], s[i, k], b.id[k])
    return best


def near_in_window(anchors: Block, low: np.ndarray, high: np.ndarray, blocks: list[Block], most: int) -> Best:
    """The best rows of other labels whose score lies within each window (columns of ``low`` and ``high``) of each anchor (rows); need
    = anchor * windows + window."""
    windows = low.shape[1]
    best = Best(low.ravel().copy(), most)
    lower, upper = score_bounds(anchors, blocks)
    for j in np.argsort(-upper.max(axis=0, initial=-np.inf), kind="stable"):
        b, floor = blocks[j], best.floor.reshape(low.shape)
        open_ = (upper[:, j, None] >= floor) & (lower[:, j, None] <= high)
        at = np.flatnonzero(open_.any(axis=1))
        if len(b.label) and (b.label == b.label[0]).all():
            at = at[anchors.label[at] != b.label[0]]
        if len(at):
            s = integer_scores(anchors.x[at], b.x)
            other = (anchors.label[at, None] != b.label) & (anchors.id[at, None] != b.id)
            found = [np.nonzero(other & (s >= floor[at, w, None]) & (s <= high[at, w, None])) for w in range(windows)]
            need = np.concatenate([at[i] * windows + w for w, (i, _) in enumerate(found)])
            best.add(need, np.concatenate([s[i, k] for i, k in found]), np.concatenate([b.id[k] for _, k in found]))
    return best


def stored_blocks(files: list[str], columns: list[str]) -> Iterator[dict]:
    """Rows of stored Parquet files, one at a time."""
    for f in files:
        system, place = file_system(f)
        with system.open_input_file(place) as source:
            for batch in pq.ParquetFile(source).iter_batches(batch_size=1, columns=columns):
                yield from batch.to_pylist()


def groups(batches: Iterator[pa.RecordBatch], most: int = GROUP_ROWS) -> Iterator[list[Block]]:
    held: list[Block] = []
    for batch in batches:
        for i in range(batch.num_rows):
            held.append(Block({name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}))
            if sum(len(b.id) for b in held) >= most:
                yield held
                held = []
    if held:
        yield held


def ranked(found: DataFrame, most: int) -> DataFrame:
    """The best ``most`` rows of each need of each part, numbered from 1."""
    order = Window.partitionBy("part", "need").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def windows_of(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest integer s with 50 * score <= 100 * s <= 95 * score."""
    return -((-50 * score) // 100), (95 * score) // 100


FOUND = "part long, need long, anchor_id long, score long, id long"


def find_positives(blocks: DataFrame, anchor_files: list[str], most: int) -> DataFrame:
    """The best rows of each stored anchor's label, with their ranks."""
    columns = ["part", *blocks.columns]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in groups(batches):
            for row in stored_blocks(anchor_files, columns):
                anchors = Block(row)
                best = near_of_label(anchors, held, most)
                arrays = [np.full(len(best.need), row["part"], np.int64), best.need, anchors.id[best.need], best.score, best.id]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["part", "need", "anchor_id", "score", "id"])

    return ranked(blocks.mapInArrow(find, FOUND), most)


def find_negatives(blocks: DataFrame, anchor_files: list[str], positives: int, most: int) -> DataFrame:
    """For each positive of each stored anchor (column ``positive`` of its block) the best rows of other labels in its window, with their
    ranks."""
    columns = ["part", "positive", *blocks.columns]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in groups(batches):
            for row in stored_blocks(anchor_files, columns):
                anchors = Block(row)
                low, high, ids, scores = (np.full((len(anchors.id), positives), x) for x in (MOST, LEAST, LEAST, LEAST))
                at, rank, ids_, scores_ = (np.array([p[k] for p in row["positive"]], np.int64) for k in ("need", "rank", "id", "score"))
                ids[at, rank - 1], scores[at, rank - 1] = ids_, scores_
                least, greatest = windows_of(scores_)
                low[at, rank - 1], high[at, rank - 1] = np.where(least <= greatest, least, MOST), greatest
                best = near_in_window(anchors, low, high, held, most)
                arrays = [np.full(len(best.need), row["part"], np.int64), best.need, anchors.id[best.need // positives], best.score, best.id]
                arrays += [ids.ravel()[best.need], scores.ravel()[best.need]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["part", "need", "anchor_id", "score", "id", "positive_id", "positive_score"])

    return ranked(blocks.mapInArrow(find, FOUND + ", positive_id long, positive_score long"), most)


def hard_negatives(embeddings: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), with the first negatives of each positive."""
    rows = clean_rows(embeddings)
    directions = reference_directions(rows)
    blocks = stored(pack(rows, directions, BLOCK_ROWS), "blocks")
    packed = pack(rows.filter(F.col("vec_id") % ANCHOR_EVERY == 0), directions, ANCHOR_ROWS)
    anchors = stored(packed.select(F.monotonically_increasing_id().alias("part"), "*"), "anchors")
    found = find_positives(blocks, sorted(anchors.inputFiles()), positives)
    # At most ``positives`` rows for each anchor of a block.
    by_part = found.groupBy("part").agg(F.collect_list(F.struct("need", "rank", "id", "score")).alias("positive"))
    opened = stored(anchors.join(by_part, "part"), "anchors")
    chosen = find_negatives(blocks, sorted(opened.inputFiles()), positives, negatives)
    return chosen.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE = f"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % {RELABEL_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
    list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, list_inner_product(a.x, r.x)::BIGINT AS score
  FROM r AS a JOIN r ON a.vec_id <> r.vec_id
  WHERE a.vec_id % {ANCHOR_EVERY} = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES}
)
SELECT p.anchor_id, p.positive_id, (row_number() OVER w)::INT AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= {NEGATIVES}
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
