"""Images cut into tiles with a border (halo): each tile is one row of dense numbers, filtered by itself.

A filter that sees ``halo`` pixels far needs no more than a tile and its border, so an image of any size is many independent
rows, and a task holds tiles, not images. Pixels are dealt to the tiles that see them in one shuffle; tiles of one shape are
filtered together as one dense array. Running extremes and running sums cost the same for any reach.

Missing pixels (absent rows, and NULL or NaN values) are NaN in the dense arrays, with a mask that tells them apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pixels along a tile's side, without its halo; and values that are filtered together.
TILE, TOGETHER = 256, 1 << 20


@dataclass
class Tiles:
    """Tiles of one shape: image, place of the first pixel (halo included), dense values by column, which pixels exist, and the
    part of each tile that is its own."""

    image: pa.Array
    top: np.ndarray
    left: np.ndarray
    values: dict[str, np.ndarray]
    there: np.ndarray
    own: tuple[slice, slice]

    def inner(self, x: np.ndarray) -> np.ndarray:
        return x[(..., *self.own)]


def tile_rows(px: DataFrame, columns: Sequence[str], halo: int, tile: int = TILE) -> DataFrame:
    """(image_id, tr, tc, p): every tile with its pixels and those of its halo, at most (tile + 2 * halo) squared of them."""
    near = lambda c: F.explode(F.sequence(F.greatest(F.floor((F.col(c) - halo) / tile), F.lit(0)).cast("int"), F.floor((F.col(c) + halo) / tile).cast("int")))
    values = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in columns]
    dealt = px.select("image_id", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), *values)
    dealt = dealt.select("*", near("r").alias("tr")).select("*", near("c").alias("tc"))
    return dealt.groupBy("image_id", "tr", "tc").agg(F.collect_list(F.struct("r", "c", *columns)).alias("p"))


def tile_arrays(images: DataFrame, height: Column, width: Column, halo: int, pixels: str = "pixels", tile: int = TILE) -> DataFrame:
    """The same (column ``v``) from arrays in row order, cut without a row for each pixel. The tiles of an image are dealt to tasks."""
    corners = lambda size: F.sequence(F.lit(0), F.floor((size - 1) / tile).cast("int"))
    cut = images.select("image_id", F.col(pixels).alias("_p"), height.cast("int").alias("_h"), width.cast("int").alias("_w"))
    cut = cut.filter((F.col("_h") > 0) & (F.col("_w") > 0)).select("*", F.explode(corners(F.col("_h"))).alias("tr")).select("*", F.explode(corners(F.col("_w"))).alias("tc"))
    places = lambda t, size: F.sequence(F.greatest(F.col(t) * tile - halo, F.lit(0)), F.least((F.col(t) + 1) * tile + halo, F.col(size)) - 1)
    pixel = lambda r, c: F.struct(r.alias("r"), c.alias("c"), F.coalesce(F.get("_p", r * F.col("_w") + c).cast("double"), F.lit(float("nan"))).alias("v"))
    p = F.flatten(F.transform(places("tr", "_h"), lambda r: F.transform(places("tc", "_w"), lambda c: pixel(r, c))))
    return cut.select("image_id", "tr", "tc", p.alias("p")).repartition("image_id", "tr", "tc")


def _shaped(batch: pa.RecordBatch, columns: Sequence[str], tile: int) -> Iterator[Tiles]:
    """The batch's tiles by shape, in dense arrays of about ``TOGETHER`` values."""
    p, n = batch.column(3), batch.num_rows
    sizes = np.asarray(p.value_lengths(), np.int64)
    owner, flat = np.repeat(np.arange(n), sizes), p.flatten()
    place = {k: np.asarray(flat.field(k), np.int64) for k in ("r", "c")}
    starts = np.cumsum(sizes) - sizes
    low = {k: np.minimum.reduceat(place[k], starts) for k in place}
    high = {k: np.maximum.reduceat(place[k], starts) for k in place}
    corner = {k: np.asarray(batch.column(i), np.int64) * tile for k, i in (("r", 1), ("c", 2))}
    shape = np.stack([x for k in ("r", "c") for x in (high[k] - low[k] + 1, np.maximum(corner[k] - low[k], 0), np.minimum(corner[k] + tile, high[k] + 1) - low[k])], axis=1)
    kinds, kind = np.unique(shape, axis=0, return_inverse=True)
    for j, (height, top, bottom, width, left, right) in enumerate(kinds.tolist()):
        if bottom <= top or right <= left:
            continue
        members = np.flatnonzero(kind.ravel() == j)
        step = max(1, TOGETHER // (height * width))
        for i in range(0, len(members), step):
            at = members[i : i + step]
            number = np.full(n, -1)
            number[at] = np.arange(len(at))
            mine = np.flatnonzero(number[owner] >= 0)
            o = owner[mine]
            spot = number[o], place["r"][mine] - low["r"][o], place["c"][mine] - low["c"][o]
            there = np.zeros((len(at), height, width), bool)
            there[spot] = True
            values = {}
            for c in columns:
                values[c] = np.full(there.shape, np.nan)
                values[c][spot] = np.asarray(flat.field(c), float)[mine]
            yield Tiles(batch.column(0).take(pa.array(at)), low["r"][at], low["c"][at], values, there, (slice(top, bottom), slice(left, right)))


def map_tiles(tiles: DataFrame, columns: Sequence[str], kernel: Callable[[Tiles], Iterator[tuple[pa.Array, dict[str, np.ndarray]]]], fields: dict[str, str], tile: int = TILE) -> DataFrame:
    """Rows that ``kernel`` makes of the tiles: pairs of image ids and columns of ``fields``."""
    # Few tiles travel at once, as each is a large row.
    names = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for some in _shaped(batch, columns, tile):
                    for image, out in kernel(some):
                        yield pa.RecordBatch.from_arrays([image, *(pa.array(out[c], from_pandas=True) for c in names)], names=["image_id", *names])

    schema = T.StructType([tiles.schema["image_id"], *(T.StructField(c, T.IntegerType() if k == "int" else T.DoubleType()) for c, k in fields.items())])
    return tiles.mapInArrow(run, schema)


def filtered(tiles: DataFrame, levels: dict[float, Callable[[np.ndarray, np.ndarray], np.ndarray]], tile: int = TILE) -> DataFrame:
    """(image_id, level, r, c, v): each level's filter of (values, which pixels exist) over the tiles' column ``v``."""

    kind = "int" if all(isinstance(level, int) for level in levels) else "double"

    def kernel(t: Tiles) -> Iterator[tuple[pa.Array, dict[str, np.ndarray]]]:
        k, r, c = np.nonzero(t.inner(t.there))
        place = {"r": (r + t.top[k] + t.own[0].start).astype(np.int32), "c": (c + t.left[k] + t.own[1].start).astype(np.int32)}
        image = t.image.take(pa.array(k))
        for level, f in levels.items():
            yield image, {"level": np.full(len(k), level, np.int32 if kind == "int" else float), **place, "v": t.inner(f(t.values["v"], t.there))[k, r, c]}

    return map_tiles(tiles, ["v"], kernel, {"level": kind, "r": "int", "c": "int", "v": "double"}, tile)


# --- filters over the last two axes ---------------------------------------------------------------------------
def _padded(x: np.ndarray, axis: int, before: int, after: int, fill: float) -> np.ndarray:
    pads = [(0, 0)] * x.ndim
    pads[axis] = (before, after)
    return np.pad(x, pads, constant_values=fill)


def running_extreme(x: np.ndarray, reach: int, f: np.ufunc, axis: int) -> np.ndarray:
    """Minimum or maximum of the ``2 * reach + 1`` values round each, at three comparisons a value whatever the reach: the axis is cut
    into blocks of that many values, and a window is the end of one block and the start of the next."""
    w, n = 2 * reach + 1, x.shape[axis]
    worst = np.inf if f is np.minimum else -np.inf
    x = np.moveaxis(_padded(x, axis, reach, reach + (-(n + 2 * reach)) % w, worst), axis, -1)
    blocks = x.reshape(*x.shape[:-1], -1, w)
    ahead = f.accumulate(blocks, axis=-1).reshape(x.shape)
    back = f.accumulate(blocks[..., ::-1], axis=-1)[..., ::-1].reshape(x.shape)
    return np.moveaxis(f(back[..., :n], ahead[..., w - 1 : w - 1 + n]), -1, axis)


def extreme(x: np.ndarray, reach: int, f: np.ufunc) -> np.ndarray:
    """Over squares; missing values are left out (NaN where a square has no other)."""
    worst = np.inf if f is np.minimum else -np.inf
    x = np.where(np.isnan(x), worst, x)
    out = running_extreme(running_extreme(x, reach, f, -1), reach, f, -2)
    return np.where(np.isinf(out), np.nan, out)


def running_sum(x: np.ndarray, reach: int) -> np.ndarray:
    """Sums over the squares round each value."""
    for axis in (-1, -2):
        n = x.shape[axis]
        sums = np.cumsum(_padded(x, axis, reach + 1, reach, 0.0), axis=axis)
        w = 2 * reach + 1
        x = np.take(sums, np.arange(w, n + w), axis=axis) - np.take(sums, np.arange(n), axis=axis)
    return x


def weighted_sum(x: np.ndarray, weights: Sequence[float], axis: int) -> np.ndarray:
    reach, n = len(weights) // 2, x.shape[axis]
    wide = np.moveaxis(_padded(x, axis, reach, reach, 0.0), axis, -1)
    return np.moveaxis(sum(w * wide[..., i : i + n] for i, w in enumerate(weights)), -1, axis)


def weighted_mean(x: np.ndarray, there: np.ndarray, weights: Sequence[float]) -> np.ndarray:
    """Weighted means along both axes, the weights renormalised over the pixels that exist; a missing value makes those round it missing."""
    there = there.astype(float)
    for axis in (-1, -2):
        total = weighted_sum(there, weights, axis)
        x = weighted_sum(np.where(there > 0, x, 0.0), weights, axis) / np.where(total > 0, total, np.nan)
    return x
