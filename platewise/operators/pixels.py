"""Images as tables: ``(image_id, r, c, v)`` pixels, degraded by expressions, and by filters of tiles."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions.scalars import uniform_of
from platewise.operators.tiles import extreme, filtered, tile_rows, weighted_mean


def explode_pixels(df: DataFrame, width: int, image_id: str = "image_id", pixels: str = "pixels", keep: tuple[str, ...] = ()) -> DataFrame:
    """Arrays in row order to pixels, which ``keep`` columns of their image."""
    each = df.select(F.col(image_id).alias("image_id"), *keep, F.posexplode(pixels).alias("i", "v"))
    return each.select("image_id", *keep, F.floor(F.col("i") / width).cast("int").alias("r"), (F.col("i") % width).cast("int").alias("c"), F.col("v").cast("double").alias("v"))


def collect_pixels(px: DataFrame) -> DataFrame:
    """Pixels back to arrays in row order (an image is one row by definition)."""
    ordered = F.array_sort(F.collect_list(F.struct("r", "c", "v")))
    return px.groupBy("image_id").agg(F.transform(ordered, lambda p: p["v"]).alias("pixels"))


def normalized(pixels: Column, dtype: Column, bits: Column | None = None) -> Column:
    """Pixels in [0, 1] with strategy, bit depth, scale and warning. Unsigned integers divide by the largest value of their
    depth: the one given, else that of their type, whatever the pixels are, so images of one plate have one scale. Booleans
    are 0 or 1; floats in [0, 1] stay; other floats need a depth. Warnings: ``inferred`` (the type's depth may be more than
    the camera's), ``below type``, ``above type``."""
    top, low = F.array_max(pixels), F.array_min(pixels)
    own = F.regexp_extract(dtype, r"^uint(\d+)$", 1).try_cast("int")
    depth = F.coalesce(bits.cast("int"), own) if bits is not None else own
    is_float, in_range = dtype.startswith("float"), (low >= 0) & (top <= 1)
    strategy = F.when(dtype == "bool", "bool").when(is_float & in_range, "identity").when(is_float | own.isNotNull(), "scale")
    bad = strategy.isNull() | ((strategy == "scale") & (depth.isNull() | (depth <= 0)))
    scale = F.when(strategy == "scale", F.pow(F.lit(2.0), depth) - 1).otherwise(1.0)
    given = bits.isNotNull() if bits is not None else F.lit(False)
    warning = F.when(own.isNull(), F.lit(None)).when(~given, "inferred").when(depth < own, "below type").when(depth > own, "above type")
    value = F.transform(pixels, lambda v: v / scale)
    shown = F.when(strategy == "scale", depth).when(strategy == "bool", 1)
    out = F.struct(value.alias("pixels"), strategy.alias("strategy"), shown.alias("bit_depth"), scale.alias("scale"), warning.alias("warning"))
    return F.when(bad, F.raise_error(F.concat(F.lit("cannot normalise pixels of type "), dtype))).otherwise(out)


def denormalized(v: Column, scale: Column, top: Column) -> Column:
    """Back to the stored range: clipped, and rounded half to even."""
    return F.bround(F.least(F.greatest(v * scale, F.lit(0.0)), top))


def gaussian_noise(px: DataFrame, std: Column | float, seed: str, channel: str | None = None) -> DataFrame:
    """Additive noise from two hashes of the pixel's place (Box-Muller), the same on every run; with the name of a ``channel``
    column, each channel of an image has a seed of its own."""
    key = lambda k: F.concat_ws("|", F.lit(f"{seed}{k}"), "image_id", *([channel] if channel else []), "r", "c")
    normal = F.sqrt(-2 * F.log(uniform_of(key("a")))) * F.cos(F.lit(2 * math.pi) * uniform_of(key("b")))
    return px.withColumn("v", F.col("v") + F.lit(std) * normal)


def gaussian_weights(sigma: float, radius: int | None = None) -> list[float]:
    radius = radius if radius is not None else max(1, math.ceil(3 * sigma))
    raw = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def _levels(px: DataFrame, halo: int, levels: dict[float, Callable]) -> DataFrame:
    return filtered(tile_rows(px, ["v"], halo), levels)


def _blur(weights: list[float]) -> Callable:
    return lambda v, there: weighted_mean(v, there, weights)


def gaussian_blur(px: DataFrame, sigma: float, radius: int | None = None) -> DataFrame:
    """Weights are renormalised where the kernel leaves the image."""
    weights = gaussian_weights(sigma, radius)
    return _levels(px, len(weights) // 2, {0: _blur(weights)}).drop("level")


def blur_sweep(px: DataFrame, sigmas: dict[float, float]) -> DataFrame:
    """Blurred images of all levels, each with a width of its own; every tile is read once."""
    weights = {level: gaussian_weights(sigma) for level, sigma in sigmas.items()}
    return _levels(px, max(len(w) for w in weights.values()) // 2, {level: _blur(w) for level, w in weights.items()})


def _reach(size: int, passes: int) -> int:
    """How far passes of a square see; an even size counts as the next odd one."""
    return passes * ((size | 1) - 1) // 2


def _extremes(px: DataFrame, reaches: dict[float, int], f: np.ufunc) -> DataFrame:
    each = lambda h: lambda v, there: extreme(v, h, f)
    return _levels(px, max(reaches.values()), {level: each(h) for level, h in reaches.items()})


def erode(px: DataFrame, size: int, passes: int = 1) -> DataFrame:
    return _extremes(px, {0: _reach(size, passes)}, np.minimum).drop("level")


def dilate(px: DataFrame, size: int, passes: int = 1) -> DataFrame:
    return _extremes(px, {0: _reach(size, passes)}, np.maximum).drop("level")


def erode_sweep(px: DataFrame, size: int, passes: list[int]) -> DataFrame:
    """Eroded images; a level is a number of passes."""
    return _extremes(px, {p: _reach(size, p) for p in passes}, np.minimum)


def dilate_sweep(px: DataFrame, size: int, passes: list[int]) -> DataFrame:
    """Dilated images; a level is a number of passes."""
    return _extremes(px, {p: _reach(size, p) for p in passes}, np.maximum)


def gamma(px: DataFrame, level: Column | float) -> DataFrame:
    """``v ** (level / 100)``."""
    return px.withColumn("v", F.pow(F.greatest(F.col("v"), F.lit(0.0)), F.lit(level) / 100))


def shift(px: DataFrame, height: int, width: int, dr: int, dc: int) -> DataFrame:
    """Moved by whole pixels, wrapping round."""
    return px.withColumns({"r": F.pmod(F.col("r") + dr, F.lit(height)), "c": F.pmod(F.col("c") + dc, F.lit(width))})


def _let(value: Column, use) -> Column:
    """``use(value)``, the value computed once."""
    return F.transform(F.array(value), use)[0]


def grid_distort(pixels: Column, image_id: Column, height: int, width: int, steps: int, limit: Column | float, seed: str) -> Column:
    """Arrays in row order, warped piecewise linearly along both axes without a shuffle. Each axis has ``steps`` cells that a hash
    of the image and cell stretches by up to ``limit``; the cells' borders, scaled to the axis, map a place to the source it
    shows (nearest pixel)."""

    def sources(axis: str, size: int) -> Column:
        stretch = lambda k: F.lit(1.0) + F.lit(limit) * (2 * uniform_of(F.concat_ws("|", F.lit(f"{seed}{axis}"), image_id, F.lit(k))) - 1)
        upto = lambda cells, n: F.aggregate(F.slice(cells, F.lit(1), n), F.lit(0.0), lambda a, x: a + x)

        def source(cells: Column, place: Column) -> Column:
            at = place * F.lit(float(steps)) / size
            cell = F.floor(at).cast("int")
            shown = (upto(cells, cell) + (at - cell) * F.get(cells, cell)) / upto(cells, F.lit(steps)) * size
            return F.least(F.greatest(F.floor(shown + 0.5), F.lit(0)), F.lit(size - 1)).cast("int")

        return _let(F.array(*[stretch(k) for k in range(steps)]), lambda cells: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda p: source(cells, p)))

    both = F.struct(sources("r", height).alias("r"), sources("c", width).alias("c"))
    return _let(both, lambda s: F.flatten(F.transform(s["r"], lambda r: F.transform(s["c"], lambda c: F.get(pixels, r * width + c)))))


def crop_patches(px: DataFrame, centres: DataFrame, size: int, height: int, width: int) -> DataFrame:
    """Patches (patch_idx, r and c from 0) of a size round centres (image_id, patch_idx, cy, cx); a patch that leaves the
    field is dropped. Pixels and patches meet by cells of the patches' size, of which a patch touches four, so the work follows
    the patches and not an image's pixels times its centres."""
    h = size // 2
    top, left = F.col("cy") - h, F.col("cx") - h
    inside = (top >= 0) & (top + size <= height) & (left >= 0) & (left + size <= width)
    cell = lambda x: F.floor(x / size).cast("int")
    each = lambda x: F.explode(F.array_distinct(F.array(cell(x), cell(x + size - 1))))
    wanted = centres.filter(inside).select("image_id", "patch_idx", top.alias("_top"), left.alias("_left"), each(top).alias("_i")).select("*", each(F.col("_left")).alias("_j"))
    near = px.withColumns({"_i": cell(F.col("r")), "_j": cell(F.col("c"))}).join(wanted, ["image_id", "_i", "_j"])
    r, c = F.col("r") - F.col("_top"), F.col("c") - F.col("_left")
    return near.filter(r.between(0, size - 1) & c.between(0, size - 1)).select("image_id", "patch_idx", r.alias("r"), c.alias("c"), "v")


def center_crop(px: DataFrame, height: int, width: int, size: int) -> DataFrame:
    """The box of a size in the middle, clamped at the borders."""
    top, left = max(0, (height - size) // 2), max(0, (width - size) // 2)
    return px.filter(F.col("r").between(top, top + size - 1) & F.col("c").between(left, left + size - 1))


def replicate_channels(channels: Column) -> Column:
    """One channel three times; three stay; another number is an error."""
    n = F.size(channels)
    return F.when(n == 1, F.flatten(F.array_repeat(channels, 3))).when(n == 3, channels).otherwise(F.raise_error(F.lit("images need one or three channels")))
