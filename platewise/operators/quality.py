"""Quality of degraded images against their originals, over pairs of pixels ``(image_id, r, c, x, y)`` in [0, 1].

A metric declares the sums that it needs, plain or by gray bin of the target, and what it makes of them. One pass over tiles
gives the union of all metrics' sums, so a table of many metrics reads its pairs once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.operators.pixels import gaussian_weights
from platewise.operators.tiles import Tiles, extreme, map_tiles, running_sum, tile_rows, weighted_mean

C1, C2 = 0.01**2, 0.03**2
EPS = 1e-12
#: Gray bins of the target for its threshold.
BINS = 64


def pair_pixels(degraded: DataFrame, target: DataFrame) -> DataFrame:
    """x: the degraded image, y: the target. Both must have the same images and pixels, else the job ends with an error."""
    a = degraded.select("image_id", "r", "c", F.struct(F.col("v").alias("x")).alias("_a"))
    b = target.select("image_id", "r", "c", F.struct(F.col("v").alias("y")).alias("_b"))
    unlike = F.raise_error(F.concat(F.lit("the two images differ in their pixels: "), F.col("image_id").cast("string")))
    value = lambda v: F.when(F.col("_a").isNull() | F.col("_b").isNull(), unlike.cast("double")).otherwise(v)
    return a.join(b, ["image_id", "r", "c"], "full").select("image_id", "r", "c", value(F.col("_a.x")).alias("x"), value(F.col("_b.y")).alias("y"))


def mae(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("image_id").agg(F.avg(F.abs(F.col("x") - F.col("y"))).alias("mae"))


def psnr(pairs: DataFrame) -> DataFrame:
    """Equal images have an infinite ratio."""
    mse = F.avg((F.col("x") - F.col("y")) ** 2)
    return pairs.groupBy("image_id").agg(F.when(mse == 0, float("inf")).otherwise(-10 * F.log10(mse)).alias("psnr"))


def similarity(mx, my, xx, yy, xy):
    """Structural similarity from the means of x, y and their products."""
    vx, vy, cov = xx - mx * mx, yy - my * my, xy - mx * my
    return (2 * mx * my + C1) * (2 * cov + C2) / ((mx * mx + my * my + C1) * (vx + vy + C2))


@dataclass(frozen=True)
class Sum:
    """Values of a tile's pixels that are added up where they are not NaN; ``reach`` is how far they see. ``bin_by`` gives the gray value by which
    they are added up in bins (plain sums have none)."""

    values: Callable[[Tiles], np.ndarray]
    reach: int = 0
    bin_by: Callable[[Tiles], np.ndarray] | None = None


def _products(t: Tiles) -> list[np.ndarray]:
    x, y = t.values["x"], t.values["y"]
    return [x, y, x * x, y * y, x * y]


def _uniform(size: int) -> Callable[[Tiles], np.ndarray]:
    """Similarity over squares with equal weights (cut where they leave the image)."""

    def values(t: Tiles) -> np.ndarray:
        n = running_sum(t.there.astype(float), size // 2)
        missing = t.there & (np.isnan(t.values["x"]) | np.isnan(t.values["y"]))
        means = [running_sum(np.nan_to_num(p), size // 2) / np.maximum(n, 1) for p in _products(t)]
        out = similarity(*means)
        return np.where(running_sum(missing.astype(float), size // 2) > 0.5, np.nan, out) if missing.any() else out

    return values


def _whole_squares(size: int) -> Callable[[Tiles], np.ndarray]:
    """The least target value of each pixel's square; NaN where the square leaves the image."""

    def values(t: Tiles) -> np.ndarray:
        whole = running_sum(t.there.astype(float), size // 2) > size * size - 0.5
        return np.where(whole, extreme(_gray(t), size // 2, np.minimum), np.nan)

    return values


def _gaussian(size: int, sigma: float) -> Callable[[Tiles], np.ndarray]:
    weights = gaussian_weights(sigma, size // 2)
    return lambda t: similarity(*(weighted_mean(p, t.there, weights) for p in _products(t)))


def _error(t: Tiles) -> np.ndarray:
    return t.values["x"] - t.values["y"]


def _count(of: Callable[[Tiles], np.ndarray]) -> Callable[[Tiles], np.ndarray]:
    return lambda t: np.where(np.isnan(of(t)), np.nan, 1.0)


def _gray(t: Tiles) -> np.ndarray:
    """What tells the foreground: a given mask, or the target."""
    return t.values.get("mask", t.values["y"])


@dataclass(frozen=True)
class Metric:
    """Its sums by name, and the value from them. Plain sums are columns of their names; a binned sum is its total over the bins of the foreground."""

    sums: dict[str, Sum]
    value: Callable[[], Column]


def gaussian_ssim_metric(size: int = 11, sigma: float = 1.5) -> Metric:
    of, name = _gaussian(size, sigma), f"gaussian_{size}_{sigma}".replace(".", "_")
    return Metric({name: Sum(of, size // 2), f"{name}_n": Sum(_count(of), size // 2)}, lambda: F.try_divide(name, f"{name}_n"))


def ssim_metric(size: int = 7) -> Metric:
    of, name = _uniform(size), f"uniform_{size}"
    return Metric({name: Sum(of, size // 2), f"{name}_n": Sum(_count(of), size // 2)}, lambda: F.try_divide(name, f"{name}_n"))


def fg_ssim_metric(size: int = 11) -> Metric:
    """Mean over pixels whose whole square is foreground (squares that leave the image never are); 0 without any."""
    of, least, name = _uniform(size), _whole_squares(size), f"fg_{size}"
    return Metric({name: Sum(of, size // 2, least), f"{name}_n": Sum(_count(of), size // 2, least)}, lambda: F.coalesce(F.try_divide(name, f"{name}_n"), F.lit(0.0)))


def fg_psnr_metric(top: float = 1.0) -> Metric:
    """Over foreground pixels; without any, or without error, the floor of the mean squared error counts."""
    mse = lambda: F.greatest(F.coalesce(F.col("fg_error"), F.lit(0.0)) / F.greatest(F.coalesce(F.col("fg_error_n"), F.lit(0.0)), F.lit(EPS)), F.lit(EPS))
    return Metric({"fg_error": Sum(lambda t: _error(t) ** 2, 0, _gray), "fg_error_n": Sum(_count(_error), 0, _gray)}, lambda: 20 * F.log10(F.lit(top)) - 10 * F.log10(mse()))


_MEAN_ERROR = {"error_n": Sum(_count(_error))}
METRICS: dict[str, Metric] = {
    "mae": Metric(_MEAN_ERROR | {"error": Sum(lambda t: np.abs(_error(t)))}, lambda: F.try_divide("error", "error_n")),
    "psnr": Metric(_MEAN_ERROR | {"error_2": Sum(lambda t: _error(t) ** 2)}, lambda: F.when(F.col("error_2") == 0, float("inf")).otherwise(-10 * F.log10(F.try_divide("error_2", "error_n")))),
    "ssim": gaussian_ssim_metric(),
    "fg_psnr": fg_psnr_metric(),
    "fg_ssim": fg_ssim_metric(),
}


def image_sums(pairs: DataFrame, sums: dict[str, Sum], bins: int) -> DataFrame:
    """(image_id, b, names of sums): plain sums in the row of bin -1, the others by gray bin (bin ``bins``: 1 and above), where also
    ``pixels`` counts the target's pixels."""
    names = list(sums)

    def bin_of(gray: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(gray), -1, np.clip(np.floor(np.nan_to_num(gray) * bins), 0, bins)).astype(np.int64)

    def kernel(t: Tiles) -> Iterator[tuple[pa.Array, dict[str, np.ndarray]]]:
        m, width = len(t.top), bins + 2
        table = {k: np.zeros((m, width)) for k in ("pixels", *names)}

        def put(name: str, values: np.ndarray, b: np.ndarray | None) -> None:
            good = t.inner(t.there) & ~np.isnan(values)
            if b is not None:
                good &= b >= 0
            tile = np.nonzero(good)[0]
            place = tile * width + (b[good] + 1 if b is not None else 0)
            table[name] = np.bincount(place, values[good], m * width).astype(float).reshape(m, width)

        made: dict[Callable, np.ndarray] = {}
        once = lambda f: made[f] if f in made else made.setdefault(f, t.inner(f(t)))
        put("pixels", np.ones_like(once(_gray)), bin_of(once(_gray)))
        for k in names:
            put(k, once(sums[k].values), bin_of(once(sums[k].bin_by)) if sums[k].bin_by else None)
        used = np.any([table[k] != 0 for k in table], axis=0)
        used[:, 0] = True
        tile, b = np.nonzero(used)
        yield t.image.take(pa.array(tile)), {"b": (b - 1).astype(np.int32)} | {k: v[tile, b] for k, v in table.items()}

    halo = max((s.reach for s in sums.values()), default=0)
    columns = [c for c in ("x", "y", "mask") if c in pairs.columns]
    rows = map_tiles(tile_rows(pairs, columns, halo), columns, kernel, {"b": "int", "pixels": "double"} | dict.fromkeys(names, "double"))
    return rows.groupBy("image_id", "b").agg(*[F.sum(k).alias(k) for k in ("pixels", *names)])


def measured(pairs: DataFrame, metrics: dict[str, Metric], bins: int = BINS) -> DataFrame:
    """image_id, and a column of each metric, from one aggregation of all their sums. The foreground is what a column ``fg`` says, if
    there is one; else what is above the target's own threshold, a bin's edge, so its sums are those of the bins above it."""
    given = "fg" in pairs.columns
    pairs = pairs.select("image_id", "r", "c", "x", "y", *([F.col("fg").cast("double").alias("mask")] if given else []))
    sums = {k: s for m in metrics.values() for k, s in m.sums.items()}
    table = image_sums(pairs, sums, bins)
    if given:
        table = table.withColumn("_edge", F.lit(bins - 1))
    elif any(s.bin_by for s in sums.values()):
        by = Window.partitionBy("image_id")
        edge = F.max(F.when(F.col("b") >= 0, F.struct("_between", (-F.least("b", F.lit(bins - 1))).alias("minus")))).over(by)
        gray = table.withColumn("_gray", F.least("b", F.lit(bins - 1)))
        table = gray.withColumn("_between", _between_classes("_gray", "pixels", by, F.col("b") >= 0)).withColumn("_edge", -edge["minus"])
    else:
        table = table.withColumn("_edge", F.lit(None).cast("int"))
    one = lambda k, s: F.sum(F.when(F.col("b") > F.col("_edge"), F.col(k))) if s.bin_by else F.sum(F.when(F.col("b") == -1, F.col(k)))
    return table.groupBy("image_id").agg(*[one(k, s).alias(k) for k, s in sums.items()]).select("image_id", *[m.value().alias(k) for k, m in metrics.items()])


def _between_classes(gray: str, n: str, by, counted: Column) -> Column:
    """The variance between the pixels up to a gray bin and those above it, over a histogram's rows."""
    upto = by.orderBy(gray).rangeBetween(Window.unboundedPreceding, 0)
    count, level = F.when(counted, F.col(n)).otherwise(0.0), F.col(gray) + 0.5
    w0, s0, w, s = F.sum(count).over(upto), F.sum(count * level).over(upto), F.sum(count).over(by), F.sum(count * level).over(by)
    between = w0 * (w - w0) * (s0 / F.nullif(w0, F.lit(0.0)) - (s - s0) / F.nullif(w - w0, F.lit(0.0))) ** 2
    return F.when(counted, F.round(F.coalesce(between, F.lit(-1.0)), 6))


def ssim(pairs: DataFrame, size: int = 7) -> DataFrame:
    return measured(pairs, {"ssim": ssim_metric(size)})


def gaussian_ssim(pairs: DataFrame, size: int = 11, sigma: float = 1.5) -> DataFrame:
    """Mean structural similarity with Gaussian weights, renormalised where a square leaves the image."""
    return measured(pairs, {"ssim": gaussian_ssim_metric(size, sigma)})


def fg_psnr(pairs: DataFrame, top: float = 1.0) -> DataFrame:
    return measured(pairs, {"fg_psnr": fg_psnr_metric(top)})


def fg_ssim(pairs: DataFrame, size: int = 11) -> DataFrame:
    return measured(pairs, {"fg_ssim": fg_ssim_metric(size)})


def otsu_threshold(px: DataFrame, bins: int = BINS, value: str = "y") -> DataFrame:
    """threshold of each image: the bin edge with the largest variance between the pixels below and above it."""
    b = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    hist = px.groupBy("image_id", b.alias("b")).agg(F.count("*").cast("double").alias("n"))
    s = hist.withColumn("between", _between_classes("b", "n", Window.partitionBy("image_id"), F.lit(True)))
    best = s.groupBy("image_id").agg(F.max(F.struct("between", (-F.col("b")).alias("minus"))).alias("best"))
    return best.select("image_id", ((1 - F.col("best.minus")) / F.lit(float(bins))).alias("threshold"))


def with_mask(pairs: DataFrame, bins: int = BINS) -> DataFrame:
    """fg: whether the target's pixel is above the target's threshold."""
    return pairs.join(otsu_threshold(pairs, bins), "image_id").withColumn("fg", F.col("y") >= F.col("threshold"))


def metric_table(pairs: DataFrame, metrics: dict[str, Metric] | None = None) -> DataFrame:
    """image_id, metric_name, metric_value: one value of each registered metric for each pair."""
    metrics = METRICS if metrics is None else metrics
    return measured(pairs, metrics).unpivot(["image_id"], list(metrics), "metric_name", "metric_value")


def gray_limits(px: DataFrame) -> tuple[Column, Column]:
    return F.min("v"), F.max("v")
