"""Tiled filters and shared sums of metrics against plain numpy over whole images."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.operators import pixels as P
from platewise.operators import quality as Q
from platewise.operators import tiles as L


def table(spark, images: dict[int, np.ndarray], name: str = "v"):
    rows = [(i, r, c, None if np.isnan(x) else float(x)) for i, a in images.items() for (r, c), x in np.ndenumerate(a)]
    return spark.createDataFrame(rows, f"image_id int, r int, c int, {name} double")


def dense(df, shape) -> np.ndarray:
    out = np.full(shape, np.nan)
    rows = df.collect()
    assert len(rows) == len({(x.r, x.c) for x in rows})
    for x in rows:
        out[x.r, x.c] = np.nan if x.v is None else x.v
    return out


def blurred(a: np.ndarray, w: list[float]) -> np.ndarray:
    h = len(w) // 2
    for axis in (1, 0):
        a = np.apply_along_axis(lambda x: [np.dot(x[max(0, i - h) : i + h + 1], v := w[max(0, h - i) : h + len(x) - i][: 2 * h + 1]) / np.sum(v) for i in range(len(x))], axis, a)
    return a


def square(a: np.ndarray, h: int, f) -> np.ndarray:
    return np.array([[f(a[max(0, r - h) : r + h + 1, max(0, c - h) : c + h + 1]) for c in range(a.shape[1])] for r in range(a.shape[0])])


@pytest.mark.parametrize("reach", [0, 1, 4, 9, 60])
def test_running_filters(reach):
    x = np.random.default_rng(reach).standard_normal((2, 23, 31))
    for f, g in ((np.minimum, np.min), (np.maximum, np.max)):
        assert np.array_equal(L.extreme(x, reach, f), [square(a, reach, g) for a in x])
    assert np.allclose(L.running_sum(x, reach), [square(a, reach, np.sum) for a in x])


@pytest.mark.parametrize("tile", [8, 13, 100])
def test_filters_do_not_see_the_tiles(spark, tile):
    rng = np.random.default_rng(1)
    images = {1: rng.random((30, 41)), 2: rng.random((5, 70)), 3: rng.random((30, 41))}
    px, w = table(spark, images), P.gaussian_weights(1.2)
    levels = {1: lambda v, there: L.weighted_mean(v, there, w), 2: lambda v, there: L.extreme(v, 3, np.minimum)}
    for tiles in (L.tile_rows(px, ["v"], 4, tile), L.tile_arrays(arrays(spark, images), F.col("height"), F.col("width"), 4, tile=tile)):
        out = L.filtered(tiles, levels, tile)
        for i, a in images.items():
            for level, want in ((1, blurred(a, w)), (2, square(a, 3, np.min))):
                assert np.allclose(dense(out.filter((F.col("image_id") == i) & (F.col("level") == level)), a.shape), want)


def arrays(spark, images):
    return spark.createDataFrame([(i, *a.shape, a.ravel().tolist()) for i, a in images.items()], "image_id int, height int, width int, pixels array<double>")


def test_missing_values_and_pixels(spark):
    a = np.random.default_rng(2).random((12, 12))
    a[3, 4] = np.nan
    px = table(spark, {1: a}).filter("r > 0")
    low = dense(P.erode(px, 3), a.shape)
    assert np.isnan(low[0]).all() and low[3, 4] == np.nanmin(a[2:5, 3:6]) and not np.isnan(low[1:]).any()
    soft = dense(P.gaussian_blur(px, 0.5, 1), a.shape)
    assert np.isnan(soft[2:5, 3:6]).all() and np.isnan(soft[1:]).sum() == 9
    assert P.erode(px.filter("false"), 3).count() == 0


def test_a_large_image_is_many_tasks(spark):
    side = 1080
    images = spark.range(1).select(F.lit(7).alias("image_id"), F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: (i.cast("long") * 7919 % 10007).cast("double")).alias("pixels"))
    tiles = L.tile_arrays(images, F.lit(side), F.lit(side), 20)
    assert tiles.count() == 25
    out = L.filtered(tiles, {1: lambda v, there: L.extreme(v, 20, np.maximum)})
    got = out.agg(F.count("*"), F.sum("v")).first()
    assert out.select(F.spark_partition_id()).distinct().count() > 1
    a = (np.arange(side * side, dtype=np.int64) * 7919 % 10007).astype(float).reshape(side, side)
    assert tuple(got) == (side * side, L.extreme(a[None], 20, np.maximum).sum())


# --- metrics --------------------------------------------------------------------------------------------------
def two_tone(rng, side: int) -> np.ndarray:
    y = 0.3 * rng.random((side, side)) + 0.6 * (np.arange(side) >= side // 2)
    return y


def metrics_by_hand(x: np.ndarray, y: np.ndarray, size: int = 11) -> dict[str, float]:
    def similarity(mean) -> np.ndarray:
        return Q.similarity(*(mean(p) for p in (x, y, x * x, y * y, x * y)))

    hist = np.bincount(np.minimum((y * 64).astype(int), 63).ravel(), minlength=64).astype(float)
    level = np.arange(64) + 0.5
    best = max(((round(a * b * ((hist[: k + 1] @ level[: k + 1]) / a - (hist[k + 1 :] @ level[k + 1 :]) / b) ** 2, 6), -k) for k in range(64) if (a := hist[: k + 1].sum()) and (b := hist[k + 1 :].sum())), default=(0, -64))
    fg = y >= (1 - best[1]) / 64
    h = size // 2
    uniform = similarity(lambda p: square(p, h, np.mean))
    whole = square(fg, h, np.all) & (square(np.ones_like(y), h, np.sum) == size * size)
    error = ((x - y) ** 2)[fg].mean() if fg.any() else 0
    return {
        "mae": np.abs(x - y).mean(), "psnr": -10 * np.log10(((x - y) ** 2).mean()), "ssim": similarity(lambda p: blurred(p, P.gaussian_weights(1.5, 5))).mean(),
        "fg_psnr": -10 * np.log10(max(error, 1e-12)), "fg_ssim": uniform[whole].mean() if whole.any() else 0.0,
    }


@pytest.mark.parametrize("tile", [10, 256])
def test_metric_table_by_hand(spark, monkeypatch, tile):
    monkeypatch.setattr(L, "TILE", tile)
    monkeypatch.setattr(Q, "tile_rows", lambda px, columns, halo: L.tile_rows(px, columns, halo, tile))
    monkeypatch.setattr(Q, "map_tiles", lambda *a: L.map_tiles(*a, tile=tile))
    rng = np.random.default_rng(3)
    y = {i: two_tone(rng, side) for i, side in ((1, 32), (2, 25), (3, 8))}
    y[4] = np.ones((4, 4))
    x = {i: np.clip(a + 0.05 * rng.standard_normal(a.shape), 0, 1) for i, a in y.items()}
    got = {(r.image_id, r.metric_name): r.metric_value for r in Q.metric_table(Q.pair_pixels(table(spark, x), table(spark, y))).collect()}
    for i in (1, 2, 3):
        for name, value in metrics_by_hand(x[i], y[i]).items():
            assert got[i, name] == pytest.approx(value, rel=1e-9, abs=1e-12), (i, name)
    assert got[1, "fg_ssim"] > 0 and got[3, "fg_ssim"] == 0 and len(got) == 20


def test_metric_table_reads_its_pairs_once(spark, tmp_path):
    rng = np.random.default_rng(4)
    y = {i: two_tone(rng, 16) for i in (1, 2)}
    Q.pair_pixels(table(spark, y), table(spark, y)).write.parquet(str(tmp_path / "pairs"))
    plan = Q.metric_table(spark.read.parquet(str(tmp_path / "pairs")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange ") <= 3


def test_pairs_must_agree(spark):
    a, b = {1: np.zeros((2, 2)), 2: np.zeros((2, 2))}, {1: np.zeros((1, 2)), 2: np.zeros((2, 2))}
    for x, y in ((a, b), (b, a), (a, {1: a[1]})):
        with pytest.raises(Exception, match="differ in their pixels"):
            Q.mae(Q.pair_pixels(table(spark, x), table(spark, y))).collect()
    nulls = Q.pair_pixels(table(spark, {1: np.array([[np.nan, 0.5]])}), table(spark, {1: np.array([[0.1, 0.1]])}))
    assert Q.metric_table(nulls).filter("metric_name = 'mae'").first().metric_value == pytest.approx(0.4)


def test_a_thousand_patches_of_an_image(spark):
    rng = np.random.default_rng(5)
    a = rng.random((90, 120))
    centres = [(1, k, int(rng.integers(-3, 95)), int(rng.integers(-3, 125))) for k in range(1000)]
    out = P.crop_patches(table(spark, {1: a}), spark.createDataFrame(centres, "image_id int, patch_idx int, cy int, cx int"), 9, 90, 120)
    got = {r.patch_idx: (r.n, r.total) for r in out.groupBy("patch_idx").agg(F.count("*").alias("n"), F.sum(F.col("v") * (9 * F.col("r") + F.col("c"))).alias("total")).collect()}
    kept = {k: a[y - 4 : y + 5, x - 4 : x + 5] for _, k, y, x in centres if y >= 4 and x >= 4 and y + 5 <= 90 and x + 5 <= 120}
    assert got.keys() == kept.keys() and all(got[k] == (81, pytest.approx((p * np.arange(81).reshape(9, 9)).sum())) for k, p in kept.items())
