"""Rules that the tables of the driver do not exercise."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.functions import scalars as X
from platewise.operators import aggregate as A
from platewise.operators import pixels as P
from platewise.operators import quality as Q
from platewise.operators import regression as G
from platewise.operators import relational as R
from platewise.operators import sampling as S
from platewise.sources import tables as T
from platewise.streaming.incremental import batch_predict


def test_required_columns_and_empty_index(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "a int")
    assert T.require_columns(df, ["a"]) is df
    with pytest.raises(ValueError, match="table lacks columns"):
        T.require_columns(df, ["a", "variant"])
    assert T.scan_parquet_index(spark, f"file://{tmp_path}/none").columns == list(T.INDEX_COLUMNS)
    with pytest.raises(ValueError):
        T.append_index(df, f"file://{tmp_path}/index")


def test_appending_nothing_writes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([], T.INDEX_SCHEMA)
    assert not T.append_index(rows, f"file://{tmp_path}/index")
    assert not T.exists(spark, f"file://{tmp_path}/index/*.parquet")


def test_unpivot_paths_needs_both_columns(spark):
    df = spark.createDataFrame([("p", "a.tif", "/d\\x//", "b.tif", None)], "Metadata_Plate string, FileName_A string, PathName_A string, FileName_B string, PathName_C string")
    assert [(r.channel, r.abs_path) for r in R.unpivot_paths(df).collect()] == [("A", "/d/x/a.tif")]


def test_null_keys_are_equal_in_null_safe_anti_join(spark):
    a, b = spark.createDataFrame([(1,), (None,), (2,)], "k int"), spark.createDataFrame([(None,), (2,)], "k int")
    assert [r.k for r in R.join_null_safe(a, b, ["k"], "left_anti").collect()] == [1]


def test_not_done(spark):
    tasks = spark.createDataFrame([(1, "a"), (2, "a"), (None, "a")], "k int, m string")
    assert R.not_done(tasks, None, ["k", "m"]).count() == 2
    assert [r.k for r in R.not_done(tasks, tasks.filter("k = 1"), ["k", "m"]).collect()] == [2]
    with pytest.raises(ValueError, match="key columns missing"):
        R.not_done(tasks, None, ["site"])


def test_filter_condition_map_can_insist_on_rows(spark):
    with pytest.raises(ValueError):
        R.filter_condition_map(spark.range(3), {"id": 7}, must_leave_rows=True)


def test_outliers_need_complete_values(spark):
    rows = [(float(i % 3),) for i in range(50)] + [(100.0,)]
    df = spark.createDataFrame(rows, "v double")
    assert [r.v for r in A.zscore_outliers(df, "v", 2.5).collect()] == [100.0]
    assert A.zscore_outliers(df.union(spark.createDataFrame([(None,)], "v double")), "v", 2.5).count() == 0
    assert A.zscore_outliers(df.limit(0), "v", 2.5).count() == 0


def test_sampling_is_reproducible_and_strict_on_request(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 4)
    draw = lambda d: sorted(r.id for r in S.sample_per_group(d, ["g"], ["id"], 5).collect())
    assert draw(df) == draw(df.repartition(7)) and len(draw(df)) == 20
    with pytest.raises(ValueError, match="fewer"):
        S.sample_per_group(df, ["g"], ["id"], 26, on_short="error")


def test_collinear_regression_is_least_norm(spark):
    x = np.linspace(-1, 1, 40)
    y = 1 + 2 * x + 0.5 * (x + 1) + np.random.default_rng(0).normal(0, 0.01, 40)
    df = spark.createDataFrame([("g", float(a), float(a + 1), float(b)) for a, b in zip(x, y, strict=True)], "g string, x1 double, x2 double, y double")
    r = G.nested_ols_numeric(df, ["g"]).first()
    want = np.linalg.pinv(np.stack([np.ones(40), x, x + 1], 1)) @ y
    assert np.allclose([r.beta_x1_full, r.beta_x2], want[1:], atol=1e-6) and r.r2_full == pytest.approx(r.r2_restricted)


def test_regression_equals_least_squares(spark):
    rng = np.random.default_rng(1)
    x1, x2 = rng.normal(size=60), rng.normal(size=60)
    level = rng.integers(0, 3, 60)
    y = 1 + x1 - 2 * x2 + level + rng.normal(0, 0.1, 60)
    df = spark.createDataFrame([("g", float(a), float(b), str(c), float(d)) for a, b, c, d in zip(x1, x2, level, y, strict=True)], "g string, x1 double, x2 double, l string, y double")

    def r2(design):
        left = y - design @ np.linalg.lstsq(design, y, rcond=None)[0]
        return 1 - left @ left / ((y - y.mean()) @ (y - y.mean()))

    one = np.ones(60)
    r = G.nested_ols_numeric(df, ["g"]).first()
    assert r.r2_restricted == pytest.approx(r2(np.stack([one, x1], 1))) and r.r2_full == pytest.approx(r2(np.stack([one, x1, x2], 1)))
    c = G.nested_ols_categorical(df, ["g"], x2="l").first()
    assert c.beta_x2 is None and c.r2_full == pytest.approx(r2(np.stack([x1, *(level == k for k in range(3))], 1).astype(float)))
    assert c.partial_r2_x2 == pytest.approx((c.r2_full - c.r2_restricted) / (1 - c.r2_restricted))


def test_resamples_are_standardised_each_by_itself(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "g", float(rng.normal(5, 3)), float(rng.normal(-2, 9)), float(rng.normal())) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, g string, a double, b double, y double")
    drawn = G.bootstrap_weights(df, ["g"], ["id"], 3).toPandas()
    for r in G.bootstrap_nested(df, ["g"], ["id"], "y", "a", "b", n_boot=3, standardize=True).collect():
        own = drawn[drawn.boot_idx == r.boot_idx]
        own = own.loc[own.index.repeat(own.weight.astype(int))]
        z = (own[["a", "b"]] - own[["a", "b"]].mean()) / own[["a", "b"]].std(ddof=0)
        beta = np.linalg.lstsq(np.column_stack([np.ones(len(z)), z]), own.y.to_numpy(), rcond=None)[0]
        assert len(z) == 30 and np.allclose([r.beta_x1_full, r.beta_x2], beta[1:])


def test_constant_variables_explain_nothing(spark):
    df = spark.createDataFrame([("g", 1.0, float(i), 2.0 * i + i % 2) for i in range(9)], "g string, a double, b double, y double")
    r = G.nested_ols_numeric(df, ["g"], "y", "a", "b").first()
    assert r.r2_restricted == 0 and r.partial_r2_x2 == pytest.approx(r.r2_full) and r.r2_full > 0.9
    e = spark.createDataFrame([(None, None, 4.0, 1.0), (1.0, 1.0, 0.0, 0.0)], "r2_restricted double, r2_full double, ssr_restricted double, ssr_full double")
    assert [x.partial_r2_x2 for x in G.effect_sizes(e).collect()] == [0.75, None]


def test_blocks_and_draws_in_several_parts(spark, monkeypatch):
    df = spark.range(50).select("id", F.lit("g").alias("g"), F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("y"))
    df = spark.createDataFrame(df.collect(), df.schema)
    out = lambda: sorted(map(tuple, G.bootstrap_weights(df, ["g"], ["id"], 5).select("boot_idx", "id", "weight").collect()))
    whole = out()
    for name, value in (("BLOCK", 8), ("DRAWS", 7), ("BOOTS", 2)):
        monkeypatch.setattr(G, name, value)
    assert out() == whole


def test_bootstrap_counts(spark):
    df = spark.range(40).select("id", F.lit("g").alias("g"), F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("y"))
    w = G.bootstrap_weights(df, ["g"], ["id"], 3, 0.5)
    assert [r.n for r in w.groupBy("boot_idx").agg(F.sum("weight").alias("n")).collect()] == [20.0] * 3
    plain = G.bootstrap_weights(df, ["g"], ["id"], 2, 0.5, replace=False)
    assert plain.count() == 40 and plain.select("boot_idx", "id").distinct().count() == 40
    out = G.bootstrap_nested(df, ["g"], ["id"], "y", "a", "b", n_boot=2)
    assert {(r.boot_idx, r.n_boot_rows, r.n_group_rows) for r in out.collect()} == {(0, 20, 40), (1, 20, 40)}
    assert G.bootstrap_nested(df.limit(20), ["g"], ["id"], "y", "a", "b", n_boot=2).count() == 0


@pytest.mark.parametrize(("dtype", "values", "want"), [("uint8", [0.0, 255.0], [0.0, 1.0]), ("uint16", [0.0, 65535.0], [0.0, 1.0]), ("uint16", [0.0, 200.0], [0.0, 200 / 65535]), ("float32", [0.0, 0.5], [0.0, 0.5]), ("bool", [0.0, 1.0], [0.0, 1.0])])
def test_normalisation(spark, dtype, values, want):
    df = spark.createDataFrame([(values, dtype)], "p array<double>, t string")
    assert df.select(P.normalized(F.col("p"), F.col("t")).alias("n")).first().n.pixels == want


def test_depth_comes_from_the_type_or_is_given(spark):
    rows = [("uint8", None), ("uint16", None), ("uint16", 12), ("uint8", 12), ("bool", None), ("float32", None)]
    df = spark.createDataFrame([([0.0, 1.0], t, b) for t, b in rows], "p array<double>, t string, b int")
    got = [(r.n.bit_depth, r.n.scale, r.n.warning) for r in df.select(P.normalized(F.col("p"), F.col("t"), F.col("b")).alias("n")).collect()]
    assert got == [(8, 255.0, "inferred"), (16, 65535.0, "inferred"), (12, 4095.0, "below type"), (12, 4095.0, "above type"), (1, 1.0, None), (None, 1.0, None)]


def test_partitioned_index_is_read_again(spark, tmp_path):
    rows = spark.createDataFrame([tuple("abcdefghi")], T.INDEX_SCHEMA)
    rows.write.partitionBy("run_id").parquet(f"file://{tmp_path}/index")
    assert T.scan_parquet_index(spark, f"file://{tmp_path}/index").count() == 1
    (tmp_path / "none" / "_tmp").mkdir(parents=True)
    assert not T.has_parts(spark, f"file://{tmp_path}/none") and not T.has_parts(spark, f"file://{tmp_path}/nowhere")


def test_channels_have_their_own_noise(spark):
    px = spark.createDataFrame([(1, ch, r, 0, 0.5) for ch in "ab" for r in range(4)], "image_id int, ch string, r int, c int, v double")
    v = {(r.ch, r.r): r.v for r in P.gaussian_noise(px, 0.1, "n", "ch").collect()}
    assert all(v["a", r] != v["b", r] for r in range(4))


def test_task_without_a_path_is_an_error(spark):
    df = spark.createDataFrame([(1, "/a"), (2, None)], "k int, path string")
    with pytest.raises(Exception, match="no output path"):
        X.checkpoint_entry(df, ["k"], [], [], "path").collect()


@pytest.mark.parametrize(("dtype", "values"), [("int16", [1.0]), ("float32", [0.0, 127.5])])
def test_normalisation_refuses(spark, dtype, values):
    df = spark.createDataFrame([(values, dtype)], "p array<double>, t string")
    with pytest.raises(Exception, match="cannot normalise"):
        df.select(P.normalized(F.col("p"), F.col("t"))).collect()


def test_quality_of_equal_images(spark):
    px = spark.range(144).select(F.lit(1).alias("image_id"), F.floor(F.col("id") / 12).cast("int").alias("r"), (F.col("id") % 12).cast("int").alias("c"), ((F.col("id") * 7) % 10 / 10).alias("v"))
    pairs = Q.pair_pixels(px, px)
    assert Q.mae(pairs).first().mae == 0 and Q.psnr(pairs).first().psnr == float("inf") and Q.ssim(pairs).first().ssim == pytest.approx(1)
    masked = pairs.withColumn("fg", F.lit(False))
    assert Q.fg_psnr(masked).first().fg_psnr == pytest.approx(120) and Q.fg_ssim(masked).first().fg_ssim == 0


def test_erosion_passes_equal_one_wide_pass(spark):
    px = spark.range(64).select(F.lit(1).alias("image_id"), F.floor(F.col("id") / 8).cast("int").alias("r"), (F.col("id") % 8).cast("int").alias("c"), F.rand(5).alias("v"))
    px = spark.createDataFrame(px.collect(), px.schema)
    key = lambda d: sorted((r.r, r.c, r.v) for r in d.collect())
    assert key(P.erode(P.erode(px, 3), 3)) == key(P.erode(px, 3, 2))


def test_stable_hash_ignores_order_and_trailing_zeros(spark):
    df = spark.createDataFrame([(1.5, "x")], "a double, b string")
    one = X.stable_hash(a=X.number_text(F.col("a")), b=F.col("b"))
    two = X.stable_hash(b=F.col("b"), a=X.number_text(F.col("a").cast("decimal(20,6)")))
    r = df.select(one.alias("x"), two.alias("y")).first()
    assert r.x == r.y and len(r.x) == 16


def test_failed_batches_are_marked(spark):
    df = spark.range(4).coalesce(1)
    assert {r.status for r in batch_predict(df, lambda: lambda pdf: pdf["id"] * 2.0).collect()} == {"ok"}
    assert all(r.status.startswith("error") for r in batch_predict(df, lambda: lambda pdf: [1.0]).collect())


def test_regression_suite_by_brute_force(spark, tmp_path):
    """Five analyses of 300 resamples each, drawn and fitted one by one."""
    import hashlib

    import numpy as np

    from platewise.plans import regression_queries as R

    rng = np.random.default_rng(5)
    names = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    rows = [(i, i % 5, i % 7, 3, float(rng.integers(100, 9000)) + 0.5, float(rng.integers(1, 51)), int(rng.integers(0, 11)) / 100, int(rng.integers(0, 9)) / 100, "A" if i < 130 else "N", "F" if i < 205 else "O") for i in range(215)]
    spark.createDataFrame(rows, names).write.parquet(f"file://{tmp_path}/lineitem.parquet")
    got = {(r.analysis, r.l_returnflag, r.l_linestatus, r.boot_idx): r for r in R.regression_suite(spark, f"file://{tmp_path}").collect()}
    md5 = lambda *parts: hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()

    def mixed(x):
        for _ in range(2):
            x = ((x ^ (x >> 16)) * 73244475) % 2**32
        return x ^ (x >> 16)

    r2 = lambda x, y: 1 - ((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    dummies = lambda v: (v[:, None] == np.unique(v)[None, :]).astype(float)
    suite = {"small": (lambda r: r[5] <= 25, 2, lambda r: r[6]), "large": (lambda r: r[5] > 25, 2, lambda r: r[6]), "flag": (lambda r: True, 2, lambda r: float(r[7] > 0.04)), "category": (lambda r: True, 2, lambda r: r[1]), "pooled": (lambda r: True, 1, lambda r: r[1])}
    want = set()
    for name, (where, k, x2) in suite.items():
        for group in sorted({r[8 : 8 + k] for r in rows}):
            own = sorted((r for r in rows if where(r) and r[8 : 8 + k] == group), key=lambda r: md5(0, *r[:5]))
            if len(own) < 25:
                continue
            size = max(2, round(len(own) * 0.5))
            for boot in range(300):
                key = md5(0, *group, boot)
                place = lambda i: (mixed(mixed(i + 1) ^ int(key[:8], 16)) << 20) + (mixed(mixed(i + 1) ^ int(key[8:16], 16)) >> 12)  # noqa: B023, E731
                drawn = [own[place(i) % len(own)] for i in range(size)]
                y, a, b = (np.array(v, float) for v in ([r[4] for r in drawn], [r[5] for r in drawn], [x2(r) for r in drawn]))
                one = np.ones_like(a)
                full = np.column_stack([a, dummies(b)]) if name in ("category", "pooled") else np.column_stack([one, a, b])
                key = (name, *group, *[None] * (2 - k), boot)
                want.add(key)
                assert abs(got[key].r2_restricted - r2(np.column_stack([one, a]), y)) < 1e-6 and abs(got[key].r2_full - r2(full, y)) < 1e-6
    assert set(got) == want
    assert all(got[k].n_boot_rows == max(2, round(got[k].n_group_rows * 0.5)) for k in want)


def test_registered_bootstrap_has_300_resamples(spark):
    from platewise.plans.catalog import QUERIES

    counts = QUERIES["bootstrap_nested"](spark, "/root/testdata/sf0.001").groupBy("l_returnflag", "l_linestatus").count().collect()
    assert counts and {r["count"] for r in counts} == {300}


def test_exact_quantiles(spark, monkeypatch):
    """Groups large and small against the built-in percentile; a low accuracy makes the estimates work."""
    rows = spark.range(6000).selectExpr("CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 3 = 1 THEN 'b' END AS g", "CASE WHEN id % 7 = 0 THEN NULL ELSE (id * 7919 % 1000) * 1.0D END AS v")
    rows = rows.union(spark.createDataFrame([("one", 5.0), ("none", None), ("two", 1.0), ("two", 2.0)], "g string, v double"))
    ps = [0.0, 0.025, 0.25, 0.5, 0.975, 1.0]
    for accuracy in (20, 10_000):
        monkeypatch.setattr(A, "ACCURACY", accuracy)
        for keys in (["g"], []):
            got = {tuple(r[k] for k in keys): list(r)[len(keys) :] for r in A.exact_quantiles(rows, keys, "v", ps).collect()}
            want = {tuple(r[k] for k in keys): r.q for r in rows.groupBy(*keys).agg(F.percentile("v", F.array(*map(F.lit, ps))).alias("q")).collect() if r.q}
            assert got == {k: pytest.approx(v) for k, v in want.items()}
    none = A.exact_quantiles(rows.filter("false"), [], "v", [0.5])
    assert [tuple(r) for r in none.collect()] == [(None,)]
    band = A.mean_quantile_band(rows, ["g"], ["v"])
    assert {r.g for r in band.collect()} == {"a", "b", None, "one", "two", "none"}


def test_grid_distort_keeps_or_moves(spark):
    images = spark.createDataFrame([(1, [float(i) for i in range(24)])], "image_id int, pixels array<double>")
    warp = lambda limit: images.select(P.grid_distort(F.col("pixels"), F.col("image_id"), 4, 6, 2, limit, "s").alias("p")).first().p
    assert warp(0.0) == [float(i) for i in range(24)]
    moved = warp(0.9)
    assert len(moved) == 24 and set(moved) <= set(range(24)) and moved != warp(0.0)


def test_gaussian_ssim_is_one_for_equal_images(spark):
    px = spark.range(144).selectExpr("1 AS image_id", "int(id div 12) AS r", "int(id % 12) AS c", "(id * 37 % 100) / 100D AS x").withColumn("y", F.col("x"))
    assert Q.gaussian_ssim(px).first().ssim == pytest.approx(1)
    assert Q.gaussian_ssim(px.withColumn("x", F.lit(0.5))).first().ssim < 0.5
