"""Incomplete rows in fits and quantiles, draws from skewed groups, restarts of batches, and files that need not be read."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.operators import aggregate as A
from platewise.operators import regression as G
from platewise.operators import relational as R
from platewise.operators import sampling as S
from platewise.sources import done as D
from platewise.sources import tables as T
from platewise.streaming import incremental as I

NAN, INF = float("nan"), float("inf")


# --- fits -----------------------------------------------------------------------------------------------------
def bad_rows(n: int = 60) -> list[tuple]:
    rng = np.random.default_rng(1)
    rows = [("g", i, float(x), float(z), "AB"[i % 2], float(1 + 2 * x + 0.5 * z + 0.1 * e)) for i, (x, z, e) in enumerate(rng.standard_normal((n, 3)))]
    bad = [("g", 1.0, None, "A", 1.0), ("g", 1.0, NAN, "A", 1.0), ("g", 1.0, INF, "A", 1.0), ("g", None, 1.0, "A", 1.0), ("g", 1.0, 1.0, "A", None), ("g", -INF, 1.0, "B", 1.0), ("g", 1.0, 1.0, "B", NAN), (None, 1.0, 1.0, "A", 1.0)]
    return rows + [(g, n + k, *rest) for k, (g, *rest) in enumerate(bad)]


def complete(rows) -> list[tuple]:
    return [r for r in rows if None not in r and all(np.isfinite(v) for v in r if isinstance(v, float))]


def r_squared(y, *columns) -> tuple[float, np.ndarray]:
    x = np.column_stack([np.ones(len(y)), *columns])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    return 1 - ((y - x @ beta) ** 2).sum() / ((y - y.mean()) ** 2).sum(), beta


def test_fits_rest_on_complete_rows(spark):
    rows = bad_rows()
    df = spark.createDataFrame(rows, "g string, id int, x1 double, x2 double, level string, y double")
    kept = complete(rows)
    x1, x2, y = (np.array([r[k] for r in kept]) for k in (2, 3, 5))
    one = G.nested_ols_numeric(df, ["g"]).first()
    r2, beta = r_squared(y, x1, x2)
    assert (one.n_rows, one.g) == (len(kept), "g") and one.beta_x1_full == pytest.approx(beta[1]) and one.beta_x2 == pytest.approx(beta[2]) and one.r2_full == pytest.approx(r2)
    assert one.r2_restricted == pytest.approx(r_squared(y, x1)[0])
    # As levels: the numbers' missing values do not count there, but a missing level does.
    more = df.withColumn("level", F.when(F.col("id") != 3, F.col("level")))
    kept = complete([(r[0], r[1], r[2], 0.0, None if r[1] == 3 else r[4], r[5]) for r in rows])
    x1, y, a = (np.array([r[k] for r in kept]) for k in (2, 5, 4))
    cat = G.nested_ols_categorical(more, ["g"], x2="level").first()
    r2, beta = r_squared(y, x1, (a == "B").astype(float))
    assert cat.n_rows == len(kept) and cat.beta_x1_full == pytest.approx(beta[1]) and cat.r2_full == pytest.approx(r2)


def test_text_in_a_fit(spark):
    rows = [("g", str(i % 7), str(i * i % 11), float(i)) for i in range(20)] + [("g", "x", "1", 1.0), ("g", "1", "", 1.0)]
    df = spark.createDataFrame(rows, "g string, x1 string, x2 string, y double")
    a, b, y = (np.array([float(r[k]) for r in rows[:20]]) for k in (1, 2, 3))
    one = G.nested_ols_numeric(df, ["g"]).first()
    assert one.n_rows == 20 and one.r2_full == pytest.approx(r_squared(y, a, b)[0])


@pytest.mark.parametrize("categorical", [False, True])
def test_bootstrap_of_incomplete_rows(spark, categorical):
    """The draws are those from the complete rows alone, so the results are the same."""
    rows = bad_rows()
    make = lambda r: spark.createDataFrame(r, "g string, id int, x1 double, x2 double, level string, y double")
    x2 = "level" if categorical else "x2"
    run = lambda df: [tuple(r) for r in G.bootstrap_nested(df, ["g"], ["id"], "y", "x1", x2, 8, categorical=categorical).orderBy("boot_idx").collect()]
    kept = [r for r in rows if r in complete([r])] if not categorical else [r for r in rows if complete([(*r[:3], 0.0, *r[4:])])]
    got, want = run(make(rows)), run(make(kept))
    assert len(got) == 8 and all(x is not None or categorical for r in got for x in r)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b)


def test_summary_of_resamples(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(a), float(b)) for g in "pq" for a, b in rng.random((41, 2))] + [("p", NAN, None), ("r", None, NAN)]
    out = {r.g: r for r in G.bootstrap_summary(spark.createDataFrame(rows, "g string, r2_restricted double, partial_r2_x2 double"), ["g"]).collect()}
    for g in "pq":
        v = np.array([r[1] for r in rows if r[0] == g and np.isfinite(r[1])])
        assert out[g].r2_restricted_mean == pytest.approx(v.mean()) and out[g].r2_restricted_low == pytest.approx(np.quantile(v, 0.025)) and out[g].r2_restricted_plus == pytest.approx(np.quantile(v, 0.975) - v.mean())
    assert out["r"].r2_restricted_mean is None and out["r"].partial_r2_x2_low is None


def test_nan_is_no_value(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 2.0, NAN, None)] + [("b", NAN)], "g string, v double")
    assert [tuple(r) for r in R.value_counts(df, "v").collect()] == [(2.0, 2), (1.0, 1)]
    bands = {r.g: r for r in A.mean_quantile_band(df, ["g"], ["v"]).collect()}
    assert bands["a"].v_mean == pytest.approx(5 / 3) and bands["a"].v_low == pytest.approx(1.05) and bands["a"].v_high == 2 and bands["b"].v_mean is None


# --- draws ----------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("n", [1, 7, 1500])
def test_draws_from_a_hot_group(spark, monkeypatch, n):
    """Nine tenths of the rows in one group; a number and a column give the same rows as a sort of the whole group."""
    df = spark.range(6000).select(F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") % 20 == 0, "cold").alias("g"), (F.col("id") % 5900).alias("id"))
    rank = F.row_number().over(S.Window.partitionBy("g").orderBy(S.draw_order("5", "id"), "id"))
    want = sorted(map(str, df.withColumn("k", rank).filter(F.col("k") <= n).drop("k").collect()))
    for k in (n, F.when(F.col("g").isNull() | F.col("g").isNotNull(), n)):
        assert sorted(map(str, S.sample_per_group(df, ["g"], ["id"], k, "5").collect())) == want
    monkeypatch.setattr(S, "FEW", 0)
    assert sorted(map(str, S.least_hashes(df, ["g"], ["id"], n, "5").collect())) == want


def test_no_window_over_a_hot_group(spark):
    df = spark.range(60_000).select(F.lit("hot").alias("g"), "id").withColumn("n", F.lit(2000))
    out = S.least_hashes(df, ["g"], ["id"], F.col("n"))
    assert out.columns == ["g", "id", "n"] and out.count() == 2000
    kept = [p for p in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window" in p and "row_number" in p]
    assert kept and all("_bucket" in p for p in kept)


# --- batches --------------------------------------------------------------------------------------------------
def score(df):
    return df.select("k", (F.col("v") * 2).alias("score"), F.concat(F.lit("/out/"), "k").alias("output_file"))


@pytest.mark.parametrize("where", ["done", None])
def test_a_batch_that_runs_again_counts_once(spark, tmp_path, monkeypatch, where):
    tasks, results, state = (f"file://{tmp_path}/{n}" for n in ("tasks", "results", "state"))
    done = f"file://{tmp_path}/{where}" if where else None
    run = lambda: I.incremental_score(spark, tasks, "k long, v double", ["k"], score, results, state, done)
    read = lambda: sorted((r.k, r.score) for r in I.committed_results(spark, results, done).collect())
    write = lambda a, b: spark.range(a, b).select(F.col("id").alias("k"), F.col("id").cast("double").alias("v")).write.mode("append").parquet(tasks)
    real = I.write_done

    def fails(*a):
        raise OSError("lost between both writes")

    def fails_later(*a):
        real(*a)
        raise OSError("lost after both writes")

    write(0, 10)
    for broken in (fails, fails_later):
        monkeypatch.setattr(I, "write_done", broken)
        with pytest.raises(Exception, match="lost"):
            run()
    monkeypatch.setattr(I, "write_done", real)
    run()
    assert read() == [(k, 2.0 * k) for k in range(10)]
    write(5, 20)
    monkeypatch.setattr(I, "write_done", fails)
    with pytest.raises(Exception, match="lost"):
        run()
    assert read() == [(k, 2.0 * k) for k in range(10)]
    monkeypatch.setattr(I, "write_done", real)
    run()
    run()
    assert read() == [(k, 2.0 * k) for k in range(20)]
    assert D.read_done(spark, done or f"{results}/_done").count() == 20


def test_nothing_committed(spark, tmp_path):
    assert I.committed_results(spark, f"file://{tmp_path}/none") is None and D.read_done(spark, f"file://{tmp_path}/none") is None


def test_small_batches_open_few_folders(spark, tmp_path):
    path = f"file://{tmp_path}/done"
    for part in range(4):
        D.write_done(spark.range(part * 1000, part * 1000 + 1000).select(F.col("id").alias("k"), F.lit("m").alias("m")), path, ["k", "m"], str(part))
    everything = len(D.read_done(spark, path).inputFiles())
    tasks = spark.createDataFrame([(17, "m"), (5000, "m"), (None, "m"), (18, None)], "k long, m string")
    found = D.done_for(tasks, path, ["k", "m"])
    assert [r.k for r in D.left_to_do(tasks, path, ["k", "m"]).collect()] == [5000]
    assert everything == 4 * D.BUCKETS and len(found.inputFiles()) <= everything
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "done_bucket" in scan.split("PartitionFilters")[1] and "GreaterThanOrEqual(k,17)" in scan
    # Ints find longs, a part can be left out, and a missing key is an error.
    assert D.left_to_do(tasks.select(F.col("k").cast("int").alias("k"), "m"), path, ["k", "m"]).count() == 1
    assert D.left_to_do(tasks, path, ["k", "m"], without="0").count() == 2
    with pytest.raises(ValueError):
        D.left_to_do(tasks.drop("m"), f"file://{tmp_path}/other", ["k", "m"])


# --- footers --------------------------------------------------------------------------------------------------
def test_many_footers_one_scan(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    paths = []
    for i in range(300):
        columns = {"b": pa.array([float(i)]), "a": pa.array([i]), f"own{i}": pa.array(["x"])}
        paths.append(f"{tmp_path}/{i}.parquet")
        pq.write_table(pa.table(columns if i % 2 else dict(reversed(columns.items()))), paths[-1])
    df = T.scan_common_columns(spark, paths)
    assert set(df.columns) == {"a", "b"} and df.agg(F.sum("a")).first()[0] == 299 * 150
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    pq.write_table(pa.table({"a": pa.array([1.5]), "b": pa.array([1.0])}), paths[0])
    assert T.common_fields(spark, paths) is None
    assert T.scan_common_columns(spark, paths[:3]).agg(F.sum("a")).first()[0] == 4.5
