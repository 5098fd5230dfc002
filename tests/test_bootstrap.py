"""Resamples whose draws are made again in each block, against the definition and against whole groups."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from platewise.operators import bootstrap as B
from platewise.operators import regression as G
from platewise.plans import regression_queries as R


@pytest.mark.parametrize(("n", "size"), [(1, 2), (2, 5), (3, 2), (64, 32), (1000, 70_000), (6_000_123, 40_000), (2**31 + 11, 50_000)])
def test_drawn_places_are_the_hash_modulo_the_rows(n, size):
    prefix = f"0|{n}"
    key = hashlib.md5(f"{prefix}|7".encode()).hexdigest()
    d = B.mixed(np.arange(1, size + 1))
    want = ((B.mixed(d ^ int(key[:8], 16)) << 20) + (B.mixed(d ^ int(key[8:16], 16)) >> 12)) % n
    draws = B.hashed_draws(size)
    assert (B.drawn_places(draws, prefix, 7, n, 0, n) == want).all()
    third = n // 3 + 1
    for start in range(0, n, third):
        own = want[(want >= start) & (want < start + third)] - start
        assert (B.drawn_places(draws, prefix, 7, n, start, min(third, n - start)) == own).all()


def test_counts_beyond_a_byte():
    places = np.array([0] * 255 + [1] * 256 + [3] * 700)
    assert B._counts(places, 5).tolist() == [255, 256, 0, 700, 0]


def table(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "g" if i % 5 else "h", float(rng.normal()), float(rng.integers(0, 9)), float(rng.normal()), int(rng.integers(0, 3))) for i in range(300)]
    return spark.createDataFrame(rows, "id long, g string, y double, a double, b double, level int")


@pytest.mark.parametrize("replace", [True, False])
def test_groups_in_several_blocks(spark, monkeypatch, replace):
    df = table(spark)
    both = [B.Analysis("n", ("g",), "y", "a", "b"), B.Analysis("c", ("g",), "y", "a", "level", True), B.Analysis("all", (), "y", "a", "b", where="a > 3")]
    run = lambda: {(r.analysis, r.g, r.boot_idx): tuple(r)[3:] for r in G.bootstrap_analyses(df, ["id"], both, 5, replace=replace).collect()}
    whole = run()
    assert len(whole) == 25 and all(v[-2] == round(v[-1] / 2) for v in whole.values())
    monkeypatch.setattr(B, "ROWS", 16)
    monkeypatch.setattr(B, "AT_ONCE", 2)
    parts = run()
    assert set(parts) == set(whole)
    for k, v in whole.items():
        assert parts[k] == pytest.approx(v)


def test_the_sums_are_those_of_the_drawn_rows(spark):
    df = table(spark)
    drawn = G.bootstrap_weights(df, ["g"], ["id"], 4).toPandas()
    out = G.bootstrap_nested(df, ["g"], ["id"], "y", "a", "b", 4).collect()
    assert len(out) == 8
    for r in out:
        own = drawn[(drawn.g == r.g) & (drawn.boot_idx == r.boot_idx)]
        own = own.loc[own.index.repeat(own.weight.astype(int))]
        beta = np.linalg.lstsq(np.column_stack([np.ones(len(own)), own.a, own.b]), own.y, rcond=None)[0]
        assert len(own) == r.n_boot_rows and np.allclose([r.beta_x1_full, r.beta_x2], beta[1:])


@pytest.mark.parametrize("run", [R.bootstrap_nested, R.bootstrap_summary])
def test_no_draw_is_shuffled(spark, run):
    plan = run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "_draws" not in plan and "FlatMapCoGroups" not in plan


def test_the_suite_reads_and_sorts_its_table_once(spark):
    """Five analyses share one scan for rows; the other scans are for the sizes of groups."""
    plan = R.regression_suite(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "_draws" not in plan and plan.count("Relation [") <= 3 and plan.count("MapInArrow") == 1
