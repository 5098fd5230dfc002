"""Components by group against numpy, and table functions with any number of rows."""

from __future__ import annotations

import numpy as np
import pytest

from platewise.operators import components as C
from platewise.operators import surface as U


def by_hand(x: np.ndarray, k: int = 2) -> np.ndarray:
    c = x - x.mean(axis=0)
    _, _, v = np.linalg.svd(c, full_matrices=False)
    v = v[:k] * np.where(v[:k][np.arange(k), np.abs(v[:k]).argmax(axis=1)] > 0, 1, -1)[:, None]
    return c @ v.T


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_components_by_plate_and_merged(spark, offset):
    rng = np.random.default_rng(1)
    turn = rng.standard_normal((3, 6, 6))
    plate = rng.choice(3, 900, p=[0.8, 0.15, 0.05])
    x = np.einsum("ni,nij->nj", rng.standard_normal((900, 6)) * [5, 3, 1, 0.5, 0.2, 0.1], turn[plate]) + offset
    names = ["hot", None, "c"]
    df = spark.createDataFrame([(i, names[plate[i]], x[i].tolist()) for i in range(900)], "id int, plate string, f array<double>").repartition(5)
    out = C.embedded(C.embedded(df, [], "f"), ["plate"], "f", names="own").orderBy("id").toPandas()
    assert np.abs(out[["pc1", "pc2"]].to_numpy() - by_hand(x)).max() < 1e-6 * max(1, offset / 1e3)
    for p in range(3):
        got = out[["own1", "own2"]].to_numpy()[plate == p]
        assert np.abs(got - by_hand(x[plate == p])).max() < 1e-6 * max(1, offset / 1e3)
    shares = {r.plate: (r.n, sum(r.explained)) for r in C.principal_components(df, ["plate"], "f").collect()}
    assert {k: v[0] for k, v in shares.items()} == {names[p]: int((plate == p).sum()) for p in range(3)} and all(0.8 < v[1] <= 1 for v in shares.values())


def test_incomplete_features(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 4.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [1.0]), (7, []), (8, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "id int, f array<double>")
    out = {r.id: r for r in C.embedded(df, [], "f").collect()}
    assert len(out) == 8 and out[1].pc1 == pytest.approx(-(2**0.5)) and out[2].pc1 == pytest.approx(2**0.5) and abs(out[2].pc2) < 1e-12
    assert all(out[i].pc1 is None for i in range(3, 9))
    none = C.embedded(df.filter("id > 2 and id < 6"), [], "f")
    assert none.columns == ["id", "f", "pc1", "pc2"] and none.filter("pc1 is not null").count() == 0


def test_more_components_than_features(spark):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(4)], "id int, f array<double>")
    rows = C.embedded(df, [], "f", 2).orderBy("id").collect()
    assert [r.pc1 for r in rows] == pytest.approx([-1.5, -0.5, 0.5, 1.5]) and {r.pc2 for r in rows} == {0.0}


def test_any_number_of_variants(spark):
    df = spark.createDataFrame([(1, []), (2, [1.0]), (3, [1.0, 2.0, 3.0]), (4, None)], "image_id int, pixels array<double>")
    hook = lambda image: ((f"v{k}", image * k) for k in range(len(image)))
    got = sorted((r.image_id, r.variant, r.out) for r in U.variants_by(df, hook, ["image_id"]).collect())
    assert got == [(2, "v0", [0.0]), (3, "v0", [0.0] * 3), (3, "v1", [1.0, 2.0, 3.0]), (3, "v2", [2.0, 4.0, 6.0])]
