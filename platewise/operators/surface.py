"""User-supplied transforms and metrics over image arrays, as Arrow-batched functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Transform = Callable[[np.ndarray, int], np.ndarray]
PairMetric = Callable[[np.ndarray, np.ndarray], float]


def transform_udf(f: Transform) -> Callable[[Column, Column], Column]:
    """A user's transform of (pixels, seed) as a column function."""

    @F.pandas_udf("array<double>")
    def apply(pixels: pd.Series, seed: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(f(np.asarray(p, dtype=float), int(s))) for p, s in zip(pixels, seed, strict=True)])

    return apply


def metric_udf(f: PairMetric) -> Callable[[Column, Column], Column]:
    """A user's metric of two images as a column function."""

    @F.pandas_udf("double")
    def apply(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([float(f(np.asarray(a), np.asarray(b))) for a, b in zip(x, y, strict=True)])

    return apply


def variants(df: DataFrame, levels: dict[str, Column]) -> DataFrame:
    """One row for each image and named variant of its pixels."""
    rows = F.array(*[F.struct(F.lit(k).alias("variant"), v.alias("out")) for k, v in levels.items()])
    return df.select("image_id", F.inline(rows))


def variants_by(df: DataFrame, hook: Callable[[np.ndarray], Iterable[tuple[str, np.ndarray]]], keep: list[str], pixels: str = "pixels") -> DataFrame:
    """``keep`` columns, variant and out of every variant that a user's hook makes of an image, as a table function in a lateral join: an image may have
    none, one or many. A null image has none."""

    class Variants:
        def eval(self, image: list | None) -> Iterator[tuple[str, list[float]]]:
            if image is not None:
                for name, out in hook(np.asarray(image, dtype=float)):
                    yield str(name), [float(x) for x in np.asarray(out).ravel()]

    made = F.udtf(Variants, returnType="variant string, out array<double>")
    return df.lateralJoin(made(F.col(pixels).outer())).select(*keep, "variant", "out")


def with_hooks(df: DataFrame, *hooks: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """User functions from table to table, applied in order."""
    for hook in hooks:
        df = df.transform(hook)
    return df
