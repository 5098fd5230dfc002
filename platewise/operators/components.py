"""Principal components of feature arrays, by group and of all groups together.

Sums of the features and of their products are taken by group in one pass: a task sends one row of sums for each group of a batch, Spark
adds them up, and each group's small matrix of products gives its directions in a task of its own. No group's rows are
brought together, so a hot group costs no more than another.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def complete(features: str) -> Column:
    """Whether an array has entries, all of them finite."""
    return F.col(features).isNotNull() & (F.size(features) > 0) & F.forall(features, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def group_sums(rows: DataFrame, groups: list[str], features: str, shift: np.ndarray) -> DataFrame:
    """groups, and ``sums``: the number of rows, the features' sums and the upper triangle of their products' sums, all about ``shift``."""
    d, upper = len(shift), np.triu_indices(len(shift))
    schema = T.StructType([*(rows.schema[g] for g in groups), T.StructField("sums", T.ArrayType(T.DoubleType()))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(len(groups)).flatten(), float).reshape(-1, d) - shift
            table = pa.table([*batch.columns[: len(groups)], pa.array(np.arange(len(x)))], names=[*groups, "_row"])
            kinds = table.group_by(groups).aggregate([("_row", "list")])
            sums = []
            for at in kinds.column("_row_list").combine_chunks():
                own = x[at.values.to_numpy()]
                sums.append(np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own)[upper]]))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1) * (1 + d + len(upper[0])), pa.int32()), pa.array(np.concatenate(sums)))
            yield pa.RecordBatch.from_arrays([*(kinds.column(g).combine_chunks() for g in groups), flat], names=[*groups, "sums"])

    each = rows.select(*groups, F.transform(features, lambda v: v.cast("double")).alias(features)).mapInArrow(add, schema)
    places = each.select(*groups, F.posexplode("sums").alias("place", "value")).groupBy(*groups, "place").agg(F.sum("value").alias("value"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "value")))
    return places.groupBy(*groups).agg(F.transform(ordered, lambda p: p["value"]).alias("sums"))


def principal_components(df: DataFrame, groups: list[str], features: str, k: int = 2) -> DataFrame | None:
    """For each group: n, mean, loadings (``k`` directions, one after the other) and explained (their shares of the variance). A direction
    points where its largest loading is positive; directions beyond the features' number are zeros. Rows whose features are missing,
    incomplete or of another length than the first complete row's count for nothing; without any there is no result."""
    known = df.filter(complete(features))
    one = known.select(features).first()
    if one is None:
        return None
    shift = np.array(one[0], float)
    d = len(shift)
    schema = T.StructType([*(df.schema[g] for g in groups), T.StructField("n", T.LongType()), *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("mean", "loadings", "explained"))])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for sums in batch.column(len(groups)):
                s = sums.values.to_numpy()
                n, mean = s[0], s[1 : d + 1] / s[0]
                products = np.zeros((d, d))
                products[np.triu_indices(d)] = s[d + 1 :] / n
                products = products + np.triu(products, 1).T - np.outer(mean, mean)
                variance, turn = np.linalg.eigh(products)
                lead, turn = np.zeros(k), turn[:, ::-1][:, :k]
                lead[: turn.shape[1]] = np.maximum(variance[::-1][:k], 0)
                turn = turn * np.where(turn[np.abs(turn).argmax(axis=0), np.arange(turn.shape[1])] > 0, 1.0, -1.0)
                loadings = np.zeros((k, d))
                loadings[: turn.shape[1]] = turn.T
                total = max(float(np.trace(products)), 0.0)
                out.append((int(n), mean + shift, loadings.ravel(), lead / total if total else lead * 0))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = [pa.int64(), *[pa.list_(pa.float64())] * 3]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(groups)], *(pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True))], names=schema.names)

    return group_sums(known.filter(F.size(features) == d), groups, features, shift).mapInArrow(fit, schema)


def embedded(df: DataFrame, groups: list[str], features: str, k: int = 2, names: str = "pc") -> DataFrame:
    """Rows with ``pc1``, ``pc2``, ... of their group's components (null is a group of its own); null where the features are incomplete."""
    marked = df.withColumn("_all", F.lit(0))
    by = groups or ["_all"]
    found = principal_components(marked, by, features, k)
    empty = {f"{names}{i + 1}": F.lit(None).cast("double") for i in range(k)}
    if found is None:
        return df.withColumns(empty)
    own = found.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(by)], F.col("mean").alias("_mean"), F.col("loadings").alias("_loadings"))
    test = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(by)])
    d = F.size("_mean")
    away = F.zip_with(features, "_mean", lambda x, m: x.cast("double") - m)
    usable = complete(features) & (F.size(features) == d)
    score = lambda i: F.aggregate(F.zip_with("_away", F.slice("_loadings", i * d + 1, d), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    joined = marked.join(own, test, "left").withColumn("_away", F.when(usable, away))
    return joined.withColumns({f"{names}{i + 1}": score(i) for i in range(k)}).select(*df.columns, *empty)
