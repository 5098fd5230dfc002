"""Aggregates over groups: moments, quantile bands, outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from platewise.operators.relational import is_missing

#: Accuracy of a quantile's estimate: it decides how many rows the exact step sorts, never the result.
ACCURACY = 10_000

#: Groups whose estimates are broadcast to their rows (some 100 bytes a group); more are joined by shuffling.
BROADCAST_GROUPS = 20_000


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Joined to one row of each group, null keys too; without keys to the only row."""
    names = {k: f"_key{i}" for i, k in enumerate(keys)}
    test = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return left.join(right.withColumnsRenamed(names), test, how).drop(*names.values()) if keys else left.crossJoin(right)


def exact_quantiles(df: DataFrame, keys: list[str], column: str, probabilities: list[float]) -> DataFrame:
    """For each group with values, interpolated quantiles ``_q0``, ``_q1``, ... (without keys one row, of nulls if there is no value).

    Estimates enclose each quantile; values below count in one number, values between one by one, as ranks. So no buffer holds the
    values of a group, and a window sorts some 4 / ``ACCURACY`` of them (all those of groups of up to 4 * ``ACCURACY`` rows). Estimates
    are read first; those of few groups are broadcast, so the rows of a hot group stay where they are until they are counted."""
    known = df.select(*keys, F.col(column).alias("_v")).filter(~is_missing(df, column))
    slack = 2 / ACCURACY
    asked = [min(max(p + s, 0.0), 1.0) for p in probabilities for s in (-slack, slack)]
    bounds = known.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_v", asked, ACCURACY).alias("_b"))
    few = bounds.limit(BROADCAST_GROUPS + 1).collect()
    if len(few) <= BROADCAST_GROUPS:
        bounds = F.broadcast(df.sparkSession.createDataFrame(few, bounds.schema))
    each = [F.struct(F.lit(i).alias("_i"), F.lit(float(p)).alias("_p"), F.get("_b", F.lit(2 * i)).alias("_low"), F.get("_b", F.lit(2 * i + 1)).alias("_high")) for i, p in enumerate(probabilities)]
    rows = _joined(known, bounds, keys, "inner").select(*keys, "_v", "_n", F.inline(F.array(*each)))
    small = F.col("_n") <= 4 * ACCURACY
    between = F.when(small | (F.col("_v") >= F.col("_low")), F.col("_v"))
    counts = rows.filter(small | (F.col("_v") <= F.col("_high"))).groupBy(*keys, "_i", "_p", "_n", between.alias("_v")).agg(F.count("*").alias("_c"))
    ranked = counts.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys, "_i").orderBy(F.asc_nulls_first("_v"))))
    at = F.col("_p") * (F.col("_n") - 1)
    value_at = lambda place: F.min(F.when(F.col("_upto") > place, F.col("_v").cast("double")))
    found = ranked.groupBy(*keys, "_i", "_p", "_n").agg(value_at(F.floor(at)).alias("_lower"), value_at(F.ceil(at)).alias("_upper"))
    value = F.when(F.floor(at) == F.ceil(at), F.col("_lower")).otherwise((F.ceil(at) - at) * F.col("_lower") + (at - F.floor(at)) * F.col("_upper"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, value)).alias(f"_q{i}") for i in range(len(probabilities))])


def mean_quantile_band(df: DataFrame, keys: list[str], columns: list[str], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """For each group and column: mean, interpolated low and high quantile, and their distances from the mean. Missing values (NULL or NaN)
    count for nothing."""
    out = df.groupBy(*keys).agg(*[F.avg(F.when(~is_missing(df, c), F.col(c))).alias(f"{c}_mean") for c in columns])
    for c in columns:
        out = _joined(out, exact_quantiles(df, keys, c, [low, high]), keys, "left").withColumnsRenamed({"_q0": f"{c}_low", "_q1": f"{c}_high"})
    return _distances(out, columns)


def _distances(bands: DataFrame, columns: list[str]) -> DataFrame:
    return bands.withColumns({k: v for c in columns for k, v in ((f"{c}_minus", F.col(f"{c}_mean") - F.col(f"{c}_low")), (f"{c}_plus", F.col(f"{c}_high") - F.col(f"{c}_mean")))})


def small_group_bands(df: DataFrame, keys: list[str], columns: list[str], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """The same in one aggregation of all columns, whose buffers hold a group's values: for groups whose size has a known bound."""
    known = {c: F.when(~is_missing(df, c), F.col(c)) for c in columns}
    found = df.groupBy(*keys).agg(*[x for c, v in known.items() for x in (F.avg(v).alias(f"{c}_mean"), F.percentile(v, [low, high]).alias(f"_{c}"))])
    out = found.select(*keys, *[x for c in columns for x in (f"{c}_mean", F.get(f"_{c}", F.lit(0)).alias(f"{c}_low"), F.get(f"_{c}", F.lit(1)).alias(f"{c}_high"))])
    return _distances(out, columns)


def min_group_filter(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows of groups with at least ``least`` rows. Group sizes join back, so a large group is never one window."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).drop("_n")
    return df.join(sizes, keys, "left_semi")


def column_summary(df: DataFrame, column: str) -> DataFrame:
    """Minimum, quartiles, mean and maximum."""
    out = df.agg(F.min(column).alias("min"), F.avg(column).alias("mean"), F.max(column).alias("max")).crossJoin(exact_quantiles(df, [], column, [0.25, 0.5, 0.75]))
    return out.select("min", F.col("_q0").alias("q1"), F.col("_q1").alias("median"), "mean", F.col("_q2").alias("q3"), "max")


def zscore_outliers(df: DataFrame, column: str, threshold: float) -> DataFrame:
    """Rows whose z-score over the whole table is beyond the threshold. The two moments are one row, read first, so no
    window gathers the table; a missing value makes every z-score undefined, so there are no outliers then."""
    missing = F.count(F.when(F.col(column).isNull() | F.isnan(column), 1))
    mean, std, gaps = df.agg(F.avg(column), F.stddev_pop(column), missing).first()
    if gaps or mean is None or not std:
        return df.limit(0)
    return df.filter(F.abs((F.col(column) - F.lit(mean)) / F.lit(std)) > threshold)


def first_known(column: str, order: Column | str) -> Column:
    """The first value that is not null, in an explicit order."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.col(order) if isinstance(order, str) else order))


def rank_in_group(keys: list[str], *order: Column | str) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
