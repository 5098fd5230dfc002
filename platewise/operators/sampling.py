"""Reproducible draws: rows are ordered by a hash of a seed and their key, whatever the partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from platewise.operators.relational import filter_condition_map


def draw_order(seed: str, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys]))


def sample_per_group(df: DataFrame, groups: list[str], keys: list[str], n: int | Column, seed: str = "0", on_short: str = "take_all") -> DataFrame:
    """``n`` rows of each group; a group with fewer is taken whole, or is an error with ``on_short='error'``."""
    if on_short == "error":
        short = df.groupBy(*groups).agg(F.count("*").alias("n")).filter(F.col("n") < n)
        if not short.isEmpty():
            raise ValueError(f"groups with fewer than {n} rows: {short.limit(5).collect()}")
    return least_hashes(df, groups, keys, n, seed)


#: Numbers of rows up to which Spark keeps the first rows of each task before it shuffles, and hex digits that deal a group's rows to buckets.
FEW, BUCKET_DIGITS = 1000, 3


def least_hashes(df: DataFrame, groups: list[str], keys: list[str], n: int | Column, seed: str = "0") -> DataFrame:
    """The ``n`` rows of each group (null is a group) whose hashes of the keys are least; ties in the order of the keys. ``n`` may be a column
    that is the same in all rows of a group.

    Where ``n`` is a small number, each task keeps its own least rows before the shuffle. Otherwise rows are counted by bucket of the hash: a bucket
    is taken whole, in part or not at all, rows of buckets that are not taken are never shuffled, and a window ranks one bucket of a group."""
    own = draw_order(seed, *keys)
    if isinstance(n, int) and n <= FEW:
        rank = F.row_number().over(Window.partitionBy(*groups).orderBy(own, *keys))
        return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
    names = {g: f"_group{i}" for i, g in enumerate(groups)}
    rows = df.withColumns({"_h": own, "_n": F.lit(n).cast("long") if isinstance(n, int) else n.cast("long")}).withColumn("_bucket", F.substring("_h", 1, BUCKET_DIGITS))
    counts = rows.groupBy(*groups, "_bucket").agg(F.count("*").alias("_c"), F.max("_n").alias("_most"))
    before = F.sum("_c").over(Window.partitionBy(*groups).orderBy("_bucket")) - F.col("_c")
    open_ = counts.withColumn("_left", F.col("_most") - before).filter(F.col("_left") > 0)
    open_ = open_.select(*[F.col(g).alias(k) for g, k in names.items()], F.col("_bucket").alias("_b"), F.least("_left", "_c").alias("_left"))
    test = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(k)) for g, k in names.items()], F.col("_bucket") == F.col("_b"))
    rank = F.row_number().over(Window.partitionBy(*groups, "_bucket").orderBy("_h", *keys))
    return rows.join(open_, test).withColumn("_rank", rank).filter(F.col("_rank") <= F.col("_left")).drop("_h", "_n", "_bucket", "_b", "_left", "_rank", *names.values())


def two_level_quota(df: DataFrame, top: str, outer: str, inner: str, keys: list[str], total: int, seed: str = "0") -> DataFrame:
    """About ``total`` rows of each ``top``: shared evenly among its ``outer`` values, then among their ``inner`` ones."""
    outers = df.groupBy(top).agg(F.countDistinct(outer).alias("_outers"))
    inners = df.groupBy(top, outer).agg(F.countDistinct(inner).alias("_inners"))
    quota = F.floor(F.floor(F.lit(total) / F.col("_outers")) / F.col("_inners"))
    rows = df.join(outers, top).join(inners, [top, outer])
    return sample_per_group(rows.withColumn("_quota", quota), [top, outer, inner], keys, F.col("_quota"), seed).drop("_quota", "_outers", "_inners")


def holdout_one_unit(df: DataFrame, condition: list[str], unit: str, seed: str = "0") -> DataFrame:
    """Marks rows of one unit of each condition, drawn from its distinct units, as ``held_out``."""
    units = df.select(*condition, unit).dropna().distinct()
    chosen = sample_per_group(units, condition, [*condition, unit], 1, seed).withColumn("held_out", F.lit(True))
    return df.join(chosen, [*condition, unit], "left").fillna(False, ["held_out"])


def sample_n(df: DataFrame, keys: list[str], n: int, seed: str = "0") -> DataFrame:
    return df.orderBy(draw_order(seed, *keys), *keys).limit(n)


def pick_even_levels(df: DataFrame, groups: list[str], level: str, n: int) -> DataFrame:
    """At most ``n`` levels of each group, evenly spaced over its sorted levels (places are rounded half to even)."""
    levels = df.select(*groups, level).distinct()
    ranked = levels.withColumn("_at", F.row_number().over(Window.partitionBy(*groups).orderBy(level)) - 1)
    last = ranked.groupBy(*groups).agg(F.max("_at").alias("_last"))
    place = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * F.col("_last") / F.lit(max(1, n - 1))).cast("int"))
    keep = F.when(F.col("_last") + 1 <= n, F.lit(True)).otherwise(F.array_contains(place, F.col("_at")))
    return ranked.join(last, groups).filter(keep).select(*groups, level)


def exploration_set(df: DataFrame, conditions: dict[str, object], unit: str, level: str, value: str, n: int, seed: str = "0") -> DataFrame:
    """Of the rows that satisfy the conditions one original (``unit``, drawn by hash) with at most ``n`` of its levels, evenly spaced
    and sorted, and for each the lowest and highest ``value``, the limits of its gray scale. Rows without unit or level count for nothing."""
    rows = filter_condition_map(df, conditions).dropna(subset=[unit, level])
    chosen = rows.select(unit).distinct().orderBy(draw_order(seed, unit), unit).limit(1)
    own = rows.join(chosen, unit, "left_semi")
    limits = own.groupBy(unit, level).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return pick_even_levels(own, [unit], level, n).join(limits, [unit, level]).orderBy(level)


def latest_artifact(df: DataFrame, run: str, name: str) -> DataFrame:
    """One artifact of each run: names with generator before model before best; among those one with ``best``, else the
    largest trailing number."""
    lower = F.lower(name)
    priority = F.when(lower.contains("generator"), 0).when(lower.contains("model"), 1).when(lower.contains("best"), 2)
    epoch = F.regexp_extract(F.col(name), r"_(\d+)(?:\.[^.]*)?$", 1).try_cast("long")
    order = Window.partitionBy(run).orderBy(priority, F.desc(lower.contains("best")), F.desc_nulls_last(epoch), name)
    return df.filter(priority.isNotNull()).withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")
