"""Nested least squares by group: how much a second variable adds to a first one, and its bootstrap.

Both models come from centred sums of squares and products, so a fit of any number of groups is one aggregation. A
bootstrap never copies rows: it counts how often each row is drawn and weights the same sums (``bootstrap.py``). Where the drawn rows
themselves are wanted, rows are numbered in a group and cut into blocks, and draws travel to the blocks as packed numbers, four bytes each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from platewise.operators.aggregate import small_group_bands
from platewise.operators.bootstrap import SUMS, Analysis, mixed, products, resampled_sums
from platewise.operators.relational import coerce_finite, is_missing
from platewise.operators.sampling import draw_order

#: Hex digits of the hash that numbers rows in two steps.
BUCKET_DIGITS = 3
#: Rows in a block of a group, draws of a resample made at a time, and resamples counted at a time.
BLOCK, DRAWS, BOOTS = 4096, 2048, 256
RESULT = ["beta_x1_restricted", "beta_x1_full", "beta_x2", "r2_restricted", "r2_full", "delta_r2", "partial_r2_x2", "cohen_f2_x2"]


def effect_sizes(df: DataFrame) -> DataFrame:
    """delta_r2, partial_r2_x2 and cohen_f2_x2 from the two coefficients of determination. Where these do not give the partial one,
    the sums of squared residuals do (columns ssr_restricted and ssr_full, if there); null where undefined."""
    re, fu = F.col("r2_restricted"), F.col("r2_full")
    delta = fu - re
    partial = F.when(re < 1, delta / F.nullif(1 - re, F.lit(0.0)))
    if {"ssr_restricted", "ssr_full"} <= set(df.columns):
        left = F.col("ssr_restricted")
        partial = F.coalesce(partial, F.when(left > 0, (left - F.col("ssr_full")) / left))
    return df.withColumns({"delta_r2": delta, "partial_r2_x2": partial, "cohen_f2_x2": F.when(fu < 1, delta / F.nullif(1 - fu, F.lit(0.0)))})


def complete_rows(df: DataFrame, groups: list[str], numeric: dict[str, str], level: str | None = None, keys: list[str] = ()) -> DataFrame:
    """What a fit can rest on: the groups, ``_k_<key>`` of the keys, numbers by new name, and ``level``, of the rows in which none of
    groups, numbers and level is missing or infinite. Text that is a number becomes one; other text counts as missing."""
    picked = df.select(*groups, *[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(n) for n, c in numeric.items()], *([F.col(level).alias("level")] if level else []))
    labels = [*groups, *(["level"] if level else [])]
    return coerce_finite(reduce(lambda d, c: d.filter(~is_missing(d, c)), labels, picked), list(numeric))


def _centred(df: DataFrame, groups: list[str], columns: list[str]) -> DataFrame:
    """Columns less their group's means, which stay as ``m_<column>``; sums are exact about any centre near them."""
    means = df.groupBy(*groups).agg(*[F.avg(c).alias(f"m_{c}") for c in columns])
    return df.join(means, groups).withColumns({c: F.col(c) - F.col(f"m_{c}") for c in columns})


def _sums(columns: list[str]) -> list[Column]:
    product = lambda cs: F.lit(1.0) if not cs else F.col(cs[0]) if len(cs) == 1 else F.col(cs[0]) * F.col(cs[1])
    return [F.sum(product(cs)).alias(name) for name, cs in products(columns).items()]


def _cross(a: str, b: str) -> Column:
    return F.col(f"s_{a}_{b}") - F.col(f"s_{a}") * F.col(f"s_{b}") / F.col("w")


def _ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def numeric_fit(s: DataFrame, groups: list[str], standardize: bool = False) -> DataFrame:
    """Both models from the sums of y, a and b about the centres m_y, m_a and m_b. With ``standardize`` a and b are taken as
    z-scores (population) of these very rows; a constant one is 0 then."""
    s = s.select(*groups, "w", *[(F.col(f"m_{c}") + F.col(f"s_{c}") / F.col("w")).alias(f"m_{c}") for c in "yab"], *[_cross(p, q).alias(p + q) for p, q in ("yy", "ya", "yb", "aa", "ab", "bb")])
    if standardize:
        z = {c: F.when(F.col(c + c) > 0, F.sqrt(F.col("w") / F.col(c + c))).otherwise(0.0) for c in "ab"}
        s = s.withColumns({"_za": z["a"], "_zb": z["b"]})
        za, zb = F.col("_za"), F.col("_zb")
        s = s.withColumns({"ya": F.col("ya") * za, "yb": F.col("yb") * zb, "ab": F.col("ab") * za * zb, "aa": F.col("aa") * za * za, "bb": F.col("bb") * zb * zb, "m_a": F.lit(0.0), "m_b": F.lit(0.0)})
    yy, ya, yb, aa, ab, bb = (F.col(c) for c in ("yy", "ya", "yb", "aa", "ab", "bb"))
    d = aa * bb - ab * ab
    singular = d <= 1e-12 * aa * bb
    beta, slope = _ratio(ya, aa), _ratio(ab, aa)
    offset, alpha = F.col("m_b") - slope * F.col("m_a"), F.col("m_y") - beta * F.col("m_a")
    # Where b is a linear function of a, the full model is the one of least norm, as a pseudo-inverse gives.
    least = (alpha * offset + beta * slope) / (offset * offset + slope * slope + 1)
    b2 = F.when(singular, least).otherwise((yb * aa - ya * ab) / d)
    b1 = F.when(singular, beta - least * slope).otherwise((ya * bb - yb * ab) / d)
    explained = F.coalesce(_ratio(ya * ya, aa), F.lit(0.0))
    more = F.when(aa == 0, F.coalesce(_ratio(yb * yb, bb), F.lit(0.0))).when(singular, explained).otherwise(((ya * bb - yb * ab) / d) * ya + ((yb * aa - ya * ab) / d) * yb)
    out = s.select(
        *groups, F.col("w").alias("n_rows"), beta.alias("beta_x1_restricted"), b1.alias("beta_x1_full"), b2.alias("beta_x2"), _ratio(explained, yy).alias("r2_restricted"), _ratio(more, yy).alias("r2_full"),
        (yy - explained).alias("ssr_restricted"), (yy - more).alias("ssr_full"),
    )
    return effect_sizes(out).drop("ssr_restricted", "ssr_full")


def _over_levels(by: DataFrame, groups: list[str], sums: list[str]) -> DataFrame:
    """The sums of each group, and of the squares and products of y and a within its levels."""
    within = [F.sum(_cross(p, q)).alias(f"in_{p}{q}") for p, q in ("yy", "ya", "aa")]
    return by.groupBy(*groups).agg(*within, *[F.sum(c).alias(c) for c in sums])


def categorical_fit(by: DataFrame, groups: list[str], standardize: bool = False) -> DataFrame:
    """Both models from the sums of y and a of each level: sums within levels give the full model; beta_x2 is null."""
    return level_fit(_over_levels(by, groups, ["w", "s_y", "s_a", "s_y_y", "s_y_a", "s_a_a"]), groups, standardize)


def level_fit(s: DataFrame, groups: list[str], standardize: bool = False) -> DataFrame:
    yy, ya, aa = _cross("y", "y"), _cross("y", "a"), _cross("a", "a")
    scale = F.sqrt(aa / F.col("w")) if standardize else F.lit(1.0)
    explained = F.coalesce(_ratio(ya * ya, aa), F.lit(0.0))
    left = F.col("in_yy") - F.coalesce(_ratio(F.col("in_ya") ** 2, F.col("in_aa")), F.lit(0.0))
    out = s.select(
        *groups, F.col("w").alias("n_rows"), (scale * _ratio(ya, aa)).alias("beta_x1_restricted"), (scale * _ratio(F.col("in_ya"), F.col("in_aa"))).alias("beta_x1_full"),
        F.lit(None).cast("double").alias("beta_x2"), _ratio(explained, yy).alias("r2_restricted"), (1 - _ratio(left, yy)).alias("r2_full"), (yy - explained).alias("ssr_restricted"), left.alias("ssr_full"),
    )
    return effect_sizes(out).drop("ssr_restricted", "ssr_full")


def nested_ols_numeric(df: DataFrame, groups: list[str], y: str = "y", x1: str = "x1", x2: str = "x2", standardize: bool = False) -> DataFrame:
    """y on x1, and y on x1 and x2, for each group, over its complete rows."""
    rows = complete_rows(df, groups, {"y": y, "a": x1, "b": x2})
    s = _centred(rows, groups, ["y", "a", "b"]).groupBy(*groups).agg(*_sums(["y", "a", "b"]), *[F.first(f"m_{c}").alias(f"m_{c}") for c in "yab"])
    return numeric_fit(s, groups, standardize)


def nested_ols_categorical(df: DataFrame, groups: list[str], y: str = "y", x1: str = "x1", x2: str = "x2", standardize: bool = False) -> DataFrame:
    """The same with a level of x2 as intercept."""
    rows = complete_rows(df, groups, {"y": y, "a": x1}, x2)
    return categorical_fit(_centred(rows, groups, ["y", "a"]).groupBy(*groups, "level").agg(*_sums(["y", "a"])), groups, standardize)


def numbered(df: DataFrame, groups: list[str], keys: list[str], seed: str) -> DataFrame:
    """Rows with ``idx`` (from 0, in hash order) and ``n`` of their group. Buckets of the hash are counted first, so rows are
    ranked inside a bucket and no group is one window."""
    rows = df.withColumn("_h", draw_order(seed, *keys)).withColumn("_b", F.substring("_h", 1, BUCKET_DIGITS))
    counts = rows.groupBy(*groups, "_b").agg(F.count("*").alias("_c"))
    by = Window.partitionBy(*groups)
    before = counts.withColumns({"_before": F.sum("_c").over(by.orderBy("_b")) - F.col("_c"), "n": F.sum("_c").over(by)}).drop("_c")
    inside = Window.partitionBy(*groups, "_b").orderBy("_h", *keys)
    return rows.join(before, [*groups, "_b"]).withColumn("idx", F.col("_before") + F.row_number().over(inside) - 1).drop("_h", "_b", "_before")


def group_sizes(df: DataFrame, groups: list[str], fraction: float | None) -> DataFrame:
    """n_group_rows, and n_boot_rows: a resample has ``max(2, round(fraction * n))`` rows, or all without a fraction."""
    n = F.count("*")
    return df.groupBy(*groups).agg(n.alias("n_group_rows"), (F.greatest(F.lit(2), F.bround(n * F.lit(fraction))).cast("long") if fraction else n).alias("n_boot_rows"))


def _draws(sizes: DataFrame, groups: list[str], n_boot: int, replace: bool, seed: str) -> DataFrame:
    """groups, block, draws: for every block of a group's rows, the draws that fall into it, as resample * BLOCK + place in the
    block. With replacement, each draw takes the row whose number is a hash of the draw under a key, the MD5 of seed, group and
    resample (52 bits, modulo the rows). Without it, a seeded generator deals a resample's rows to the blocks, and then picks
    them in each block."""
    n_units = F.floor((F.col("n_boot_rows") - 1) / DRAWS) + 1 if replace else F.lit(n_boot)
    units = sizes.select(*groups, "n_group_rows", "n_boot_rows", F.concat_ws("|", F.lit(seed), *[F.col(g).cast("string") for g in groups]).alias("_prefix"), F.explode(F.sequence(F.lit(0).cast("long"), n_units.cast("long") - 1)).alias("_unit"))
    schema = T.StructType([*(sizes.schema[g] for g in groups), T.StructField("_block", T.LongType()), T.StructField("_draws", T.BinaryType())])

    def by_hash(prefix: str, n: int, size: int, unit: int) -> tuple[np.ndarray, np.ndarray]:
        draw = mixed(np.arange(unit * DRAWS + 1, min((unit + 1) * DRAWS, size) + 1))
        rows = []
        for boot in range(n_boot):
            key = hashlib.md5(f"{prefix}|{boot}".encode()).hexdigest()
            high, low = (mixed(draw ^ int(key[k : k + 8], 16)) for k in (0, 8))
            rows.append(((high << 20) + (low >> 12)) % n)
        return np.concatenate(rows), np.repeat(np.arange(n_boot), len(draw))

    def by_deal(prefix: str, n: int, size: int, boot: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(list(hashlib.md5(f"{prefix}|{boot}".encode()).digest()))
        lengths = np.append(np.full((n - 1) // BLOCK, BLOCK), (n - 1) % BLOCK + 1)
        rows = [k * BLOCK + rng.choice(length, m, replace=False) for k, (length, m) in enumerate(zip(lengths, rng.multivariate_hypergeometric(lengths, size, method="marginals"), strict=True))]
        return np.concatenate(rows), np.full(size, boot)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                target, boot = (by_hash if replace else by_deal)(row["_prefix"], row["n_group_rows"], row["n_boot_rows"], row["_unit"])
                order = np.argsort(target // BLOCK, kind="stable")
                block, packed = (target // BLOCK)[order], (boot * BLOCK + target % BLOCK)[order].astype(np.uint32)
                cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
                parts = np.split(packed, cuts[1:])
                yield pd.DataFrame({**{g: [row[g]] * len(cuts) for g in groups}, "_block": block[cuts], "_draws": [x.tobytes() for x in parts]})

    return units.repartition(*groups, "_unit").mapInPandas(run, schema)


def resampled(rows: DataFrame, groups: list[str], keys: list[str], each: Callable[[pd.DataFrame, np.ndarray, int], pd.DataFrame], schema: T.StructType, n_boot: int, fraction: float | None, replace: bool, seed: str) -> DataFrame:
    """``each`` of every block of a group's rows and its counts (resamples, rows), for some resamples (from the given one) at
    a time; its result has the group's columns first."""
    placed = numbered(rows, groups, keys, seed).drop("n").withColumn("_block", F.floor(F.col("idx") / BLOCK)).withColumn("_at", (F.col("idx") % BLOCK).cast("int")).drop("idx")
    draws = _draws(group_sizes(rows, groups, fraction), groups, n_boot, replace, seed)

    def run(key: tuple, block: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        packed = np.concatenate([np.frombuffer(x, np.uint32) for x in drawn["_draws"]] or [np.zeros(0, np.uint32)])
        out = []
        for first in range(0, n_boot, BOOTS):
            some = packed[(packed >= first * BLOCK) & (packed < (first + BOOTS) * BLOCK)] - np.uint32(first * BLOCK)
            counts = np.bincount(some, minlength=min(BOOTS, n_boot - first) * BLOCK).reshape(-1, BLOCK)[:, block["_at"].to_numpy()]
            out.append(each(block, counts, first))
        found = pd.concat(out)
        for g, value in zip(groups, key, strict=False):
            found[g] = value
        return found[schema.names]

    by = [*groups, "_block"]
    return placed.groupBy(*by).cogroup(draws.groupBy(*by)).applyInPandas(run, schema)


def bootstrap_weights(df: DataFrame, groups: list[str], keys: list[str], n_boot: int, fraction: float | None = 0.5, replace: bool = True, seed: str = "0") -> DataFrame:
    """Rows with boot_idx, weight (how often the resample holds the row), n_boot_rows and n_group_rows, for rows that it holds."""
    schema = T.StructType([*df.schema.fields, T.StructField("boot_idx", T.IntegerType()), T.StructField("weight", T.DoubleType())])

    def each(block: pd.DataFrame, counts: np.ndarray, first: int) -> pd.DataFrame:
        boot, at = np.nonzero(counts)
        return block.iloc[at].assign(boot_idx=boot + first, weight=counts[boot, at].astype(float))

    return resampled(df, groups, keys, each, schema, n_boot, fraction, replace, seed).join(group_sizes(df, groups, fraction), groups)


def bootstrap_nested(df: DataFrame, groups: list[str], keys: list[str], y: str, x1: str, x2: str, n_boot: int = 300, fraction: float | None = 0.5, categorical: bool = False, least: int = 25, replace: bool = True, seed: str = "0", most: int | None = None, standardize: bool = False) -> DataFrame:
    """One row for each group of at least ``least`` complete rows and each resample; ``most`` caps a group's rows (a draw). With
    ``standardize`` x1 (and a numeric x2) are z-scores within each resample."""
    if most:
        # Keys have names of their own, as they may be among the numbers.
        df, keys = complete_rows(df, groups, {"y": y, "a": x1} | ({} if categorical else {"b": x2}), x2 if categorical else None, keys), [f"_k_{k}" for k in keys]
        df = numbered(df, groups, keys, f"{seed}|cap").filter(F.col("idx") < most).drop("idx", "n")
        y, x1, x2 = "y", "a", "level" if categorical else "b"
    one = Analysis("", tuple(groups), y, x1, x2, categorical)
    return bootstrap_analyses(df, keys, [one], n_boot, fraction, least, replace, seed, standardize).drop("analysis")


def bootstrap_analyses(df: DataFrame, keys: list[str], analyses: list[Analysis], n_boot: int = 300, fraction: float | None = 0.5, least: int = 25, replace: bool = True, seed: str = "0", standardize: bool = False) -> DataFrame:
    """The same for several analyses of one table, named by ``analysis``: rows are sorted once, and analyses of the same rows and groups
    share their draws. Groups that are not an analysis' own are null."""
    sums, sizes = resampled_sums(df, keys, analyses, n_boot, fraction, least, replace, seed)
    groups = [c for c in sizes.columns if c not in ("_a", "n_group_rows", "n_boot_rows", "m_y", "m_a", "m_b")]
    names = {c: f"_of_{c}" for c in ("_a", *groups)}
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(k)) for c, k in names.items()])
    s = _over_levels(sums, ["_a", *groups, "boot_idx"], SUMS).join(sizes.withColumnsRenamed(names), same).drop(*names.values())
    by = ["_a", *groups, "boot_idx", "n_boot_rows", "n_group_rows"]
    is_level = F.element_at(F.array(*[F.lit(a.categorical) for a in analyses]), F.col("_a") + 1)
    name = F.element_at(F.array(*[F.lit(a.name) for a in analyses]), F.col("_a") + 1)
    kinds = {a.categorical for a in analyses}
    out = _either(s, by, is_level, standardize) if len(kinds) == 2 else (level_fit if True in kinds else numeric_fit)(s, by, standardize)
    return out.select(name.alias("analysis"), *groups, "boot_idx", *RESULT, "n_boot_rows", "n_group_rows")


def _either(s: DataFrame, by: list[str], is_level: Column, standardize: bool) -> DataFrame:
    """Both fits of each row, and that of its kind, so that the resamples are made once."""
    kept = [c for c in s.columns if c not in by]
    fields = F.struct(*kept).alias("_s")
    numeric = numeric_fit(s.select(*by, fields, *kept), [*by, "_s"], standardize).select(*by, "_s", F.struct(*RESULT).alias("_numeric"))
    level = level_fit(numeric.select(*by, "_numeric", "_s.*"), [*by, "_numeric"], standardize)
    return level.select(*by, *[F.when(is_level, F.col(c)).otherwise(F.col(f"_numeric.{c}")).alias(c) for c in RESULT])


def bootstrap_summary(boot: DataFrame, groups: list[str], columns: tuple[str, ...] = ("r2_restricted", "partial_r2_x2")) -> DataFrame:
    """Mean and 2.5 to 97.5 % band of each group's resamples. A group has as many rows as there are resamples, so its quantiles are taken
    in the one aggregation that reads them."""
    return small_group_bands(boot, groups, list(columns))


def standardized(df: DataFrame, groups: list[str], columns: list[str]) -> DataFrame:
    """Population z-scores within each group; a constant column becomes 0."""
    moments = df.groupBy(*groups).agg(*[x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    out = df.join(moments, groups)
    z = lambda c: F.coalesce((F.col(c) - F.col(f"_m_{c}")) / F.nullif(f"_s_{c}", F.lit(0.0)), F.lit(0.0))
    return out.withColumns({c: z(c) for c in columns}).drop(*[f"_{k}_{c}" for c in columns for k in "ms"])


def confound_curve(spark: SparkSession, shares: tuple[float, ...] = (1.0, 0.5, 0.1), points: int = 200) -> DataFrame:
    """The curves ``y = c * x / (1 - x)``, on which the second variable adds a share ``c`` of what the first explains: share, x, y at
    evenly spaced x from 0 to below ``1 / (1 + c)``, where y is 1."""
    c = F.col("share")
    grid = spark.createDataFrame([(s,) for s in shares], "share double").select("share", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    x = F.col("i") / F.lit(points) / (1 + c)
    return grid.select("share", x.alias("x"), (c * x / (1 - x)).alias("y"))


def confound_band(x: Column, y: Column, shares: tuple[float, ...] = (1.0, 0.5, 0.1)) -> Column:
    """Which band between the curves ``y = c * x / (1 - x)`` a point (restricted, partial) lies in."""
    curve = lambda c: F.lit(c) * x / F.nullif(1 - x, F.lit(0.0))
    return F.when(y <= curve(shares[2]), "<=10%").when(y <= curve(shares[1]), "10-50%").when(y <= curve(shares[0]), "50-100%").otherwise(">100%")
