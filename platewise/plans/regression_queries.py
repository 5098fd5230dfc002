"""Queries of nested regression and its bootstrap, over line items as metric rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.operators import regression as G
from platewise.operators.bootstrap import Analysis
from platewise.operators.components import embedded
from platewise.plans.registry import query, table

#: Resamples of every bootstrap.
N_BOOT = 300
GROUPS = ["l_returnflag", "l_linestatus"]
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
KEY_SQL = "concat_ws('|', '0', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"

_FULL = """(CASE WHEN aa * bb - ab * ab <= 1e-12 * aa * bb THEN ya * ya / (aa * yy) ELSE ((ya * bb - yb * ab) * ya + (yb * aa - ya * ab) * yb) / (aa * bb - ab * ab) / yy END)"""


def _numeric_sql(moments: str, keys: str) -> str:
    """Both models from the moments of each group, in round numbers: slopes to 4 places, as sums in another order differ beyond."""
    return f"""SELECT {keys}, round(ya / aa, 4) AS beta_x1_restricted, round((ya * bb - yb * ab) / (aa * bb - ab * ab), 4) AS beta_x1_full,
  round((yb * aa - ya * ab) / (aa * bb - ab * ab), 4) AS beta_x2, round(ya * ya / (aa * yy), 8) AS r2_restricted, round({_FULL}, 8) AS r2_full FROM ({moments})"""


_MOMENTS = """SELECT l_returnflag, l_linestatus, regr_sxx(l_extendedprice, l_quantity) AS aa, regr_sxx(l_extendedprice, l_discount) AS bb, regr_syy(l_extendedprice, l_quantity) AS yy,
  regr_sxy(l_extendedprice, l_quantity) AS ya, regr_sxy(l_extendedprice, l_discount) AS yb, regr_sxy(l_quantity, l_discount) AS ab FROM lineitem GROUP BY 1, 2"""


def _rounded(df, keys):
    return df.select(*keys, *[F.round(c, 4).alias(c) for c in ("beta_x1_restricted", "beta_x1_full", "beta_x2")], *[F.round(c, 8).alias(c) for c in ("r2_restricted", "r2_full")])


def _fit(spark, d):
    return G.nested_ols_numeric(table(spark, d, "lineitem"), GROUPS, "l_extendedprice", "l_quantity", "l_discount")


@query("nested_ols_numeric", _numeric_sql(_MOMENTS, "l_returnflag, l_linestatus"))
def nested_ols_numeric(spark, d):
    return _rounded(_fit(spark, d), GROUPS)


_CATEGORICAL = """WITH c AS (SELECT l_returnflag, l_linestatus, regr_sxx(l_extendedprice, l_quantity) AS aa, regr_syy(l_extendedprice, l_quantity) AS yy, regr_sxy(l_extendedprice, l_quantity) AS ya
    FROM lineitem GROUP BY 1, 2),
  l AS (SELECT l_returnflag, l_linestatus, p_brand, regr_sxx(l_extendedprice, l_quantity) AS aa, regr_syy(l_extendedprice, l_quantity) AS yy, regr_sxy(l_extendedprice, l_quantity) AS ya
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
  i AS (SELECT l_returnflag, l_linestatus, sum(aa) AS aa, sum(yy) AS yy, sum(ya) AS ya FROM l GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, round(c.ya / c.aa, 4) AS beta_x1_restricted, round(i.ya / i.aa, 4) AS beta_x1_full, round(c.ya * c.ya / (c.aa * c.yy), 8) AS r2_restricted,
  round(1 - (i.yy - i.ya * i.ya / i.aa) / c.yy, 8) AS r2_full FROM c JOIN i USING (l_returnflag, l_linestatus)"""


@query("nested_ols_categorical", _CATEGORICAL)
def nested_ols_categorical(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return _rounded(G.nested_ols_categorical(rows, GROUPS, "l_extendedprice", "l_quantity", "p_brand"), GROUPS).drop("beta_x2")


@query("effect_sizes", f"""SELECT l_returnflag, l_linestatus, round(f - r, 8) AS delta_r2, round((f - r) / (1 - r), 8) AS partial_r2_x2, round((f - r) / (1 - f), 8) AS cohen_f2_x2
  FROM (SELECT *, ya * ya / (aa * yy) AS r, {_FULL} AS f FROM ({_MOMENTS}))""")  # fmt: skip
def effect_sizes(spark, d):
    return _fit(spark, d).select(*GROUPS, *[F.round(c, 8).alias(c) for c in ("delta_r2", "partial_r2_x2", "cohen_f2_x2")])


def _mixed_sql(source: str, *columns: str) -> str:
    """Three layers of a query that hash 32-bit columns as the library does."""
    for _ in range(2):
        source = f"SELECT * REPLACE ({', '.join(f'(xor({c}, {c} >> 16) * 73244475) & 4294967295 AS {c}' for c in columns)}) FROM ({source})"
    return f"SELECT * REPLACE ({', '.join(f'xor({c}, {c} >> 16) AS {c}' for c in columns)}) FROM ({source})"


def _boot_moments(n_boot: int) -> str:
    """Moments of resamples, drawn as the library draws them."""
    draws = _mixed_sql("SELECT l_returnflag, l_linestatus, n, idx + 1 AS x FROM s WHERE idx < size", "x")
    keyed = _mixed_sql("SELECT l_returnflag, l_linestatus, boot_idx, n, xor(x, ('0x' || substr(h, 1, 8))::BIGINT) AS hi, xor(x, ('0x' || substr(h, 9, 8))::BIGINT) AS lo FROM d JOIN m USING (l_returnflag, l_linestatus)", "hi", "lo")
    return f"""SELECT l_returnflag, l_linestatus, boot_idx, n, size, sum(w) AS sw,
    sum(w * a * a) - sum(w * a) * sum(w * a) / sum(w) AS aa, sum(w * b * b) - sum(w * b) * sum(w * b) / sum(w) AS bb, sum(w * y * y) - sum(w * y) * sum(w * y) / sum(w) AS yy,
    sum(w * y * a) - sum(w * y) * sum(w * a) / sum(w) AS ya, sum(w * y * b) - sum(w * y) * sum(w * b) / sum(w) AS yb, sum(w * a * b) - sum(w * a) * sum(w * b) / sum(w) AS ab
  FROM (
    WITH r AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS y, l_quantity AS a, l_discount AS b, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n,
        row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY md5({KEY_SQL}), l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS idx FROM lineitem),
      s AS (SELECT *, greatest(2, round_even(n * 0.5::DOUBLE, 0))::BIGINT AS size FROM r),
      d AS ({draws}),
      m AS (SELECT l_returnflag, l_linestatus, boot_idx, md5(concat_ws('|', '0', l_returnflag, l_linestatus, boot_idx)) AS h
        FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM s), range(0, {n_boot}) b(boot_idx)),
      k AS (SELECT l_returnflag, l_linestatus, boot_idx, (hi * 1048576 + (lo >> 12)) % n AS idx, count(*)::DOUBLE AS w FROM ({keyed}) GROUP BY 1, 2, 3, 4)
    SELECT s.l_returnflag, s.l_linestatus, boot_idx::INT AS boot_idx, n, size, y - avg(y) OVER g AS y, a - avg(a) OVER g AS a, b - avg(b) OVER g AS b, w
    FROM s JOIN k USING (l_returnflag, l_linestatus, idx) WINDOW g AS (PARTITION BY l_returnflag, l_linestatus)
  ) GROUP BY 1, 2, 3, 4, 5"""


def _boot(spark, d):
    return G.bootstrap_nested(table(spark, d, "lineitem"), GROUPS, KEYS, "l_extendedprice", "l_quantity", "l_discount", N_BOOT)


@query("bootstrap_nested", f"SELECT *, (SELECT 1) AS one FROM ({_numeric_sql(_boot_moments(N_BOOT), 'l_returnflag, l_linestatus, boot_idx, size AS n_boot_rows, n AS n_group_rows')})")
def bootstrap_nested(spark, d):
    return _rounded(_boot(spark, d), [*GROUPS, "boot_idx", "n_boot_rows", "n_group_rows"]).withColumn("one", F.lit(1))


@query("standardize_in_group", """SELECT l_returnflag, l_linestatus, round(sum(z * z), 4) AS zz, round(max(z), 6) AS top FROM (SELECT l_returnflag, l_linestatus,
  (l_quantity - avg(l_quantity) OVER w) / stddev_pop(l_quantity) OVER w AS z FROM lineitem WINDOW w AS (PARTITION BY l_returnflag, l_linestatus)) GROUP BY 1, 2""")  # fmt: skip
def standardize_in_group(spark, d):
    rows = G.standardized(table(spark, d, "lineitem"), GROUPS, ["l_quantity"])
    return rows.groupBy(*GROUPS).agg(F.round(F.sum(F.col("l_quantity") ** 2), 4).alias("zz"), F.round(F.max("l_quantity"), 6).alias("top"))


@query("bootstrap_summary", f"""WITH b AS (SELECT l_returnflag, l_linestatus, ya * ya / (aa * yy) AS r, {_FULL} AS f FROM ({_boot_moments(N_BOOT)}))
  SELECT l_returnflag, l_linestatus, round(avg(r), 8) AS mean, round(quantile_cont(r, 0.025), 8) AS low, round(quantile_cont(r, 0.975), 8) AS high,
    round(avg((f - r) / (1 - r)), 8) AS partial FROM b GROUP BY 1, 2""")  # fmt: skip
def bootstrap_summary(spark, d):
    s = G.bootstrap_summary(_boot(spark, d), GROUPS)
    return s.select(*GROUPS, F.round("r2_restricted_mean", 8).alias("mean"), F.round("r2_restricted_low", 8).alias("low"), F.round("r2_restricted_high", 8).alias("high"), F.round("partial_r2_x2_mean", 8).alias("partial"))


@query("confound_bands", """WITH s(share, name) AS (VALUES (1.0::DOUBLE, '>100%'), (0.5::DOUBLE, '50-100%'), (0.1::DOUBLE, '10-50%')),
  b AS (SELECT CASE WHEN y <= 0.1 * x / nullif(1 - x, 0) THEN '<=10%' WHEN y <= 0.5 * x / nullif(1 - x, 0) THEN '10-50%' WHEN y <= x / nullif(1 - x, 0) THEN '50-100%' ELSE '>100%' END AS band
    FROM (SELECT l_discount * 5 AS x, l_tax * 5 AS y FROM lineitem))
  SELECT band, i, n, round(x, 8) AS x, round(share * x / (1 - x), 8) AS y FROM (SELECT band, count(*) AS n FROM b GROUP BY 1) LEFT JOIN
    (SELECT name, share, i, i / 20.0::DOUBLE / (1 + share) AS x FROM s, range(0, 20) r(i)) ON band = name""")  # fmt: skip
def confound_bands(spark, d):
    """Points in each band, with the grid of the curve below it (none below the lowest)."""
    rows = table(spark, d, "lineitem").select(G.confound_band(F.col("l_discount") * 5, F.col("l_tax") * 5).alias("band"))
    below = F.when(F.col("share") == 1.0, ">100%").when(F.col("share") == 0.5, "50-100%").otherwise("10-50%")
    curve = G.confound_curve(spark, points=20).select(below.alias("band"), F.round(F.col("x") * (1 + F.col("share")) * 20).cast("long").alias("i"), F.round("x", 8).alias("x"), F.round("y", 8).alias("y"))
    return rows.groupBy("band").agg(F.count("*").alias("n")).join(curve, "band", "left").select("band", "i", "n", "x", "y")


#: analysis: (rows, groups, x2, whether x2 is a category). Two halves by a number, all rows by a flag, and by a category in each
#: group and pooled over the line status.
SUITE = {
    "small": ("l_quantity <= 25", GROUPS, "l_discount", False),
    "large": ("l_quantity > 25", GROUPS, "l_discount", False),
    "flag": ("true", GROUPS, "cast(l_tax > 0.04 AS double)", False),
    "category": ("true", GROUPS, "l_linenumber", True),
    "pooled": ("true", GROUPS[:1], "l_linenumber", True),
}


@query("regression_suite")
def regression_suite(spark, d):
    """Five bootstrapped analyses, a row for each group and resample; without SQL, tested by brute force."""
    rows = table(spark, d, "lineitem")
    for name, (_, _, x2, _) in SUITE.items():
        rows = rows.withColumn(f"x2_{name}", F.expr(x2))
    analyses = [Analysis(name, tuple(groups), "l_extendedprice", "l_quantity", f"x2_{name}", categorical, where) for name, (where, groups, _, categorical) in SUITE.items()]
    return _rounded(G.bootstrap_analyses(rows, KEYS, analyses, N_BOOT), ["analysis", *GROUPS, "boot_idx", "n_boot_rows", "n_group_rows"])


@query("feature_pca_2d")
def feature_pca_2d(spark, d):
    """Two principal components of the features over all plates (labels), and over each plate by itself."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    return embedded(embedded(rows, [], "embedding"), ["label"], "embedding", names="plate_pc").drop("embedding")
