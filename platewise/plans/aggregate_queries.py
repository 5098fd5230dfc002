"""Queries of aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.operators import aggregate as A
from platewise.plans.registry import query, table


@query("group_count", "SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2")
def group_count(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))


@query("max_of_group_counts", "SELECT max(n) AS most, round(max(n) * 1.05::DOUBLE, 4) AS axis FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey)")
def max_of_group_counts(spark, d):
    counts = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return counts.agg(F.max("n").alias("most"), F.round(F.max("n") * F.lit(1.05), 4).alias("axis"))


@query("first_per_group", """SELECT user_id, arg_min(CASE WHEN event_type <> 'error' THEN event_type END, event_id) FILTER (event_type <> 'error') AS first_type
  FROM events GROUP BY 1""")  # fmt: skip
def first_per_group(spark, d):
    rows = table(spark, d, "events").withColumn("event_type", F.nullif(F.col("event_type"), F.lit("error")))
    return rows.groupBy("user_id").agg(A.first_known("event_type", "event_id").alias("first_type"))


@query("global_moments", "SELECT round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM (SELECT unnest([l_quantity, l_extendedprice]) AS v FROM lineitem)")
def global_moments(spark, d):
    pooled = table(spark, d, "lineitem").select(F.explode(F.array("l_quantity", "l_extendedprice")).alias("v"))
    return pooled.agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"))


@query("removed_fraction", """WITH s AS (SELECT count(DISTINCT (l_orderkey, l_linenumber)) AS sites FROM lineitem),
  r AS (SELECT count(*) AS removed FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 UNION ALL
    SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_tax > 0.07))
  SELECT sites, removed, round(100.0::DOUBLE * removed / sites, 6) AS percent FROM s, r""")  # fmt: skip
def removed_fraction(spark, d):
    rows, keys = table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]
    removed = [F.countDistinct(F.when(F.expr(t), F.struct(*keys))) for t in ("l_quantity > 45", "l_tax > 0.07")]
    out = rows.agg(F.countDistinct(*keys).alias("sites"), (removed[0] + removed[1]).alias("removed"))
    return out.withColumn("percent", F.round(100.0 * F.col("removed") / F.col("sites"), 6))


_BAND = """SELECT l_returnflag, l_linestatus, {cols} FROM (SELECT l_returnflag, l_linestatus, avg(l_quantity) AS m, quantile_cont(l_quantity, 0.025) AS lo,
  quantile_cont(l_quantity, 0.975) AS hi FROM lineitem GROUP BY 1, 2)"""


def _band(spark, d):
    return A.mean_quantile_band(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity"])


@query("mean_quantile_ci", _BAND.format(cols="round(m, 6) AS mean, round(lo, 6) AS low, round(hi, 6) AS high"))
def mean_quantile_ci(spark, d):
    r = lambda c, name: F.round(f"l_quantity_{c}", 6).alias(name)
    return _band(spark, d).select("l_returnflag", "l_linestatus", r("mean", "mean"), r("low", "low"), r("high", "high"))


@query("error_extents", _BAND.format(cols="round(m - lo, 6) AS minus, round(hi - m, 6) AS plus"))
def error_extents(spark, d):
    return _band(spark, d).select("l_returnflag", "l_linestatus", F.round("l_quantity_minus", 6).alias("minus"), F.round("l_quantity_plus", 6).alias("plus"))


@query("min_group_filter", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 25")
def min_group_filter(spark, d):
    return A.min_group_filter(table(spark, d, "lineitem").select("l_partkey"), ["l_partkey"], 25).groupBy("l_partkey").agg(F.count("*").alias("n"))


@query("column_summary", """SELECT min(value) AS min, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, round(avg(value), 6) AS mean,
  quantile_cont(value, 0.75) AS q3, max(value) AS max FROM events""")  # fmt: skip
def column_summary(spark, d):
    return A.column_summary(table(spark, d, "events"), "value").withColumn("mean", F.round("mean", 6))


@query("minmax_limits", "SELECT label, min(v) AS low, max(v) AS high FROM (SELECT label, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY 1")
def minmax_limits(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.min(F.array_min("embedding")).cast("double").alias("low"), F.max(F.array_max("embedding")).cast("double").alias("high"))


@query("count_rows", "SELECT count(*) AS n FROM lineitem")
def count_rows(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"))


@query("zscore_outliers", "SELECT event_id, value FROM (SELECT *, (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS z FROM events) WHERE abs(z) > 2.5")
def zscore_outliers(spark, d):
    return A.zscore_outliers(table(spark, d, "events"), "value", 2.5).select("event_id", "value")
