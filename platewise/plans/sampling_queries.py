"""Queries of draws, ranks, sorts and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.operators import aggregate as A
from platewise.operators import sampling as S
from platewise.plans.registry import query, table


@query("patch_index", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT - 1 AS patch_idx FROM conversations")
def patch_index(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", (A.rank_in_group(["conv_id"], "turn") - 1).alias("patch_idx"))


@query("sample_per_group", """SELECT label, vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('0|' || vec_id), vec_id) <= 5""")
def sample_per_group(spark, d):
    return S.sample_per_group(table(spark, d, "embeddings").select("label", "vec_id"), ["label"], ["vec_id"], 5)


@query("sample_two_level_quota", """WITH o AS (SELECT p_brand, count(DISTINCT p_type) AS o FROM part GROUP BY 1),
  i AS (SELECT p_brand, p_type, count(DISTINCT p_size) AS i FROM part GROUP BY 1, 2)
  SELECT p_brand, p_type, p_size, p_partkey FROM part JOIN o USING (p_brand) JOIN i USING (p_brand, p_type)
  QUALIFY row_number() OVER (PARTITION BY p_brand, p_type, p_size ORDER BY md5('0|' || p_partkey), p_partkey) <= floor(floor(1000 / o) / i)""")  # fmt: skip
def sample_two_level_quota(spark, d):
    return S.two_level_quota(table(spark, d, "part").select("p_brand", "p_type", "p_size", "p_partkey"), "p_brand", "p_type", "p_size", ["p_partkey"], 1000)


@query("holdout_one_unit", """WITH u AS (SELECT DISTINCT l_returnflag, l_linestatus, l_suppkey FROM lineitem),
  h AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_linestatus
    ORDER BY md5(concat_ws('|', '0', l_returnflag, l_linestatus, l_suppkey)), l_returnflag, l_linestatus, l_suppkey) = 1)
  SELECT l_returnflag, l_linestatus, h.l_suppkey IS NOT NULL AS held_out, count(*) AS n FROM lineitem LEFT JOIN h USING (l_returnflag, l_linestatus, l_suppkey) GROUP BY 1, 2, 3""")  # fmt: skip
def holdout_one_unit(spark, d):
    rows = S.holdout_one_unit(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_suppkey")
    return rows.groupBy("l_returnflag", "l_linestatus", "held_out").agg(F.count("*").alias("n"))


@query("sample_n", "SELECT event_id FROM events ORDER BY md5('0|' || event_id), event_id LIMIT 50")
def sample_n(spark, d):
    return S.sample_n(table(spark, d, "events").select("event_id"), ["event_id"], 50)


@query("cap_group_size", """SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY md5('7|' || event_id), event_id) <= 20""")
def cap_group_size(spark, d):
    return S.sample_per_group(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], ["event_id"], 20, seed="7")


@query("pick_even_levels", """WITH r AS (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) - 1 AS pos FROM (SELECT DISTINCT p_brand, p_size FROM part)),
  l AS (SELECT p_brand, max(pos) AS last_at FROM r GROUP BY 1)
  SELECT p_brand, p_size FROM r JOIN l USING (p_brand) WHERE last_at + 1 <= 5 OR pos IN (0, round_even(last_at / 4.0::DOUBLE, 0), round_even(2 * last_at / 4.0::DOUBLE, 0), round_even(3 * last_at / 4.0::DOUBLE, 0), last_at)""")  # fmt: skip
def pick_even_levels(spark, d):
    return S.pick_even_levels(table(spark, d, "part"), ["p_brand"], "p_size", 5)


@query("latest_artifact_per_run", """WITH a AS (SELECT user_id, CASE WHEN event_type = 'click' THEN 'generator_' || event_id || '.pt' WHEN event_type = 'view' THEN 'best_' || event_id
    ELSE 'model_' || event_id END AS name FROM events)
  SELECT user_id, name FROM a QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN name LIKE '%generator%' THEN 0 WHEN name LIKE '%model%' THEN 1 ELSE 2 END,
    (name LIKE '%best%')::INT DESC, regexp_extract(name, '_([0-9]+)', 1)::BIGINT DESC, name) = 1""")  # fmt: skip
def latest_artifact_per_run(spark, d):
    kind = F.when(F.col("event_type") == "click", F.concat(F.lit("generator_"), "event_id", F.lit(".pt"))).when(F.col("event_type") == "view", F.concat(F.lit("best_"), "event_id"))
    rows = table(spark, d, "events").select("user_id", F.coalesce(kind, F.concat(F.lit("model_"), "event_id")).alias("name"))
    return S.latest_artifact(rows, "user_id", "name")


@query("sort_nulls_last", """SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY nullif(round(value), 1) NULLS LAST, event_type NULLS LAST, event_id) AS place FROM events""")
def sort_nulls_last(spark, d):
    rows = table(spark, d, "events").withColumn("level", F.nullif(F.round("value"), F.lit(1.0)))
    place = A.rank_in_group(["user_id"], F.asc_nulls_last("level"), F.asc_nulls_last("event_type"), "event_id")
    return rows.select("event_id", place.cast("long").alias("place"))


@query("head_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def head_limit(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")
