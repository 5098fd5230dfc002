"""Queries of column expressions."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import functions as F

from platewise.functions import scalars as X
from platewise.plans.registry import query, table


@query("split_config_id", """SELECT event_id, split_part(c, ':', 1) AS backend, nullif(split_part(c, ':', 2), '') AS kind, nullif(split_part(c, ':', 3), '') AS hash FROM
  (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'spark' ELSE 'spark:' || event_type || ':h' || user_id END AS c FROM events)""")  # fmt: skip
def split_config_id(spark, d):
    c = F.when(F.col("event_id") % 3 == 0, "spark").otherwise(F.concat(F.lit("spark:"), "event_type", F.lit(":h"), "user_id"))
    rows = table(spark, d, "events").withColumn("c", c)
    return rows.select("event_id", *[X.config_part("c", i).alias(n) for i, n in enumerate(("backend", "kind", "hash"), 1)])


@query("parse_param_list", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 1 END::INT AS n, CASE event_id % 3 WHEN 0 THEN user_id::DOUBLE END AS scalar FROM events""")
def parse_param_list(spark, d):
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("["), "user_id", F.lit("]"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("["), "user_id", F.lit(", 2]"))).otherwise("no list")
    parsed = X.parse_list("text")
    return table(spark, d, "events").withColumn("text", text).select("event_id", F.size(parsed).alias("n"), X.scalar_of(parsed).alias("scalar"))


@query("encode_json", """SELECT event_id, '{"kind":"' || event_type || '","user":' || user_id || '}' AS params_json FROM events""")
def encode_json(spark, d):
    return table(spark, d, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("user"))).alias("params_json"))


@query("extract_file_index", "SELECT page_id, page_id AS idx FROM pages")
def extract_file_index(spark, d):
    path = F.concat(F.lit("/out/plate.1/"), F.col("page_id").cast("string"), F.lit(".tiff"))
    return table(spark, d, "pages").select("page_id", X.file_stem(path).try_cast("long").alias("idx"))


@query("join_path", "SELECT page_id, rtrim(replace(url, '\\', '/'), '/') || '/' || page_id || '.tiff' AS path FROM pages")
def join_path(spark, d):
    name = F.concat(F.col("page_id").cast("string"), F.lit(".tiff"))
    return table(spark, d, "pages").select("page_id", X.join_path(F.concat("url", F.lit("\\/")), name).alias("path"))


@query("derive_output_path", """SELECT event_id, CASE WHEN user_id % 2 = 0 THEN user_id || '/' ELSE '' END || event_id || '__' || event_type || '.tiff' AS path FROM events""")
def derive_output_path(spark, d):
    path = F.concat(F.when(F.col("user_id") % 2 == 0, "/data/").otherwise("/else/"), "user_id", F.lit("/"), "event_id", F.lit(".tif"))
    return table(spark, d, "events").select("event_id", X.output_path(path, "/data/", F.col("event_type")).alias("path"))


@query("task_output_path", """SELECT l_orderkey, l_linenumber, '/r/' || l_suppkey || '/' || l_returnflag || '/' || l_linenumber || '.tiff' AS nested,
  '/r/' || l_suppkey || '_' || l_returnflag || '_' || l_linestatus || '_' || l_linenumber || '.tiff' AS flat FROM lineitem""")  # fmt: skip
def task_output_path(spark, d):
    index = F.col("l_linenumber")
    nested = X.task_path("/r", [F.col("l_suppkey"), F.col("l_returnflag")], index)
    flat = X.task_path("/r", [F.col("l_suppkey"), F.concat_ws("/", "l_returnflag", "l_linestatus")], index, flat=True)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", nested.alias("nested"), flat.alias("flat"))


@query("stable_param_hash", """SELECT event_id, substr(sha1('{"kind":"' || event_type || '","value":' || regexp_replace(regexp_replace(value::DECIMAL(30,8)::VARCHAR, '0+$', ''), '\\.$', '') || '}'), 1, 16) AS hash FROM events""")
def stable_param_hash(spark, d):
    kind = F.concat(F.lit('"'), "event_type", F.lit('"'))
    return table(spark, d, "events").select("event_id", X.stable_hash(value=X.number_text(F.col("value")), kind=kind).alias("hash"))


@query("seed_from_key", "SELECT page_id, ('0x' || substr(md5(url || 's'), 1, 8))::BIGINT % 2147483647 AS seed FROM pages")
def seed_from_key(spark, d):
    return table(spark, d, "pages").select("page_id", X.seed_of(F.col("url"), "s").alias("seed"))


@query("build_variant_id", """SELECT event_id, 'blur_' || event_type || '_' || substr(sha1('{"user":' || user_id || '}'), 1, 16) AS variant,
  'spark:' || event_type || ':' || substr(sha1('{"user":' || user_id || '}'), 1, 16) AS config_id FROM events""")  # fmt: skip
def build_variant_id(spark, d):
    h = X.stable_hash(user=F.col("user_id").cast("string"))
    return table(spark, d, "events").select("event_id", F.concat_ws("_", F.lit("blur"), "event_type", h).alias("variant"), F.concat_ws(":", F.lit("spark"), "event_type", h).alias("config_id"))


@query("sweep_grid", """SELECT p_partkey, i, round(0.1::DOUBLE * sqrt(i), 8) AS noise, round(0.8::DOUBLE * sqrt(i), 8) AS sigma,
  round(100 * pow(p_size::DOUBLE, i / 6.0::DOUBLE), 2) AS gamma FROM part, range(1, 7) r(i)""")  # fmt: skip
def sweep_grid(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(6).cast("long"))).alias("i"))
    return rows.select("p_partkey", "i", F.round(0.1 * F.sqrt("i"), 8).alias("noise"), F.round(0.8 * F.sqrt("i"), 8).alias("sigma"), F.round(100 * F.pow(F.col("p_size").cast("double"), F.col("i") / 6.0), 2).alias("gamma"))


@query("run_stamps")
def run_stamps(spark, d):
    run, now = str(uuid.uuid4()), datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ")
    return table(spark, d, "part").select("p_partkey", F.lit(run).alias("run_id"), F.lit(now).alias("created_at"))


@query("cast_label", "SELECT p_partkey, p_size::VARCHAR AS label, 'type=' || p_type || ' | size=' || p_size AS facet FROM part")
def cast_label(spark, d):
    return table(spark, d, "part").select("p_partkey", F.col("p_size").cast("string").alias("label"), F.concat(F.lit("type="), "p_type", F.lit(" | size="), "p_size").alias("facet"))


@query("checkpoint_entry", "SELECT o_orderkey, o_orderstatus AS Metadata_Model_o_orderstatus, o_orderpriority, NULL::VARCHAR AS density, '/out/' || o_orderkey || '.tiff' AS output_file FROM orders")
def checkpoint_entry(spark, d):
    rows = table(spark, d, "orders").withColumn("path", F.concat(F.lit("/out/"), "o_orderkey", F.lit(".tiff")))
    return X.checkpoint_entry(rows, ["o_orderkey"], ["o_orderstatus"], ["o_orderpriority", "density"], "path")
