"""Queries of projections, filters, reshapes, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.operators import relational as R
from platewise.plans.registry import query, table
from platewise.sources.done import left_to_do, write_done
from platewise.sources.tables import shared_folder


@query("select_by_name", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem")
def select_by_name(spark, d):
    return R.select_by_name(table(spark, d, "lineitem"), lambda c: c.endswith("key"))


@query("rename_prefix", "SELECT s_suppkey AS Metadata_Model_s_suppkey, s_name AS Metadata_Model_s_name FROM supplier")
def rename_prefix(spark, d):
    return R.rename_prefix(table(spark, d, "supplier").select("s_suppkey", "s_name"), "Metadata_Model_")


@query("filter_condition_map", "SELECT p_partkey, p_type, p_size FROM part WHERE p_type = 'ECONOMY' AND p_size IN (1, 11, 28)")
def filter_condition_map(spark, d):
    return R.filter_condition_map(table(spark, d, "part"), {"p_type": "ECONOMY", "p_size": [1, 11, 28]}).select("p_partkey", "p_type", "p_size")


@query("split_complement", "SELECT coalesce(nullif(p_size, 11) > 20, false) AS selected, count(*) AS n FROM part GROUP BY 1")
def split_complement(spark, d):
    size = F.nullif(F.col("p_size"), F.lit(11))
    return R.split_complement(table(spark, d, "part"), size > 20).groupBy("selected").agg(F.count("*").alias("n"))


@query("filter_subset", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority IN ('5-LOW', '2-HIGH')")
def filter_subset(spark, d):
    return table(spark, d, "orders").filter((F.col("o_orderstatus") == "P") & F.col("o_orderpriority").isin("5-LOW", "2-HIGH")).select("o_orderkey")


@query("encode_indicator", "SELECT l_returnflag, avg((l_returnflag = 'R')::INT) AS share, count(*) AS n FROM lineitem GROUP BY 1")
def encode_indicator(spark, d):
    rows = table(spark, d, "lineitem").withColumn("is_r", (F.col("l_returnflag") == "R").cast("int"))
    return rows.groupBy("l_returnflag").agg(F.avg("is_r").alias("share"), F.count("*").alias("n"))


@query("drop_null_rows", "SELECT event_id, nullif(event_type, 'error') AS event_type FROM events WHERE event_type <> 'error' AND value <> 0")
def drop_null_rows(spark, d):
    rows = table(spark, d, "events").withColumn("event_type", F.nullif(F.col("event_type"), F.lit("error")))
    rows = rows.withColumn("value", F.when(F.col("value") == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return rows.dropna(subset=["event_type", "value"]).select("event_id", "event_type")


@query("coerce_numeric_finite", """SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events
  WHERE json_extract_string(props, '$.k') IS NOT NULL AND event_type <> 'view'""")  # fmt: skip
def coerce_numeric_finite(spark, d):
    rows = table(spark, d, "events").withColumn("k", F.when(F.col("event_type") == "view", "none").otherwise(F.get_json_object("props", "$.k")))
    return R.coerce_finite(rows, ["k"], ["event_type"]).select("event_id", "k")


@query("any_null_check", "SELECT bool_or(l_quantity IS NULL OR l_tax IS NULL OR l_returnflag IS NULL) AS any_missing FROM lineitem")
def any_null_check(spark, d):
    return R.any_missing(table(spark, d, "lineitem").select("l_quantity", "l_tax", "l_returnflag"))


@query("distinct_values", "SELECT p_brand, count(DISTINCT p_type) AS types, count(DISTINCT p_size) AS sizes FROM part GROUP BY 1")
def distinct_values(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.countDistinct("p_type").alias("types"), F.countDistinct("p_size").alias("sizes"))


@query("value_counts", "SELECT p_brand, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY 1")
def value_counts(spark, d):
    return R.value_counts(table(spark, d, "part"), "p_brand")


@query("dedup_keep_first", """SELECT user_id, event_type, event_id FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value, event_id) = 1""")  # fmt: skip
def dedup_keep_first(spark, d):
    return R.first_rows(table(spark, d, "events"), ["user_id", "event_type"], "value", "event_id").select("user_id", "event_type", "event_id")


@query("unpivot_channel_metrics", """SELECT l_orderkey, l_linenumber, 'A' AS channel, l_quantity AS slope, l_discount AS saturation FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'B', l_extendedprice, l_tax FROM lineitem""")  # fmt: skip
def unpivot_channel_metrics(spark, d):
    groups = {"A": {"slope": "l_quantity", "saturation": "l_discount"}, "B": {"slope": "l_extendedprice", "saturation": "l_tax"}}
    return R.unpivot_together(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], groups, "channel")


@query("unpivot_paths", """WITH w AS (SELECT page_id, regexp_extract(url, '^(.*)/([^/]*)$', 1) AS p, regexp_extract(url, '^(.*)/([^/]*)$', 2) AS f FROM pages)
  SELECT 'DNA' AS channel, rtrim(p, '/') || '/' || f AS abs_path, page_id FROM w
  UNION ALL SELECT 'RNA', rtrim(p, '/') || '/' || f || '.rna', page_id FROM w WHERE page_id % 2 = 0""")  # fmt: skip
def unpivot_paths(spark, d):
    folder, name = (F.regexp_extract("url", r"^(.*)/([^/]*)$", i) for i in (1, 2))
    wide = table(spark, d, "pages").select(
        F.col("page_id").alias("Metadata_page_id"), name.alias("FileName_DNA"), folder.alias("PathName_DNA"), F.lit("x").alias("FileName_Alone"),
        F.when(F.col("page_id") % 2 == 0, F.concat(name, F.lit(".rna"))).alias("FileName_RNA"), F.concat(folder, F.lit("//")).alias("PathName_RNA"),
    )
    return R.unpivot_paths(wide).select("channel", "abs_path", F.get_json_object("meta_row", "$.Metadata_page_id").cast("long").alias("page_id"))


@query("unpivot_metrics", """SELECT l_orderkey, l_linenumber, metric_name, metric_value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem)
  UNPIVOT (metric_value FOR metric_name IN (l_quantity, l_discount, l_tax))""")  # fmt: skip
def unpivot_metrics(spark, d):
    return table(spark, d, "lineitem").unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "metric_name", "metric_value")


@query("meta_row_pack", """SELECT o_orderkey, '{"o_orderstatus":"' || o_orderstatus || '","o_custkey":' || o_custkey || '}' AS meta_row FROM orders""")
def meta_row_pack(spark, d):
    return R.pack_row(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey"), ["o_orderkey"])


@query("join_inner", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_inner(spark, d):
    return table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")


@query("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def join_left(spark, d):
    joined = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def join_anti(spark, d):
    gone = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return R.join_null_safe(table(spark, d, "customer"), gone, ["c_custkey"], "left_anti").select("c_custkey")


@query("join_semi", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def join_semi(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left_semi")


@query("join_multi_key", """SELECT a.user_id, a.event_type, count(*) AS n FROM events a
  JOIN (SELECT DISTINCT user_id, event_type, ts::DATE AS day FROM events WHERE value > 50) b
  ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.ts::DATE = b.day GROUP BY 1, 2""")  # fmt: skip
def join_multi_key(spark, d):
    rows = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    keys = ["user_id", "event_type", "day"]
    return rows.join(rows.filter("value > 50").select(keys).distinct(), keys).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("join_renamed_keys", """SELECT n_name, p_brand, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem
  JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2""")  # fmt: skip
def join_renamed_keys(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name", "p_brand").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("anti_done_pairs", """SELECT DISTINCT user_id, event_type FROM events
  EXCEPT SELECT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-02'""")  # fmt: skip
def anti_done_pairs(spark, d):
    rows = table(spark, d, "events")
    return R.not_done(rows.select("user_id", "event_type").distinct(), rows.filter("ts < timestamp_ntz'2024-01-02'"), ["user_id", "event_type"])


@query("anti_done_tasks", "SELECT o_orderkey, 'unet' AS model FROM orders WHERE o_orderstatus <> 'F'")
def anti_done_tasks(spark, d):
    """Against an index of finished tasks in folders by key."""
    tasks, index, keys = table(spark, d, "orders").select("o_orderkey", "o_orderstatus").withColumn("model", F.lit("unet")), shared_folder(spark, "done"), ["o_orderkey", "model"]
    write_done(tasks.filter("o_orderstatus = 'F'").select(keys), index, keys, "0")
    return left_to_do(tasks, index, keys).select(keys)


@query("anti_done_metrics", """SELECT p_partkey, m AS metric_name FROM part, (VALUES ('mae'), ('psnr'), ('ssim')) t(m)
  WHERE NOT (m = 'mae' AND p_size > 20)""")  # fmt: skip
def anti_done_metrics(spark, d):
    pairs = table(spark, d, "part").select("p_partkey", "p_size", F.explode(F.array(*map(F.lit, ("mae", "psnr", "ssim")))).alias("metric_name"))
    done = table(spark, d, "part").filter("p_size > 20").select("p_partkey", F.lit("mae").alias("metric_name"))
    return R.not_done(pairs, done, ["p_partkey", "metric_name"]).select("p_partkey", "metric_name")


@query("lookup_metadata", """WITH l AS (SELECT user_id, props FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
  SELECT c_custkey, coalesce(props, '{}') AS props FROM customer LEFT JOIN l ON c_custkey = user_id""")  # fmt: skip
def lookup_metadata(spark, d):
    known = R.last_row_lookup(table(spark, d, "events"), ["user_id"], "ts", "event_id").select(F.col("user_id").alias("c_custkey"), "props")
    return table(spark, d, "customer").select("c_custkey").join(known, "c_custkey", "left").fillna("{}", ["props"])


_SWEEPS = ("noise", "blur", "erode", "dilate", "brighten", "darken", "distort")


@query("cross_join_sweep", f"SELECT vec_id, name, level::DOUBLE AS level FROM embeddings, (SELECT unnest({list(_SWEEPS)}) AS name), (SELECT unnest(range(1, 7)) AS level)")
def cross_join_sweep(spark, d):
    """Seven sweeps of six levels."""
    grid = spark.createDataFrame([(name, float(level)) for name in _SWEEPS for level in range(1, 7)], "name string, level double")
    return R.sweep(table(spark, d, "embeddings").select("vec_id"), grid)


@query("join_agg_first", """SELECT l_suppkey, count(*) AS n, arg_min(l_returnflag, l_orderkey * 1000000 + l_partkey) AS flag FROM lineitem GROUP BY 1""")
def join_agg_first(spark, d):
    order = F.col("l_orderkey") * 1000000 + F.col("l_partkey")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.min_by("l_returnflag", order).alias("flag"))


@query("join_cells_to_sites", """SELECT o_orderkey, count(*) AS cells, round(sum(l_extendedprice), 2) AS x FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  WHERE o_orderstatus = 'O' GROUP BY 1""")  # fmt: skip
def join_cells_to_sites(spark, d):
    sites = table(spark, d, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey"), F.col("o_orderkey").alias("l_orderkey"))
    return sites.join(table(spark, d, "lineitem"), "l_orderkey").groupBy("o_orderkey").agg(F.count("*").alias("cells"), F.round(F.sum("l_extendedprice"), 2).alias("x"))


@query("pair_images", """SELECT a.vec_id, b.vec_id AS reference, len(a.embedding)::INT AS pixels FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - a.vec_id % 10""")
def pair_images(spark, d):
    a = table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("vec_id") - F.col("vec_id") % 10).alias("reference"))
    b = table(spark, d, "embeddings").select(F.col("vec_id").alias("reference"), F.col("embedding").alias("target"))
    same = F.assert_true(F.size("embedding") == F.size("target"), F.lit("images of a pair differ in size"))
    return a.join(b, "reference").filter(same.isNull()).select("vec_id", "reference", F.size("embedding").alias("pixels"))


@query("union_all", "SELECT 'q' AS metric, l_orderkey FROM lineitem WHERE l_quantity > 45 UNION ALL SELECT 't', l_orderkey FROM lineitem WHERE l_tax > 0.07")
def union_all(spark, d):
    rows = table(spark, d, "lineitem")
    part = lambda name, test: rows.filter(test).select(F.lit(name).alias("metric"), "l_orderkey")
    return part("q", "l_quantity > 45").unionByName(part("t", "l_tax > 0.07"))


@query("union_distinct", "SELECT user_id FROM events UNION SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0")
def union_distinct(spark, d):
    return table(spark, d, "events").select("user_id").union(table(spark, d, "customer").filter("c_custkey % 3 = 0").select("c_custkey")).distinct()


@query("except_keys", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def except_keys(spark, d):
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


@query("intersect_keys", "SELECT p_partkey AS k FROM part INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity > 48")
def intersect_keys(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k")).intersect(table(spark, d, "lineitem").filter("l_quantity > 48").select("l_partkey"))
