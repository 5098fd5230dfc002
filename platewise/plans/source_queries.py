"""Queries of the scans and sinks. What they read back, they wrote from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.plans.registry import query, table
from platewise.sources import tables as S

SUPPLIER = "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"


@query("scan_csv_union", "SELECT s_suppkey, s_nationkey, round(s_acctbal, 2) AS s_acctbal FROM supplier")
def scan_csv_union(spark, d):
    path = S.shared_folder(spark, "csv")
    S.sink_csv(table(spark, d, "supplier"), path)
    return S.scan_csv_union(spark, path, SUPPLIER).select("s_suppkey", "s_nationkey", F.round("s_acctbal", 2).alias("s_acctbal"))


@query("scan_partition_dirs", "SELECT 'plate=' || s_nationkey AS plate, count(*) AS n FROM supplier GROUP BY 1")
def scan_partition_dirs(spark, d):
    path = S.shared_folder(spark, "plates")
    table(spark, d, "supplier").withColumn("plate", F.col("s_nationkey")).write.partitionBy("plate").option("header", True).csv(path)
    return S.scan_partition_dirs(spark, f"{path}/*/*.csv", "plate", SUPPLIER).groupBy("plate").agg(F.count("*").alias("n"))


def _files_by_value(spark, rows, column):
    """A folder with one CSV file for each value of a column, named after it."""
    parts, path = S.shared_folder(spark, "parts"), S.shared_folder(spark, "named")
    rows.withColumn("part", F.col(column)).repartition("part").write.partitionBy("part").option("header", True).csv(parts)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    system = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(hadoop(path))
    for r in S.list_files(spark, parts, "*.csv").collect():
        folder = r.path.rsplit("/", 2)[1]
        system.rename(hadoop(r.path), hadoop(f"{path}/{folder.removeprefix('part=')}.csv"))
    return path


@query("scan_driven_by_table", """SELECT o_orderstatus AS file_stem, count(*) AS n, sum(o_orderkey)::BIGINT AS s FROM orders
  WHERE o_orderstatus IN (SELECT l_linestatus FROM lineitem) GROUP BY 1""")  # fmt: skip
def scan_driven_by_table(spark, d):
    """Of the files of three statuses, those that the line items name."""
    path = _files_by_value(spark, table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")
    rows = S.scan_driven_by_table(spark, table(spark, d, "lineitem"), "l_linestatus", path, "o_orderkey long, o_orderstatus string")
    return rows.groupBy("file_stem").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("s"))


@query("scan_common_columns", "SELECT p_partkey AS k, p_name AS name FROM part UNION ALL SELECT p_partkey + 1, p_name FROM part")
def scan_common_columns(spark, d):
    part, paths = table(spark, d, "part"), [S.shared_folder(spark, "a"), S.shared_folder(spark, "b")]
    part.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), "p_size").write.parquet(paths[0])
    part.select(F.col("p_name").alias("name"), (F.col("p_partkey") + 1).alias("k"), "p_brand").write.parquet(paths[1])
    return S.scan_common_columns(spark, paths)


def _index_rows(events):
    """Events as rows of an index of degraded images."""
    text = lambda *c: F.concat(*[F.col(x).cast("string") if x in ("event_id", "user_id", "event_type") else F.lit(x) for x in c])
    return events.select(
        F.date_format("ts", "yyyy-MM-dd").alias("created_at"), F.lit("run").alias("run_id"),
        text("/images/", "user_id", ".tiff").alias("original_abs_path"), text("user_id", ".tiff").alias("original_rel_path"),
        text("/out/", "event_id", ".tiff").alias("aug_abs_path"), text("event_id", ".tiff").alias("aug_rel_path"),
        F.col("event_type").alias("variant"), text("spark:", "event_type", ":h").alias("config_id"), F.col("props").alias("params_json"),
    )


@query("scan_parquet_index", "SELECT event_type AS variant, 2 * count(*) AS n FROM events GROUP BY 1")
def scan_parquet_index(spark, d):
    """A plain index and one in folders of a key, each read before and after its first part."""
    rows, out = _index_rows(table(spark, d, "events")), None
    for keys in ((), ("run_id",)):
        path = S.shared_folder(spark, "index")
        before = S.scan_parquet_index(spark, path)
        rows.write.mode("append").partitionBy(*keys).parquet(path)
        for part in (before, S.scan_parquet_index(spark, path).select(before.columns)):
            out = part if out is None else out.unionByName(part)
    return out.groupBy("variant").agg(F.count("*").alias("n"))


@query("scan_recursive_parts", "SELECT count(*) AS n, sum(c_custkey)::BIGINT AS s FROM customer")
def scan_recursive_parts(spark, d):
    path, rows = S.shared_folder(spark, "sessions"), table(spark, d, "customer")
    for i in range(2):
        rows.filter(F.col("c_custkey") % 2 == i).write.parquet(f"{path}/session_{i}/parts")
    return S.scan_recursive_parts(spark, path).agg(F.count("*").alias("n"), F.sum("c_custkey").alias("s"))


@query("scan_pruned_filtered", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45")
def scan_pruned_filtered(spark, d):
    rows = table(spark, d, "lineitem").filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 45))
    return rows.select("l_orderkey", "l_quantity")


@query("scan_skip_missing", "SELECT count(*) AS n, 1::BIGINT AS missing FROM lineitem")
def scan_skip_missing(spark, d):
    found, missing = S.scan_skip_missing(spark, [f"{d}/lineitem.parquet", f"{d}/no_such_plate.parquet"])
    return found.agg(F.count("*").alias("n"), F.lit(len(missing)).cast("long").alias("missing"))


@query("list_image_files", "SELECT event_type AS name, 1::BIGINT AS files FROM events GROUP BY 1")
def list_image_files(spark, d):
    path = _files_by_value(spark, table(spark, d, "events").select("event_id", "event_type"), "event_type")
    return S.list_files(spark, path, "*.csv").groupBy(F.regexp_extract("path", r"([^/]+)\.csv$", 1).alias("name")).agg(F.count("*").alias("files"))


@query("require_columns", "SELECT o_orderkey, o_orderstatus FROM orders")
def require_columns(spark, d):
    return S.require_columns(table(spark, d, "orders"), ["o_orderkey", "o_orderstatus"]).select("o_orderkey", "o_orderstatus")


@query("sink_csv", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def sink_csv(spark, d):
    path = S.shared_folder(spark, "csv")
    S.sink_csv(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), path)
    return spark.read.option("header", True).schema("c_custkey long, c_name string, c_nationkey int").csv(path)


@query("sink_append_index", "SELECT 2 * count(*) AS n, count(DISTINCT event_id) AS images FROM events")
def sink_append_index(spark, d):
    path, rows = S.shared_folder(spark, "index"), _index_rows(table(spark, d, "events"))
    for part in (rows, rows, rows.limit(0)):
        S.append_index(part, path)
    return S.scan_parquet_index(spark, path).agg(F.count("*").alias("n"), F.countDistinct("aug_abs_path").alias("images"))


@query("sink_metrics_partitioned", "SELECT event_type AS metric_name, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def sink_metrics_partitioned(spark, d):
    path = S.shared_folder(spark, "metrics")
    rows = table(spark, d, "events").select(F.lit("r1").alias("run"), F.col("event_type").alias("metric_name"), F.col("value").alias("metric_value"))
    S.sink_partitioned(rows, path, "run", "metric_name")
    return spark.read.parquet(path).groupBy("metric_name").agg(F.count("*").alias("n"), F.round(F.sum("metric_value"), 4).alias("total"))


@query("sink_overwrite_result", "SELECT o_orderkey, o_orderstatus FROM orders")
def sink_overwrite_result(spark, d):
    path, rows = S.shared_folder(spark, "result"), table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    S.sink_overwrite(rows, path)
    S.sink_overwrite(rows, path)
    return spark.read.parquet(path)
