"""Queries of incremental work and of user-supplied functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from platewise.functions.scalars import seed_of
from platewise.operators import surface as U
from platewise.plans.image_queries import images
from platewise.plans.registry import query, table
from platewise.sources.done import read_done
from platewise.sources.tables import shared_folder
from platewise.streaming.incremental import batch_predict, committed_results, finished, incremental_score


@query("incremental_score", """SELECT o_orderkey, round(o_totalprice * 2, 2) AS score, '/out/' || o_orderkey || '.tiff' AS output_file FROM orders""")
def incremental(spark, d):
    """Results joined with the rows that say they are done."""
    tasks, results, state, done = (shared_folder(spark, n) for n in ("tasks", "results", "state", "done"))
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    path = F.concat(F.lit("/out/"), "o_orderkey", F.lit(".tiff")).alias("output_file")
    score = lambda df: df.select("o_orderkey", F.round(F.col("o_totalprice") * 2, 2).alias("score"), path)
    # The second run gets all tasks again with the new ones, and scores the new ones only.
    for part in (rows.filter("o_orderkey % 2 = 0"), rows):
        part.write.mode("append").parquet(tasks)
        incremental_score(spark, tasks, "o_orderkey long, o_totalprice double", ["o_orderkey"], score, results, state, done)
    return committed_results(spark, results, done).select("o_orderkey", "score").join(read_done(spark, done).select("o_orderkey", "output_file"), "o_orderkey")


@query("udf_transform", "SELECT vec_id AS image_id, round(list_sum(list_transform(embedding, lambda x: 1 - (x::DOUBLE + 1) / 2)), 6) AS total FROM embeddings")
def udf_transform(spark, d):
    invert = U.transform_udf(lambda image, seed: 1 - image)
    out = images(spark, d).select("image_id", invert("pixels", seed_of(F.col("image_id").cast("string"))).alias("out"))
    return out.select("image_id", F.round(F.aggregate("out", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("udf_metric", "SELECT vec_id AS image_id, round(list_max(list_transform(embedding, lambda x: abs((x::DOUBLE + 1) / 2 - 0.5))), 6) AS worst FROM embeddings")
def udf_metric(spark, d):
    worst = U.metric_udf(lambda x, y: np.abs(x - y).max())
    flat = F.transform("pixels", lambda x: F.lit(0.5))
    return images(spark, d).select("image_id", F.round(worst("pixels", flat), 6).alias("worst"))


def _brighter(image):
    """As many variants as the image has pixels above 0.65."""
    for k in range(int((image > 0.65).sum())):
        yield f"x{k + 2}", image * (k + 2)


@query("udtf_sweep", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: (x::DOUBLE + 1) / 2) AS v FROM embeddings),
  n AS (SELECT vec_id, list_sum(v) AS total, len(list_filter(v, lambda x: x > 0.65)) AS n FROM v)
  SELECT vec_id AS image_id, variant, round(f * list_sum(v), 6) AS total FROM v, (VALUES ('dim', 0.5::DOUBLE), ('same', 1.0::DOUBLE)) t(variant, f)
  UNION ALL SELECT vec_id, 'x' || (k + 2), round((k + 2) * total, 6) FROM (SELECT vec_id, total, unnest(range(n)) AS k FROM n)""")  # fmt: skip
def udtf_sweep(spark, d):
    """Named variants as expressions, and those of a hook whose number depends on the image."""
    rows = U.variants(images(spark, d), {"dim": F.transform("pixels", lambda x: x * 0.5), "same": F.col("pixels")})
    rows = rows.unionByName(U.variants_by(images(spark, d), _brighter, ["image_id"]))
    return rows.select("image_id", "variant", F.round(F.aggregate("out", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("batch_predict", "SELECT vec_id AS image_id, round(list_max(list_transform(embedding, lambda x: (x::DOUBLE + 1) / 2)), 6) AS prediction FROM embeddings")
def predict(spark, d):
    out = batch_predict(images(spark, d), lambda: lambda pdf: pdf["pixels"].map(max))
    return finished(out).select("image_id", F.round("prediction", 6).alias("prediction"))


@query("callbacks", "SELECT vec_id, label + 1 AS label FROM embeddings WHERE vec_id % 2 = 0")
def callbacks(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "label")
    return U.with_hooks(rows, lambda df: df.filter("vec_id % 2 = 0"), lambda df: df.withColumn("label", F.col("label") + 1))
