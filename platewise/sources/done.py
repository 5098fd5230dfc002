"""An index of finished tasks that a small batch of tasks reads a small part of.

Every batch of finished tasks is one part, written as a whole under the batch's own name, so a batch that runs again replaces
its part. Inside a part, tasks lie in folders by a hash of their keys: a batch opens the folders of its own keys' hashes, and in them Parquet's
row groups are skipped by the range of its keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.operators.relational import not_done
from platewise.sources.tables import has_parts

#: Folders of a part.
BUCKETS = 16
PART, BUCKET = "done_part", "done_bucket"
_ORDERED = T.IntegerType | T.LongType | T.ShortType | T.StringType | T.DateType


def bucket(keys: list[str]) -> Column:
    """Text of the keys, so that an integer key has the same folder whatever its width."""
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(BUCKETS)).cast("int")


def write_done(rows: DataFrame, path: str, keys: list[str], part: str) -> None:
    """Writes or replaces one part."""
    own = rows.withColumn(BUCKET, bucket(keys))
    own.repartition(BUCKET).sortWithinPartitions(BUCKET, *keys).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/{PART}={part}")


def read_done(spark: SparkSession, path: str) -> DataFrame | None:
    """All parts, with the columns ``done_part`` and ``done_bucket``; None without any."""
    return spark.read.parquet(path) if has_parts(spark, path) else None


def done_for(tasks: DataFrame, path: str, keys: list[str], without: str | None = None) -> DataFrame | None:
    """Keys of finished tasks, from those folders alone in which a task of ``tasks`` could be, and within its keys' range; leaving out one
    part."""
    done = read_done(tasks.sparkSession, path)
    if done is None:
        return None
    known = tasks.dropna(subset=keys)
    ranged = [k for k in keys if isinstance(tasks.schema[k].dataType, _ORDERED) and tasks.schema[k].dataType == done.schema[k].dataType]
    # At most ``BUCKETS`` numbers, and two values a key.
    found = known.agg(F.collect_set(bucket(keys)).alias("buckets"), *[f(k).alias(f"{name}_{k}") for k in ranged for name, f in (("low", F.min), ("high", F.max))]).first()
    done = done.filter(F.col(BUCKET).isin(found.buckets))
    for k in ranged:
        if found[f"low_{k}"] is not None:
            done = done.filter(F.col(k).between(F.lit(found[f"low_{k}"]), F.lit(found[f"high_{k}"])))
    return (done.filter(F.col(PART) != without) if without else done).select(keys)


def left_to_do(tasks: DataFrame, path: str, keys: list[str], without: str | None = None) -> DataFrame:
    """Tasks whose keys are in no part (but one, if given); tasks with a null key go."""
    return not_done(tasks, done_for(tasks, path, keys, without), keys)
