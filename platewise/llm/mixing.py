"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash; a document's virtual finish time is the source's words up to and
with it, divided by the source's target. All documents, each in as many passes as are allowed, then stand in one
order of finish times, and the mix is what fits in the total budget. Every source reaches its target at time 1,
so truncating the order at the budget gives all sources their targets, to within about a document.

Sums run over hash buckets: bucket totals first (a small table), then a window inside each bucket, so a source
with a third of all rows is spread over 4096 groups. The global order is a range sort of all passes (thin rows, without
texts) into stored partitions of about ``PART_ROWS``; the partitions' totals tell in which one the budget ends, and running
sums are taken in that one alone. Two windows run in one task: over the table of sources (a row each) and over that of the
sorted partitions (a row each, one in ``PART_ROWS`` of the passes).

Null texts have size 0 and are never taken; null sources form the last source; repeated rows are separate documents, in order
of id and size; rows with a null id are shuffled by their text. Columns of whatever name may be kept but those the result
itself has; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from platewise.llm.common import WORD, stored

#: Hex digits of the shuffling hash that name a bucket.
BUCKET_DIGITS = 3
#: Passes in a partition of the sorted queue, about.
PART_ROWS = 2_000_000
WEIGHTS = (3, 1, 2)


def sizes(df: DataFrame, text: str = "text", seed: str = "mix", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns to keep, doc_id, source, size (words), h (place in the source's shuffle)."""
    return df.select(
        *keep,
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null|"), F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))))).alias("h"),
    )


def key_of(source: Column) -> Column:
    """The source as a join key that is never null."""
    return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source))


def source_targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """sk, source_size, target, place. Targets are proportional to the weights, at most ``most`` times the source's
    size; what is above goes to the others by weight. That fixed point is ``min(cap, level * weight)`` for one level,
    found from running sums in order of cap / weight. One row for each source: the windows are over that table."""
    by_source = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    choice = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    s = by_source.withColumn("place", F.row_number().over(order)).withColumn("weight", choice.cast("long"))
    s = s.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "place")
    budget = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    before = F.sum("cap").over(by_ratio) - F.col("cap")
    rest = F.sum("weight").over(Window.partitionBy()) - F.sum("weight").over(by_ratio) + F.col("weight")
    s = s.withColumn("level", (budget - before) / rest)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(Window.partitionBy())["level"]
    s = s.withColumn("target", F.coalesce(F.least(F.col("cap").cast("double"), level * F.col("weight")), F.col("cap").cast("double")))
    return s.select(key_of(F.col("source")).alias("sk"), "source_size", "target", "place")


#: The order of the queue: by virtual finish time, ties by source, pass and place in the source's shuffle.
ORDER = ("f", "place", "pass", "h", "doc_id", "size")


def finish_times(df: DataFrame, text: str, weights: tuple[int, ...], share: float, most: int, seed: str, keep: tuple[str, ...]) -> DataFrame:
    """Every row once, with the finish time of each of its passes (f0, f1 ...); stored."""
    docs = stored(sizes(df, text, seed, keep), "mix-sizes").withColumn("sk", key_of(F.col("source"))).withColumn("b", F.substring("h", 1, BUCKET_DIGITS))
    targets = source_targets(docs, weights, share, most)
    prefix = docs.groupBy("sk", "b").agg(F.sum("size").alias("in_b"))
    prefix = prefix.withColumn("before", F.sum("in_b").over(Window.partitionBy("sk").orderBy("b")) - F.col("in_b")).drop("in_b")
    inside = Window.partitionBy("sk", "b").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = docs.join(prefix, ["sk", "b"]).withColumn("cum", F.col("before") + F.sum("size").over(inside)).join(targets, "sk")
    finish = lambda n: F.coalesce((F.col("cum") + n * F.col("source_size")) / F.nullif("target", F.lit(0.0)), F.lit(0.0))
    return stored(queued.select(*keep, "doc_id", "source", "size", "source_size", "target", "place", "h", *[finish(n).alias(f"f{n}") for n in range(most)]), "mix-times")


def last_taken(times: DataFrame, most: int, budget: float) -> tuple[DataFrame, Row | None]:
    """The sorted queue of all passes, with the partition (``part``) of each, and its last row that fits the budget."""
    passes = times.select("place", "h", "doc_id", "size", F.inline(F.array(*[F.struct(F.col(f"f{n}").alias("f"), F.lit(n).alias("pass")) for n in range(most)])))
    parts = max(int(times.sparkSession.conf.get("spark.sql.shuffle.partitions")), times.count() * most // PART_ROWS)
    queue = stored(passes.repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER).withColumn("part", F.spark_partition_id()), "mix-queue")
    totals = queue.groupBy("part").agg(F.sum("size").alias("in_part")).withColumn("upto", F.sum("in_part").over(Window.orderBy("part")))
    spent, whole, after = totals.agg(
        F.max(F.when(F.col("upto") <= budget, F.col("upto"))), F.max(F.when(F.col("upto") <= budget, F.col("part"))), F.min(F.when(F.col("upto") > budget, F.col("part")))
    ).first()
    up = [F.desc_nulls_last(c) for c in ORDER]
    if after is not None:
        running = F.sum("size").over(Window.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)) + F.lit(spent or 0)
        edge = queue.filter(F.col("part") == after).withColumn("upto", running).filter(F.col("upto") <= budget).orderBy(*up).first()
        if edge is not None or whole is None:
            return queue, edge
    return queue, queue.filter(F.col("part") == whole).orderBy(*up).first() if whole is not None else None


def up_to(edge: Row | None, f: Column, number: Column) -> Column:
    """Whether a pass stands in the queue up to the last one that fits."""
    if edge is None:
        return F.lit(False)
    here = F.struct(f.alias("f"), "place", number.alias("pass"), "h", "doc_id", "size")
    kinds = {"f": "double", "place": "int", "pass": "int", "h": "string", "doc_id": "long", "size": "long"}
    return here <= F.struct(*[F.lit(edge[c]).cast(kinds[c]).alias(c) for c in ORDER])


def mix_sources(df: DataFrame, text: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, seed: str = "mix", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, passes (how often the mix holds the document), taken of every row, and the
    finish time of its first pass (``finish``), after those columns of its row that are to be kept (such as a key, where doc_id is
    none)."""
    times = finish_times(df.withColumn("doc_id", F.col("doc_id").cast("long")), text, weights, share, most, seed, keep)
    budget = (times.agg(F.sum("size")).first()[0] or 0) * share
    _, edge = last_taken(times, most, budget)
    passes = sum((up_to(edge, F.col(f"f{n}"), F.lit(n)).cast("int") for n in range(most)), F.lit(0))
    return times.select(*keep, "doc_id", "source", "size", "source_size", "target", passes.alias("passes"), (passes * F.col("size")).cast("long").alias("taken"), F.col("f0").alias("finish"))


def mixed_queue(df: DataFrame, key: str, text: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, seed: str = "mix") -> DataFrame:
    """The mix itself: ``key`` (unique in ``df``), and the columns of ``ORDER``, of every pass up to the total budget, a row each."""
    times = finish_times(df.withColumn("doc_id", F.col("doc_id").cast("long")), text, weights, share, most, seed, (key,))
    budget = (times.agg(F.sum("size")).first()[0] or 0) * share
    _, edge = last_taken(times, most, budget)
    each = F.array(*[F.struct(F.col(f"f{n}").alias("f"), F.lit(n).alias("pass")) for n in range(most)])
    return times.select(key, "place", "h", "doc_id", "size", F.inline(each)).filter(up_to(edge, F.col("f"), F.col("pass")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, in the order of the queue."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs).orderBy("finish", "doc_id").select("doc_id", "size", "source_size", "target", "taken")


def mix_sql(source: str = "documents") -> str:
    """DuckDB SQL of the same mix over ``source``."""
    return rf"""
WITH d AS (
  SELECT doc_id, source, md5('mix|' || coalesce(doc_id::VARCHAR, 'null|' || md5(coalesce(text, '')))) AS h,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM {source}
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), s1 AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM s0
), s2 AS (
  SELECT *, [3, 1, 2][((place - 1) % 3 + 1)::INT]::BIGINT AS weight, 2 * source_size AS cap FROM s1
), s3 AS (
  SELECT *, cap::DOUBLE / weight AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM s2
), s4 AS (
  SELECT *, (budget - (sum(cap) OVER w - cap))::DOUBLE / (sum(weight) OVER () - sum(weight) OVER w + weight)::DOUBLE AS level
  FROM s3 WINDOW w AS (ORDER BY ratio, place)
), s AS (
  SELECT *, least(cap::DOUBLE, (SELECT level FROM s4 WHERE level <= ratio ORDER BY ratio, place LIMIT 1) * weight) AS target FROM s4
), q AS (
  SELECT d.doc_id, d.h, d.size, s.source_size, s.target, s.place,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS cum
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
), p AS (
  SELECT q.*, pass, coalesce((cum + pass * source_size)::DOUBLE / nullif(target, 0), 0) AS f FROM q, (VALUES (0), (1)) v(pass)
), o AS (
  SELECT *, sum(size) OVER (ORDER BY f, place, pass, h, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM p
)
SELECT doc_id, size, source_size, coalesce(target, 0) AS target,
  sum(CASE WHEN upto <= (SELECT sum(size) * 1.5::DOUBLE FROM d) THEN size ELSE 0 END)::BIGINT AS taken
FROM o GROUP BY doc_id, size, source_size, target"""


ORACLE = mix_sql()
