"""Incremental work: new task files are read as a stream, finished tasks are skipped, results are appended."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.functions.scalars import checkpoint_entry
from platewise.sources.done import PART, left_to_do, read_done, write_done


def incremental_score(spark: SparkSession, tasks: str, schema: str, keys: list[str], score: Callable[[DataFrame], DataFrame], results: str, checkpoint: str, done: str | None = None, output: str = "output_file") -> None:
    """Scores the tasks in new files below ``tasks`` that are not done yet. A batch of the stream is one part of the results and one of
    the index of finished tasks, both named by the stream's checkpoint and the batch's number: one that runs again after a failure replaces what
    it wrote. The index is written last, and a part counts from then on (:func:`committed_results`).

    The index lies in ``done``, where each scored task has a row (its keys and its result's ``output`` path); without it beside
    the results, with keys alone."""
    index = done or f"{results}/_done"
    stream_name = hashlib.md5(checkpoint.encode()).hexdigest()[:16]

    def batch(rows: DataFrame, number: int) -> None:
        part = f"{stream_name}-{number}"
        # What this very batch has committed before does not count: it is written anew.
        scored = score(left_to_do(rows.dropDuplicates(keys), index, keys, without=part))
        scored.write.mode("overwrite").parquet(f"{results}/part-{part}")
        written = spark.read.schema(scored.schema).parquet(f"{results}/part-{part}")
        write_done(checkpoint_entry(written, keys, [], [], output) if done else written.select(keys), index, keys, part)

    stream = spark.readStream.schema(schema).parquet(tasks)
    stream.writeStream.foreachBatch(batch).trigger(availableNow=True).option("checkpointLocation", checkpoint).start().awaitTermination()


def committed_results(spark: SparkSession, results: str, done: str | None = None) -> DataFrame | None:
    """Results of the parts that the index of finished tasks names; None without any. What a failed batch has left does not count."""
    index = read_done(spark, done or f"{results}/_done")
    parts = [r[0] for r in index.select(PART).distinct().collect()] if index is not None else []
    return spark.read.parquet(*[f"{results}/part-{p}" for p in sorted(parts)]) if parts else None


def batch_predict(df: DataFrame, make_model: Callable[[], Callable[[pd.DataFrame], pd.Series]], value: str = "prediction") -> DataFrame:
    """A user's model over batches of rows, made once for each task. A batch that fails is marked, not dropped, and a model
    that returns another number of values than it was given is an error of its batch."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField(value, T.DoubleType()), T.StructField("status", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for pdf in batches:
            try:
                out = list(model(pdf))
                if len(out) != len(pdf):
                    raise ValueError(f"{len(out)} predictions for {len(pdf)} rows")
                yield pdf.assign(**{value: out, "status": "ok"})
            except Exception as e:  # noqa: BLE001  (any failure of a user's model)
                yield pdf.assign(**{value: None, "status": f"error: {e}"})

    return df.mapInPandas(run, schema)


def finished(df: DataFrame) -> DataFrame:
    return df.filter(F.col("status") == "ok")
