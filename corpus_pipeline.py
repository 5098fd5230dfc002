"""A corpus pipeline of the training-data operators: each stage is written as Parquet and read by the next.

Rules first, then one document (a row) of each near-duplicate group, then no document that holds a benchmark item; what is left
is mixed to the sources' weights and written as token ids. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm.common import shared_folder, stored
from platewise.llm.decontamination import contaminated
from platewise.llm.mixing import ORDER, mixed_queue
from platewise.llm.ngram_join import near_duplicates
from platewise.llm.quality_rules import quality_rules
from platewise.llm.token_files import read_token_files, write_token_files


def keyed_rows(docs: DataFrame) -> DataFrame:
    """``row``, a unique key of every row, as ids may repeat or be null, and ``doc``, the row itself.

    The key is the row's place in its file and stays the same in all jobs, if ``docs`` is read from files, as it is between stages
    (rows may be left out, not multiplied). Rows that come from no file are numbered and written once. Files are numbered
    on the driver, which lists them anyway to plan the scan."""
    try:
        placed = docs.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"), F.struct("*").alias("doc"))
    except AnalysisException:
        return stored(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "rows")
    files = sorted(r.file for r in placed.select("file").distinct().collect())
    numbers = docs.sparkSession.createDataFrame(list(enumerate(files)), "number long, file string")
    return placed.join(F.broadcast(numbers), "file").select((F.shiftleft("number", 40) + F.col("at")).alias("row"), "doc")


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, whatever other columns they have; null and empty texts fail."""
    return quality_rules(docs.select(F.struct("*").alias("doc"), "text")).filter("kept").select("doc.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates one row: that of the smallest id; if all ids are null, the first. Every row is decided
    by its own text, so the other rows of a repeated id stay, and so do all rows without a word."""
    rows = keyed_rows(docs)
    found = near_duplicates(rows.select(F.col("row").alias("doc_id"), "doc.text")).select(F.col("doc_id").alias("row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    first = found.join(rows.select("row", "doc.doc_id"), "row").groupBy("component_id").agg(F.min(order).alias("first"))
    return rows.join(first.select("first.row"), "row", "left_semi").select("doc.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark item is found, whatever their ids."""
    rows = keyed_rows(docs)
    found = contaminated(rows.select(F.col("row").alias("doc_id"), "doc.text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.join(found.select(F.col("doc_id").alias("row")).distinct(), "row", "left_anti").select("doc.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, also where ids repeat or are null, in the order of the queue; a row that is taken
    twice is two rows. Rows without a word are never counted against the budget; they stay if their place in the queue does."""
    rows = keyed_rows(docs)
    queue = mixed_queue(rows.select("row", "doc.doc_id", "doc.text", "doc.source"), "row")
    return rows.join(queue, "row").repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select("doc.*")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and says what they hold."""
    return read_token_files(write_token_files(docs.select("doc_id", "text"), shared_folder(spark, "tokens")))


STAGES = [
    ("quality rules", rules_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
    ("token files", token_stage),
]

#: SQL has no tokenizer, so the whole is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage{i}")
    return docs
