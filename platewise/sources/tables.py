"""Reading and writing the flat tables of an experiment: CSV and Parquet, one or many files."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns that every index of degraded images must have.
INDEX_COLUMNS = ("created_at", "run_id", "original_abs_path", "original_rel_path", "aug_abs_path", "aug_rel_path", "variant", "config_id", "params_json")
INDEX_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in INDEX_COLUMNS])


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``. Where that is unset, a local master gets a temporary folder, and a cluster an
    error, as its executors share no local folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="platewise-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or a glob) matches anything, in any file system that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def has_parts(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds a Parquet part that Spark would read, in folders of partitions too; what starts with a dot or
    an underscore does not count."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        return False
    waiting = [where]
    while waiting:
        for entry in system.listStatus(waiting.pop()):
            name = entry.getPath().getName()
            if name.startswith(("_", ".")):
                continue
            if entry.isDirectory():
                waiting.append(entry.getPath())
            elif name.endswith(".parquet"):
                return True
    return False


def require_columns(df: DataFrame, required: list[str] | tuple[str, ...]) -> DataFrame:
    """``df`` itself, or an error that lists what is missing, required and found."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"table lacks columns {missing} of {list(required)}; it has {df.columns}")
    return df


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL, so that aggregates skip both alike."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType | T.FloatType)]
    if not floats:
        return df
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def with_file_stem(df: DataFrame, name: str = "file_stem") -> DataFrame:
    return df.withColumn(name, F.regexp_extract(F.col("_metadata.file_path"), r"([^/\\]+)\.[^./\\]+$", 1))


def scan_csv_union(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """All CSV files under a path or glob as one table; ``file_stem`` names the file of each row."""
    reader = spark.read.option("header", True)
    return with_file_stem((reader.schema(schema) if schema else reader).csv(path))


def scan_partition_dirs(spark: SparkSession, path: str, name: str, schema: str | None = None) -> DataFrame:
    """One folder for each plate; the folder's name becomes column ``name``."""
    reader = spark.read.option("header", True)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/\\]+)/[^/\\]+$", 1)
    return (reader.schema(schema) if schema else reader).csv(path).withColumn(name, folder)


def scan_driven_by_table(spark: SparkSession, names: DataFrame, column: str, pattern: str, schema: str | None = None) -> DataFrame:
    """Rows of those files whose stem another table names. All files of the glob are listed; the stems join."""
    rows = scan_csv_union(spark, pattern, schema)
    return rows.join(names.select(F.col(column).alias("file_stem")).distinct(), "file_stem", "left_semi")


def scan_common_columns(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet files of differing schemas, cut to the columns that all of them have (footers are read first); NaN is NULL."""
    fields = common_fields(spark, paths)
    if fields is not None:
        return nan_to_null(spark.read.schema(fields).parquet(*paths))
    frames = [spark.read.parquet(p) for p in paths]
    common = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    return nan_to_null(reduce(DataFrame.unionByName, [f.select(common) for f in frames]))


#: Footers that one task reads.
FOOTERS = 50


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    scheme, _, rest = path.partition(":")
    return (pafs.LocalFileSystem(), "/" + unquote(rest).lstrip("/")) if scheme == "file" else pafs.FileSystem.from_uri(path)


def common_fields(spark: SparkSession, paths: list[str]) -> T.StructType | None:
    """Columns that all Parquet files below the paths have, in the order of the first path, so that one scan reads all files. Footers
    are read in tasks. None where a common column's type differs between files, or only Spark can open their store."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(paths).select("path")
    one = files.first()
    try:
        _opened(one.path if one else "")
    except (ValueError, OSError, pa.ArrowException):
        return None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = _opened(path)
                with system.open_input_file(place) as source:
                    fields = [(f.name, str(f.type)) for f in pq.read_schema(source)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in ([n for n, _ in fields], [t for _, t in fields])], names=["name", "type"])

    found = files.repartition(max(1, len(paths) // FOOTERS)).mapInArrow(read, "name string, type string")
    columns = {r.name: r for r in found.groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("type").alias("types")).collect()}
    most = files.count()
    kept = [f for f in spark.read.parquet(paths[0]).schema.fields if f.name in columns and columns[f.name].n == most]
    return T.StructType(kept) if all(columns[f.name].types == 1 for f in kept) else None


def scan_parquet_index(spark: SparkSession, path: str, required: tuple[str, ...] = INDEX_COLUMNS) -> DataFrame:
    """All parts of an append-only index, in folders of partitions too (their keys are columns); a missing or empty folder is
    an empty table with the required columns."""
    if not has_parts(spark, path):
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in required]))
    return nan_to_null(require_columns(spark.read.option("mergeSchema", True).parquet(path), required))


def scan_recursive_parts(spark: SparkSession, path: str) -> DataFrame:
    """Parquet parts in nested session folders; NaN is NULL."""
    return nan_to_null(spark.read.option("recursiveFileLookup", "true").parquet(path))


def scan_skip_missing(spark: SparkSession, paths: list[str]) -> tuple[DataFrame | None, list[str]]:
    """Those of the expected files that exist, as one table, and the paths that do not."""
    there = [p for p in paths if exists(spark, p)]
    return (nan_to_null(spark.read.parquet(*there)) if there else None), [p for p in paths if p not in there]


def list_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Path, length and modification time of all files that match, without reading them; an error when there are none."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    found = found.select("path", "length", "modificationTime")
    if found.isEmpty():
        raise FileNotFoundError(f"no file matches {pattern} below {path}")
    return found


def sink_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).mode("overwrite").csv(path)


def append_index(df: DataFrame, path: str, required: tuple[str, ...] = INDEX_COLUMNS) -> bool:
    """Appends one part after checking its columns; an empty table writes nothing."""
    require_columns(df, required)
    if df.isEmpty():
        return False
    df.write.mode("append").parquet(path)
    return True


def sink_partitioned(df: DataFrame, path: str, *columns: str) -> None:
    """Long metric rows in one folder for each run and metric, compressed with Zstandard."""
    df.write.mode("append").partitionBy(*columns).option("compression", "zstd").parquet(path)


def sink_overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
