"""Projections, filters, reshapes, joins and set operations on flat tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


# --- columns and rows -----------------------------------------------------------------------------------------
def select_by_name(df: DataFrame, test: Callable[[str], bool], complement: bool = False) -> DataFrame:
    return df.select([c for c in df.columns if bool(test(c)) != complement])


def rename_prefix(df: DataFrame, prefix: str, columns: list[str] | None = None) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in columns or df.columns})


def condition(conditions: dict[str, object]) -> Column:
    """All of ``{column: value or list of values}``."""
    tests = [F.col(c).isin(list(v)) if isinstance(v, list | tuple | set) else F.col(c) == v for c, v in conditions.items()]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def filter_condition_map(df: DataFrame, conditions: dict[str, object], must_leave_rows: bool = False) -> DataFrame:
    out = df.filter(condition(conditions))
    if must_leave_rows and out.isEmpty():
        raise ValueError(f"no rows satisfy {conditions}")
    return out


def split_complement(df: DataFrame, test: Column, name: str = "selected") -> DataFrame:
    """Marks rows that satisfy the test; rows where it is null belong to everything else."""
    return df.withColumn(name, F.coalesce(test, F.lit(False)))


def is_missing(df: DataFrame, column: str) -> Column:
    """NULL, or NaN where the column can hold it."""
    test = F.col(column).isNull()
    return test | F.isnan(column) if isinstance(df.schema[column].dataType, T.DoubleType | T.FloatType) else test


def coerce_finite(df: DataFrame, numeric: list[str], other: list[str] = ()) -> DataFrame:
    """Text that is no number becomes null; rows with a null, NaN or infinite number, or a null in ``other``, go."""
    out = df.withColumns({c: F.col(c).try_cast("double") for c in numeric})
    keep = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in numeric] + [F.col(c).isNotNull() for c in other]
    return out.filter(reduce(lambda a, b: a & b, keep))


def any_missing(df: DataFrame) -> DataFrame:
    """One row: does any cell hold NULL or NaN?"""
    return df.agg(F.bool_or(reduce(lambda a, b: a | b, [is_missing(df, c) for c in df.columns])).alias("any_missing"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows of each value; missing ones (NULL or NaN) are no value."""
    return df.filter(~is_missing(df, column)).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def first_rows(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each group in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


# --- reshape --------------------------------------------------------------------------------------------------
def unpivot_together(df: DataFrame, ids: list[str], groups: dict[str, dict[str, str]], name: str) -> DataFrame:
    """Wide columns to long rows, several values moving together: ``{label: {long column: wide column}}``."""
    rows = F.array(*[F.struct(F.lit(k).alias(name), *[F.col(w).alias(v) for v, w in cols.items()]) for k, cols in groups.items()])
    return df.select(*ids, F.inline(rows))


def unpivot_paths(df: DataFrame, file_prefix: str = "FileName_", path_prefix: str = "PathName_") -> DataFrame:
    """channel, abs_path and meta_row (all columns of the row, as JSON) for every stem that has both a file and a path column; rows
    without a path go, and a table without such a stem gives none."""
    stems = [c.removeprefix(file_prefix) for c in df.columns if c.startswith(file_prefix) and path_prefix + c.removeprefix(file_prefix) in df.columns]
    if not stems:
        return df.sparkSession.createDataFrame([], "channel string, abs_path string, meta_row string")
    folder = lambda s: F.regexp_replace(F.rtrim(F.col(path_prefix + s), F.lit("/\\")), r"\\", "/")
    path = lambda s: F.concat(folder(s), F.lit("/"), F.col(file_prefix + s))
    rows = F.array(*[F.struct(F.lit(s).alias("channel"), path(s).alias("abs_path")) for s in stems])
    return df.select(F.inline(rows), F.to_json(F.struct(*df.columns)).alias("meta_row")).filter(F.col("abs_path").isNotNull())


def pack_row(df: DataFrame, keys: list[str], name: str = "meta_row") -> DataFrame:
    """The other columns of each row as JSON."""
    return df.select(*keys, F.to_json(F.struct(*[c for c in df.columns if c not in keys])).alias(name))


# --- joins ----------------------------------------------------------------------------------------------------
def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join in which null keys are equal."""
    test = reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])
    return left.join(right, test, how)


def not_done(all_tasks: DataFrame, done: DataFrame | None, keys: list[str]) -> DataFrame:
    """Tasks whose keys are not in ``done``; tasks with a null key go; without an index, all are left."""
    missing = [k for k in keys if k not in all_tasks.columns or (done is not None and k not in done.columns)]
    if missing:
        raise ValueError(f"key columns missing: {missing}")
    tasks = all_tasks.dropna(subset=keys)
    return tasks if done is None else tasks.join(done.select(keys).distinct(), keys, "left_anti")


def last_row_lookup(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """For repeated keys the last row in the given order wins."""
    flipped = [F.desc(c) if isinstance(c, str) else c for c in order]
    return first_rows(rows, keys, *flipped)


#: Most levels of a grid that images carry as an array.
GRID = 10_000


def sweep(images: DataFrame, grid: DataFrame) -> DataFrame:
    """Every image at every level. A grid is a handful of rows, which each image carries as an array; beyond ``GRID`` of them it is an
    error."""
    levels = grid.limit(GRID + 1).collect()
    if len(levels) > GRID:
        raise ValueError(f"a grid has at most {GRID} levels")
    rows = F.array(*[F.struct(*[F.lit(r[c]).cast(grid.schema[c].dataType).alias(c) for c in grid.columns]) for r in levels])
    return images.select("*", F.inline(rows))
