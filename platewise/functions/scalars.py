"""Column expressions for the identifiers, paths and parameters of an experiment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def config_part(column: str, i: int) -> Column:
    """Part ``i`` (from 1) of ``backend:type:hash``; null where there are fewer."""
    return F.try_element_at(F.split(column, ":"), F.lit(i))


def parse_list(column: str) -> Column:
    """JSON list text as an array; text that is no list is one element; null is empty."""
    text = F.col(column)
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.coalesce(F.when(F.trim(text).startswith("["), F.from_json(text, "array<string>")), F.array(text)))


def scalar_of(parsed: Column) -> Column:
    """The element of a list of one, as a number where it is one."""
    return F.when(F.size(parsed) == 1, parsed[0].try_cast("double"))


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)\.[^./\\]+$", 1)


def join_path(folder: Column, name: Column) -> Column:
    """Folder without trailing slashes, slash, name; backslashes become slashes."""
    return F.regexp_replace(F.concat(F.regexp_replace(folder, r"[/\\]+$", ""), F.lit("/"), name), r"\\", "/")


def output_path(path: Column, root: str, variant: Column) -> Column:
    """``parent/stem__variant.tiff`` relative to the root; a path outside it keeps its name only."""
    relative = F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 20)).otherwise(F.regexp_extract(path, r"([^/\\]+)$", 1))
    return F.concat(F.regexp_replace(F.regexp_replace(relative, r"^/+", ""), r"\.[^./\\]+$", ""), F.lit("__"), variant, F.lit(".tiff"))


def task_path(root: str, values: list[Column], index: Column, flat: bool = False, suffix: str = ".tiff") -> Column:
    """Where a task's result goes: a folder for each value and the index as name, or one name of all, without slashes."""
    values = [v.cast("string") for v in values]
    if flat:
        name = F.regexp_replace(F.concat_ws("_", *values), "/", "_")
        return F.concat(F.lit(f"{root.rstrip('/')}/"), name, F.lit("_"), index.cast("string"), F.lit(suffix))
    return F.concat(F.concat_ws("/", F.lit(root.rstrip("/")), *values, index.cast("string")), F.lit(suffix))


def stable_hash(**params: Column) -> Column:
    """The first 16 hex digits of the SHA-1 of the parameters as JSON with sorted keys and floats of 8 places."""
    parts = [F.concat(F.lit(f'"{k}":'), v) for k, v in sorted(params.items())]
    return F.substring(F.sha1(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))), 1, 16)


def number_text(value: Column) -> Column:
    """A number as text, of 8 places without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(value.cast("decimal(30,8)").cast("string"), r"0+$", ""), r"\.$", "")


def hex_number(text: Column, digits: int = 8) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def seed_of(key: Column, salt: str = "") -> Column:
    """A seed below 2^31 - 1 from a row's key."""
    return hex_number(F.concat(key, F.lit(salt))) % F.lit(2147483647)


def uniform_of(key: Column) -> Column:
    """A number in (0, 1) from a key."""
    return (hex_number(key) + F.lit(0.5)) / F.lit(4294967296.0)


def checkpoint_entry(df: DataFrame, keys: list[str], model_keys: list[str], optional: list[str], output: str, prefix: str = "Metadata_Model_") -> DataFrame:
    """One row for each finished task: keys, prefixed model keys, optional columns (null where absent), output path. A task without
    a path is an error, so there are as many paths as tasks."""
    path = F.coalesce(F.col(output).cast("string"), F.raise_error(F.lit("a finished task has no output path")).cast("string"))
    extra = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in optional]
    return df.select(*keys, *[F.col(c).alias(prefix + c) for c in model_keys], *extra, path.alias("output_file"))
