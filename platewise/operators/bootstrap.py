"""Sums of resampled rows, for any number of analyses of one table at a time.

Rows are shuffled by a bucket of their hash, sorted there and packed: for each analysis and group an array of each number, in as few
bytes as hold it exactly. Packed rows are shuffled to blocks of a group. A block's task makes the draws of its group again, by the hash
that defines them, counts those that fall into the block and multiplies the counts with its rows. So no draw is shuffled.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.operators.sampling import draw_order

#: Hex digits of the hash that deal rows to buckets.
PIECE_DIGITS = 2
#: Rows in a block of a group, about, and resamples whose counts a task holds at a time.
ROWS, AT_ONCE = 1 << 23, 8
#: Draws hashed at a time, and rows whose counts are multiplied at a time: both fit into a core's cache.
HASHED, MULTIPLIED = 32768, 16384
#: Rows of a stretch that a resample without replacement is dealt to.
DEALT = 4096


@dataclass(frozen=True)
class Analysis:
    """y on x1 and x2 in each group of the rows where ``where`` holds; a categorical x2 is a level."""

    name: str
    groups: tuple[str, ...]
    y: str
    x1: str
    x2: str
    categorical: bool = False
    where: str = "true"

    @property
    def numbers(self) -> list[str]:
        return ["y", "a"] if self.categorical else ["y", "a", "b"]


def products(columns: list[str]) -> dict[str, tuple[str, ...]]:
    """Names of the weighted sums of the columns and of their products, and what each multiplies."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    return {"w": (), **{f"s_{c}": (c,) for c in columns}, **{f"s_{a}_{b}": (a, b) for a, b in pairs}}


SUMS = list(products(["y", "a", "b"]))
#: What is known of a group.
HEAD = ["n_group_rows", "n_boot_rows", "_prefix", "m_y", "m_a", "m_b"]


# --- draws ----------------------------------------------------------------------------------------------------
def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 32-bit numbers (in 64 bits): shifts, exclusive ors and products, which SQL has too."""
    for _ in range(2):
        x = ((x ^ (x >> 16)) * 73244475) & 0xFFFFFFFF
    return x ^ (x >> 16)


def _mix(x: np.ndarray, spare: np.ndarray) -> None:
    """The same in place and in 32 bits, whose products drop what is beyond."""
    for _ in range(2):
        np.right_shift(x, 16, out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, np.uint32(73244475), out=x)
    np.right_shift(x, 16, out=spare)
    np.bitwise_xor(x, spare, out=x)


def hashed_draws(size: int) -> np.ndarray:
    """Hashes of the draws of a resample, which all resamples of a group share."""
    return np.concatenate([mixed(np.arange(at + 1, min(at + HASHED, size) + 1)).astype(np.uint32) for at in range(0, size, HASHED)])


def drawn_places(draws: np.ndarray, prefix: str, boot: int, n: int, start: int, length: int) -> np.ndarray:
    """Places in the block of the draws that fall into it. A draw takes the row whose number is a hash of the draw under a key, the
    MD5 of seed, group and resample (52 bits, modulo the rows). These are whole numbers below 2^53, so doubles divide them exactly: the
    quotient is made a little too small, never too large, and where it misses the rest is still n or more."""
    key = hashlib.md5(f"{prefix}|{boot}".encode()).hexdigest()
    high, low = (np.uint32(int(key[k : k + 8], 16)) for k in (0, 8))
    inverse = np.nextafter(np.nextafter(1.0 / n, 0.0), 0.0)
    h, l, spare = (np.empty(HASHED, np.uint32) for _ in range(3))
    x, q = np.empty(HASHED), np.empty(HASHED)
    out, found = np.empty(len(draws), np.int64), 0
    for at in range(0, len(draws), HASHED):
        some = draws[at : at + HASHED]
        if len(some) < HASHED:
            h, l, spare, x, q = (v[: len(some)] for v in (h, l, spare, x, q))
        for v, k in ((h, high), (l, low)):
            np.bitwise_xor(some, k, out=v)
            _mix(v, spare)
        np.right_shift(l, 12, out=l)
        np.multiply(h, 1048576.0, out=x)
        np.add(x, l, out=x)
        np.multiply(x, inverse, out=q)
        np.floor(q, out=q)
        np.multiply(q, float(n), out=q)
        np.subtract(x, q, out=x)
        while x.max() >= n:
            x[x >= n] -= n
        if length == n:
            out[at : at + len(some)] = x
            found += len(some)
        else:
            own = x[(x >= start) & (x < start + length)]
            out[found : found + len(own)] = own
            found += len(own)
    out = out[:found]
    return out if length == n else out - start


def dealt_places(prefix: str, boot: int, n: int, size: int, start: int, length: int) -> np.ndarray:
    """The same without replacement: a seeded generator deals a resample's rows to stretches, and then picks them in each."""
    rng = np.random.default_rng(list(hashlib.md5(f"{prefix}|{boot}".encode()).digest()))
    lengths = np.append(np.full((n - 1) // DEALT, DEALT), (n - 1) % DEALT + 1)
    out = []
    for k, (own, m) in enumerate(zip(lengths, rng.multivariate_hypergeometric(lengths, size, method="marginals"), strict=True)):
        picked = rng.choice(own, m, replace=False) + k * DEALT - start
        out.append(picked[(picked >= 0) & (picked < length)])
    return np.concatenate(out)


def _counts(places: np.ndarray, length: int) -> np.ndarray:
    """How often each place occurs, in bytes where that is enough: a byte that ran over shows in their sum."""
    out = np.zeros(length, np.uint8)
    np.add.at(out, places, np.uint8(1))
    return out if out.sum(dtype=np.int64) == len(places) else np.bincount(places, minlength=length)


# --- packed rows ----------------------------------------------------------------------------------------------
def _packed(values: np.ndarray) -> tuple[str, bytes]:
    """The numbers in the smallest of a few types that holds all of them exactly."""
    for kind in (np.int8, np.float32):
        with np.errstate(all="ignore"):
            small = values.astype(kind)
        if (small == values).all():
            return small.dtype.char, small.tobytes()
    return values.dtype.char, values.tobytes()


def _level_text(df: DataFrame, level: str) -> Column:
    """A level as text, by which its sums meet; a negative zero is a zero, as in a group."""
    c = F.col(level)
    return (c + F.lit(0.0) if isinstance(df.schema[level].dataType, T.DoubleType | T.FloatType) else c).cast("string")


def _tie(df: DataFrame, keys: list[str]) -> Column:
    """What orders rows of one hash: their keys, where the hash does not tell these apart (text, and keys that are missing)."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.lit(True))
    plain = not any(isinstance(df.schema[k].dataType, T.StringType) for k in keys)
    return F.when(~known if plain else F.lit(True), F.struct(*keys))


def _inputs(df: DataFrame, keys: list[str], analyses: list[Analysis], seed: str) -> tuple[DataFrame, list[list[str]], list[str]]:
    """Groups, bucket, hash, tie, every number and level once, and ``_in<i>``: does the row belong to analysis i? Also the names of
    the numbers (and level) of each analysis."""
    groups = list(dict.fromkeys(g for a in analyses for g in a.groups))
    columns: dict[tuple[str, bool], str] = {}
    own = []
    for a in analyses:
        own.append([columns.setdefault((c, k), f"_v{len(columns)}") for c, k in ((a.y, False), (a.x1, False), (a.x2, a.categorical))])
    rows = df.select(
        *groups, F.unhex(draw_order(seed, *keys)).alias("_h"), _tie(df, keys).alias("_tie"),
        *[(_level_text(df, c) if level else F.col(c).try_cast("double")).alias(v) for (c, level), v in columns.items()],
        *[F.expr(a.where).alias(f"_where{i}") for i, a in enumerate(analyses)],
        *[(F.isnan(c) if isinstance(df.schema[c].dataType, T.DoubleType | T.FloatType) else F.lit(False)).alias(f"_nan_{c}") for c in {*groups, *(c for c, level in columns if level)}],
    )
    finite = lambda v: F.col(v).isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    known = lambda v, c: F.col(v).isNotNull() & ~F.col(f"_nan_{c}")
    member = {}
    for i, (a, names) in enumerate(zip(analyses, own, strict=True)):
        tests = [F.coalesce(F.col(f"_where{i}"), F.lit(False)), *[known(g, g) for g in a.groups], finite(names[0]), finite(names[1]), known(names[2], a.x2) if a.categorical else finite(names[2])]
        member[f"_in{i}"] = reduce(lambda x, y: x & y, tests)
    rows = rows.withColumns(member).filter(reduce(lambda x, y: x | y, [F.col(m) for m in member]))
    rows = rows.withColumn("_bucket", F.substring(F.hex("_h"), 1, PIECE_DIGITS)).select(*groups, "_bucket", "_h", "_tie", *columns.values(), *member)
    return rows, own, groups


def group_table(rows: DataFrame, own: list[list[str]], analyses: list[Analysis], groups: list[str], fraction: float | None, least: int, seed: str) -> DataFrame:
    """From one scan a row for each analysis and group: number of rows, size of a resample, means. An analysis has nulls for groups that are
    not its own."""
    sums = lambda i, a: [F.count(F.when(F.col(f"_in{i}"), 1)).alias(f"_c{i}"), *[F.sum(F.when(F.col(f"_in{i}"), F.col(v))).alias(f"_s{i}{c}") for c, v in zip(a.numbers, own[i], strict=False)]]
    cells = rows.groupBy(*groups).agg(*[x for i, a in enumerate(analyses) for x in sums(i, a)])
    each = [F.struct(F.lit(i).alias("_a"), *[(F.col(g) if g in a.groups else F.lit(None).cast(cells.schema[g].dataType)).alias(g) for g in groups], F.col(f"_c{i}").alias("_c"), *[(F.col(f"_s{i}{c}") if c in a.numbers else F.lit(0.0)).alias(f"_s{c}") for c in "yab"]) for i, a in enumerate(analyses)]
    cells = cells.select(F.inline(F.array(*each))).filter("_c > 0")
    n = F.sum("_c")
    counted = cells.groupBy("_a", *groups).agg(n.alias("n_group_rows"), *[(F.sum(f"_s{c}") / n).alias(f"m_{c}") for c in "yab"])
    size = F.greatest(F.lit(2), F.bround(F.col("n_group_rows") * F.lit(fraction))).cast("long") if fraction else F.col("n_group_rows")
    prefix = F.element_at(F.array(*[F.concat_ws("|", F.lit(seed), *[F.col(g).cast("string") for g in a.groups]) for a in analyses]), F.col("_a") + 1)
    return counted.filter(F.col("n_group_rows") >= least).select("_a", *groups, *HEAD[:1], size.alias("n_boot_rows"), prefix.alias("_prefix"), *HEAD[3:])


def packed_rows(rows: DataFrame, sizes: DataFrame, own: list[list[str]], analyses: list[Analysis], groups: list[str]) -> DataFrame:
    """Rows of a group in order, some thousands in a record: their bucket, where in it they start, how many they are, and each number as
    bytes. A block of a group is a range of buckets, and later blocks get a record of the number alone. Rows of a bucket meet what is
    known of the groups in one task, groups first."""
    n_buckets = 16**PIECE_DIGITS
    bucket = F.explode(F.sequence(F.lit(0), F.lit(n_buckets - 1)))
    heads = sizes.select(*groups, bucket.alias("_bucket"), F.struct("_a", *HEAD).alias("_head")).withColumn("_bucket", F.lpad(F.hex("_bucket"), PIECE_DIGITS, "0"))
    data = [v for v in rows.columns if v.startswith(("_v", "_in"))]
    both = rows.unionByName(heads, allowMissingColumns=True)
    both = both.repartition("_bucket").sortWithinPartitions("_bucket", F.desc(F.col("_head").isNotNull()), "_h", "_tie", *[v for v in data if v.startswith("_v")])
    both = both.select(*groups, "_bucket", "_head", *data)
    fields = {s.name: s for s in sizes.schema.fields}
    chunk = [T.StructField("_bucket", T.LongType()), T.StructField("_at", T.LongType()), T.StructField("_k", T.LongType()), T.StructField("_kinds", T.StringType()), T.StructField("_levels", T.StringType()), *[T.StructField(f"_d{j}", T.BinaryType()) for j in range(3)]]
    schema = T.StructType([T.StructField("_a", T.IntegerType()), *[T.StructField(g, fields[g].dataType) for g in groups], T.StructField("_block", T.LongType()), *[fields[h] for h in HEAD], *chunk])
    limit = ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, known, seen = None, {}, {}
        for batch in batches:
            table = {c: batch.column(c) for c in batch.schema.names}
            names = table["_bucket"].dictionary_encode()
            cuts = [0, *(np.flatnonzero(np.diff(names.indices.to_numpy())) + 1).tolist(), len(names)]
            values = {v: c.to_numpy(zero_copy_only=False) for v, c in table.items() if v.startswith("_v") and pa.types.is_floating(c.type)}
            texts = {v: table[v].dictionary_encode() for v in table if v.startswith("_v") and v not in values}
            inside = {v: np.asarray(c.fill_null(False)) for v, c in table.items() if v.startswith("_in")}
            is_head = np.asarray(table["_head"].is_valid())
            codes = {}
            for g in groups:
                code = table[g].dictionary_encode(null_encoding="encode")
                codes[g] = (code.indices.to_numpy(zero_copy_only=False), code.dictionary.to_pylist())
            out: list[dict] = []
            for first, last in zip(cuts, cuts[1:], strict=False):
                if names[first].as_py() != bucket:
                    bucket, known, seen = names[first].as_py(), {}, {}
                heads = first + np.flatnonzero(is_head[first:last])
                for i in heads:
                    h = table["_head"][int(i)].as_py()
                    known[(h["_a"], *[codes[g][1][codes[g][0][i]] for g in groups])] = h
                for a, analysis in enumerate(analyses):
                    at = first + np.flatnonzero(inside[f"_in{a}"][first:last])
                    if not len(at):
                        continue
                    label = np.zeros(len(at), np.int64)
                    for g in analysis.groups:
                        label = label * len(codes[g][1]) + codes[g][0][at]
                    order = np.argsort(label, kind="stable")
                    at, label = at[order], label[order]
                    for mine in np.split(at, np.flatnonzero(label[1:] != label[:-1]) + 1):
                        group = {g: codes[g][1][codes[g][0][mine[0]]] if g in analysis.groups else None for g in groups}
                        key = (a, *group.values())
                        h = known.get(key)
                        if h is None:  # a group of too few rows
                            continue
                        blocks = -(-h["n_group_rows"] // limit)
                        number = int(bucket, 16)
                        block = number * blocks // n_buckets
                        one = {"_a": a, **group, **{k: h[k] for k in HEAD}, "_bucket": number, "_at": seen.get(key, 0), "_k": len(mine)}
                        seen[key] = seen.get(key, 0) + len(mine)
                        packs = [_packed(values[v][mine]) for v in own[a][: len(analysis.numbers)]]
                        levels = None
                        if analysis.categorical:
                            which, level = np.unique(texts[own[a][2]].indices.to_numpy(zero_copy_only=False)[mine], return_inverse=True)
                            levels = json.dumps([texts[own[a][2]].dictionary[int(w)].as_py() for w in which])
                            packs.append(_packed(level))
                        out.append({**one, "_block": block, "_kinds": "".join(k for k, _ in packs), "_levels": levels, **{f"_d{j}": x for j, (_, x) in enumerate(packs)}})
                        out.extend({**one, "_block": later} for later in range(block + 1, blocks))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return both.mapInArrow(run, schema)


# --- sums -----------------------------------------------------------------------------------------------------
def _products_of(values: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([reduce(np.multiply, [values[c] for c in cs]) if cs else np.ones(len(values["y"])) for cs in products(list(values)).values()], axis=1)


class _Block:
    """The rows of a block for one analysis, put together from packed records in any order."""

    def __init__(self, records: list[dict], numbers: list[str], categorical: bool) -> None:
        self.head, self.numbers, self.categorical = {k: v for k, v in records[0].items() if not k.startswith("_d")}, numbers, categorical
        self.start = sum(r["_k"] for r in records if r["_kinds"] is None)
        records = sorted((r for r in records if r["_kinds"] is not None), key=lambda r: (r["_bucket"], r["_at"]))
        self.length = sum(r["_k"] for r in records)
        self.columns: list[np.ndarray | None] = [None] * (len(numbers) + categorical)
        self.levels: dict[str, int] = {}
        at = 0
        for r in records:
            self._put(at, r)
            at += r["_k"]

    def _put(self, at: int, record: dict) -> None:
        for j, kind in enumerate(record["_kinds"]):
            values = np.frombuffer(record.pop(f"_d{j}"), kind)
            if j == len(self.numbers):
                values = np.array([self.levels.setdefault(x, len(self.levels)) for x in json.loads(record["_levels"])], np.int32)[values.astype(np.int64)]
                values = values.astype(np.int16) if len(self.levels) < 1 << 15 else values
            have = self.columns[j]
            kind = values.dtype if have is None else np.promote_types(have.dtype, values.dtype)
            if have is None:
                self.columns[j] = np.empty(self.length, kind)
            elif kind != have.dtype:
                self.columns[j] = have.astype(kind)
            self.columns[j][at : at + len(values)] = values

    @property
    def draws(self) -> tuple:
        """What decides the counts."""
        return self.head["_prefix"], self.head["n_group_rows"], self.head["n_boot_rows"], self.start, self.length

    def sums(self, counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The sums about the group's means of each level (or of all rows) and resample, with zeros for sums of b in a level."""
        out = np.zeros((max(1, len(self.levels)), len(counts), len(SUMS)))
        place = [SUMS.index(s) for s in products(self.numbers)]
        for at in range(0, self.length, MULTIPLIED):
            cut = slice(at, at + MULTIPLIED)
            table = _products_of({c: self.columns[j][cut].astype(float) - self.head[f"m_{c}"] for j, c in enumerate(self.numbers)})
            weight = np.stack([c[cut] for c in counts])
            if not self.categorical:
                out[0][:, place] += weight.astype(float) @ table
                continue
            level = self.columns[-1][cut]
            order = np.argsort(level, kind="stable")
            weight, table, level = weight[:, order], table[order], level[order]
            edges = [0, *(np.flatnonzero(level[1:] != level[:-1]) + 1), len(level)]
            for first, last in zip(edges, edges[1:], strict=False):
                out[level[first]][:, place] += weight[:, first:last].astype(float) @ table[first:last]
        return out


def resampled_sums(df: DataFrame, keys: list[str], analyses: list[Analysis], n_boot: int, fraction: float | None, least: int, replace: bool, seed: str) -> tuple[DataFrame, DataFrame]:
    """``_a`` (the analysis), groups, boot_idx, level and sums about the means of the group; and the groups with number of rows, size
    of a resample and means. Groups of fewer than ``least`` rows are left out."""
    rows, own, groups = _inputs(df, keys, analyses, seed)
    sizes = group_table(rows, own, analyses, groups, fraction, least, seed)
    packed = packed_rows(rows, sizes, own, analyses, groups)
    fields = {s.name: s for s in packed.schema.fields}
    schema = T.StructType([fields["_a"], *[fields[g] for g in groups], T.StructField("boot_idx", T.IntegerType()), T.StructField("level", T.StringType()), *[T.StructField(s, T.DoubleType()) for s in SUMS]])
    at_once = AT_ONCE

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records: dict[int, list[dict]] = {}
        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            for i in range(batch.num_rows):
                record = {c: v[i].as_py() for c, v in columns.items()}
                records.setdefault(record["_a"], []).append(record)
        blocks = {a: _Block(records.pop(a), analyses[a].numbers, analyses[a].categorical) for a in list(records)}
        same: dict[tuple, list[int]] = {}
        for a, block in blocks.items():
            if block.length:
                same.setdefault(block.draws, []).append(a)
        for (prefix, n, size, start, length), members in same.items():
            draws = hashed_draws(size) if replace else None
            for first in range(0, n_boot, at_once):
                counts = []
                for boot in range(first, min(first + at_once, n_boot)):
                    places = drawn_places(draws, prefix, boot, n, start, length) if replace else dealt_places(prefix, boot, n, size, start, length)
                    counts.append(_counts(places, length))
                for a in members:
                    found = blocks[a].sums(counts)
                    which, boot = np.nonzero(found[:, :, 0])
                    names = [*blocks[a].levels] or [None]
                    columns = [pa.array(np.full(len(boot), a, np.int32)), *[pa.array([blocks[a].head[g]] * len(boot), type=arrow.field(g).type) for g in groups], pa.array((boot + first).astype(np.int32)), pa.array([names[w] for w in which], type=arrow.field("level").type), *[pa.array(x) for x in found[which, boot].T]]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    by = ["_a", *groups, "boot_idx", "level"]
    # Analyses of equal groups meet in a task, as those of equal rows share their draws.
    family = {g: i for i, g in enumerate(dict.fromkeys(a.groups for a in analyses))}
    which = F.element_at(F.array(*[F.lit(family[a.groups]) for a in analyses]), F.col("_a") + 1)
    sums = packed.groupBy(which.alias("_family"), *groups, "_block").applyInArrow(run, schema)
    return sums.groupBy(*by).agg(*[F.sum(s).alias(s) for s in SUMS]), sizes.drop("_prefix")
