"""N-gram Jaccard join: near duplicates by token-combination prefixes.

A document's tokens are its distinct five-word shingles. All documents order tokens alike, rare ones first (a count
sketch of the whole corpus gives each token a frequency class). A document is indexed under keys made from the
head of its order: rare tokens by themselves, frequent tokens in pairs of the same class (frequent tokens are
dealt into classes by hash, so a document has few pairs). The head is extended until

    (rare tokens) + sum over classes of (frequent tokens - 1)  >  tokens that a partner may lack,

so two documents that link always share a key: in the head that ends first, fewer tokens are missing in the partner
than it would take to leave every rare token and every pair of every class unshared.

Documents with equal sets are one class and compared once. Candidates are found in two rounds, so that no group of
copies is expanded into all pairs: first every key's documents are verified against one leader (the one whose
tokens are most common, which is the original of near copies), and linked ones merge into components; then those
pairs that share a key but not a component are verified, until every pair that shares a key is verified or in one
component. These meet by key and size, as partners' sizes differ by a third at most. Verification counts common shingles exactly.

Texts that are null, empty or without words have an empty set and link with nothing; rows with equal texts always
link (if the text has a word); a repeated doc_id is a document for each row; rows with a null id take the component
of their text. Other columns, of whatever name, are not read; an empty table gives no rows. Shingles are compared as 64-bit
hashes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm.common import grams_of, drop_stored, list_array, mix, slices, small_batches, stored, words_of
from platewise.llm.graph import components
from platewise.llm.sketches import STEPS, bitmap, count_classes, in_bitmap, power_of_two

K = 5
#: Linked if 100 * intersection >= 75 * union, that is 7 * intersection >= 3 * (size + size).
NUMERATOR, DENOMINATOR = 3, 7
#: About so many frequent tokens of a head fall in one class.
CLASS_TOKENS = 12
#: Least and most bits of a bitmap (at most 32 MB), and bits for each key between them.
BITMAP_BITS, BITS_EACH = (1 << 20, 1 << 28), 8
#: Base of the sizes' logarithm by which pairs meet; above 4/3, so partners are in the same or in neighbouring steps.
SIZE_STEP = 1.34


# --- sets -----------------------------------------------------------------------------------------------------
def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and each text's bounds in them."""
    words, bounds = words_of(texts)
    grams, gram_bounds = grams_of(words, bounds, K)
    n = np.diff(bounds)
    owner = np.repeat(np.arange(len(n)), np.diff(gram_bounds))
    short = np.flatnonzero((n > 0) & (n < K))
    if len(short):
        whole = []
        for i in short:
            w = words[bounds[i] : bounds[i + 1]]
            g, _ = grams_of(w, np.array([0, len(w)]), len(w), seed=int(len(w)))
            whole.append(g[0])
        grams, owner = np.concatenate([grams, np.array(whole, np.uint64)]), np.concatenate([owner, short])
    if len(n) == 1:
        # A long text is alone.
        grams.sort()
        grams = grams[np.concatenate([np.ones(min(1, len(grams)), bool), grams[1:] != grams[:-1]])]
        return grams, np.array([0, len(grams)], np.int64)
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    first = np.ones(len(grams), bool)
    first[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[first], owner[first]
    return grams, np.searchsorted(owner, np.arange(len(n) + 1)).astype(np.int64)


def class_hashes(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set: equal sets are one class."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)))])
    return mix((total[bounds[1:]] - total[bounds[:-1]]) ^ mix(np.diff(bounds).astype(np.uint64)))


# --- heads ----------------------------------------------------------------------------------------------------
@functools.lru_cache(maxsize=1)
def level_starts() -> np.ndarray:
    """Sizes at which levels begin: partners' levels differ by one at most."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, -(-4 * out[-1] // 3)))
    return np.array(out, np.int64)


def level_of(n: np.ndarray | int) -> np.ndarray | int:
    return np.searchsorted(level_starts(), n, side="right") - 1


def may_lack(n, least_partner):
    """The most tokens of a set of ``n`` that a partner of at least ``least_partner`` may lack."""
    return n + (-(NUMERATOR * (n + least_partner)) // DENOMINATOR)


def least_partner(n):
    return -(-3 * n // 4)


def head_keys(tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of one set whose tokens stand in the common order, and the ``lack`` of each: if no earlier key is shared, the
    partner lacks so many of the tokens before."""
    n = len(tokens)
    level = int(level_of(n))
    starts = level_starts()
    singles, keys, lacks = 0, [], []
    for at in (level, level - 1):
        if at < 0:
            continue
        smallest = max(least_partner(n), int(starts[at]))
        if smallest > (n if at == level else int(starts[at + 1]) - 1):
            continue
        quota = may_lack(n, smallest) + 1
        classes = max(1, int(starts[at]) // CLASS_TOKENS)
        cls = (mix(tokens) % np.uint64(classes)).astype(np.int64)
        # Each rare token adds one; a frequent token adds one unless it is the first of its class.
        adds = ~frequent
        f = np.flatnonzero(frequent)
        later = np.ones(len(f), bool)
        later[np.unique(cls[f], return_index=True)[1]] = False
        adds[f] |= later
        sums = np.cumsum(adds)
        end = int(np.searchsorted(sums, quota)) + 1
        singles = max(singles, end)
        f = f[f < end]
        f = f[np.argsort(cls[f], kind="stable")]
        bounds = np.flatnonzero(np.concatenate([[True], cls[f][1:] != cls[f][:-1], [True]])) if len(f) else np.zeros(1, int)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a > 1:
                i, j = np.triu_indices(b - a, 1)
                x, y = tokens[f[a:b]][i], tokens[f[a:b]][j]
                keys.append(mix(np.minimum(x, y) * np.uint64(3) + mix(np.maximum(x, y)) + np.uint64(at + 1)))
                # The later of both tokens adds one itself, as it is not the first of its class.
                lacks.append(sums[f[a:b]][np.maximum(i, j)] - 1)
    rare = np.flatnonzero(~frequent[:singles])
    return np.concatenate([tokens[rare], *keys]), np.concatenate([rare, *lacks])


def index_rows(grams: np.ndarray, bounds: np.ndarray, classes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all sets, each key's set and lack, and each set's rank as a leader (least: most common tokens)."""
    n = np.diff(bounds)
    owner = np.repeat(np.arange(len(n)), n)
    c = classes[(grams & np.uint64(len(classes) - 1)).astype(np.int64)]
    order = np.lexsort((grams, c, owner))
    tokens, c = grams[order], c[order]
    frequent = c > limit
    sums = np.concatenate([[0], np.cumsum(c.astype(np.int64))])
    rank = 4096 - 16 * (sums[bounds[1:]] - sums[bounds[:-1]]) // np.maximum(n, 1)
    # Sets without a frequent token in the plain head need no loop.
    place = np.arange(len(tokens)) - np.repeat(bounds[:-1], n)
    quota = may_lack(n, least_partner(n)) + 1
    head = place < np.repeat(quota, n)
    hot = np.zeros(len(n), bool)
    hot[owner[head & frequent]] = True
    plain = head & ~np.repeat(hot, n)
    keys, owners, lacks = [tokens[plain]], [owner[plain]], [place[plain]]
    for i in np.flatnonzero(hot):
        k, lack = head_keys(tokens[bounds[i] : bounds[i + 1]], frequent[bounds[i] : bounds[i + 1]])
        keys.append(k)
        owners.append(np.full(len(k), i))
        lacks.append(lack)
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(lacks), rank


# --- jobs -----------------------------------------------------------------------------------------------------
def set_table(df: DataFrame) -> DataFrame:
    """doc_id, n_shingles, c (hash of the set) of every row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                grams, bounds = shingle_sets(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), pa.array(class_hashes(grams, bounds).view(np.int64))], names=["doc_id", "n_shingles", "c"])

    return df.mapInArrow(run, "doc_id long, n_shingles long, c long")


def _batch_sets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for part in slices(batch, "text"):
        yield shingle_sets(part.column(1))[0]


def key_table(df: DataFrame, classes: np.ndarray, limit: int, known: np.ndarray | None = None) -> DataFrame:
    """key, c, n, rank, lack for all keys of all documents; with a bitmap, for those keys only whose bit is set."""
    table = df.sparkSession.sparkContext.broadcast((classes, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                grams, bounds = shingle_sets(batch.column(1))
                c, n = class_hashes(grams, bounds).view(np.int64), np.diff(bounds)
                classes, known = table.value
                keys, owner, lack, rank = index_rows(grams, bounds, classes, limit)
                if known is not None:
                    take = in_bitmap(known, keys)
                    keys, owner, lack = keys[take], owner[take], lack[take]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(c[owner]), pa.array(n[owner].astype(np.int32)), pa.array(rank[owner].astype(np.int32)), pa.array(lack.astype(np.int32))], names=["key", "c", "n", "rank", "lack"])

    return df.mapInArrow(run, "key long, c long, n int, rank int, lack int")


def key_bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """A bitmap of stored keys. A larger table makes it larger, up to its most, and beyond that less sharp, never wrong."""
    return bitmap(keys, column, power_of_two(BITS_EACH * keys.count(), *BITMAP_BITS))


def fetch_sets(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """(c, grams) of the sets in stored pairs (a, b), one row each. A bitmap keeps most other sets off the shuffle, and a join
    drops the rest of them."""
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct(), "wanted")
    table = df.sparkSession.sparkContext.broadcast(key_bitmap(wanted, "c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                grams, bounds = shingle_sets(batch.column(1))
                c = class_hashes(grams, bounds)
                take = in_bitmap(table.value, c) & (np.diff(bounds) > 0)
                # Copies in one piece are sent once.
                _, first = np.unique(c, return_index=True)
                some = np.zeros(len(c), bool)
                some[first] = True
                sets = list_array(grams, bounds)
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)), sets], names=["c", "grams"]).filter(pa.array(take & some))

    rows = df.mapInArrow(run, "c long, grams array<long>").join(wanted, "c", "left_semi")
    return rows.groupBy("c").agg(F.any_value("grams").alias("grams"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) whose sets link. ``a`` may be a leader of many pairs: its set joins first, while rows are small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                p, q = x[i].values.to_numpy(), y[i].values.to_numpy()
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                common = int((q[at] == p).sum())
                keep[i] = DENOMINATOR * common >= NUMERATOR * (len(p) + len(q))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    # Signed order, as the arrays are searched as signed longs.
    a = sets.select(F.col("c").alias("a"), F.array_sort("grams").alias("x"))
    b = sets.select(F.col("c").alias("b"), F.array_sort("grams").alias("y"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def may_link(n: str, lack: str, m: str, other_lack: str) -> Column:
    """Whether sets of sizes ``n`` and ``m`` can link if this key is the first that they share: what each must lack
    before the key leaves enough common tokens."""
    common = F.ceil((F.col(n) + F.col(m)) * NUMERATOR / DENOMINATOR)
    return (F.col(n) - F.col(lack) >= common) & (F.col(m) - F.col(other_lack) >= common)


def size_step(n: str) -> Column:
    return F.floor(F.log(F.col(n)) / F.log(F.lit(SIZE_STEP))).cast("int")


def links(df: DataFrame, total: int) -> DataFrame:
    """Pairs (a, b) of set hashes whose components are those of the whole join: the stars of the first round's components, and
    the second round's links. ``total`` shingles are expected."""
    classes, mean = count_classes(df.select("doc_id", "text"), _batch_sets, total)
    # Frequent: clearly above what chance puts into one counter.
    limit = int(STEPS * np.log2(1 + mean + 8 * np.sqrt(mean) + 64))
    keys = stored(shared_keys(df, classes, limit), "keys")
    # Stored, as Spark splits a hot key where plain tables join, and not where one of them is an aggregate.
    lead = stored(keys.groupBy("key").agg(F.min(F.struct("rank", "c", "n", "lack")).alias("lead")), "lead")
    near = keys.join(lead, "key").filter(F.col("c") != F.col("lead.c")).filter(may_link("n", "lack", "lead.n", "lead.lack"))
    first = stored(near.select(F.col("lead.c").alias("a"), F.col("c").alias("b")).distinct(), "pairs")
    drop_stored(lead)
    done = stored(verified(first, fetch_sets(df, first)), "links")
    # What shares a key but not a component yet.
    roots = stored(components(done), "roots")
    labelled = keys.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    mixed = stored(labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter(F.col("low") != F.col("high")).select("key"), "several")
    left = stored(labelled.join(mixed, "key").select("key", "c", "n", "lack", "root"), "mixed")
    drop_stored(keys, done, mixed)
    own = left.select("key", F.col("c").alias("a"), "n", "lack", "root", size_step("n").alias("step"))
    near_steps = F.explode(F.array(*[size_step("n") + k for k in (-1, 0, 1)])).alias("step")
    other = left.select("key", F.col("c").alias("b"), F.col("n").alias("m"), F.col("lack").alias("other_lack"), F.col("root").alias("other"), near_steps)
    cross = own.join(other, ["key", "step"]).filter((F.col("a") < F.col("b")) & (F.col("root") != F.col("other"))).filter(may_link("n", "lack", "m", "other_lack"))
    tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = stored(cross.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    drop_stored(left, first)
    more = stored(verified(second, fetch_sets(df, second)), "links")
    drop_stored(second)
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)


def shared_keys(df: DataFrame, classes: np.ndarray, limit: int) -> DataFrame:
    """The rows of keys that at least two documents have, one for each set.

    Most keys belong to one document. The keys are counted first, alone; then the rows are made again, only where a bitmap
    of the repeated keys says so, and an exact join removes what the bitmap lets through."""
    several = stored(key_table(df, classes, limit).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "several")
    rows = key_table(df, classes, limit, key_bitmap(several, "key"))
    return rows.join(several, "key", "left_semi").distinct()


def near_duplicates(df: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) of every row of (doc_id, text)."""
    # All that runs in Python is stored by then.
    with small_batches(df.sparkSession):
        return _near_duplicates(df)


def _near_duplicates(df: DataFrame) -> DataFrame:
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = stored(set_table(docs), "sets")
    total = table.agg(F.sum("n_shingles")).first()[0] or 0
    nodes = table.filter("n_shingles > 0").groupBy("c").agg(F.min("doc_id").alias("low"))
    roots = stored(components(links(docs, total)), "roots")
    # Stored, so that the joins with them are between plain tables, whose skewed keys (a large component) Spark splits.
    linked = stored(nodes.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c")), "linked")
    lowest = stored(linked.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")
    found = stored(linked.join(lowest, "root").select("c", "component_id"), "found")
    out = table.join(found, "c", "left")
    alone = F.col("n_shingles") == 0
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: DuckDB SQL of the same components: all pairs that share a shingle are counted, then labels spread along links.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM w
), x AS (
  SELECT doc_id, len(s) AS n, hash(unnest(s)) AS g FROM s
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id
    AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a
), m AS (
  SELECT node, min(seen) AS low FROM r GROUP BY node
)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, coalesce(low, s.doc_id) AS component_id FROM s LEFT JOIN m ON s.doc_id = m.node"""
