"""Token ids in patched frame-of-reference files.

A file holds the ids of consecutive documents. They are cut into blocks of ``BLOCK`` ids; a block stores its
minimum, the differences to it packed at the width that a percentile of them needs, and an exception list
(position, difference) of those that are wider. After the blocks stand the index of block starts, the table of
documents, and a footer, so any block or document can be reached without decoding the ones before it.

    file   := "PFOR1\\0\\0\\0" block* starts documents footer
    block  := min u32, n u32, width u32, exceptions u32, packed bits, positions u32*, differences u32*
    starts := u64 for each block; documents := (doc_id i64)*, (is_null u8)*, (n_ids i64)*
    footer := starts' place u64, blocks u64, documents' place u64, documents u64

Tasks write to the cluster's shared folder, each attempt under a name of its own; the stored manifest lists the
files of the attempts that counted. Null texts count as empty (one end id); null ids sort first; repeated rows
stay, in order of id and text hash; other columns, of whatever name, are not read; an empty table gives no files and no
rows. A task holds one piece of texts and one group of blocks at a time.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from platewise.llm.common import file_system, mix, shared_folder, slices, spaced_parts, span_hashes, stored, string_buffers, word_spans

MAGIC = b"PFOR1\0\0\0"
BLOCK = 1024
GROUP = 64 * BLOCK
PERCENTILE = 0.9
FOOTER = 4 * 8


# --- blocks ---------------------------------------------------------------------------------------------------
def widths_of(diffs: np.ndarray, percentile: float = PERCENTILE) -> np.ndarray:
    """Bits that the percentile of each row's differences needs."""
    k = min(diffs.shape[1] - 1, int(percentile * diffs.shape[1]))
    at = np.partition(diffs, k, axis=1)[:, k].astype(np.float64)
    return np.where(at > 0, np.floor(np.log2(np.maximum(at, 1))) + 1, 0).astype(np.int64)


def encode_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """The blocks of one group of ids (its last block may be short)."""
    whole = len(ids) // BLOCK
    out: list[bytes] = [b""] * whole
    if whole:
        table = ids[: whole * BLOCK].reshape(whole, BLOCK)
        least = table.min(axis=1)
        diffs = table - least[:, None]
        widths = widths_of(diffs, percentile)
        for w in np.unique(widths):
            rows = np.flatnonzero(widths == w)
            part = diffs[rows]
            wide = (part >> np.uint32(w)) > 0 if w < 32 else np.zeros(part.shape, bool)
            bits = ((np.where(wide, 0, part)[:, :, None] >> np.arange(w, dtype=np.uint32)) & 1).astype(np.uint8)
            packed = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little") if w else np.zeros((len(rows), 0), np.uint8)
            for r, p, x, d in zip(rows, packed, wide, part, strict=True):
                at = np.flatnonzero(x).astype(np.uint32)
                head = np.array([least[r], BLOCK, w, len(at)], np.uint32)
                out[r] = head.tobytes() + p.tobytes() + at.tobytes() + d[at].tobytes()
    if len(rest := ids[whole * BLOCK :]):
        least = rest.min()
        diffs = rest - least
        w = int(widths_of(diffs[None], percentile)[0])
        wide = (diffs >> np.uint32(w)) > 0 if w < 32 else np.zeros(len(diffs), bool)
        bits = ((np.where(wide, 0, diffs)[:, None] >> np.arange(w, dtype=np.uint32)) & 1).astype(np.uint8)
        at = np.flatnonzero(wide).astype(np.uint32)
        head = np.array([least, len(rest), w, len(at)], np.uint32)
        out.append(head.tobytes() + np.packbits(bits.ravel(), bitorder="little").tobytes() + at.tobytes() + diffs[at].tobytes())
    return out


def decode_block(block: bytes | memoryview) -> np.ndarray:
    least, n, w, exceptions = (int(x) for x in np.frombuffer(block, np.uint32, 4))
    size = (n * w + 7) // 8
    diffs = np.zeros(n, np.uint32)
    if w:
        bits = np.unpackbits(np.frombuffer(block, np.uint8, size, 16), count=n * w, bitorder="little").reshape(n, w)
        for j in range(w):
            diffs |= bits[:, j].astype(np.uint32) << np.uint32(j)
    rest = np.frombuffer(bytes(block[16 + size :]), np.uint32)
    diffs[rest[:exceptions]] = rest[exceptions : 2 * exceptions]
    return diffs + np.uint32(least)


# --- encoding -------------------------------------------------------------------------------------------------
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b".,!?")] = True


class WordEncoder:
    """Ids of texts by way of their words: the vocabulary drops white space and case and never joins what white space
    separates, so each distinct word is encoded once and remembered under a 64-bit hash (at most ``most`` words). A
    run of ``.,!?`` that ends a word after a letter is a piece by itself, as the tokenizer cuts there too. The string of a
    special token, exactly as the vocabulary spells it, is that token wherever it stands, as with the tokenizer's defaults."""

    def __init__(self, vocabulary: str, most: int = 1_500_000):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        # Pieces are lower-cased before they are encoded, so special tokens are found before that, and not here.
        self.tokenizer.encode_special_tokens = True
        self.pattern = re.compile(b"|".join(re.escape(t.encode()) for t in sorted(self.special, key=len, reverse=True)) or rb"(?!)")
        self.most = most
        self.reset()

    def reset(self) -> None:
        # Open addressing: a hash's slot or the next free one; 0 is a free slot.
        slots = 1 << (2 * self.most - 1).bit_length()
        self.keys, self.place = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
        self.starts, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)
        if self.special:
            texts = pa.array(list(self.special))
            keys = pieces_of(texts, self.pattern)[1]
            self._keep(keys, np.array(list(self.special.values()), np.uint32), np.ones(len(keys), np.int64))

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers for each word, encoded many at a time between spaces and told apart by offsets."""
        ids, counts = [], []
        for i in range(0, len(words), 2000):
            group = [w.decode() for w in words[i : i + 2000]]
            e = self.tokenizer.encode(" ".join(group), add_special_tokens=False)
            ends = np.cumsum([len(w) + 1 for w in group])
            owner = np.searchsorted(ends, np.array([a for a, _ in e.offsets], np.int64), side="right")
            ids.append(np.array(e.ids, np.uint32))
            counts.append(np.bincount(owner, minlength=len(group)))
        return np.concatenate(ids), np.concatenate(counts)

    def _keep(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        value = np.arange(len(self.starts) - 1, len(self.starts) - 1 + len(keys), dtype=np.int32)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts)])
        self.flat = np.concatenate([self.flat, ids])
        mask = np.uint64(len(self.keys) - 1)
        slot = (keys & mask).astype(np.int64)
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            placed = self.keys[slot] == keys
            self.place[slot[placed]] = value[placed]
            keys, value, slot = keys[~placed], value[~placed], (slot[~placed] + 1) & int(mask)

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = len(self.keys) - 1
        place, known = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        left, slot = np.arange(len(h)), (h & np.uint64(mask)).astype(np.int64)
        while len(left):
            there = self.keys[slot]
            hit = there == h[left]
            place[left[hit]], known[left[hit]] = self.place[slot[hit]], True
            on = ~hit & (there != 0)
            left, slot = left[on], (slot[on] + 1) & mask
        return place, known

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids with the end id after each text, and the number of each text's ids. A long text is encoded in parts."""
        parts = [self._ids(part) for part in spaced_parts(texts)]
        ids = np.concatenate([p[0] for p in parts])
        counts = parts[0][1] if len(parts) == 1 else np.array([len(ids)])
        out = np.full(len(ids) + len(texts), end, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), counts)] = ids
        return out, counts + 1

    def _ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, h, s, e, bounds = pieces_of(texts, self.pattern)
        place, known = self._find(h)
        if not known.all():
            if len(self.starts) > self.most:
                self.reset()
                place, known = self._find(h)
            missing = np.flatnonzero(~known)
            keys, first = np.unique(h[missing], return_index=True)
            raw = data.tobytes()
            self._keep(keys, *self._encode([raw[s[i] : e[i]] for i in missing[first]]))
            place, known = self._find(h)
        starts, lengths = self.starts[place], self.starts[place + 1] - self.starts[place]
        ends = np.cumsum(lengths)
        ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)]
        return ids, np.diff(np.concatenate([[0], ends])[bounds])


def pieces_of(texts: pa.Array, special: re.Pattern[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes; hash, start and end of each piece of a word; and each text's bounds in the pieces. What ``special``
    matches inside a text is a piece by itself, whose hash no other piece has."""
    data, offs, s, e, bounds = word_spans(texts)
    if not len(s):
        return data, np.zeros(0, np.uint64), s, e, bounds
    # Matches are in the bytes before lower-casing, and inside one text.
    found = np.array([m.span() for m in special.finditer(string_buffers(texts)[0].tobytes())], np.int64).reshape(-1, 2)
    found = found[np.searchsorted(offs, found[:, 0], side="right") == np.searchsorted(offs, found[:, 1] - 1, side="right")]
    if len(found):
        a, b = found.T
        word = np.searchsorted(s, a, side="right") - 1
        s, e = np.unique(np.concatenate([s, a, b[b < e[word]]])), np.unique(np.concatenate([e, b, a[a > s[word]]]))
        bounds = np.searchsorted(s, offs)
    # The last byte of each word that is no punctuation, where that is a letter and punctuation follows.
    last = np.maximum.accumulate(np.where(_PUNCTUATION[data], -1, np.arange(len(data))))[e - 1]
    cut = (last >= s) & (last < e - 1) & (data[last] >= 0x61) & (data[last] <= 0x7A)
    extra = np.concatenate([[0], np.cumsum(cut)])
    starts, ends = np.empty(len(s) + extra[-1], np.int64), np.empty(len(s) + extra[-1], np.int64)
    body = np.arange(len(s)) + extra[:-1]
    starts[body], ends[body] = s, np.where(cut, last + 1, e)
    tail = body[cut] + 1
    starts[tail], ends[tail] = last[cut] + 1, e[cut]
    hashes = span_hashes(data, starts, ends)
    if len(found):
        own = np.searchsorted(starts, found[:, 0])
        hashes[own] = mix(hashes[own] ^ np.uint64(0x3C6EF372FE94F82B))
    return data, np.maximum(hashes, np.uint64(1)), starts, ends, bounds + extra[bounds]


@functools.lru_cache(maxsize=2)
def word_encoder(vocabulary: str) -> WordEncoder:
    return WordEncoder(vocabulary)


# --- files ----------------------------------------------------------------------------------------------------
MANIFEST = "part int, path string, n_docs long, n_ids long, n_bytes long"


def write_token_files(df: DataFrame, folder: str, vocabulary: str = "word_bpe_49k.json", end: int = 2, text: str = "text") -> DataFrame:
    """Encodes (doc_id, text) in ascending doc_id order and writes the files; returns the stored manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encoder = TaskContext.get(), word_encoder(vocabulary)
        out, system, path = None, None, ""
        waiting, held, place = [], 0, len(MAGIC)
        starts, docs, lengths, total = [], [], [], 0

        def put(ids: np.ndarray) -> None:
            nonlocal place
            for block in encode_blocks(ids):
                starts.append(place)
                out.write(block)
                place += len(block)

        for whole in batches:
            for batch in slices(whole, "text"):
                if out is None:
                    path = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.pfor"
                    system, where = file_system(path)
                    system.create_dir(where.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(where)
                    out.write(MAGIC)
                ids, counts = encoder.encode(batch.column(1), end)
                docs += batch.column(0).to_pylist()
                lengths.append(counts)
                total += len(ids)
                waiting.append(ids)
                held += len(ids)
                if held >= GROUP:
                    ids = np.concatenate(waiting)
                    cut = len(ids) // BLOCK * BLOCK
                    for i in range(0, cut, GROUP):
                        put(ids[i : min(i + GROUP, cut)])
                    waiting, held = [ids[cut:]], len(ids) - cut
        if out is None:
            return
        if held:
            put(np.concatenate(waiting))
        n = len(docs)
        null = np.array([d is None for d in docs], np.uint8)
        table = np.array([0 if d is None else d for d in docs], np.int64).tobytes() + null.tobytes() + np.concatenate(lengths).astype(np.int64).tobytes()
        out.write(np.array(starts, np.uint64).tobytes() + table + np.array([place, len(starts), place + 8 * len(starts), n], np.uint64).tobytes())
        size = out.tell()
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([path]), *(pa.array([v], pa.int64()) for v in (n, total, size))], names=["part", "path", "n_docs", "n_ids", "n_bytes"])

    rows = df.select("doc_id", F.col(text).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return stored(ordered.mapInArrow(run, MANIFEST), "manifest")


def decoded_blocks(f: pa.NativeFile, starts: np.ndarray, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """All blocks of a file, fetched about ``most`` bytes at a time."""
    first = 0
    while first < len(starts) - 1:
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + most, side="right")) - 1)
        data = memoryview(f.read_at(int(starts[last] - starts[first]), int(starts[first])))
        for i in range(first, last):
            yield decode_block(data[starts[i] - starts[first] : starts[i + 1] - starts[first]])
        first = last


def read_file(path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of a file's documents, in order; holds one read and one document at a time."""
    system, where = file_system(path)
    with system.open_input_file(where) as f:
        size = f.size()
        if f.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"not a token file: {path}")
        starts_at, blocks, docs_at, n = (int(x) for x in np.frombuffer(f.read_at(FOOTER, size - FOOTER), np.uint64))
        starts = np.append(np.frombuffer(f.read_at(8 * blocks, starts_at), np.uint64), np.uint64(starts_at)).astype(np.int64)
        table = f.read_at(17 * n, docs_at)
        ids, null, counts = np.frombuffer(table, np.int64, n), np.frombuffer(table, np.uint8, n, 8 * n), np.frombuffer(table, np.int64, n, 9 * n)
        ahead, held = [], 0
        blocks_of = decoded_blocks(f, starts)
        for doc, is_null, count in zip(ids.tolist(), null.tolist(), counts.tolist(), strict=True):
            while held < count:
                ahead.append(next(blocks_of))
                held += len(ahead[-1])
            have = ahead[0] if len(ahead) == 1 else np.concatenate(ahead)
            yield None if is_null else doc, have[:count]
            ahead, held = [have[count:]], len(have) - count


def read_token_files(manifest: DataFrame, each: Callable[[np.ndarray], int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document in the files. One row of the
    manifest is a unit of work; the running sum is over the manifest, one row for each file."""
    before = F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids")
    units = manifest.withColumn("start", before).select("path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

        for units in batches:
            for path, start in zip(units.column(0).to_pylist(), units.column(1).to_pylist(), strict=True):
                rows = []
                for doc, ids in read_file(path):
                    rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield batch(rows)
                        rows = []
                yield batch(rows)

    files = manifest.count()
    return units.repartition(max(1, files)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents' ids and says what the files hold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_token_files(write_token_files(docs, shared_folder(spark, "tokens")))
