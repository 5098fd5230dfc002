"""Chat formatting by token-level assembly.

Each turn becomes ``<|im_start|>role\\ncontent<|im_end|>\\n``. Role, content and line ends are encoded separately
and the reserved ids spliced between them, so no text can ever produce a reserved id; the loss mask follows from
the prefix sums of the segments' token counts. Control strings in a text are escaped: every ``<``, backslashes,
``|`` gets one backslash more, which unescaping takes away again.

Turns are encoded, and decoded again, where they are read, so a conversation with a large part of all rows is spread over tasks;
only the digest of a conversation, which must be taken in order, streams through one task, sorted by turn, with two
running hashes as its state. Null texts and roles count as empty. Null ids form one conversation; equal turns of a
conversation are ordered by role and text; repeated rows stay; texts may be of any length, unbroken runs too; other columns, of whatever name, are not read; an empty table
gives no rows.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

IM_START, IM_END = 50257, 50258
CONTROL = {IM_START: "<|im_start|>", IM_END: "<|im_end|>"}


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """A role on one line: its first line break ends it."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@functools.lru_cache(maxsize=2)
def encoding(vocabulary: str):
    """The byte-level encoding of a vocabulary file, without special tokens; kept for the worker's life."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if max(ranks.values()) >= IM_START:
        raise ValueError(f"{vocabulary} uses the ids reserved for control tokens")
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Runs of white space from which on they are encoded by themselves, as the pattern would recurse once a character.
RUN = 1000
_SPACES = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % RUN)


def encode_text(enc, text: str) -> list[int]:
    """The encoding of a text, long runs of white space apart. The pattern takes such a run as one piece, but for its last character where
    something follows, which begins the next piece; so cutting there changes no id."""
    ids, at = [], 0
    for run in _SPACES.finditer(text):
        end = run.end() - (run.end() < len(text))
        ids += enc.encode_ordinary(text[at : run.start()])
        ids += enc._encode_single_piece(text[run.start() : end])
        at = end
    return ids + enc.encode_ordinary(text[at:]) if at else enc.encode_ordinary(text)


def assemble(roles: list[str], texts: list[str], enc) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    """Token ids of each turn, and where the content stands in them."""
    line_end = enc.encode_ordinary("\n")
    heads = {r: encode_text(enc, escape_role(r) + "\n") for r in set(roles)}
    bodies = [encode_text(enc, escape(t)) for t in texts]
    ids, spans = [], []
    for role, body in zip(roles, bodies, strict=True):
        segments = ([IM_START], heads[role], body, [IM_END], line_end)
        ends = np.cumsum([len(s) for s in segments])
        ids.append(np.array([i for s in segments for i in s], np.int32))
        spans.append((int(ends[1]), int(ends[2])))
    return ids, spans


FORMATTED = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("turn", T.LongType()),
    T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
    T.StructField("loss_mask", T.ArrayType(T.ByteType(), False)),
])


def format_chat(df: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", loss_role: str = "assistant") -> DataFrame:
    """Turns (conv_id, turn, role, text) to their tokens: conv_id, turn, ids, and loss_mask (1 on the content of ``loss_role``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                role, text = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                ids, spans = assemble(role, text, enc)
                masks = []
                for x, r, (a, b) in zip(ids, role, spans, strict=True):
                    mask = np.zeros(len(x), np.int8)
                    mask[a:b] = r == loss_role
                    masks.append(mask)
                bounds = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(ids))), pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(masks)))], names=FORMATTED.names
                )

    turns = df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return turns.mapInArrow(run, FORMATTED)


def read_turns(formatted: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """What each turn's tokens say: conv_id, turn, role, text, loss (the text under the mask, null without one), and chars (of
    the formatted turn)."""
    names = ["conv_id", "turn", "role", "text", "loss", "chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                roles, texts, losses, chars = [], [], [], []
                for ids, mask in zip(batch.column(2), batch.column(3), strict=True):
                    x, mask = ids.values.to_numpy(), mask.values.to_numpy()
                    cuts = np.flatnonzero((x == IM_START) | (x == IM_END))
                    head, _, text = enc.decode(x[cuts[0] + 1 : cuts[1]].tolist()).partition("\n")
                    roles.append(unescape_role(head))
                    texts.append(unescape(text))
                    losses.append(unescape(enc.decode(x[mask == 1].tolist())) if mask.any() else None)
                    chars.append(sum(len(CONTROL[int(x[i])]) for i in cuts) + len(enc.decode(x[(x != IM_START) & (x != IM_END)].tolist())))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.string()) for c in (roles, texts, losses)), pa.array(chars, pa.int64())], names=names)

    return formatted.mapInArrow(run, "conv_id long, turn long, role string, text string, loss string, chars long")


def chat_digests(formatted: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """What the output of :func:`format_chat` says, read back from the tokens alone, by conversation."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, done = None, []

        def close():
            if state is not None:
                done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        def flush():
            columns = list(zip(*done, strict=True)) or [[]] * len(names)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                for c, role, text, loss, chars in zip(*(whole.slice(i, 1024).column(k).to_pylist() for k in (0, 2, 3, 4, 5)), strict=True):
                    if state is None or state[0] != c:
                        close()
                        state = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                    if loss is not None:
                        state[3] += len(loss)
                        state[4].update(loss.encode())
                    state[5] += chars
            yield flush()
        close()
        yield flush()

    turns = read_turns(formatted, vocabulary)
    # A loss that is the turn's text is not sent twice.
    turns = turns.withColumn("same", F.col("loss") == F.col("text")).withColumn("loss", F.when(~F.col("same"), F.col("loss")))
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    dealt = dealt.select("conv_id", "turn", "role", "text", F.when(F.col("same"), F.col("text")).otherwise(F.col("loss")).alias("loss"), "chars")
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, and of conversation -1 whose texts hold control strings."""
    text = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return chat_digests(format_chat(turns.unionByName(extra)))


#: DuckDB SQL of the same digests, from the turns themselves.
ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(role) + 1 + length(text)
    + length(regexp_extract_all(text, '<\\*\|')) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""
