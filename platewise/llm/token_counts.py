"""Token counts by a tokenizer compiled into a finite-state transducer.

A byte-pair encoding merges the best pair of the whole text first. Still, the tokens of any prefix follow from left to right: the
prefix that ends before a character's token keeps its own tokens, and of all vocabulary entries that end at the character, exactly one
stands beside the last token of what is before it (their characters together are encoded as just these two). So a deterministic
transducer over characters can carry all that matters: the longest end of the text that may still grow into an entry, and for each
place in it where an entry may have begun, the last token before that place and the number of tokens up to it. Its transitions are
annotated with what the character adds to the number of tokens of the prefix (which may be negative, as characters join).
Transitions are compiled when a text first takes them, and kept by the worker.

Texts are cut into chunks of ``CHUNK`` characters that run side by side. A chunk's state map says for a state before it which state
stands after it and how many tokens it adds. Where no entry holds a pair of neighbouring characters (a space after anything else), all
states become one, so nearly all maps are constant behind the chunk's first space. Elsewhere a map starts with a guess, the state
after a few characters before the chunk, and takes in what its predecessor's map hands on until the texts' states are all in
their maps. Maps compose by a parallel prefix scan (pointers doubled).

Null texts are empty; an empty text has no bytes and no tokens. Repeated rows and null ids stay as they are. Texts of any length are
read in blocks of ``BLOCK_BYTES`` that hand on their state, so memory does not grow with a text beyond Arrow's copy of it. Other columns, of
whatever name, are not read; an empty table gives no rows. Special strings inside texts are plain text, as for the library.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm.common import string_buffers

VOCABULARY = "piece_bpe_32k.model"
LIMIT = 4096
#: Characters in a chunk, characters before a chunk from which a state is guessed, bytes of text that run together.
CHUNK, WARM, BLOCK_BYTES = 256, 64, 1 << 20
#: States after which a worker forgets what it compiled.
MOST_STATES = 300_000
SPACE = "▁"
#: Classes from here on are characters without an entry, by their number of bytes.
UNKNOWN = 0x110000
_CODE_BITS = 21


class Transducer:
    """The transducer of a byte-pair encoding with byte fallback, compiled as it is used."""

    def __init__(self, scores: dict[str, float], most_states: int = MOST_STATES):
        if missing := {c for piece in scores for c in piece} - scores.keys():
            raise ValueError(f"characters without an entry of their own: {sorted(missing)[:5]}")
        self.scores, self.most_states = scores, most_states
        self.prefixes = {p[:i] for p in scores for i in range(1, len(p))}
        self.pairs = {p[i : i + 2] for p in scores for i in range(len(p) - 1)}
        #: A space behind anything else ends whatever was before it.
        self.space_cuts = not any(p[0] != SPACE and p[1] == SPACE for p in self.pairs)
        codes = np.arange(UNKNOWN)
        self.classes = (UNKNOWN + 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)).astype(np.int32)
        known = np.array([ord(p) for p in scores if len(p) == 1])
        self.classes[known] = known
        self.classes[0x20] = ord(SPACE) if SPACE in scores else self.classes[ord(SPACE)]
        self.beside = functools.lru_cache(1 << 18)(self._beside)
        self.forget()

    @classmethod
    def of_model(cls, path: str) -> Transducer:
        """From a model file of the sentencepiece library, without normalisation."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        return cls({model.id_to_piece(i): model.get_score(i) for i in plain})

    def forget(self) -> None:
        self.beside.cache_clear()
        self.states: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.slots = np.full(1 << 16, -1, np.int64)
        self.next, self.adds, self.used = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), 0
        self.number(("", ((0, None, 0),)))

    def number(self, state: tuple) -> int:
        """The number of a state: the open end of the text, and (length of its rest, last token before it, tokens up to there less
        tokens up to here) for each place where an entry may have begun."""
        if (found := self.numbers.get(state)) is None:
            found = self.numbers[state] = len(self.states)
            self.states.append(state)
        return found

    def encode(self, text: str) -> list[str]:
        """Merges of a short text: the best score first, then the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            scored = [(self.scores.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            best, i = max(scored)
            if best == -np.inf:
                break
            parts[-i : -i + 2] = [parts[-i] + parts[-i + 1]]
        return parts

    def _beside(self, last: str | None, entry: str) -> bool:
        return self.encode((last or "") + entry) == ([entry] if last is None else [last, entry])

    def compile(self, state: int, code: int) -> tuple[int, int]:
        """(next state, tokens added) of one transition."""
        if code >= UNKNOWN:
            return 0, code - UNKNOWN
        end, places = self.states[state]
        c = chr(code)
        if end and end[-1] + c not in self.pairs:
            end, places = self.states[0]
        grown = [(end[len(end) - n :] + c, last, before) for n, last, before in places]
        entry, adds = next((rest, before + 1) for rest, last, before in grown if rest in self.scores and self.beside(last, rest))
        open_ = tuple((len(rest), last, before - adds) for rest, last, before in grown if rest in self.prefixes)
        if not open_:
            return 0, adds
        return self.number(((end + c)[-open_[0][0] :], (*open_, (0, entry, 0)))), adds

    def _keep(self, key: int, to: int, adds: int) -> None:
        slot = (key * 0x9E3779B97F4A7C15 % 2**64) >> (64 - len(self.slots).bit_length() + 1)
        while self.slots[slot] >= 0:
            slot = (slot + 1) & (len(self.slots) - 1)
        self.slots[slot], self.next[slot], self.adds[slot] = key, to, adds
        self.used += 1

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot, or that of a free one."""
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - len(self.slots).bit_length() + 1)).astype(np.int64)
        found = self.slots[at]
        off = np.flatnonzero((found != keys) & (found >= 0))
        while len(off):
            at[off] = (at[off] + 1) & (len(self.slots) - 1)
            found = self.slots[at[off]]
            off = off[(found != keys[off]) & (found >= 0)]
        return at

    def _extend(self, keys: np.ndarray) -> None:
        for key in np.unique(keys).tolist():
            if 4 * self.used > len(self.slots):
                kept = np.flatnonzero(self.slots >= 0)
                old = self.slots[kept].tolist(), self.next[kept].tolist(), self.adds[kept].tolist()
                size = 4 * len(self.slots)
                self.slots, self.next, self.adds, self.used = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int32), 0
                for row in zip(*old, strict=True):
                    self._keep(*row)
            self._keep(key, *self.compile(key >> _CODE_BITS, key & ((1 << _CODE_BITS) - 1)))

    def run(self, codes: np.ndarray, start: np.ndarray, stop: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state after, tokens added) of every span of characters, each from its own state, side by side."""
        order = np.argsort(start - stop, kind="stable")
        lengths, at = (stop - start)[order], start[order]
        now, total = state[order].astype(np.int64), np.zeros(len(order), np.int64)
        for i in range(int(lengths.max(initial=0))):
            m = int(np.searchsorted(-lengths, -i, side="left"))
            keys = (now[:m] << _CODE_BITS) | codes[at[:m] + i]
            slot = self._find(keys)
            if (free := self.slots[slot] != keys).any():
                self._extend(keys[free])
                slot = self._find(keys)
            now[:m] = self.next[slot]
            total[:m] += self.adds[slot]
        after, added = np.empty_like(now), np.empty_like(total)
        after[order], added[order] = now, total
        return after, added

    def counts(self, codes: np.ndarray, bounds: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state after, tokens added) of each text; ``bounds`` are the texts' bounds in ``codes``, ``state`` is what they start from."""
        chunks = -(-np.diff(bounds) // CHUNK)
        firsts = np.cumsum(chunks) - chunks
        if not chunks.sum():
            return state.copy(), np.zeros(len(state), np.int64)
        text = np.repeat(np.arange(len(chunks)), chunks)
        start = bounds[text] + (np.arange(len(text)) - firsts[text]) * CHUNK
        stop = np.minimum(start + CHUNK, bounds[text + 1])
        first, last = np.arange(len(text)) == firsts[text], np.append(np.diff(text) > 0, True)

        # The constant part of each map: from the chunk's first cut on.
        cut = stop.copy()
        if self.space_cuts:
            space = codes == self.classes[0x20]
            cuts = np.flatnonzero(space[1:] & ~space[:-1]) + 1
            if len(cuts):
                nearest = cuts[np.minimum(np.searchsorted(cuts, start), len(cuts) - 1)]
                cut = np.where((nearest >= start) & (nearest < stop), nearest, stop)
        constant = cut < stop
        body, body_adds = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        at = np.flatnonzero(constant)
        body[at], body_adds[at] = self.run(codes, cut[at], stop[at], np.zeros(len(at), np.int64))

        # What each map is known for at first: the text's own state, a constant predecessor's state, or a guess.
        known = np.where(first, state[text], np.append(0, body[:-1]))
        at = np.flatnonzero(~first & ~np.append(False, constant[:-1]))
        known[at], _ = self.run(codes, np.maximum(start[at] - WARM, bounds[text[at]]), start[at], np.zeros(len(at), np.int64))
        chunk, before, after, adds = (np.zeros(0, np.int64) for _ in range(4))
        new, reach = (np.arange(len(text)), known), 1
        while True:
            to, n = self.run(codes, start[new[0]], cut[new[0]], new[1])
            at = new[0]
            to, n = np.where(constant[at], body[at], to), n + body_adds[at]
            chunk, before, after, adds = (np.concatenate(x) for x in ((chunk, new[0]), (before, new[1]), (after, to), (adds, n)))
            order = np.argsort((chunk << 32) | before)
            chunk, before, after, adds = chunk[order], before[order], after[order], adds[order]
            total, end, whole = self._scan((chunk << 32) | before, ((chunk + 1) << 32) | after, last[chunk], adds)
            begun = np.searchsorted((chunk << 32) | before, (firsts[chunks > 0] << 32) | state[chunks > 0])
            if whole[begun].all():
                break
            # Texts with a gap: every map of theirs takes in what the one before it hands on, and the maps next to the gap also the
            # state that stands there, more of them each time, as the states of a text that repeats itself come back.
            broken = np.flatnonzero(chunks)[~whole[begun]]
            gap = np.zeros(len(chunks), bool)
            gap[broken] = True
            handed = np.flatnonzero(gap[text[chunk]] & ~last[chunk])
            edge = end[begun][~whole[begun]]
            ahead = np.minimum(firsts[broken] + chunks[broken] - chunk[edge] - 1, reach)
            where = np.repeat(chunk[edge] + 1, ahead) + np.arange(ahead.sum()) - np.repeat(np.cumsum(ahead) - ahead, ahead)
            wanted = np.concatenate([((chunk[handed] + 1) << 32) | after[handed], (where << 32) | np.repeat(after[edge], ahead)])
            wanted, reach = np.setdiff1d(wanted, (chunk << 32) | before), 4 * reach
            new = wanted >> 32, wanted & 0xFFFFFFFF
        out, added = state.copy(), np.zeros(len(state), np.int64)
        out[chunks > 0], added[chunks > 0] = after[end[begun]], total[begun]
        return out, added

    @staticmethod
    def _scan(keys: np.ndarray, wanted: np.ndarray, last: np.ndarray, adds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Composes maps by doubling: for each (chunk, state before), in the order of its key, the tokens up to the text's end, the entry of its last
        chunk, and whether all maps on the way know their state."""
        n = len(keys)
        at = np.minimum(np.searchsorted(keys, wanted), n - 1)
        # Entry n ends a text, entry n + 1 is a gap.
        to = np.append(np.where(last, n, np.where(keys[at] == wanted, at, n + 1)), [n, n + 1])
        total, end = np.append(adds, [0, 0]), np.arange(n + 2)
        while (to[:n] < n).any():
            total, end = total + total[to], np.where(to < n, end[to], end)
            to = to[to]
        return total[:n], end[:n], to[:n] == n


@functools.lru_cache(maxsize=2)
def transducer(vocabulary: str) -> Transducer:
    import public_tokenizers

    return Transducer.of_model(public_tokenizers.path(vocabulary))


def blocks_of(data: np.ndarray, offs: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Cuts the bytes of texts into blocks of at most about ``most`` bytes: (texts of a block, their bounds in the bytes). A long text is cut
    between characters and stands in several blocks, one after the other."""
    row, place = 0, 0
    rows = len(offs) - 1
    while row < rows:
        stop = min(place + most, int(offs[-1]))
        while stop < offs[-1] and data[stop] & 0xC0 == 0x80:
            stop -= 1
        end = max(int(np.searchsorted(offs, stop, side="right")) - 1, row)
        if end > row and place == offs[row]:
            stop = int(offs[end])
            texts, bounds = np.arange(row, end), offs[row : end + 1]
            row = end
        else:
            stop = min(stop, int(offs[row + 1]))
            texts, bounds = np.array([row]), np.array([place, stop])
            row += int(stop == offs[row + 1])
        yield texts, bounds
        place = stop


def count_tokens(column: pa.Array, machine: Transducer, prefix: bool = True, most: int = BLOCK_BYTES) -> np.ndarray:
    """Tokens of each text of an Arrow column; with ``prefix``, a text that is not empty starts with a space of its own."""
    data, offs = string_buffers(column)
    out = np.zeros(len(offs) - 1, np.int64)
    held = 0, machine.states[0]
    for texts, bounds in blocks_of(data, offs, most):
        if len(machine.states) > machine.most_states:
            machine.forget()
        raw = data[bounds[0] : bounds[-1]]
        codes = machine.classes[np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)]
        starts = np.concatenate([[0], np.cumsum(raw & 0xC0 != 0x80)])[bounds - bounds[0]]
        state = np.zeros(len(texts), np.int64)
        if bounds[0] > offs[texts[0]]:
            state[0] = machine.number(held[1])
        if prefix:
            fresh = (bounds[:-1] == offs[texts]) & (bounds[1:] > bounds[:-1])
            codes = np.insert(codes, starts[:-1][fresh], machine.classes[0x20])
            starts = starts + np.append(0, np.cumsum(fresh))
        after, added = machine.counts(codes, starts, state)
        out[texts] += added
        held = texts[-1], machine.states[after[-1]]
    return out


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(vocabulary)
        for batch in batches:
            n = count_tokens(batch.column(1), machine)
            size = np.diff(string_buffers(batch.column(1))[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
