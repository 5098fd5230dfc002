"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Each line is good or bad. Its features are properties of the line (length, characters, words, repetition) and of
its neighbours; transitions tie neighbouring labels. Forward-backward gives each line's probability to be good, and
the mean weighted by length is the document's quality.

Only documents are labelled, so lines learn their document's label. Labels never change inside such a text, so the fit also reads
texts glued from passages of good and bad ones (``GLUED``), whose lines keep their labels; without them the transitions would forbid
any change. It maximises one penalised likelihood of features and transitions, by Adam in numpy, on a bounded sample of labelled rows
(``SAMPLE`` of each class); a monotone calibration on whole documents puts the threshold 0.3 between the classes. Scoring reads whole texts, in tasks, without shuffles. Lines without a word carry no
weight; a text without words (null, empty) has the prior ``EMPTY_SCORE``. Repeated rows are scored alike; null ids stay null;
columns but doc_id and text, of whatever name, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
import math
import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm.common import slices
from platewise.llm.labelled import remainder, training_sample

#: At most so many training rows of each class.
SAMPLE = 400
#: Training uses chains of at most so many lines, cut from whole texts.
CHAIN = 64
#: Training texts glued from passages of both classes, and the most passages of one and lines of a passage.
GLUED, PASSAGES, PASSAGE_LINES = 400, 4, 10
#: Weight of the mixed chains together; good and bad ones have 1 each.
MIXED = 0.5
THRESHOLD = 0.3
EMPTY_SCORE = 0.0
HASHED = 64
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SHORT = 4

OWN = ("bias", "log_chars", "log_words", "word_length", "upper", "digit", "symbol", "pipe", "exclaim", "short_words", "distinct", "same_next", "seen", "ends_sentence", "starts_upper", "bang_words")


_UPPER, _DIGIT, _SYMBOL = bytes(range(0x41, 0x5B)), bytes(range(0x30, 0x3A)), b"#*$%&<>{}[]^~_=+\\@/"
#: Words that end with ASCII punctuation.
_ENDED = re.compile(r"[!-/:-@\[-`{-~](?![^\x20\x09-\x0D])")


@functools.lru_cache(maxsize=1 << 16)
def _column(word: str) -> int:
    return len(OWN) + zlib.crc32(word.encode()) % HASHED


#: Lines of a text whose features stand in memory at once.
LINES = 1 << 15


def lines_of(text: str) -> Iterator[str]:
    """The text's lines, cut at line feeds."""
    at = 0
    while (end := text.find("\n", at)) >= 0:
        yield text[at:end]
        at = end + 1
    yield text[at:]


def feature_blocks(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(lines, features) of the lines that have a word, by themselves, and each line's weight (its characters that are not white space), for
    ``LINES`` lines at a time. What is kept of earlier lines is that they were seen."""
    seen: set[str] = set()
    lines = lines_of(text)
    while part := list(itertools.islice(lines, LINES)):
        yield _line_features(part, seen)


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The features of all lines of a text of the training sample."""
    own, weight = zip(*feature_blocks(text), strict=True)
    return np.concatenate(own), np.concatenate(weight)


def line_scores(text: str, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bad, good) scores of each line that has a word, with its neighbours' features, and its weight. A block waits for the next one, whose first
    line is a neighbour of its last."""
    scores, weights, held, before = [], [], None, None
    for own, weight in itertools.chain(feature_blocks(text), [(None, None)]):
        if own is not None and not len(own):
            continue
        if held is not None:
            edges = [x for x in (before, held, own[:1] if own is not None else None) if x is not None]
            first = 0 if before is None else 1
            scores.append((with_neighbours(np.concatenate(edges)) @ w)[first : first + len(held)])
            before = held[-1:]
        held = own
        if own is not None:
            weights.append(weight)
    return (np.concatenate(scores), np.concatenate(weights)) if scores else (np.zeros((0, 2)), np.zeros(0))


def _line_features(lines: list[str], seen: set[str]) -> tuple[np.ndarray, np.ndarray]:
    rows, weight, at_line, at_column, share = [], [], [], [], []
    for line in lines:
        words = _WORD.findall(line)
        if not words:
            continue
        raw = line.encode()
        size, n, chars = len(raw), len(words), sum(map(len, words))
        shorts = Counter(w for w in words if len(w) <= _SHORT)
        rows.append((
            1.0,
            math.log1p(len(line)) / 8,
            math.log1p(n) / 6,
            chars / n / 10,
            (size - len(raw.translate(None, _UPPER))) / chars,
            (size - len(raw.translate(None, _DIGIT))) / chars,
            5 * (size - len(raw.translate(None, _SYMBOL))) / chars,
            3 * raw.count(b"|") / n,
            2 * raw.count(b"!") / n,
            sum(shorts.values()) / n,
            len(set(words)) / n,
            sum(map(operator.eq, words, words[1:])) / n,
            float(line in seen),
            float(words[-1][-1] in ".!?:"),
            float(words[0][0].isupper()),
            len(_ENDED.findall(line)) / n,
        ))
        # Shares of short words, by hash: function words of any language fall here.
        at_line += [len(weight)] * len(shorts)
        at_column += map(_column, shorts)
        share += [2 * k / n for k in shorts.values()]
        weight.append(chars)
        seen.add(line)
    out = np.zeros((len(rows), len(OWN) + HASHED), np.float32)
    if rows:
        out[:, : len(OWN)] = rows
        np.add.at(out, (at_line, at_column), share)
    return out, np.array(weight, np.float64)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """A line's features, those of the lines before and after (zero beyond the ends), and whether there are any."""
    k = len(OWN)
    before, after = np.zeros((len(own), k), own.dtype), np.zeros((len(own), k), own.dtype)
    before[1:], after[:-1] = own[:-1, :k], own[1:, :k]
    return np.concatenate([own, before, after], axis=1)


WIDTH = 3 * len(OWN) + HASHED


def padded(chains: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(longest, chains, ...) of scores by step, and lengths."""
    lengths = np.array([len(c) for c in chains])
    out = np.zeros((int(lengths.max()), len(chains), *chains[0].shape[1:]), np.float64)
    for i, c in enumerate(chains):
        out[: len(c), i] = c
    return out, lengths


def marginals(scores: list[np.ndarray], transitions: np.ndarray, weight: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Forward-backward over chains of (bad, good) scores: each line's (bad, good) probabilities, the expected number of
    each transition (weighted by chain), and each chain's log partition. Chains whose lengths differ by less than a factor of two advance
    together, so that a long chain beside short ones takes no more memory than its own lines."""
    kinds = np.array([max(len(s) - 1, 0).bit_length() for s in scores])
    out, pairs, partition = [np.zeros((0, 2))] * len(scores), np.zeros((2, 2)), np.zeros(len(scores))
    for kind in np.unique(kinds):
        at = np.flatnonzero(kinds == kind)
        some, n, log_z = _like_chains([scores[i] for i in at], transitions, None if weight is None else weight[at])
        pairs += n
        partition[at] = log_z
        for i, p in zip(at, some, strict=True):
            out[i] = p
    return out, pairs, partition


def _like_chains(scores: list[np.ndarray], transitions: np.ndarray, weight: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The same for chains of about one length, in order of length."""
    order = np.argsort([-len(s) for s in scores], kind="stable")
    s, n = padded([scores[i] for i in order])
    weight = np.ones(len(order)) if weight is None else weight[order]
    steps, m = s.shape[0], s.shape[1]
    alive = [int(np.searchsorted(-n, -t, side="left")) for t in range(steps)]  # chains longer than t
    trans = np.exp(transitions - transitions.max())
    top = s.max(axis=2, keepdims=True)
    e = np.exp(s - top)
    f = np.zeros_like(e)
    z = e[0].sum(axis=1, keepdims=True)
    f[0] = e[0] / z
    log_z = np.log(z[:, 0]) + top.sum(axis=(0, 2)) + np.maximum(n - 1, 0) * transitions.max()
    for t in range(1, steps):
        a = alive[t]
        x = (f[t - 1, :a] @ trans) * e[t, :a]
        z = x.sum(axis=1, keepdims=True)
        f[t, :a] = x / z
        log_z[:a] += np.log(z[:, 0])
    b = np.ones_like(e)
    pairs = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        a = alive[t + 1]
        y = e[t + 1, :a] * b[t + 1, :a]
        x = y @ trans.T
        both = f[t, :a, :, None] * trans[None] * y[:, None, :]
        pairs += (both * (weight[:a] / both.sum(axis=(1, 2)))[:, None, None]).sum(axis=0)
        b[t, :a] = x / x.sum(axis=1, keepdims=True)
    p = f * b
    p /= np.maximum(p.sum(axis=2, keepdims=True), 1e-300)
    out, partition = [np.zeros((0, 2))] * m, np.zeros(m)
    for k, i in enumerate(order):
        out[i], partition[i] = p[: n[k], k], log_z[k]
    return out, pairs, partition


#: Penalty of the squared weights and transitions.
DECAY = 1e-3


class Likelihood:
    """The penalised, weighted log likelihood of chains, each with one label for all lines or a label a line."""

    def __init__(self, chains: list[np.ndarray], labels: list[int | np.ndarray]):
        self.x = np.concatenate(chains).astype(np.float64)
        size = np.array([len(c) for c in chains])
        self.bounds = np.concatenate([[0], np.cumsum(size)])
        lines = [np.broadcast_to(y, n) for y, n in zip(labels, size, strict=True)]
        # A chain counts once, however long; good and bad ones count alike, mixed ones by their weight.
        kind = np.array([y[0] if (y == y[0]).all() else 2 for y in lines])
        self.weight = 1 / size
        for value in np.unique(kind):
            self.weight[kind == value] *= (MIXED if value == 2 else 1) / (kind == value).sum()
        y = np.concatenate(lines)
        self.observed = np.eye(2)[y]
        self.line_weight = np.repeat(self.weight, size)[:, None]
        chain = np.repeat(np.arange(len(size)), size)
        inside = chain[1:] == chain[:-1]
        self.seen = np.zeros((2, 2))
        np.add.at(self.seen, (y[:-1][inside], y[1:][inside]), self.line_weight[1:, 0][inside])

    def __call__(self, w: np.ndarray, t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Its value, and its gradients by the features' weights and by the transitions."""
        s = self.x @ w
        p, pairs, log_z = marginals([s[a:b] for a, b in zip(self.bounds[:-1], self.bounds[1:], strict=True)], t, self.weight)
        value = (self.line_weight * self.observed * s).sum() + (self.seen * t).sum() - self.weight @ log_z - DECAY / 2 * ((w * w).sum() + (t * t).sum())
        return value, self.x.T @ ((self.observed - np.concatenate(p)) * self.line_weight) - DECAY * w, self.seen - pairs - DECAY * t


def glued_texts(rows: list[tuple[str, int]], n: int = GLUED, seed: int = 7) -> list[tuple[str, np.ndarray]]:
    """Texts of two to ``PASSAGES`` passages, good and bad ones in turn, each of the next document of its class; and the labels of their lines.
    The same rows give the same texts."""
    lines = [[], []]
    for text, label in rows:
        some = [line for line in lines_of(text) if _WORD.search(line)]
        if some:
            lines[label].append(some)
    if not lines[0] or not lines[1]:
        return []
    rng, used, out = np.random.default_rng(seed), [0, 0], []
    for i in range(n):
        text, labels = [], []
        for k in range(int(rng.integers(2, PASSAGES + 1))):
            label = (i + k) % 2
            source = lines[label][used[label] % len(lines[label])]
            used[label] += 1
            size = min(int(rng.integers(1, PASSAGE_LINES + 1)), len(source))
            at = int(rng.integers(0, len(source) - size + 1))
            text += source[at : at + size]
            labels += [label] * size
        out.append(("\n".join(text), np.array(labels)))
    return out


def fit(rows: list[tuple[str, int]], rounds: int = 60, rate: float = 0.1) -> dict[str, np.ndarray]:
    """Weights of the features and transitions, and the calibration."""
    chains, labels, texts = [], [], []
    for text, label in rows:
        own, weight = line_features(text)
        if len(own):
            x = with_neighbours(own)
            texts.append((x, weight, label))
            for i in range(0, len(x), CHAIN):
                chains.append(x[i : i + CHAIN])
                labels.append(label)
    model = {"w": np.zeros((WIDTH, 2)), "t": np.zeros((2, 2)), "cut": np.array([0.0, 1.0])}
    if len(set(labels)) < 2:
        return model
    for text, line_label in glued_texts(rows):
        chains.append(with_neighbours(line_features(text)[0]))
        labels.append(line_label)
    likelihood = Likelihood(chains, labels)
    first, second = {k: np.zeros_like(model[k]) for k in "wt"}, {k: np.zeros_like(model[k]) for k in "wt"}
    for step in range(1, rounds + 1):
        _, *gradient = likelihood(model["w"], model["t"])
        for k, g in zip("wt", gradient, strict=True):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g**2
            model[k] = model[k] + rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    raw = np.array([document_scores([x @ model["w"]], [w], model["t"])[0] for x, w, _ in texts])
    model["cut"] = calibration(raw, np.array([label for *_, label in texts]))
    return model


def calibration(raw: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """(cut, 1): the raw score that best parts the classes (mean of their accuracies), in the middle of the widest gap."""
    values = np.unique(np.concatenate([[0.0], raw, [1.0]]))
    cuts = (values[1:] + values[:-1]) / 2
    good, bad = np.sort(raw[labels == 1]), np.sort(raw[labels == 0])
    right = (len(good) - np.searchsorted(good, cuts)) / len(good) + np.searchsorted(bad, cuts) / len(bad)
    best = np.flatnonzero(right >= right.max() - 1e-12)
    widest = best[np.argmax((values[1:] - values[:-1])[best])]
    return np.array([cuts[widest], 1.0])


def calibrated(raw: np.ndarray, cut: float) -> np.ndarray:
    """Piecewise linear and increasing, with the cut at the threshold."""
    cut = min(max(cut, 1e-6), 1 - 1e-6)
    return np.where(raw < cut, raw / cut * THRESHOLD, THRESHOLD + (raw - cut) / (1 - cut) * (1 - THRESHOLD))


def document_scores(scores: list[np.ndarray], weights: list[np.ndarray], transitions: np.ndarray) -> np.ndarray:
    """Mean probability of good lines, weighted by length; texts without lines get NaN."""
    out = np.full(len(scores), np.nan)
    some = [i for i, s in enumerate(scores) if len(s)]
    if some:
        p = marginals([scores[i] for i in some], transitions)[0]
        for i, q in zip(some, p, strict=True):
            out[i] = float(q[:, 1] @ weights[i] / weights[i].sum())
    return out


def score_texts(df: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """doc_id and score of every row of (doc_id, text)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for batch in slices(whole, "text", 1 << 19):
                scores, weights = [], []
                for text in batch.column(1).to_pylist():
                    own, weight = line_scores(text or "", m["w"])
                    scores.append(own)
                    weights.append(weight)
                raw = document_scores(scores, weights, m["t"])
                score = np.where(np.isnan(raw), EMPTY_SCORE, calibrated(np.nan_to_num(raw), float(m["cut"][0])))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(score, 0.0, 1.0))], names=["doc_id", "score"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def line_labels(df: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, line (its number in the text, from 0), good (probability) and label of every line that has a word."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for batch in slices(whole, "text", 1 << 19):
                ids, lines, scores = [], [], []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    own, _ = line_scores(text or "", m["w"])
                    if len(own):
                        scores.append(own)
                        ids += [doc] * len(own)
                        lines += [i for i, line in enumerate(lines_of(text)) if _WORD.search(line)]
                if ids:
                    good = np.concatenate(marginals(scores, m["t"])[0])[:, 1]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.int32()), pa.array(good), pa.array((good >= 0.5).astype(np.int32))], names=["doc_id", "line", "good", "label"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, line int, good double, label int")


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; rows whose remainder is 0 are held out of the fit."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = remainder(F.col("doc_id"), 5) == 0
    model = fit(training_sample(docs, labels, "quality", ~held_out, SAMPLE))
    return score_texts(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
