"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text's words stand in windows of ``WINDOW`` words that start every ``STRIDE`` words, half a window. Each step's input is the
word's embedding (by hash) beside the mean embedding of its character n-grams, so inflected and unseen forms of a word are
near it. Two GRUs read the window forwards and backwards, attention pools their states, and a logistic unit scores the
window. A text scores as its worst window: every window of every text is read.

Only documents are labelled. The embeddings start from a plain descent on whole texts; then a toxic document's worst window
under the current model stands for it in training, against windows of other documents, the worst ones among them. The fit
uses a bounded sample of labelled rows (``SAMPLE`` of each class). A calibration puts 0.3 between the classes. Texts
without words (null, empty) score ``EMPTY_SCORE``. Rows are scored one by one, so repeated rows score alike; null ids stay
null; columns but doc_id and text, of whatever name, are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm.common import ALNUM_SEPARATORS, CHUNK_BYTES, mix, slices, span_hashes, string_buffers, text_part, word_blocks, word_spans
from platewise.llm.labelled import remainder, training_sample

#: At most so many training rows of each class.
SAMPLE = 800
THRESHOLD = 0.3
EMPTY_SCORE = 0.0
WINDOW, STRIDE = 64, 32
WORD_ROWS, GRAM_ROWS = 1 << 16, 1 << 18
WORD_DIM, GRAM_DIM, HIDDEN, ATTENTION = 6, 8, 8, 8
INPUT = WORD_DIM + GRAM_DIM
#: Lengths of the n-grams in bytes, and of the word's beginnings (with its ``^``).
GRAMS, HEADS = (3, 4, 5), (5, 6, 7, 8, 9)
#: Windows that a task scores at a time.
BATCH = 1024
#: Words in a part of a long text: a multiple of the stride.
PART_WORDS = 1 << 15
#: Steps, step size of the bias, and that of the rows in terms of it, in the descent that starts the embeddings.
WARM_STEPS, WARM_RATE, WARM_SCALE = 100, 2.0, 300.0
#: What the warm start is divided by, to be of the size of the network's other inputs.
LEAD = 4.0
#: Step sizes of the weights and of the embeddings, by Adam.
RATE, TABLE_RATE = 0.01, 0.0005


# --- inputs ---------------------------------------------------------------------------------------------------
class Inputs:
    """The words of some texts: each word's distinct form, the forms' embedding rows, and the windows."""

    def __init__(self, texts: pa.Array):
        data, _, s, e, self.bounds = word_spans(texts, ALNUM_SEPARATORS)
        h = span_hashes(data, s, e) if len(s) else np.zeros(0, np.uint64)
        forms, first, self.form = np.unique(h, return_index=True, return_inverse=True)
        self.word_row = (forms % np.uint64(WORD_ROWS)).astype(np.int64)
        self.gram_row, self.gram_cut = self._grams(data, s[first], e[first])
        n = np.diff(self.bounds)
        count = np.where(n > 0, np.maximum(0, -(-(n - WINDOW) // STRIDE)) + 1, 0)
        self.owner = np.repeat(np.arange(len(n)), count)
        k = np.arange(len(self.owner)) - np.repeat(np.cumsum(count) - count, count)
        self.start = self.bounds[self.owner] + k * STRIDE
        self.length = np.minimum(WINDOW, self.bounds[self.owner + 1] - self.start)

    @staticmethod
    def _grams(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all n-grams of the forms, with ``^`` before and ``$`` after, and each form's start in them."""
        size = e - s + 2
        at = np.concatenate([[0], np.cumsum(size)])
        padded = np.full(at[-1], ord("$"), np.uint64)
        padded[at[:-1]] = ord("^")
        inner = np.arange(at[-1]) - np.repeat(at[:-1], size)
        body = (inner > 0) & (inner < np.repeat(size, size) - 1)
        padded[body] = data[np.repeat(s, size)[body] + inner[body] - 1]
        left = np.repeat(size, size) - inner
        owners, rows = [], []
        form = np.repeat(np.arange(len(size)), size)
        for n in GRAMS:
            # Forms shorter than n are one n-gram of the smallest length.
            starts = np.flatnonzero((left >= n) | ((inner == 0) & (n == GRAMS[0])))
            h = np.full(len(starts), n, np.uint64)
            for j in range(n):
                h = h * np.uint64(1_000_003) + np.where(left[starts] > j, padded[np.minimum(starts + j, len(padded) - 1)], np.uint64(0))
            rows.append((mix(h) % np.uint64(GRAM_ROWS)).astype(np.int64))
            owners.append(form[starts])
        for n in HEADS:
            starts = at[:-1][size > n]
            h = np.full(len(starts), 100 + n, np.uint64)
            for j in range(1, n):
                h = h * np.uint64(1_000_003) + padded[starts + j]
            rows.append((mix(h) % np.uint64(GRAM_ROWS)).astype(np.int64))
            owners.append(form[starts])
        owner, row = np.concatenate(owners), np.concatenate(rows)
        order = np.argsort(owner, kind="stable")
        return row[order], np.searchsorted(owner[order], np.arange(len(size) + 1))

    def embedded(self, model: dict[str, np.ndarray], forms: np.ndarray | None = None) -> np.ndarray:
        """(forms, INPUT): the network's inputs for all forms, or for the given ones: the word's row, and the mean row of its
        n-grams."""
        words, grams, cut = self.word_row, self.gram_row, self.gram_cut
        if forms is not None:
            words, (grams, cut) = words[forms], self.grams_of(forms)
        out = np.zeros((len(words), INPUT), np.float32)
        if len(out):
            out[:, :WORD_DIM] = model["words"][words]
            out[:, WORD_DIM:] = np.add.reduceat(model["grams"][grams], cut[:-1], axis=0) / np.diff(cut)[:, None]
        return out

    def grams_of(self, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-gram rows of some forms, and each form's start in them."""
        size = np.diff(self.gram_cut)[forms]
        cut = np.concatenate([[0], np.cumsum(size)])
        return self.gram_row[np.arange(cut[-1]) + np.repeat(self.gram_cut[forms] - cut[:-1], size)], cut

    def steps(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(steps, windows) forms of the words, and lengths; beyond a window's length, its last word stands."""
        length = self.length[windows]
        t = np.minimum(np.arange(int(length.max()))[:, None], length[None] - 1)
        return self.form[self.start[windows][None] + t], length


# --- network --------------------------------------------------------------------------------------------------
def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


def gru(x: np.ndarray, u: np.ndarray, alive: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States of all steps from the projected inputs (steps, windows, 3 * HIDDEN): reset, update, candidate."""
    steps, m, _ = x.shape
    states, kept = np.empty((steps, m, HIDDEN), np.float32), []
    h = np.zeros((m, HIDDEN), np.float32)
    for t in range(steps):
        g = h @ u
        rz = _sigmoid(x[t, :, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
        n = np.tanh(x[t, :, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
        new = n + z * (h - n)
        if not alive[t].all():
            new = np.where(alive[t][:, None], new, h)
        if keep:
            kept.append((h, r, z, n, g[:, 2 * HIDDEN :]))
        states[t] = h = new
    return states, kept


def gru_back(d: np.ndarray, kept: list, u: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of ``u`` from those of the states."""
    steps, m, _ = d.shape
    dx, du, dh = np.zeros((steps, m, 3 * HIDDEN), np.float32), np.zeros_like(u), np.zeros((m, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        h, r, z, n, gn = kept[t]
        dh = dh + d[t]
        live = dh * alive[t][:, None]
        dn = live * (1 - z) * (1 - n * n)
        dz = live * (h - n) * z * (1 - z)
        dr = dn * gn * r * (1 - r)
        dx[t] = np.concatenate([dr, dz, dn], axis=1)
        dg = np.concatenate([dr, dz, dn * r], axis=1)
        du += h.T @ dg
        dh = dh - live + live * z + dg @ u.T
    return dx, du


def _reversed_steps(length: np.ndarray, steps: int) -> np.ndarray:
    """For each step of the backward reading, the step of the window that it reads."""
    t = np.arange(steps)[:, None]
    return np.where(t < length[None], length[None] - 1 - t, t)


def forward(inputs: np.ndarray, forms: np.ndarray, length: np.ndarray, model: dict[str, np.ndarray], keep: bool = False):
    """Logits of windows, and what the backward pass needs."""
    steps, m = forms.shape
    alive = np.arange(steps)[:, None] < length[None]
    back, cols = _reversed_steps(length, steps), np.arange(m)[None]
    # Inputs are projected once for each distinct word, not for each step.
    xf, xb = inputs @ model["wf"] + model["bf"], inputs @ model["wb"] + model["bb"]
    hf, kf = gru(xf[forms], model["uf"], alive, keep)
    hb, kb = gru(xb[forms[back, cols]], model["ub"], alive, keep)
    h = np.concatenate([hf, hb[back, cols]], axis=2)
    a = np.tanh(h @ model["wa"] + model["ba"])
    e = np.where(alive, a @ model["va"], np.float32(-30))
    p = np.exp(e - e.max(axis=0))
    p /= p.sum(axis=0)
    c = np.einsum("tm,tmh->mh", p, h)
    logits = c @ model["wo"] + model["bo"][0]
    return logits, (alive, back, cols, kf, kb, h, a, p, c) if keep else None


def backward(dlogits: np.ndarray, kept, inputs: np.ndarray, forms: np.ndarray, model: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the weights, and of the inputs of each form."""
    alive, back, cols, kf, kb, h, a, p, c = kept
    g = {"wo": c.T @ dlogits, "bo": np.array([dlogits.sum()], np.float32)}
    dc = dlogits[:, None] * model["wo"][None]
    dp = np.einsum("mh,tmh->tm", dc, h)
    de = p * (dp - (p * dp).sum(axis=0)) * alive
    dh = p[:, :, None] * dc[None]
    g["va"] = np.einsum("tm,tma->a", de, a)
    da = de[:, :, None] * model["va"] * (1 - a * a)
    g["wa"], g["ba"] = np.einsum("tmh,tma->ha", h, da, optimize=True), da.sum(axis=(0, 1))
    dh = dh + da @ model["wa"].T
    dxf, g["uf"] = gru_back(dh[:, :, :HIDDEN], kf, model["uf"], alive)
    dxb, g["ub"] = gru_back(dh[back, cols][:, :, HIDDEN:], kb, model["ub"], alive)
    dinputs = np.zeros_like(inputs)
    for x, dx, w, b in ((forms, dxf, "wf", "bf"), (forms[back, cols], dxb, "wb", "bb")):
        flat, f = dx.reshape(-1, 3 * HIDDEN), x.ravel()
        by_form = add_rows(len(inputs), f, flat)
        g[w], g[b] = inputs.T @ by_form, flat.sum(axis=0)
        dinputs += by_form @ model[w].T
    return g, dinputs


def add_rows(size: int, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the values of each row of a table."""
    out = np.zeros((size, values.shape[1]), np.float32)
    if len(rows):
        order = np.argsort(rows, kind="stable")
        sorted_rows = rows[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))
        out[sorted_rows[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


# --- training -------------------------------------------------------------------------------------------------
def warm_start(inputs: Inputs, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One number for each row of both tables, by gradient descent on the labels of whole texts: a form's score is its word's
    number and the mean of its n-grams', a text's logit the log of the mean exponent of its forms' scores. Plain descent moves
    a row by how many texts agree on it, so rows of single texts stay near zero."""
    words, grams, bias = np.zeros(WORD_ROWS), np.zeros(GRAM_ROWS), 0.0
    size = np.diff(inputs.gram_cut)
    gram_form = np.repeat(np.arange(len(size)), size)
    text = np.repeat(np.arange(len(labels)), np.diff(inputs.bounds))
    pairs = np.unique(text.astype(np.int64) * len(size) + inputs.form)
    text, form = pairs // len(size), pairs % len(size)
    some, first, count = np.unique(text, return_index=True, return_counts=True)
    y = labels[some]
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for _ in range(WARM_STEPS):
        score = words[inputs.word_row] + np.add.reduceat(grams[inputs.gram_row], inputs.gram_cut[:-1]) / size
        e = np.exp(score[form])
        total = np.add.reduceat(e, first)
        logit = bias + np.log(total / count)
        slope = weight * (y - 1 / (1 + np.exp(-logit)))
        by_form = np.bincount(form, np.repeat(slope / total, count) * e, len(size))
        bias += WARM_RATE * slope.sum()
        words += WARM_RATE * WARM_SCALE * np.bincount(inputs.word_row, by_form, WORD_ROWS)
        grams += WARM_RATE * WARM_SCALE * np.bincount(inputs.gram_row, (by_form / size)[gram_form], GRAM_ROWS)
    return words, grams


def start_model(seed: int = 7) -> dict[str, np.ndarray]:
    rng, d = np.random.default_rng(seed), INPUT
    normal = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    model = {"wf": normal(d, 3 * HIDDEN), "wb": normal(d, 3 * HIDDEN), "uf": normal(HIDDEN, 3 * HIDDEN), "ub": normal(HIDDEN, 3 * HIDDEN)}
    model |= {"bf": np.zeros(3 * HIDDEN, np.float32), "bb": np.zeros(3 * HIDDEN, np.float32), "wa": normal(2 * HIDDEN, ATTENTION), "ba": np.zeros(ATTENTION, np.float32), "va": normal(ATTENTION), "wo": normal(2 * HIDDEN), "bo": np.zeros(1, np.float32)}
    return model | {"words": np.zeros((WORD_ROWS, WORD_DIM), np.float32), "grams": np.zeros((GRAM_ROWS, GRAM_DIM), np.float32), "cut": np.array([0.0], np.float32)}


def window_logits(inputs: Inputs, model: dict[str, np.ndarray]) -> np.ndarray:
    x = inputs.embedded(model)
    out = np.full(len(inputs.start), -np.inf, np.float32)
    order = np.argsort(inputs.length, kind="stable")
    for i in range(0, len(order), BATCH):
        some = order[i : i + BATCH]
        out[some] = forward(x, *inputs.steps(some), model)[0]
    return out


def worst(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The window with the largest value of each text (-1: none)."""
    out = np.full(n, -1)
    order = np.argsort(values, kind="stable")
    out[owner[order]] = order
    return out


def fit(rows: list[tuple[str, int]], epochs: int = 12, batch: int = 256, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights, embeddings and calibration from (text, label) rows; the same rows give the same model."""
    # Every fourth row of a class is kept for the calibration.
    place = {y: iter(range(len(rows))) for y in (0, 1)}
    kept_rows = [next(place[y]) % 4 == 3 for _, y in rows]
    held, rows = [r for r, k in zip(rows, kept_rows, strict=True) if k], [r for r, k in zip(rows, kept_rows, strict=True) if not k]
    model, labels = start_model(seed), np.array([y for _, y in rows], np.int64)
    if len(set(labels.tolist())) < 2:
        return model
    inputs, rng = Inputs(pa.array([t for t, _ in rows])), np.random.default_rng(seed)
    words, grams = warm_start(inputs, labels)
    # Rows of the sample start at random, led by the warm start; others stay at zero.
    for table, lead, used in (("words", words, inputs.word_row), ("grams", grams, inputs.gram_row)):
        used = np.unique(used)
        model[table][used] = rng.normal(0, 0.05, (len(used), model[table].shape[1]))
        model[table][used, 0] = lead[used] / LEAD
    telling = inputs.embedded(model)[:, [0, WORD_DIM]].sum(axis=1)
    first = np.concatenate([[0], np.cumsum(np.maximum(telling[inputs.form], 0) ** 2)])
    values = first[inputs.start + inputs.length] - first[inputs.start]
    toxic_text = np.flatnonzero(labels == 1)
    clean_windows = np.flatnonzero(labels[inputs.owner] == 0)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items() if k != "cut"}
    step = 0
    for epoch in range(epochs):
        if epoch and epoch % 4 == 0:
            values = window_logits(inputs, model)
        top = worst(values, inputs.owner, len(labels))
        positive = top[toxic_text]
        positive = positive[positive >= 0]
        hard = top[labels == 0]
        hard = hard[hard >= 0]
        easy = rng.choice(clean_windows, size=min(len(clean_windows), 2 * len(positive)), replace=False)
        windows = np.concatenate([positive, hard, easy])
        target = np.concatenate([np.ones(len(positive)), np.zeros(len(hard) + len(easy))]).astype(np.float32)
        # Classes weigh alike, and small samples are cut into as many steps as large ones.
        share = np.where(target == 1, len(target) / max(1, 2 * len(positive)), len(target) / max(1, 2 * (len(target) - len(positive)))).astype(np.float32)
        order = rng.permutation(len(windows))
        size = min(batch, max(32, len(order) // 7))
        for i in range(0, len(order), size):
            some = order[i : i + size]
            f, length = inputs.steps(windows[some])
            used, f = np.unique(f, return_inverse=True)
            x, f = inputs.embedded(model, used), f.reshape(-1, len(some))
            logits, kept = forward(x, f, length, model, keep=True)
            g, dx = backward(share[some] * (_sigmoid(logits) - target[some]) / len(some), kept, x, f, model)
            rows, cut = inputs.grams_of(used)
            sizes = np.diff(cut)
            g["words"] = add_rows(WORD_ROWS, inputs.word_row[used], dx[:, :WORD_DIM])
            g["grams"] = add_rows(GRAM_ROWS, rows, np.repeat(dx[:, WORD_DIM:] / sizes[:, None], sizes, axis=0))
            step += 1
            for k, (m1, m2) in moments.items():
                m1 *= 0.9
                m1 += 0.1 * g[k]
                m2 *= 0.99
                m2 += 0.01 * g[k] ** 2
                rate = TABLE_RATE if k in ("words", "grams") else RATE
                model[k] = (model[k] - rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-4)).astype(np.float32)
    if {y for _, y in held} == {0, 1}:
        inputs, labels = Inputs(pa.array([t for t, _ in held])), np.array([y for _, y in held])
    values = window_logits(inputs, model)
    top = worst(values, inputs.owner, len(labels))
    model["cut"] = np.array([best_cut(values[top[(top >= 0) & (labels == 0)]], values[top[(top >= 0) & (labels == 1)]])], np.float32)
    return model


def best_cut(clean: np.ndarray, toxic: np.ndarray) -> float:
    """The logit that best parts the classes (mean of their accuracies), in the middle of the widest such gap."""
    if not len(clean) or not len(toxic):
        return 0.0
    values = np.unique(np.concatenate([clean, toxic]))
    values = np.concatenate([[values[0] - 1], values, [values[-1] + 1]])
    cuts = (values[1:] + values[:-1]) / 2
    right = np.searchsorted(np.sort(clean), cuts) / len(clean) + 1 - np.searchsorted(np.sort(toxic), cuts) / len(toxic)
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float(cuts[best[np.argmax((values[1:] - values[:-1])[best])]])


# --- scoring --------------------------------------------------------------------------------------------------
def text_scores(texts: pa.Array, model: dict[str, np.ndarray]) -> np.ndarray:
    """Each text's score: its worst window's probability, with the cut at the threshold."""
    parts = [worst_logits(part, model) for part in window_parts(texts)]
    logit = parts[0] if len(parts) == 1 else np.concatenate(parts).max(keepdims=True)
    out = np.full(len(texts), EMPTY_SCORE)
    some = logit > -np.inf
    logit = logit[some].astype(np.float64) - float(model["cut"][0])
    out[some] = 1 / (1 + np.exp(-(np.clip(logit, -30, 30) + np.log(THRESHOLD / (1 - THRESHOLD)))))
    return out


def worst_logits(texts: pa.Array, model: dict[str, np.ndarray]) -> np.ndarray:
    """The largest logit of each text's windows; minus infinity for texts without a word."""
    inputs = Inputs(texts)
    out = np.full(len(texts), -np.inf, np.float32)
    if len(inputs.start):
        some = np.flatnonzero(np.diff(inputs.bounds) > 0)
        out[some] = np.maximum.reduceat(window_logits(inputs, model), np.searchsorted(inputs.owner, some))
    return out


def window_parts(texts: pa.Array) -> Iterator[pa.Array]:
    """A column of one long text in parts that have its windows, each once: ``PART_WORDS`` words and what the last window of
    these reaches beyond. Other columns as they are. A single word is never cut, and its n-grams take some 200 bytes for each
    of its bytes."""
    data, _ = string_buffers(texts)
    if len(texts) != 1 or len(data) <= CHUNK_BYTES:
        yield texts
        return
    start = np.concatenate([at + s for _, at, s, _ in word_blocks(texts, ALNUM_SEPARATORS)])
    over = WINDOW - STRIDE
    for i in range(0, max(len(start) - over, 1), PART_WORDS):
        end = i + PART_WORDS + over
        yield text_part(data[start[i] if len(start) else 0 : start[end] if end < len(start) else len(data)])


def score_texts(df: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """doc_id and score of every row of (doc_id, text)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text_scores(batch.column(1), shared.value))], names=["doc_id", "score"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def op5_toxicity_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; rows whose remainder is 2 are held out of the fit."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = fit(training_sample(docs, labels, "toxic", ~held_out, SAMPLE))
    return score_texts(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
