"""The two classifiers: window scores by plain loops, and line labels where labels change inside a text."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from platewise.llm import quality_crf, toxicity_gru
from platewise.llm.common import words_of

DATA = "/root/testdata/sf0.01"
MASK = (1 << 64) - 1
LINE = re.compile(r"[^\x20\x09-\x0D]+")


def finalised(h: int) -> int:
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & MASK
    return h ^ (h >> 31)


def gram_row(seed: int, chars: bytes, n: int) -> int:
    h = seed
    for j in range(n):
        h = (h * 1_000_003 + (chars[j] if j < len(chars) else 0)) & MASK
    return finalised(h) % toxicity_gru.GRAM_ROWS


def input_of(word: bytes, model: dict) -> np.ndarray:
    """The word's row beside the mean row of its n-grams, of all lengths, and of its beginnings."""
    form, rows = b"^" + word + b"$", []
    for n in (3, 4, 5):
        rows += [gram_row(n, form[i : i + n], n) for i in range(len(form) - n + 1)]
    if len(form) < 3:
        rows.append(gram_row(3, form, 3))
    # A beginning of n characters counts its ^, which it leaves out of the hash; it must end inside the form.
    for n in (5, 6, 7, 8, 9):
        if len(form) > n:
            h = 100 + n
            for c in form[1:n]:
                h = (h * 1_000_003 + c) & MASK
            rows.append(finalised(h) % toxicity_gru.GRAM_ROWS)
    own = int(words_of(pa.array([word.decode()]))[0][0]) % toxicity_gru.WORD_ROWS
    return np.concatenate([model["words"][own], np.mean([model["grams"][r] for r in rows], axis=0)]).astype(np.float64)


def states(steps: list[np.ndarray], w: np.ndarray, u: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    k, h, out = toxicity_gru.HIDDEN, np.zeros(toxicity_gru.HIDDEN), []
    for x in steps:
        a, g = x @ w + b, h @ u
        r, z = (1 / (1 + np.exp(-(a[i * k : (i + 1) * k] + g[i * k : (i + 1) * k]))) for i in (0, 1))
        h = (1 - z) * np.tanh(a[2 * k :] + r * g[2 * k :]) + z * h
        out.append(h)
    return out


def score_by_hand(text: str | None, model: dict) -> float:
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return toxicity_gru.EMPTY_SCORE
    m = {k: v.astype(np.float64) for k, v in model.items()}
    inputs, logits, at = [input_of(w, model) for w in words], [], 0
    while True:
        steps = inputs[at : at + 64]
        front = states(steps, m["wf"], m["uf"], m["bf"])
        back = states(steps[::-1], m["wb"], m["ub"], m["bb"])[::-1]
        h = [np.concatenate(x) for x in zip(front, back, strict=True)]
        e = np.exp([np.tanh(x @ m["wa"] + m["ba"]) @ m["va"] for x in h])
        logits.append(sum(p * x for p, x in zip(e / e.sum(), h, strict=True)) @ m["wo"] + m["bo"][0])
        if at + 64 >= len(words):
            break
        at += 32
    x = max(logits) - m["cut"][0]
    return 1 / (1 + math.exp(-(min(max(x, -30), 30) + math.log(0.3 / 0.7))))


def test_scores_of_texts_by_plain_windows():
    """Null, empty, one word, short forms, window edges, a second language, and a text of many windows."""
    rng = np.random.default_rng(3)
    model = toxicity_gru.start_model(5) | {"cut": np.array([-3.4], np.float32)}
    model |= {k: rng.normal(0, 1, model[k].shape).astype(np.float32) for k in ("words", "grams", "bf", "bb", "ba", "bo")}
    forms = ["a", "Is", "THE", "fünf", "漢字", "x9", "scoundrel", "abcdefghijklmnop"]
    text = lambda n: " ".join(rng.choice(forms, n)) + " ."
    texts = [None, "", " .!\n", "a", "Is it?", *(text(n) for n in (63, 64, 65, 96, 97, 128, 400)), text(65), text(65)]
    got = toxicity_gru.text_scores(pa.array(texts, pa.string()), model)
    assert got == pytest.approx([score_by_hand(t, model) for t in texts], abs=1e-5)
    assert np.ptp(got[3:]) > 0.05


def passages(spark) -> tuple[list[tuple[str, int]], list[tuple[str, np.ndarray]]]:
    """Training rows, and texts glued from the heads of held-out documents, a good and a bad one, with their lines' labels."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id")
    rows = docs.select("doc_id", "text", "quality").dropna().orderBy("doc_id").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    lines = {v: [[x for x in r.text.split("\n") if LINE.search(x)][:5] for r in rows if held(r.doc_id) and r.quality == v] for v in (0, 1)}
    glued = []
    for i, good in enumerate(lines[1]):
        bad = lines[0][i % len(lines[0])]
        for parts in (((good, 1), (bad, 0)), ((bad, 0), (good, 1))):
            glued.append(("\n".join(x for p, _ in parts for x in p), np.array([y for p, y in parts for _ in p])))
    return [(r.text, r.quality) for r in rows if not held(r.doc_id)], glued


def line_accuracy(spark, model: dict, glued: list[tuple[str, np.ndarray]]) -> float:
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(glued)], "doc_id long, text string")
    found = {(r.doc_id, r.line): r.label for r in quality_crf.line_labels(df, model).collect()}
    assert len(found) == sum(len(y) for _, y in glued)
    return float(np.mean([found[i, k] == v for i, (_, y) in enumerate(glued) for k, v in enumerate(y)]))


def test_lines_of_glued_texts(spark, monkeypatch):
    """Held-out texts in which the label changes: lines are told apart better than by a fit that never saw a change."""
    rows, glued = passages(spark)
    mixed = line_accuracy(spark, quality_crf.fit(rows), glued)
    monkeypatch.setattr(quality_crf, "glued_texts", lambda rows: [])
    plain = line_accuracy(spark, quality_crf.fit(rows), glued)
    print("lines of glued texts: accuracy", round(mixed, 3), "fit without glued texts", round(plain, 3))
    assert mixed >= 0.78 and mixed > plain + 0.02


def test_glued_texts_keep_their_labels():
    rows = [("\n".join(f"{'good' if y else 'bad'} {i} {k}" for k in range(12)) + "\n\n", y) for i in range(6) for y in (0, 1)]
    texts = quality_crf.glued_texts(rows, 50)
    assert len(texts) == 50 and [t for t, _ in texts] == [t for t, _ in quality_crf.glued_texts(rows, 50)]
    for text, labels in texts:
        assert [line.startswith("good") for line in text.split("\n")] == labels.astype(bool).tolist() and set(labels) == {0, 1}
    assert quality_crf.glued_texts(rows[:1]) == quality_crf.glued_texts([]) == quality_crf.glued_texts([("", 0), ("a", 1)]) == []


def test_likelihood_of_mixed_chains_by_enumeration():
    """Value with a label a line, against all labellings; the gradient by differences."""
    import itertools

    rng = np.random.default_rng(1)
    chains = [rng.normal(size=(n, 3)) for n in (1, 3, 4, 2)]
    labels = [0, 1, np.array([0, 1, 1, 0]), np.array([1, 0])]
    like, w, t = quality_crf.Likelihood(chains, labels), rng.normal(size=(3, 2)), rng.normal(size=(2, 2))
    weight = [1, 1 / 3, quality_crf.MIXED / 2 / 4, quality_crf.MIXED / 2 / 2]
    want = -quality_crf.DECAY / 2 * ((w * w).sum() + (t * t).sum())
    for x, y, share in zip(chains, labels, weight, strict=True):
        s, y = x @ w, np.broadcast_to(y, len(x))
        total = lambda z, s=s: sum(s[i, v] for i, v in enumerate(z)) + sum(t[a, b] for a, b in itertools.pairwise(z))
        want += share * (total(y) - np.log(sum(np.exp(total(z)) for z in itertools.product((0, 1), repeat=len(x)))))
    value, dw, dt = like(w, t)
    assert value == pytest.approx(want)
    for x, g, move in ((w, dw, lambda d: like(w + d, t)[0]), (t, dt, lambda d: like(w, t + d)[0])):
        for i in np.ndindex(x.shape):
            d = np.zeros_like(x)
            d[i] = 1e-5
            assert g[i] == pytest.approx((move(d) - move(-d)) / 2e-5, abs=1e-6)
