"""Token counts against the library, hard negatives and whitening against plain numpy, and their hard inputs."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from oracle import connect, same
from platewise.llm import hard_negatives, token_counts, whitening
from platewise.llm.common import stored

VECTORS = "vec_id long, embedding array<float>, label int, n long, score long"


# --- token counts ---------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.VOCABULARY))


@pytest.fixture(scope="module")
def machine():
    return token_counts.transducer(token_counts.VOCABULARY)


def drawn_texts(machine) -> list[str | None]:
    rng = random.Random(11)
    texts = [None, "", " ", "   ", "a", "\n\n\t x", "▁▁ a", "<s> </s> <unk> hi <0x0A>", "é中文字漢\U0001f600 z\0", "\x00"]
    pieces = list(machine.scores)
    for _ in range(60):
        texts.append("".join(rng.choice(pieces) for _ in range(rng.randrange(1, 400))).replace("▁", rng.choice(["", " "])))
        texts.append("".join(rng.choice("etaoinsh  \n.,AB01éß中\U0001f600") for _ in range(rng.randrange(1, 2000))))
        texts.append("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(1, 1500))))
    return texts


@pytest.mark.parametrize("block", [1 << 20, 700])
def test_counts_equal_the_library(machine, library, block):
    texts = drawn_texts(machine)
    got = token_counts.count_tokens(pa.array(texts, pa.string()), machine, most=block)
    assert got.tolist() == [len(library.encode(t or "")) for t in texts]


@pytest.mark.parametrize("text", ["a" * 300_000, " " * 300_000, "\n" * 50_000, "0123456789" * 20_000, "ab1" * 50_000, "the" * 50_000, "=-" * 50_000, "aA" * 30_000 + " b", "中" * 30_000])
def test_long_runs_without_a_cut(machine, library, text):
    """No chunk but the first knows its state, and guesses may never come true."""
    assert token_counts.count_tokens(pa.array([text, "x", text[:777]]), machine).tolist() == [len(library.encode(t)) for t in (text, "x", text[:777])]


def test_a_worker_may_forget(library):
    small = token_counts.Transducer(token_counts.transducer(token_counts.VOCABULARY).scores, most_states=50)
    texts = [t for t in drawn_texts(small) if t][:40]
    assert token_counts.count_tokens(pa.array(texts), small, most=300).tolist() == [len(library.encode(t)) for t in texts]


def test_characters_need_entries():
    with pytest.raises(ValueError):
        token_counts.Transducer({"ab": 0.0, "a": -1.0})


def test_entries_across_spaces(machine):
    """A vocabulary whose entries span spaces has no cuts, and the state maps alone must do."""
    own = token_counts.Transducer({"a": -9.0, "b": -8.0, "▁": -7.0, "a▁": -1.0, "▁b": -2.0, "ba": -3.0, "a▁b": -4.0, "ba▁": -0.5})
    assert not own.space_cuts
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab  ") for _ in range(n)) for n in (1, 5, 300, 700, 2000)]
    assert token_counts.count_tokens(pa.array(texts), own, prefix=False).tolist() == [len(own.encode(t.replace(" ", "▁"))) for t in texts]


def test_count_query_on_hard_rows(spark, library):
    texts = [None, "", " \n", "one", "one", "w " * 5000, "ça va <s>", "x" * 100_000]
    df = spark.createDataFrame([(None if i == 3 else i // 2, t, 1, "t") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, n_bytes string")
    out = token_counts.token_counts(df)
    want = sorted((str(None if i == 3 else i // 2), len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for i, t in enumerate(texts))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect()) == want
    assert token_counts.token_counts(df.limit(0)).count() == 0


def test_count_query(spark, library):
    data = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    out = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.op11_token_counts(spark, data).collect()}
    assert out == {i: (len(t.encode()), len(library.encode(t))) for i, t in texts.items()}


# --- hard negatives -------------------------------------------------------------------------------------------
def negatives_by_hand(rows: list[tuple]) -> list[tuple]:
    kept = []
    for i, v, label, *_ in rows:
        if i is not None and label is not None and v is not None and all(c is not None and np.isfinite(c) for c in v):
            kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(np.float32(c)))) for c in v]))
    out = []
    for a, la, x in kept:
        if a % 50 == 0:
            scored = [(-sum(p * q for p, q in zip(x, y, strict=False)), i, lb) for i, lb, y in kept if i != a]
            for s, i, _ in sorted((t for t in scored if t[2] == la), key=lambda t: t[:2])[:5]:
                fits = sorted(t[:2] for t in scored if t[2] != la and 50 * -s <= 100 * -t[0] <= 95 * -s)[:3]
                out += [(a, i, k + 1, j, -s, -t) for k, (t, j) in enumerate(fits)]
    return sorted(out)


def mined(df) -> list[tuple]:
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.fixture
def small_blocks(monkeypatch):
    for name, n in (("BLOCK_ROWS", 7), ("ANCHOR_ROWS", 3), ("GROUP_ROWS", 40)):
        monkeypatch.setattr(hard_negatives, name, n)


@pytest.mark.parametrize("kind", ["clusters", "noise", "ties", "one label"])
def test_negatives_by_hand(spark, small_blocks, kind):
    rng = np.random.default_rng(5)
    n, width = 600, 6
    centres = rng.standard_normal((5, width)) * 2
    v = {"clusters": centres[rng.integers(0, 5, n)] + 0.3 * rng.standard_normal((n, width)), "noise": rng.standard_normal((n, width)), "ties": rng.integers(-1, 2, (n, width)).astype(float), "one label": rng.standard_normal((n, width))}[kind]
    label = np.zeros(n, int) if kind == "one label" else rng.integers(0, 10, n)
    rows = [(i, v[i].tolist(), int(label[i]), i, 0) for i in range(n)]
    got = mined(spark.createDataFrame(rows, VECTORS).repartition(5))
    assert got == negatives_by_hand(rows) and got


def test_negatives_of_hard_rows(spark, small_blocks):
    rng = np.random.default_rng(6)
    rows = [(i % 260, rng.integers(-2, 3, 4).tolist(), int(rng.integers(0, 3)), 0, 0) for i in range(400)]
    rows = [(i, [float(c) for c in v], b, p, q) for i, v, b, p, q in rows]
    bad = [[1.0, None, 1.0, 1.0], [1.0, float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0, 1.0], None]
    rows += [(1000 + 50 * k, v, 1, 0, 0) for k, v in enumerate(bad)] + [(None, [2.0] * 4, 1, 0, 0), (500, [2.0] * 4, None, 0, 0)]
    rows += [(600, [0.0] * 4, 1, 0, 0), (601, [1.0, 1.0], 1, 0, 0), (602, [], 2, 0, 0), (650, [-1.0] * 4, 2, 0, 0)]
    df = spark.createDataFrame(rows, VECTORS)
    assert mined(df) == negatives_by_hand(rows)
    assert mined(df.limit(0)) == [] and mined(df.filter("vec_id = 600")) == [] and mined(df.filter("vec_id = 602")) == []


def test_bounds_hold_every_score(spark):
    rng = np.random.default_rng(7)
    x = (rng.standard_normal((400, 8)) * rng.uniform(1, 300, (400, 1))).astype(np.int32)
    x[:20], x[20:40] = x[20:40] * 3, 0
    directions = hard_negatives.unit(x[100:108].astype(float))

    def block(at):
        a = x[at]
        return hard_negatives.Block({"label": np.zeros(len(a)), "id": at, "width": 8, "x": a.tobytes(), "norm": np.linalg.norm(a.astype(float), axis=1), "angle": hard_negatives.angles(a, directions).ravel()})

    order = np.argsort(hard_negatives.angles(x, directions)[:, 0])
    anchors, blocks = block(np.arange(0, 400, 9)), [block(order[i : i + 10]) for i in range(0, 400, 10)]
    lower, upper = hard_negatives.score_bounds(anchors, blocks)
    for j, b in enumerate(blocks):
        s = hard_negatives.integer_scores(anchors.x, b.x)
        assert (s.min(axis=1) >= lower[:, j]).all() and (s.max(axis=1) <= upper[:, j]).all()
    assert (upper < upper.max(axis=1, keepdims=True) / 2).any()
    wide = np.array([[2**31 - 1] * 8], np.int32)
    assert hard_negatives.integer_scores(np.array([[2**27] * 8]), wide)[0, 0] == 8 * 2**27 * (2**31 - 1)


# --- whitening ------------------------------------------------------------------------------------------------
def whitened_by_hand(x: np.ndarray, most: int = 8):
    n, s = len(x), x.sum(axis=0)
    c = (x * n - s) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1][:most], q[:, ::-1][:, :most]
    return c @ q / np.sqrt(e), e / np.trace(c.T @ c / n), ((x * n - s).astype(object) ** 2).sum(axis=1)


def test_whitening_by_hand(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 37)
    rng = np.random.default_rng(8)
    v = (rng.standard_normal((500, 12)) @ np.diag(np.linspace(3, 0.2, 12))).astype(np.float32)
    rows = [(i, v[i].tolist(), 0, i, i) for i in range(500)]
    rows += [(900, None, 0, 0, 0), (901, [1.0] * 11 + [None], 0, 0, 0), (902, [float("nan")] * 12, 0, 0, 0), (903, [1.0] * 11, 0, 0, 0), (904, [float("-inf")] * 12, 0, 0, 0)]
    out = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(3)).toPandas()
    assert len(out) == 500 * 8 and set(out.n) == {500} and out.identity_error.max() < 1e-10 and out.identity_error.nunique() == 1
    want, explained, deviation = whitened_by_hand(np.floor(1024 * v.astype(float)).astype(np.int64) + 100_000)
    got = out.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(got * np.sign((got * want).sum(axis=0)) - want).max() < 1e-10
    assert np.allclose(out.groupby("component").explained.first(), explained, rtol=1e-12)
    assert out.groupby("vec_id").deviation.first().tolist() == deviation.tolist()


def test_whitening_of_few_directions(spark):
    """Fewer directions than components, repeated variances, repeated rows, null ids, and nothing at all."""
    square = [[0.0, 0.0, 1.0], [0.0, 1.0, 1.0], [1.0, 0.0, 1.0], [1.0, 1.0, 1.0]]
    df = spark.createDataFrame([(None if i == 3 else 1, v, 0, 0, 0) for i, v in enumerate(square)], VECTORS)
    out = whitening.whiten(df).toPandas()
    assert sorted(out.component) == [1] * 4 + [2] * 4 and np.allclose(out.explained, 0.5) and out.vec_id.isna().sum() == 2
    assert np.allclose((out.whitened**2).groupby(out.component).sum(), 4) and set(out.deviation) == {4096**2 // 2}
    for some in (df.limit(0), df.limit(1), spark.createDataFrame([(1, [], 0, 0, 0), (2, None, 0, 0, 0)], VECTORS), spark.createDataFrame([(i, [0.5, 0.5], 0, 0, 0) for i in range(9)], VECTORS)):
        assert whitening.whiten(some).count() == 0
    with pytest.raises(OverflowError):
        whitening.Centre(10**6, np.array([0]), np.array([0])).deviations(np.array([[10**5]]))


@pytest.mark.parametrize("spectrum", [np.linspace(5, 1, 20), np.r_[np.full(6, 2.0), np.full(14, 1.0)], np.r_[1e6, 1e3, np.geomspace(1, 1e-6, 18)], np.r_[np.arange(9, 0, -1.0), np.zeros(11)]])
def test_bidiagonalisation(spectrum):
    """Singular values and vectors of a matrix that is known by its products; repeated, spread and zero values too."""
    rng = np.random.default_rng(9)
    q, _ = np.linalg.qr(rng.standard_normal((300, 20)))
    t, _ = np.linalg.qr(rng.standard_normal((20, 20)))
    a = q * spectrum @ t.T
    values, right, steps = whitening.bidiagonalise(lambda w: ((a @ w).T @ (a @ w[:, -1]), a.T @ (a @ w[:, -1])), 20, 8)
    assert np.allclose(values[:8], np.sort(spectrum)[::-1][:8], rtol=1e-9, atol=1e-12 * spectrum.max()) and steps <= 20
    lead = right[:, :8]
    assert np.abs(lead.T @ lead - np.eye(8)).max() < 1e-12
    assert np.abs(np.linalg.norm(a @ lead, axis=0) - values[:8]).max() < 1e-9 * spectrum.max()


def test_early_end_of_the_bidiagonalisation():
    """Of a thousand dimensions, some tens of steps suffice where eight directions stand out."""
    rng = np.random.default_rng(10)
    a = rng.standard_normal((1200, 8)) @ np.diag(np.arange(30, 14, -2.0)) @ rng.standard_normal((8, 200)) + 0.01 * rng.standard_normal((1200, 200))
    values, right, steps = whitening.bidiagonalise(lambda w: ((a @ w).T @ (a @ w[:, -1]), a.T @ (a @ w[:, -1])), 200, 8)
    assert steps < 60 and np.allclose(values[:8], np.linalg.svd(a, compute_uv=False)[:8], rtol=1e-12)


def test_whitening_query(spark):
    data = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").toPandas()
    out = stored(whitening.op13_whitening(spark, data), "whitened").toPandas().sort_values(["vec_id", "component"])
    want, explained, deviation = whitened_by_hand(np.floor(1024 * np.array(table.embedding.tolist(), float)).astype(np.int64) + 100_000)
    got = out.whitened.to_numpy().reshape(-1, 8)
    assert np.abs(got * np.sign((got * want).sum(axis=0)) - want).max() < 1e-9 and out.deviation.to_numpy()[::8].tolist() == deviation.tolist()


def test_negatives_query(spark):
    data = "/root/testdata/sf0.1"
    assert same(hard_negatives.op12_hard_negatives(spark, data).toPandas(), connect(data).execute(hard_negatives.ORACLE).df())
