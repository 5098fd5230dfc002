"""Very long texts, and long beside short ones: results as from plain code, in bounded memory."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from platewise.llm import chat_format, common, license_scan, ngram_join, quality_crf, token_files, toxicity_gru


@pytest.mark.parametrize("text", [" " * 2_000_000, "a" * 2_000_000, "7" * 2_000_000, "\n" * 2_000_000, "x" + " \n" * 500_000 + "y", "\u3000" * 300_000 + " end"])
def test_a_chat_turn_of_one_long_run(spark, text):
    df = spark.createDataFrame([(1, 0, "assistant", text), (1, 1, "user", "short")], "conv_id long, turn int, role string, text string")
    rows = {r.turn: r for r in chat_format.read_turns(chat_format.format_chat(df)).collect()}
    assert rows[0].text == text and rows[0].loss == text and rows[1].text == "short" and rows[1].loss is None


def test_long_runs_change_no_id(monkeypatch):
    """Runs of any length from three on cut where the pattern cuts."""
    import re

    enc, rng = chat_format.encoding("byte_bpe_50k.tiktoken"), random.Random(4)
    monkeypatch.setattr(chat_format, "_SPACES", re.compile(chat_format._SPACES.pattern.replace("{1000,}", "{3,}")))
    for _ in range(400):
        text = "".join(rng.choice(["a", "it's", "9", "é", ".", " ", "  ", "\n", "\t", "\u3000", "\x1c", "\x85", " " * 9]) for _ in range(rng.randrange(60)))
        assert chat_format.encode_text(enc, text) == enc.encode_ordinary(text)


def test_blocks_of_lines_change_no_score(monkeypatch):
    rng = random.Random(5)
    w = np.random.default_rng(5).standard_normal((quality_crf.WIDTH, 2))
    for n in (1, 2, 7, 50):
        text = "\n".join(rng.choice(["", "  ", "Good line here.", "BAD | 9!", "repeated", " ".join(rng.choice("ab") * 3 for _ in range(5))]) for _ in range(n))
        monkeypatch.setattr(quality_crf, "LINES", 10**6)
        own, weight = quality_crf.line_features(text)
        want = quality_crf.with_neighbours(own) @ w
        for size in (1, 3, 10):
            monkeypatch.setattr(quality_crf, "LINES", size)
            got, weights = quality_crf.line_scores(text, w)
            assert got.shape == want.shape and np.allclose(got, want) and np.array_equal(weights, weight)


def test_a_long_chain_beside_short_ones():
    """Forty thousand lines beside a thousand texts of four: the same as alone, in the memory of the lines."""
    rng = np.random.default_rng(6)
    chains = [rng.standard_normal((4, 2)) for _ in range(500)] + [rng.standard_normal((40_000, 2))] + [rng.standard_normal((4, 2)) for _ in range(500)]
    t = np.array([[1.0, -1.0], [-0.5, 0.5]])
    tracemalloc.start()
    p, pairs, log_z = quality_crf.marginals(chains, t)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    alone = [quality_crf.marginals([c], t) for c in (chains[0], chains[500], chains[-1])]
    for i, (q, _, z) in zip((0, 500, -1), alone, strict=True):
        assert np.allclose(p[i], q[0]) and log_z[i] == pytest.approx(z[0])
    assert pairs.sum() == pytest.approx(39_999 + 3 * 1000)


def test_document_score_by_enumeration():
    """The query's score of a text: the length-weighted chance of good lines over all labellings."""
    import itertools

    rng = np.random.default_rng(7)
    w, t = rng.standard_normal((quality_crf.WIDTH, 2)), rng.standard_normal((2, 2))
    text = "First good line.\n\nSECOND | line 12 !!\nthird\nFirst good line."
    s, weight = quality_crf.line_scores(text, w)
    assert weight.tolist() == [len(x.replace(" ", "")) for x in text.split("\n") if x]
    total, good = 0.0, np.zeros(len(s))
    for labels in itertools.product((0, 1), repeat=len(s)):
        chance = np.exp(sum(s[i, y] for i, y in enumerate(labels)) + sum(t[a, b] for a, b in itertools.pairwise(labels)))
        total += chance
        good += chance * np.array(labels)
    assert quality_crf.document_scores([s], [weight], t)[0] == pytest.approx((good / total) @ weight / weight.sum())


# --- words, shingles, windows and ids of texts that are read in parts --------------------------------------------
ALPHABET = ["a", "B", "\u00e9", " ", " ", "\n", "0", ".", "!", "\u6f22", "abcdefghij", "<|endoftext|>", "word "]


def some_text(rng, n):
    return "".join(rng.choice(ALPHABET) for _ in range(n))


def small_blocks(monkeypatch, size):
    monkeypatch.setattr(common, "BLOCK_BYTES", size)
    common._powers.cache_clear()


@pytest.mark.parametrize("separators", [common.SPACE_SEPARATORS, common.ALNUM_SEPARATORS], ids=["space", "alnum"])
def test_blocks_change_no_hash(monkeypatch, separators):
    """Words that fill many blocks, blocks that hold many rows: hashes and bounds are those of one block, and of each word alone."""
    rng = random.Random(8)
    columns = [pa.array([None if rng.random() < 0.1 else some_text(rng, rng.randrange(30)) for _ in range(rng.randrange(6))], pa.string()) for _ in range(80)]
    want = [(common.words_of(c, separators), common.grams_of(*common.words_of(c, separators), 3)) for c in columns]
    for size in (1, 2, 7, 64):
        small_blocks(monkeypatch, size)
        for c, ((words, bounds), (grams, gram_bounds)) in zip(columns, want, strict=True):
            got = common.words_of(c, separators)
            assert np.array_equal(got[0], words) and np.array_equal(got[1], bounds)
            data, _, s, e, _ = common.word_spans(c, separators)
            assert np.array_equal(common.span_hashes(data, s, e), words)
            again = common.grams_of(words, bounds, 3)
            assert np.array_equal(again[0], grams) and np.array_equal(again[1], gram_bounds)
    common._powers.cache_clear()


@pytest.mark.parametrize("text", ["abc de " * 1_500_000, "x" * 10_000_000, " " * 10_000_000], ids=["words", "one word", "white space"])
def test_memory_of_a_long_text(text):
    """Ten megabytes take less than thirteen bytes for each byte, with all shingles."""
    column = pa.array([text])
    common.words_of(pa.array(["warm"]))
    for work in (lambda: common.words_of(column), lambda: ngram_join.shingle_sets(column), lambda: license_scan._grams(column)):
        tracemalloc.start()
        work()
        assert tracemalloc.get_traced_memory()[1] < 13 * len(text)
        tracemalloc.stop()


def test_shingles_of_a_text_alone_and_among_others():
    rng = random.Random(9)
    for n in (0, 1, 3, 4, 5, 6, 40, 400):
        text = " ".join(rng.choice(["x", "y", "z"]) for _ in range(n))
        grams, bounds = ngram_join.shingle_sets(pa.array(["other words are here now", text, None]))
        alone, own = ngram_join.shingle_sets(pa.array([text]))
        assert np.array_equal(alone, grams[bounds[1] : bounds[2]]) and own.tolist() == [0, len(alone)]


def test_windows_of_a_text_in_parts(monkeypatch):
    """The parts of a long text hold its windows, each once, and its score is that of the whole."""
    rng = random.Random(10)
    model = toxicity_gru.start_model()
    for table in ("words", "grams"):
        model[table] = np.random.default_rng(11).normal(0, 1, model[table].shape).astype(np.float32)
    for n in (0, 1, 63, 64, 65, 96, 97, 128, 129, 160, 161, 500, 1000):
        text = ", ".join(rng.choice(["one", "two", "b", "four4", "\u00fc"]) for _ in range(n)) + "!" * (n % 3)
        column = pa.array([text])
        whole, inputs = toxicity_gru.text_scores(column, model), toxicity_gru.Inputs(column)
        words = text.replace("!", "").split(", ") if n else []
        want = sorted(words[i : i + 64] for i in inputs.start)
        monkeypatch.setattr(toxicity_gru, "CHUNK_BYTES", 0)
        for size in (32, 64, 320):
            monkeypatch.setattr(toxicity_gru, "PART_WORDS", size)
            got = []
            for part in toxicity_gru.window_parts(column):
                own = [w for w in part[0].as_py().replace("!", "").split(", ") if w]
                got += [own[i : i + 64] for i in toxicity_gru.Inputs(part).start]
            assert sorted(got) == want
            assert toxicity_gru.text_scores(column, model) == pytest.approx(whole, abs=1e-5)
        monkeypatch.undo()


def test_ids_of_a_text_in_parts(monkeypatch):
    """Parts of a long text give the ids that the library gives for the whole."""
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng, encoder = random.Random(12), token_files.word_encoder("word_bpe_49k.json")
    for size in (1, 5, 40):
        monkeypatch.setattr(common, "CHUNK_BYTES", size)
        for _ in range(60):
            text = some_text(rng, rng.randrange(120))
            ids, counts = encoder.encode(pa.array([text]), 2)
            assert ids.tolist() == [*library.encode(text, add_special_tokens=False).ids, 2] and counts.tolist() == [len(ids)]
