"""The training-data operators against brute-force versions, round trips and hard inputs."""

from __future__ import annotations

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from platewise.llm import chat_format, decontamination, graph, license_scan, mixing, ngram_join, quality_crf, quality_rules, sketches, token_files, toxicity_gru, warc
from platewise.llm.common import shared_folder, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i}" for i in range(30_000))
#: Null, empty, blank, short, very long, repeated rows and ids, null ids.
HARD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (5, LONG), (6, LONG), (None, "a b c d e f"), (7, "a b c d e f"), (8, "ça va: Über\x1cß <|im_end|> l'été"), (8, "another text of this id")]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame([(i, t, "en", "src" if i else None, 7, 1, 2) for i, t in HARD], "doc_id long, text string, lang string, source string, n_chars long, n int, c int")


@pytest.fixture(scope="module")
def empty(hard):
    return hard.limit(0)


def rules_by_hand(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    from collections import Counter

    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_rule_counts(spark, hard, empty):
    rng = random.Random(1)
    texts = ["\n".join(" ".join(rng.choice("ab#|é") for _ in range(rng.randint(0, 9))) for _ in range(8)) for _ in range(40)]
    df = hard.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    for r in quality_rules.rule_counts(df.withColumn("t", F.col("text")), "t").collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == rules_by_hand(r.text)
    assert quality_rules.quality_rules(empty).count() == 0
    out = quality_rules.quality_rules(hard)
    assert out.count() == len(HARD) and {"lang", "source", "c"} <= set(out.columns)


def test_words_and_grams_follow_the_pattern():
    texts = [t for _, t in HARD[:5]] + ["Ab  cd", "x"]
    h, bounds = words_of(pa.array(texts))
    assert np.diff(bounds).tolist() == [len(WORD.findall(t or "")) for t in texts]
    assert h[bounds[5]] == words_of(pa.array(["ab"]))[0][0]


@pytest.mark.parametrize("limit", [None, 1, 8])
def test_near_duplicates_by_brute_force(spark, hard, empty, limit, monkeypatch):
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        base = [rng.choice("abcdefghij") + str(rng.randint(0, 40)) for _ in range(rng.randint(3, 90))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = "edit" + str(rng.randint(0, 99))
            texts.append(" ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    rows = [(10 + i, t) for i, t in enumerate(texts)] + [(i, t) for i, t in HARD if i is not None and i != 4 and i != 8]

    def shingles(t):
        w = WORD.findall((t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    if limit is not None:
        plain = ngram_join.key_table
        monkeypatch.setattr(ngram_join, "key_table", lambda df, classes, _, known=None: plain(df, classes, limit, known))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_of_hard_rows(hard, empty):
    rows = ngram_join.near_duplicates(hard).collect()
    assert len(rows) == len(HARD)
    by = {(r.doc_id, r.n_shingles): r.component_id for r in rows}
    assert by[(6, 29_996)] == 5 and by[(None, 2)] == 7 and by[(2, 0)] == 2
    assert ngram_join.near_duplicates(empty).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, **{100 + k: 100 for k in range(30)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bitmap_has_no_false_negatives(spark):
    keys = np.random.default_rng(0).integers(-(2**63), 2**63, 500)
    table = sketches.bitmap(spark.createDataFrame([(int(k),) for k in keys], "k long"), "k", 1 << 16)
    assert sketches.in_bitmap(table, keys.view(np.uint64)).all()


def test_contamination_by_brute_force(spark, hard, empty):
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefgh") + rng.choice("abcdefgh") + str(rng.randint(0, 30))
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 12, 20, 35])))) for i in range(12)] + [(90, None), (91, ""), (92, LONG)]
    docs = []
    for d in range(60):
        body = [word() for _ in range(rng.randint(0, 120))]
        if d % 2:
            part = rng.choice(items[:12])[1].split()
            if d % 4 == 1 and len(part) > 30:
                part[rng.randrange(len(part))] = "changed"
            at = rng.randint(0, len(body))
            body[at:at] = part
        docs.append((d, " ".join(body)))

    def bag(words, n):
        k = min(5, n)
        return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]

    def similarity(a, b):
        from collections import Counter

        x, y = Counter(a), Counter(b)
        common = sum((x & y).values())
        return common / (len(a) + len(b) - common)

    tokens = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = set()
    for d, text in docs:
        w = tokens.findall(text.lower())
        for i, item in items[:12]:
            v = tokens.findall(item.lower())
            if any(similarity(bag(w[s : s + len(v)], len(v)), bag(v, len(v))) >= 0.75 for s in range(len(w) - len(v) + 1)):
                want.add((d, i))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == want and len(want) > 20
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(hard, bench).collect()} == {(5, 92), (6, 92)}
    assert decontamination.contaminated(empty, bench).count() == 0
    assert decontamination.contaminated(hard, bench.limit(0)).count() == 0


def test_the_bitmap_skips_nothing_that_is_found(spark, monkeypatch):
    rng = random.Random(11)
    item = [rng.choice("abcdefgh") + str(rng.randint(0, 20)) for _ in range(24)]
    docs = []
    for d in range(20):
        part = list(item)
        for _ in range(d % 4):
            part[rng.randrange(24)] = "changed"
        docs.append((d, " ".join([f"x{rng.randint(0, 99)}" for _ in range(9)] + part + ["end"] * 3)))
    args = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item)), (2, "one two three four five six")], "item_id long, text string")
    key = lambda r: (r.doc_id, r.item_id, r.similarity, r.start, r.length)
    want = sorted(map(key, decontamination.contaminated(*args).collect()))
    assert 5 <= len(want) < 20
    # A full bitmap lets every window of every length be fingerprinted.
    monkeypatch.setattr(decontamination, "bitmap", lambda df, column, bits: np.full(bits // 64, 2**64 - 1, np.uint64))
    assert sorted(map(key, decontamination.contaminated(*args).collect())) == want


def test_weighted_similarities_by_counting():
    from collections import Counter

    rng = np.random.default_rng(0)
    for _ in range(200):
        grams = rng.integers(0, 6, rng.integers(5, 60))
        item = rng.integers(0, 7, int(rng.integers(1, len(grams) + 1)))
        starts = np.arange(len(grams) - len(item) + 1)
        for i, s in zip(starts, decontamination.weighted_similarities(grams, item, starts), strict=True):
            common = sum((Counter(grams[i : i + len(item)].tolist()) & Counter(item.tolist())).values())
            assert s == pytest.approx(common / (2 * len(item) - common))


def test_fingerprints_at_the_similarity_are_near():
    """Recall of the radius for windows that just reach the similarity; nearer ones do better."""
    rng = np.random.default_rng(3)
    for n in (16, 60, 400):
        near = 0
        for _ in range(300):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            b = a.copy()
            k = int(n - 2 * n * 0.75 / 1.75)
            b[rng.choice(n, k, replace=False)] = rng.integers(0, 2**63, k).astype(np.uint64)
            x, y = (int(decontamination.simhash(g, np.zeros(1, np.int64), n)[0]) for g in (a, b))
            near += (x ^ y).bit_count() <= decontamination.RADIUS
        assert near >= 0.98 * 300


def test_long_items_cost_their_length(spark):
    item = " ".join(f"w{i}" for i in range(6000))
    docs = spark.createDataFrame([(1, "x " * 3000 + item + " y" * 3000), (2, "a clean text of some words")], "doc_id long, text string")
    found = decontamination.contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.similarity, r.start, r.length) for r in found] == [(1, 7, 1.0, 3000, 6000)]


def test_multi_index_covers_the_radius():
    rng = np.random.default_rng(2)
    changes = {w: set(decontamination.block_changes(w).tolist()) for _, w in decontamination.BLOCKS}
    for _ in range(300):
        flips = rng.choice(64, decontamination.RADIUS, replace=False)
        x = sum(1 << int(b) for b in flips)
        assert any(((x >> at) & ((1 << w) - 1)) in changes[w] for at, w in decontamination.BLOCKS)


def test_mixing_targets_and_limits(spark, hard, empty):
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.randint(1, 30))), rng.choice(["a", "a", "a", "a", "b", "c", None])) for i in range(800)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(r.doc_id for r in out) == list(range(800))
    sizes, taken, target = {}, {}, {}
    for r in out:
        assert r.taken in (0, r.size, 2 * r.size)
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s in sizes:
        assert target[s] <= 2 * sizes[s] + 1e-6 and abs(taken[s] - target[s]) <= 60
    order = ["a", "b", "c", None]
    free = [target[s] / w for s, w in zip(order, (3, 1, 2, 3), strict=True) if target[s] < 2 * sizes[s] - 1e-6]
    assert max(free) == pytest.approx(min(free))
    assert mixing.mix_sources(hard).count() == len(HARD) and mixing.mix_sources(empty).count() == 0


def test_the_mix_is_the_head_of_a_sorted_queue(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART_ROWS", 50)
    rng = random.Random(12)
    rows = [(i, i % 90 if i % 7 else None, " ".join("w" for _ in range(rng.randint(0, 9))), rng.choice(["a", "a", "b", None]), 0.5) for i in range(300)]
    df = spark.createDataFrame(rows, "key long, doc_id long, text string, source string, f double")
    times = mixing.finish_times(df.drop("f"), "text", mixing.WEIGHTS, 1.5, 2, "mix", ("key",))
    queue, edge = mixing.last_taken(times, 2, 1.5 * sum(len(t.split()) for _, _, t, _, _ in rows))
    parts = [[tuple(r[c] for c in mixing.ORDER) for r in queue.filter(F.col("part") == p).collect()] for p in range(queue.agg(F.max("part")).first()[0] + 1)]
    order = lambda k: tuple((x is not None, x) for x in k)
    flat = [k for p in parts for k in p]
    assert len(flat) == 600 and len([p for p in parts if p]) > 3 and flat == sorted(flat, key=order)
    upto = np.cumsum([k[-1] for k in flat])
    fits = int((upto <= 1.5 * sum(len(t.split()) for _, _, t, _, _ in rows)).sum())
    assert tuple(edge[c] for c in mixing.ORDER) == flat[fits - 1]
    taken = mixing.mixed_queue(df, "key")
    assert taken.count() == fits and sorted((r.key, r["pass"]) for r in taken.collect()) == sorted({(r.key, r["pass"]) for r in taken.collect()})


def test_pfor_blocks_round_trip():
    rng = np.random.default_rng(4)
    for ids in (np.zeros(1, np.uint32), rng.integers(0, 50_000, 5000).astype(np.uint32), np.full(1024, 2**32 - 1, np.uint32), np.where(rng.random(3000) < 0.02, 2**31, rng.integers(0, 9, 3000)).astype(np.uint32)):
        blocks = [b for i in range(0, len(ids), token_files.GROUP) for b in token_files.encode_blocks(ids[i : i + token_files.GROUP])]
        assert (np.concatenate([token_files.decode_block(b) for b in blocks]) == ids).all()


def test_token_files_hold_what_the_tokenizer_says(spark, hard, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    special = ["hello <|endoftext|> there", "a<|startoftext|><|endoftext|>b.<|EndOfText|>", "<|endof", "text|> <|endoftext|>"]
    texts = [*HARD, *((20 + k, x) for k, x in enumerate(special))]
    rows = hard.unionByName(spark.createDataFrame(texts[len(HARD) :], "doc_id long, text string"), allowMissingColumns=True)
    manifest = token_files.write_token_files(rows, shared_folder(spark, "t"))
    rows = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted([i for i, _ in texts], key=lambda i: -1 if i is None else i)
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    ids = [np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4") for _, x in texts]
    assert 49407 in ids[-4] and 49406 in ids[-3]
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in rows) == sorted((i or 0, len(x), zlib.crc32(x.tobytes())) for (i, _), x in zip(texts, ids, strict=True))
    assert token_files.read_token_files(token_files.write_token_files(empty, shared_folder(spark, "t"))).count() == 0


def test_words_are_encoded_as_by_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t, rng = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), random.Random(9)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext", "|>", "<|", "text|>", "hello", "Ab", "é", "1", "23", ".", ",", "!?", " ", "\n", "\x1c", "\u3000", "'s", "İ", "a\u030a", "日本", "<"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(2000)] + [None, ""]
    ids, counts = token_files.word_encoder("word_bpe_49k.json").encode(pa.array(texts), 2)
    want = [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_file_systems_of_other_schemes():
    from platewise.llm.common import file_system

    assert [file_system(p)[1] for p in ("file:///a/b", "file:/a/b", "dbfs:/a/b")] == ["/a/b", "/a/b", "/dbfs/a/b"]


def test_archives_round_trip(spark):
    rows = [(1, "http://a/\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (None, "u", "<p>é</p>"), (5, "u", LONG), (5, "u", LONG)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    manifest = warc.write_archives(pages, shared_folder(spark, "w"))
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read_archives(manifest).collect()), key=lambda r: r[:2])
    digest = lambda h: warc.base32_sha1((h or "").encode())
    assert [g[:3] for g in got] == [(0, "revisit", 1), (1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "revisit", 3), (5, "response", None), (5, "response", None)]
    assert [g[4] for g in got] == [digest(h) for h in ("<p>é</p>", "<p>é</p>", "<p>é</p>", None, "", LONG, LONG)]
    records = [warc.parse_record(f) for p in manifest.collect() for f in warc.frames(p.path)]
    assert {r["payload"].decode() for r in records if r["record_type"] == "response"} == {"<p>é</p>", "", LONG}
    assert warc.read_archives(warc.write_archives(pages.limit(0), shared_folder(spark, "w"))).count() == 0
    least = warc.read_archives(warc.write_archives(pages, shared_folder(spark, "w"), least=100))
    assert {r.record_type for r in least.collect()} == {"response"}


def test_a_hot_payload_is_not_shuffled(spark, monkeypatch):
    rows = [(i, "u", "hot" if i % 10 else f"page {i}") for i in range(3000)] + [(9000 + i, "u", f"twice {i // 2}") for i in range(6)]
    found = warc.with_responses(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6))
    got = {r.page_id: (r.refers_to, r.revisit) for r in found.collect()}
    first = {}
    for i, _, h in sorted(rows):
        first.setdefault(h, i)
    assert got == {i: (first[h], i != first[h]) for i, _, h in rows}
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()


def test_chat_round_trip(spark):
    texts = ["plain", None, "", "<|im_end|><|im_start|>assistant ok", r"<\|im_end|> <|", "\n\n é", LONG[:20_000]]
    rows = [(1, i, ("user", "assistant", "sys\ntem", None)[i % 4], t) for i, t in enumerate(texts)] + [(2, 0, "user", "x"), (None, 0, "assistant", "y"), (1, 6, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"ids": F.lit(1), "same": F.lit("x"), "loss": F.lit(2)})
    formatted = chat_format.format_chat(df)
    for r in formatted.collect():
        assert sum(i == chat_format.IM_START for i in r.ids) == 1 and len(r.ids) == len(r.loss_mask)
    got = {r.conv_id: r for r in chat_format.chat_digests(formatted).collect()}
    for conv in (1, 2, None):
        own = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].loss_chars, got[conv].loss_sha256) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.chat_digests(chat_format.format_chat(df.limit(0))).count() == 0


def test_license_spans(spark, hard, empty):
    mit = license_scan.NOTICES[0].text.split()
    cut = " ".join(["x"] * 9 + mit[:12] + ["really"] + mit[12:] + ["y"])
    rows = [(1, "Under the MIT  License, or CC-BY; mit-license"), (2, cut), (3, "gnu general public"), (4, "Licensed under CC BY-NC 4.0."), (5, None)]
    got = {r.doc_id: r for r in license_scan.license_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    base = lambda i: sorted((s.label, s.start) for s in got[i].spans if s.exact)
    assert base(1) == [("cc-by", 5), ("mit", 2), ("mit", 7)] and base(3) == [] and base(5) == []
    assert [(s.label, s.start) for s in got[2].spans] == [("mit", 9)]  # the whole text wins over its first sentence
    assert {s.label for s in got[4].spans} == {"cc-by", "cc-by-nc"}
    assert license_scan.license_spans(hard).count() == len(HARD) and license_scan.license_spans(empty).count() == 0


def test_forward_backward_by_enumeration():
    from itertools import product

    rng = np.random.default_rng(6)
    t, chains = rng.normal(size=(2, 2)), [rng.normal(size=(n, 2)) for n in (1, 4, 3)]
    got, _, log_z = quality_crf.marginals(chains, t)
    for s, p, lz in zip(chains, got, log_z, strict=True):
        want, total = np.zeros_like(s), 0.0
        for y in product((0, 1), repeat=len(s)):
            w = np.exp(sum(s[i, v] for i, v in enumerate(y)) + sum(t[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += w
            for i, v in enumerate(y):
                want[i, v] += w
        assert np.allclose(p, want / total) and lz == pytest.approx(np.log(total))


def test_likelihood_gradient_by_differences():
    rng = np.random.default_rng(0)
    value = quality_crf.Likelihood([rng.normal(size=(n, 3)) for n in (1, 4, 7, 2)], [0, 1, 0, 1])
    w, t = rng.normal(size=(3, 2)), rng.normal(size=(2, 2))
    _, *gradients = value(w, t)
    for x, g in zip((w, t), gradients, strict=True):
        for i in np.ndindex(x.shape):
            at, e = x[i], 1e-6
            x[i] = at + e
            high = value(w, t)[0]
            x[i] = at - e
            low = value(w, t)[0]
            x[i] = at
            assert g[i] == pytest.approx((high - low) / (2 * e), abs=1e-5)


def test_neighbours_decide_doubtful_lines(hard):
    rows = learned("quality")
    model = quality_crf.fit(rows[:160])
    assert model["t"][0, 0] + model["t"][1, 1] - model["t"][0, 1] - model["t"][1, 0] > 2
    plain = [np.array([[2.0, -2.0]]), np.array([[0.0, 0.1]]), np.array([[2.0, -2.0]])]
    alone, between = (quality_crf.marginals([np.concatenate(c)], model["t"])[0][0] for c in (plain[1:2], plain))
    assert between[1, 1] < alone[0, 1] - 0.1
    lines = quality_crf.line_labels(hard.select("doc_id", "text"), model).collect()
    assert sorted((r.doc_id or 0, r.line) for r in lines) == sorted((i or 0, k) for i, t in HARD for k, line in enumerate((t or "").split("\n")) if WORD.search(line))
    assert all(0 <= r.good <= 1 and r.label == (r.good >= 0.5) for r in lines)


def test_recurrent_gradients_by_differences():
    model = {k: v.astype(np.float64) if v.dtype == np.float32 else v for k, v in toxicity_gru.start_model(1).items()}
    inputs = toxicity_gru.Inputs(pa.array(["you are such a fool and a bore", "fine day", ""]))
    x = np.random.default_rng(0).normal(size=(len(inputs.word_row), toxicity_gru.INPUT))
    forms, length = inputs.steps(np.arange(len(inputs.start)))
    logits, kept = toxicity_gru.forward(x, forms, length, model, keep=True)
    g, dx = toxicity_gru.backward(np.ones(len(logits)), kept, x, forms, model)
    for k in ("wf", "ub", "wa", "va", "wo"):
        at, e = tuple(0 for _ in model[k].shape), 1e-3
        high, low = ({**model, k: model[k].copy()} for _ in range(2))
        high[k][at] += e
        low[k][at] -= e
        slope = (toxicity_gru.forward(x, forms, length, high)[0].sum() - toxicity_gru.forward(x, forms, length, low)[0].sum()) / (2 * e)
        assert g[k][at] == pytest.approx(slope, rel=2e-2, abs=1e-3)


def learned(kind: str) -> list[tuple[str, int]]:
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioubdglmnrst") for _ in range(rng.randint(2, 8)))
    rows = []
    for i in range(240):
        lines = [" ".join(word() for _ in range(rng.randint(4, 14))) + "." for _ in range(rng.randint(2, 12))]
        if i % 2 and kind == "toxic":
            lines[rng.randrange(len(lines))] += " you wretched vermin scoundrel"
        if i % 2 == 0 and kind == "quality":
            lines = [line.replace(" ", "### ").upper() for line in lines]
        rows.append(("\n".join(lines), i % 2))
    return rows


def test_quality_is_learned(hard, empty):
    rows = learned("quality")
    model = quality_crf.fit(rows[:160])
    spark = hard.sparkSession
    test = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows[160:])], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in quality_crf.score_texts(test, model).collect()}
    assert all((scores[i] >= quality_crf.THRESHOLD) == bool(y) for i, (_, y) in enumerate(rows[160:]))
    out = quality_crf.score_texts(hard, model).collect()
    assert len(out) == len(HARD) and all(0 <= r.score <= 1 for r in out)
    assert quality_crf.score_texts(empty, quality_crf.fit([])).count() == 0


def test_toxicity_is_learned(hard, empty):
    rows = learned("toxic")
    model = toxicity_gru.fit(rows[:180])
    spark = hard.sparkSession
    test = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows[180:])], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in toxicity_gru.score_texts(test, model).collect()}
    assert np.mean([(scores[i] >= toxicity_gru.THRESHOLD) == bool(y) for i, (_, y) in enumerate(rows[180:])]) >= 0.95
    out = toxicity_gru.score_texts(hard, model).collect()
    assert len(out) == len(HARD) and all(0 <= r.score <= 1 for r in out)
    assert toxicity_gru.score_texts(empty, toxicity_gru.fit([])).count() == 0


def test_every_text_is_read_to_its_end():
    rows = learned("toxic")
    model = toxicity_gru.fit(rows[:180])
    clean = " ".join(t for t, y in rows[180:] if not y)
    a, b = toxicity_gru.text_scores(pa.array([clean, clean + " you wretched vermin scoundrel"]), model)
    assert b > a
    assert json.dumps([float(a), float(b)])
