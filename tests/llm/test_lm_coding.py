"""The coder of texts against a plain loop over words, bytes and bits."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from arterial.llm import mixlm, spelling

RNG = np.random.default_rng(12)
COMMON = ["the", "of", "and", "a", "to", "in"]
OTHER = ["".join(RNG.choice(list("abcdelnorst"), RNG.integers(2, 9))) for _ in range(150)]


def corpus():
    texts = []
    for k in range(60):
        words = [str(RNG.choice(COMMON)) if RNG.random() < 0.5 else str(RNG.choice(OTHER)) for _ in range(int(RNG.integers(1, 300)))]
        texts.append(" ".join(words) + (f"\n\nOnly{k}x  End." if k % 3 else ""))
    return [*texts, texts[3], None, "", " \n "]


def fitted(texts):
    """One batch of all texts and its models, by the library's own fit."""
    train = [zlib.crc32(str(k).encode()) % 5 != 1 for k in range(len(texts))]
    packing = mixlm._Packing()
    for k, t in enumerate(texts):
        packing.add(k, t, train[k])
    *rows, packed = packing.packed(0)
    rows = pd.concat(rows)
    names, c = list(rows["word"]), rows["trained"].to_numpy(np.int64)
    known = sorted((n, int(x), k) for k, (n, x) in enumerate(zip(names, c, strict=True)) if x)
    depth = mixlm.tree_depth(int(c.sum()))
    width = max(int((c == 1).sum()) + 1, int(c.sum()) >> (depth - 2))
    total, counts = int(c.sum()) + width, np.array([x for _, x, _ in known], float)
    paths, shared = mixlm.code_words(width + np.cumsum(counts) - counts, counts, total, depth)
    escape = int(mixlm.code_words(np.zeros(1), np.array([float(width)]), total, 52)[0][0])
    path, buckets = np.full(len(c), escape), np.zeros(2 << depth)
    for (_, x, k), p, s in zip(known, paths, shared, strict=True):
        path[k] = p
        buckets[p] += x * s
    frame = pd.DataFrame({"number": np.arange(len(c)), "c": c, "path": path, "bytes": [n if x <= 1 else None for n, x in zip(names, c, strict=True)]})
    last = pd.DataFrame({"number": [-1], "c": [len(texts)], "path": [0], "bytes": [packed["texts"].iloc[0]]})
    b, words = next(mixlm._read(mixlm._joined(pd.concat([frame, last], ignore_index=True))))
    nodes, bits = 1 << max(depth + 1, escape.bit_length()), max(mixlm.LEAST_BITS, total.bit_length() - 6)
    letters = 1 << max(spelling.LEAST_BITS, (8 * int((c == 1).sum())).bit_length())
    tables = {"alone": np.zeros((2, nodes), np.float32), "near": np.zeros((mixlm.CONTEXTS, 2, 1 << bits), np.float32), "letters": np.zeros((spelling.PREDICTORS, 2, letters), np.float32)}
    mixlm.count_batch(b, words, escape, tables)
    learned = mixlm.Learners()
    mixlm.learn_batch(b, words, escape, tables, learned, 1)
    odds = np.stack([np.rint(mixlm.ODDS * mixlm.log_odds(t[0], t[1])).clip(-127, 127).astype(np.int8) for t in tables["near"]])
    model = mixlm.PathModel(mixlm.log_odds(*tables["alone"]), odds, learned.path.weights, mixlm.refined(learned.path.refine), buckets)
    t = tables["letters"]
    spell = spelling.BitModel(spelling.log_odds(t[:, 0], t[:, 1]), learned.letters.weights, mixlm.refined(learned.refine))
    kinds = mixlm.kind_log10(b.about[b.train, 3:].sum(0))
    return names, b, words, escape, model, spell, kinds


def share_of(w, words, model):
    whole = model.buckets[min(int(words.path[w]), len(model.buckets) - 1)]
    return math.log10(words.c[w] / whole) if whole and words.c[w] else 0.0


def mixed_bit(x, weights, refine):
    m = max(-15.0, min(15.0, float(np.dot(x, weights))))
    m = math.floor(m * mixlm.FINE + 0.5) / mixlm.FINE
    cell = min(mixlm.REFINE - 1, max(0, round(m * 2 + mixlm.REFINE // 2)))
    p = 1 / (1 + math.exp(-m))
    return p, (p + float(refine[cell])) / 2


def plain_score(k, names, b, words, escape, model, spell, kinds):
    """log10 probability of text k, word by word and bit by bit."""
    lengths = b.about[:, 0]
    first = int(lengths[:k].sum())
    own = [int(w) for w in b.words[first : first + int(lengths[k])]]
    u32 = lambda v: int(v) & 0xFFFFFFFF
    mult = [int(x) for x in mixlm._MULT]
    seen = [1 if words.c[w] <= 1 else int(words.path[w]) for w in own]
    total = float(b.about[k, 3:] @ kinds)
    frequent, added = [], None
    for i, w in enumerate(own):
        if i % mixlm.STRETCH == 0:
            added = np.zeros(len(mixlm.START))
        one, two = (seen[i - 1] if i else 0), (seen[i - 2] if i > 1 else 0)
        near, far = (frequent[-1] if frequent else 0), (frequent[-2] if len(frequent) > 1 else 0)
        h = [u32(one * mult[0]), u32(u32(one * mult[1]) ^ u32(u32(two * mult[2]) + 1)), u32(u32(near * mult[3]) + 2), u32(u32(near * mult[4]) ^ u32(u32(far * mult[5]) + 3))]
        h = [x ^ (x >> 15) for x in h]
        bits, node = bin(int(words.path[w]))[3:], 1
        for d, bit in enumerate(map(int, bits)):
            size = model.odds.shape[1].bit_length() - 1
            odds = [int(model.odds[c][u32(u32(x + u32(node * mult[6])) * mult[7]) >> (32 - size)]) for c, x in enumerate(h)]
            gate = min(d // 3, mixlm.DEPTH_CLASSES - 1) * 9 + 3 * sum(o != 0 for o in odds[:2]) + sum(o != 0 for o in odds[2:])
            x = np.array([float(model.alone[node]), *(o / mixlm.ODDS for o in odds), 0.3])
            p, both = mixed_bit(x, model.weights[gate] + added, model.refine[gate])
            total += math.log10(max(1e-6, both if bit else 1 - both))
            added += mixlm.CODING_RATE * (bit - p) * x
            node = node * 2 + bit
        total += share_of(w, words, model)
        if words.c[w] == 0:
            total += float(spelling.score_words([names[w]], spell, np.array([[h[2]], [h[3]]], np.uint32))[0])
        if seen[i] > 1 and seen[i] < (2 << mixlm.FREQUENT):
            frequent.append(seen[i])
    return total


def test_a_plain_loop_codes_the_same(spark):
    texts = corpus()
    names, b, words, escape, model, spell, kinds = fit = fitted(texts)
    got = mixlm.code_batch(b, words, model, spell, kinds)
    want = [plain_score(k, *fit) for k in range(len(texts))]
    # Single precision rounds the refinement's cells in rare cases.
    assert np.allclose(got, want, rtol=2e-3)
    assert got[3] == pytest.approx(got[60], rel=1e-4) and got[61] == pytest.approx(got[62], rel=1e-4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = {r.doc_id: r for r in mixlm.mix_scores(docs).collect()}
    assert np.allclose([rows[k].score for k in range(len(texts))], got, rtol=1e-3)
    held = {k: Counter(w for j, t in enumerate(texts) if b.train[j] and j != k for w in set(names[x] for x in own_words(b, j))) for k in (3, 5, 60)}
    assert all(rows[k].n_alone == sum(not held[k][names[w]] for w in set(own_words(b, k))) for k in held)


def own_words(b, k):
    first = int(b.about[:k, 0].sum())
    return [int(w) for w in b.words[first : first + int(b.about[k, 0])]]


def test_words_of_the_tree_add_up():
    """Behind any words, known words and the escape are a distribution."""
    names, b, words, escape, model, spell, kinds = fitted(corpus())
    first = np.concatenate([[words.path[b.words[0]]], [words.path[b.words[1]]]])
    total = 0.0
    kinds_of = Counter((int(words.path[w]), share_of(w, words, model)) for w in range(len(names)) if words.c[w])
    for (p, share), n in [*kinds_of.items(), ((escape, 0.0), 1)]:
        path = np.array([*first, p], np.int32)
        contexts = mixlm.word_contexts(path, np.zeros(3, bool), np.array([3]))
        both = mixlm.code_stretches(contexts, np.array([0]), np.array([3]), model)[0]
        front = mixlm.code_stretches(mixlm.word_contexts(path[:2], np.zeros(2, bool), np.array([2])), np.array([0]), np.array([2]), model)[0]
        total += n * 10 ** (both - front + share)
    assert 0.5 < total <= 1 + 1e-4


def test_paths_are_told_apart():
    counts = RNG.integers(1, 400, 500).astype(float)
    total = int(counts.sum()) + 100
    path, shared = mixlm.code_words(100 + np.cumsum(counts) - counts, counts, total, 12)
    bits = [bin(int(p))[3:] for p in path]
    own = [x for x, s in zip(bits, shared, strict=True) if not s]
    assert len(set(own)) == len(own) and not any(a != c and c.startswith(a) for a in own for c in bits)
    assert all(len(x) == 12 for x, s in zip(bits, shared, strict=True) if s)
    assert bits == sorted(bits)


def test_words_are_numbered_as_split(monkeypatch):
    texts = [*corpus(), "A\tb\n\nc \r\x0b\x0c", "x" * 9000 + " " + "y" * 300_000 + " x", "é\x85É a\xa0b"]
    for together in (1 << 21, 50):
        monkeypatch.setattr(mixlm._Packing, "TOGETHER", together)
        packing = mixlm._Packing()
        for k, t in enumerate(texts):
            packing.add(k, t, True)
        *rows, head = packing.packed(0)
        names = [w for r in rows for w in r["word"]]
        b = mixlm.Batch.unpacked(head["texts"].iloc[0], len(texts))
        at = 0
        for k, t in enumerate(texts):
            want = re.split(rb"[ \n\t\r\x0b\x0c]", (t or "").encode().lower())
            got = [names[w] for w in b.words[at : at + b.about[k, 0]]]
            assert got == want and b.about[k, 1] == sum(map(bool, want)) and b.about[k, 2] == len((t or "").encode()) + 1
            assert b.about[k, 3:].sum() == len(want) and b.about[k, 3:].reshape(mixlm.CLASSES, -1)[:, -1].sum() == 1
            at += b.about[k, 0]
        assert len(set(names)) == len(names) and names[b.empty] == b""
        assert sum(int(r["trained"].sum()) for r in rows) == len(b.words)


def test_words_that_share_a_hash_stay_apart(monkeypatch):
    plain = mixlm._WordHasher.__call__

    def poor(self, data, start, end):
        out = plain(self, data, start, end)
        out[0] %= np.uint64(7)
        return out

    monkeypatch.setattr(mixlm._WordHasher, "__call__", poor)
    packing = mixlm._Packing()
    packing.add(1, " ".join(OTHER * 2), True)
    *rows, head = packing.packed(0)
    names = [w.decode() for r in rows for w in r["word"]]
    b = mixlm.Batch.unpacked(head["texts"].iloc[0], 1)
    assert [names[w] for w in b.words] == OTHER * 2


@pytest.mark.parametrize("together", [1, 3])
def test_all_training_texts_teach(together):
    """Every coded bit of every training text is learned from, however many texts share a step."""
    names, b, words, escape, *_ = fitted(corpus())
    tables = {"alone": np.zeros((2, 1 << 24), np.float32), "near": np.zeros((mixlm.CONTEXTS, 2, 1 << 14), np.float32), "letters": np.zeros((spelling.PREDICTORS, 2, 1 << 14), np.float32)}
    mixlm.count_batch(b, words, escape, tables)
    learned = mixlm.Learners()
    mixlm.learn_batch(b, words, escape, tables, learned, together)
    own = b.words[np.repeat(b.train, b.about[:, 0])]
    c, path = words.c[own], words.path[own]
    assert learned.path.used.sum() == learned.path.refine.sum() == mixlm.path_bits(np.where(c == 1, escape, path)).sum()
    assert learned.used.sum() == learned.refine.sum() == 8 * sum(len(names[w]) + 1 for w in own[c == 1])
    assert mixlm.ROUNDS[-1] == 64  # all batches


def test_left_out_odds_are_those_without_the_bit():
    counts = RNG.integers(0, 3, (1, 2, 500)).astype(np.float32)
    got = spelling.left_out(counts)[0]
    for bit in (0, 1):
        own = np.flatnonzero(counts[0, bit] > 0)
        n = counts[0][:, own] - np.array([[1 - bit], [bit]])
        assert np.allclose(got[bit, own], spelling.log_odds(n[0], n[1]), atol=1e-6)
        assert ((got[bit, own] != 0) == (n.sum(0) > 0)).all()


def test_words_come_longest_path_first_row_by_row():
    """What coding and learning read bit by bit lies in rows, and only words with a bit at a depth are there."""
    path = np.array([5, 9, 3, 17, 2, 6, 33], np.int32)
    contexts = mixlm.word_contexts(path, np.zeros(7, bool), np.array([4, 3]))
    steps = list(mixlm.lane_words(contexts, np.array([0, 4]), np.array([4, 3])))
    seen = [(lane.tolist(), p.tolist(), until) for lane, p, _, _, until in steps]
    assert seen == [([0, 1], [5, 2], [2, 1]), ([0, 1], [9, 6], [2, 2, 1]), ([1, 0], [33, 3], [2, 1, 1, 1, 1]), ([0], [17], [1, 1, 1, 1])]
    for (lane, _, _, hashes, _), t in zip(steps, range(4), strict=True):
        assert hashes.flags.c_contiguous and np.array_equal(hashes, contexts.hashes[:, np.array([0, 4])[lane] + t] * mixlm._MULT[7])


@pytest.mark.parametrize("n", [1, 50, 10_000])
def test_products_pick_and_sum_by_gate(n):
    seen = RNG.integers(0, 9, n).astype(np.int8)
    weights, x = RNG.normal(size=(6, 9)).astype(np.float32), RNG.normal(size=(6, n)).astype(np.float32)
    gate = mixlm.chosen(seen)
    assert np.array_equal(mixlm.picked(weights, gate), weights[:, seen])
    assert np.allclose(mixlm.gate_sums(x, gate), [x[:, seen == g].sum(1) for g in range(9)], atol=1e-2)
