"""Spelling of words that the vocabulary doesn't hold: bits predicted from hashed contexts.

A word is its lower-cased bytes and an end-of-word byte, coded bit by bit. Contexts are
hashed into tables of bit counts over training words: one to five bytes before, with the
place in the word, and some of these with what stands in front of the word (its outer
contexts). A predictor is the log odds of its counts. The gate, how many predictors with
and without have seen their context, picks the weights that mix the log odds; a table over gate and mixed
odds, learned along the way, refines the result, and the mean of both codes the bit. The
tables grow with the words up to ``2 ** TABLE_BITS`` slots a predictor.

Weights are learned online, in minibatches with each word's own bits taken out of the
counts; a learner carries them, and the size of its steps, on from call to call.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes of the word before the coded one that each predictor sees.
ORDERS = (1, 2, 3, 4, 5)
#: Further predictors: which outer context, with how many bytes before.
OUTER = ((0, 1), (0, 2), (0, 3), (1, 1))
PREDICTORS = len(ORDERS) + len(OUTER)
#: Slots of a predictor's table as a power of two, at most and at least.
TABLE_BITS, LEAST_BITS = 18, 14
#: Bytes of words that are coded together, and those that share one weight update.
STEP_BYTES, UPDATE_BYTES = 16_000, 3_000
PRIOR = 0.4
#: Weights that learning starts from, by predictor.
START = np.array([0.1, 0.1, 0.1, 0.2, 0.2, 0.1, 0.2, 0.2, 0.1])
#: First step of the online weights.
RATE = 0.3
REFINE = 33
#: Gates: how many predictors of either family have seen their context.
GATES = (len(ORDERS) + 1) * (len(OUTER) + 1)
END_WORD = 0x20
_MULT = np.uint64(0x9E3779B97F4A7C15)
_CTX = (np.random.default_rng(3).integers(1, 1 << 62, 32, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_NODE = np.uint64(int(_CTX[30]) * int(_MULT) & 0xFFFFFFFFFFFFFFFF)


@dataclass
class BitModel:
    """Tables of log odds by predictor, mixing weights and refinement by gate."""

    odds: np.ndarray  # (predictors, slots) float32
    weights: np.ndarray  # (gates, predictors)
    refine: np.ndarray  # (gates, REFINE) probabilities


def flat_words(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words with their end bytes, each byte's place in its word, and its word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    ends = np.cumsum(lengths)
    place = np.arange(len(data)) - np.repeat(ends - lengths, lengths)
    return data, place, np.repeat(np.arange(len(words)), lengths)


def context_hashes(data: np.ndarray, place: np.ndarray, word: np.ndarray, outer: np.ndarray | None) -> np.ndarray:
    """For each predictor, a hash of the bytes before within the word, the capped place, and the
    word's outer context (outer contexts, words), as ``slots`` takes it: (predictors, bytes)."""
    h = (np.minimum(place, 3).astype(np.uint64) + np.uint64(1)) * _CTX[31]
    out = {0: h.copy()}
    for k in range(1, ORDERS[-1] + 1):
        before = np.zeros(len(data), np.uint64)
        before[k:] = data[:-k] if k < len(data) else 0
        before[place < k] = 0
        h = h + (before + (place >= k)) * _CTX[k]
        out[k] = h.copy()
    near = [np.zeros(1, np.uint64) if outer is None else outer[which][word].astype(np.uint64) for which, _ in OUTER]
    found = [out[o] ^ np.uint64(o * 0x51ED27) for o in ORDERS]
    found += [out[o] ^ (w + np.uint64(0x7F4A + k)) * _CTX[20 + k] for k, ((_, o), w) in enumerate(zip(OUTER, near, strict=True))]
    hashes = np.stack(found)
    hashes *= _MULT
    hashes ^= hashes >> np.uint64(31)
    hashes *= _MULT
    return hashes


def slots(ctx: np.ndarray, node: np.ndarray, size: int) -> np.ndarray:
    """Slots in a table of ``size`` of the bit at ``node`` (the byte's bits so far behind a leading 1)."""
    h = ctx + node.view(np.uint64) * _NODE
    h >>= np.uint64(65 - size.bit_length())
    return h.view(np.int64)


def bit_steps(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(node, bit) of all bytes, from the highest bit to the lowest."""
    node = np.ones(len(data), np.int64)
    for b in range(7, -1, -1):
        bit = (data >> b) & 1
        yield node, bit
        node = node * 2 + bit


def word_steps(words: list[bytes]) -> Iterator[slice]:
    """Runs of words with about ``STEP_BYTES`` bytes."""
    at, size = 0, 0
    for k, w in enumerate(words):
        size += len(w) + 1
        if size >= STEP_BYTES:
            yield slice(at, k + 1)
            at, size = k + 1, 0
    if at < len(words):
        yield slice(at, len(words))


def count_bits(words: list[bytes], table: np.ndarray, outer: np.ndarray | None = None) -> None:
    """Add the words' bits to ``table`` (predictors, 2, slots), once for each word."""
    size = table.shape[-1]
    for part in word_steps(words):
        data, place, word = flat_words(words[part])
        ctx = context_hashes(data, place, word, None if outer is None else outer[:, part])
        nodes = list(bit_steps(data))
        ones = np.concatenate([bit for _, bit in nodes]).astype(np.int64)
        for o in range(PREDICTORS):
            at = np.concatenate([slots(ctx[o], node, size) for node, _ in nodes]) + ones * size
            np.add.at(table[o].reshape(-1), at, np.float32(1))


def log_odds(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + PRIOR) / (n0 + PRIOR)).astype(np.float32)


def _refine_cell(x: np.ndarray) -> np.ndarray:
    return np.minimum(np.maximum(np.rint(x * 2 + REFINE // 2), 0), REFINE - 1).astype(np.int64)


@dataclass
class Learner:
    """Weights (gates, predictors) and how many steps they have learned."""

    weights: np.ndarray
    steps: int = 0


def left_out(table: np.ndarray) -> np.ndarray:
    """Log odds (predictors, bit, slots) of a table of counts, with a bit taken out of its own slot; not 0
    where others were seen."""
    out = np.empty(table.shape, np.float32)
    for bit in (0, 1):
        n0, n1 = table[:, 0] - np.float32(1 - bit), table[:, 1] - np.float32(bit)
        out[:, bit] = log_odds(np.maximum(n0, 0), np.maximum(n1, 0))
        out[:, bit][(out[:, bit] == 0) & (n0 + n1 > 0)] = 1e-12
        out[:, bit][n0 + n1 <= 0] = 0
    return out


def seen_contexts(odds: np.ndarray) -> np.ndarray:
    """Gates of log odds (predictors, bits)."""
    seen = (odds != 0).view(np.int8)
    gate = seen[: len(ORDERS)].sum(0, np.int8)
    gate *= np.int8(len(OUTER) + 1)
    gate += seen[len(ORDERS) :].sum(0, np.int8)
    return gate.astype(np.intp)


def mix(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Mixed odds of inputs (predictors, bits), within bounds; the weights are used up."""
    weights *= x
    mixed = weights.sum(0)
    np.maximum(mixed, np.float32(-20), out=mixed)
    return np.minimum(mixed, np.float32(20), out=mixed)


def learn_weights(words: list[bytes], table: np.ndarray | None, learner: Learner | None = None, outer: np.ndarray | None = None, odds: np.ndarray | None = None, together: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One online pass: weights (gates, predictors), how often each gate was used, and refinement
    counts (gates, REFINE, 2). A word's own bits are taken out of the counts, so each is
    learned from as an unseen one; ``odds`` are what ``left_out`` makes of the table, if at hand.
    A ``learner`` is carried on; an update has ``together`` times the bytes."""
    gates = GATES
    odds = left_out(table) if odds is None else odds
    size, odds = odds.shape[-1], odds.reshape(-1)
    tables, inputs = (np.arange(PREDICTORS) * (2 * size))[:, None], (np.arange(PREDICTORS) * gates)[:, None]
    learner = learner or Learner(np.tile(START, (gates, 1)))
    w, t = learner.weights, learner.steps
    used, refine = np.zeros(gates), np.zeros((gates, REFINE, 2))
    for part in _updates(words, UPDATE_BYTES * together):
        data, place, word = flat_words(words[part])
        ctx = context_hashes(data, place, word, None if outer is None else outer[:, part])
        for node, bit in bit_steps(data):
            t += 1
            at = slots(ctx, node, size)
            at += tables
            at += bit * np.int64(size)
            x = odds.take(at)
            gate = seen_contexts(x)
            mixed = mix(x, w.T.astype(np.float32).take(gate, 1))
            cells = np.bincount((gate * REFINE + _refine_cell(mixed)) * 2 + bit, minlength=refine.size).reshape(refine.shape)
            mass = cells.sum((1, 2))
            refine += cells
            used += mass
            x *= bit.astype(np.float32) - 1 / (1 + np.exp(-mixed))
            grad = np.bincount((inputs + gate).ravel(), x.ravel(), PREDICTORS * gates).reshape(PREDICTORS, gates).T
            w += RATE / (1 + t / 400) ** 0.5 * grad / np.maximum(mass, 1)[:, None]
    learner.steps = t
    return w, used, refine


def _updates(words: list[bytes], most: int) -> Iterator[slice]:
    at, size = 0, 0
    for k, w in enumerate(words):
        size += len(w) + 1
        if size >= most or k == len(words) - 1:
            yield slice(at, k + 1)
            at, size = k + 1, 0


def score_words(words: list[bytes], model: BitModel, outer: np.ndarray | None = None) -> np.ndarray:
    """log10 probability of each word with its end byte."""
    out, size, odds = np.zeros(len(words)), model.odds.shape[-1], model.odds.reshape(-1)
    tables, weights, refine = (np.arange(PREDICTORS) * size)[:, None], np.ascontiguousarray(model.weights.T, np.float32), model.refine.reshape(-1)
    for part in word_steps(words):
        data, place, word = flat_words(words[part])
        ctx = context_hashes(data, place, word, None if outer is None else outer[:, part])
        now = np.ones(len(data))  # a byte's probability, the product of its bits'
        for node, bit in bit_steps(data):
            at = slots(ctx, node, size)
            at += tables
            x = odds.take(at)
            gate = seen_contexts(x)
            mixed = mix(x, weights.take(gate, 1))
            p = (1 / (1 + np.exp(-mixed.astype(float))) + refine.take(gate * REFINE + _refine_cell(mixed))) / 2
            now *= np.abs(1 - bit - np.clip(p, 1e-6, 1 - 1e-6))
        out[part] = np.bincount(word, np.log10(now), part.stop - part.start)
    return out
