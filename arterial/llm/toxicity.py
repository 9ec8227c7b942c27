"""Toxicity: a subsequence string-kernel support vector machine with Nystroem landmarks.

Kernel: two words are as alike as the letter triples they share as subsequences, each
occurrence weighted by ``DECAY`` to the power of the length it spans, divided by both
words' norms. Letters inserted or left out only lower the weight, so ``i-d.i_o t`` stays
near ``idiot``; runs of single characters between blanks are read as one word as well.

Learning (a bounded sample of labelled rows, on the driver): landmarks are the words that
mark toxic texts best and frequent words of clean ones. A word's features are its kernel
values at the landmarks times the inverse root of the landmarks' kernel matrix. Labels
are given for texts, so the machine learns from what they put forward: toxic texts the
words that are far more frequent in them than chance has it, clean texts their words, of
which those found hardest are added twice. Last, a logistic curve turns a text's counts
of offending words and its worst margin into a score.

Scoring: the features are linear in the triples of a word, so machine, root and landmarks
fold into one weight for each triple. A word's margin is a sum over its triples; a task
keeps the margins of words it has seen in a table of bounded size.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arterial.llm.common import release
from arterial.llm.rules import labelled_sample

#: Labelled rows that the machine is trained on, about, and distinct words of one of them, at most.
SAMPLE_ROWS, SAMPLE_WORDS = 4_000, 20_000
TOXIC_LANDMARKS, CLEAN_LANDMARKS = 160, 64
DECAY = 0.7
#: Characters are told apart in so many classes.
CLASSES = 40
#: Log-likelihood ratio from which a word counts as put forward by toxic texts.
SURPRISE = 14.0
#: Longer words are read in overlapping windows.
WINDOW, STRIDE = 20, 10
KEPT_WORDS = 150_000
#: What the triples may span, weights beyond are under 0.06.
_EDGE = b".,!?;:\"'()[]{}|*#$%&<>-_/"
# Runs of single characters, taken whole (possessive), so that a text is read once.
_SINGLES = re.compile(r"(?<!\S)(?:\S[ ]){2,}+")
_LETTER = re.compile(r"\w(?!\w)")


def char_classes(word: str) -> np.ndarray:
    """One class for each character: letters, other letters by code, digits, the rest."""
    out = np.empty(len(word), np.int64)
    for k, c in enumerate(word):
        o = ord(c)
        if 97 <= o <= 122:
            out[k] = o - 97
        elif c.isalpha():
            out[k] = 26 + o % 10
        else:
            out[k] = 36 + (o % 2 if c.isdigit() else 2 + o % 2)
    return out


@lru_cache(maxsize=None)
def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the triples of n characters, and their weights; n is at most ``WINDOW``."""
    at = np.array(list(combinations(range(n), 3)), np.int64).reshape(-1, 3)
    return at, (DECAY ** (at[:, 2] - at[:, 0] + 1)).astype(np.float64)


def triple_codes(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows by triples) of words of one length, and the triples' weights."""
    at, weight = _triples(classes.shape[1])
    c = classes[:, at]
    return (c[..., 0] * CLASSES + c[..., 1]) * CLASSES + c[..., 2], weight


def norms(codes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Square roots of each row's kernel with itself; triples that occur twice add up first."""
    order = np.argsort(codes, axis=1, kind="stable")
    sorted_, w = np.take_along_axis(codes, order, 1), weight[order]
    new = np.ones(codes.shape, bool)
    new[:, 1:] = sorted_[:, 1:] != sorted_[:, :-1]
    sums = np.add.reduceat(w.ravel(), np.flatnonzero(new.ravel()))
    rows = np.repeat(np.arange(len(codes)), new.sum(1))
    return np.sqrt(np.bincount(rows, sums * sums, len(codes)))


def windows(word: str) -> list[str]:
    """The word, or overlapping windows of a long one; behind them, if characters other
    than letters and digits lie inside, the same without these."""
    if not word.isalnum() and 3 <= len(bare := "".join(filter(str.isalnum, word))) < len(word):
        return _windows(word) + _windows(bare)
    return _windows(word)


def _windows(word: str) -> list[str]:
    if len(word) <= WINDOW:
        return [word]
    return [word[k : k + WINDOW] for k in range(0, len(word) - WINDOW + STRIDE, STRIDE)]


def feature_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse unit rows in triple space: (row, code, value)."""
    rows, codes, values = [], [], []
    for n, at in _by_length(words).items():
        if n < 3:
            continue
        c, w = triple_codes(np.stack([char_classes(words[k]) for k in at]))
        v = w[None, :] / norms(c, w)[:, None]
        rows.append(np.repeat(np.array(at), c.shape[1]))
        codes.append(c.ravel())
        values.append(v.ravel())
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(rows), np.concatenate(codes), np.concatenate(values)


def _by_length(words: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        out.setdefault(len(w), []).append(k)
    return out


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel values between words and landmarks, none longer than a window."""
    r, c, v = feature_rows(landmarks)
    at = np.full(CLASSES**3, -1, np.int64)
    used = np.unique(c)
    at[used] = np.arange(len(used))
    dense = np.zeros((len(used), len(landmarks)))
    np.add.at(dense, (at[c], r), v)
    out = np.zeros((len(words), len(landmarks)))
    for lo in range(0, len(words), 100):
        wr, wc, wv = feature_rows(words[lo : lo + 100])
        hit = np.flatnonzero(at[wc] >= 0)
        hit = hit[np.argsort(wr[hit], kind="stable")]
        if len(hit):
            starts = np.flatnonzero(np.diff(wr[hit], prepend=-1))
            out[wr[hit][starts] + lo] = np.add.reduceat(dense[at[wc[hit]]] * wv[hit, None], starts)
    return out


def spaced_out(text: str) -> list[str]:
    """Words of three characters or more written with a blank behind each, the last a letter or digit."""
    out = []
    for m in _SINGLES.finditer(text):
        run = m.group()[::2]
        if _LETTER.match(text, m.end()):
            out.append(run + text[m.end()])
            continue
        last = max((k for k in range(2, len(run)) if run[k].isalnum() or run[k] == "_"), default=0)
        if last:
            out.append(run[: last + 1])
    return out


def units(text: str | None) -> list[str]:
    """The words of a text, lower-cased and without punctuation at the ends, and spaced-out words joined."""
    t = (text or "").lower()
    found = [w for b in t.encode().split() if (w := b.strip(_EDGE).decode(errors="ignore"))]
    return found + spaced_out(t)


@dataclass
class Machine:
    """Weights of the triples, the bias, the curve over a text's statistics, and the base rate."""

    triples: np.ndarray | None
    bias: float
    curve: np.ndarray | None
    rate: float

    def margins(self, words: list[str]) -> np.ndarray:
        """Margins of words of any length: the highest of a word's windows."""
        parts, owner = [], []
        for k, w in enumerate(words):
            for p in windows(w):
                parts.append(p)
                owner.append(k)
        got = np.full(len(parts), self.bias)
        for n, at in _by_length(parts).items():
            if n < 3:
                continue
            for lo in range(0, len(at), 1 + 150_000 // len(_triples(n)[0])):
                some = at[lo : lo + 1 + 150_000 // len(_triples(n)[0])]
                c, w = triple_codes(np.stack([char_classes(parts[k]) for k in some]))
                got[some] += (self.triples[c] * w).sum(1) / norms(c, w)
        out = np.full(len(words), -np.inf)
        np.maximum.at(out, np.array(owner, np.int64), got)
        return out


def text_features(margins: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """Worst margin, offending words and their share, of a text's word margins, each counted ``times``."""
    if not len(margins):
        return np.array([-2.0, 0.0, 0.0, 0.0])
    times = np.ones(len(margins)) if times is None else times
    hits = float(times[margins > 0].sum())
    strong = float(times[margins > 0.5].sum())
    return np.array([float(np.clip(margins.max(), -2, 2)), np.log1p(hits), np.log1p(strong), min(3.0, 100 * hits / float(times.sum()))])


def hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 3000.0) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by Newton steps over the rows within the margin; y is +1 or -1."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    scale = 2 * c * weight / weight.sum()
    active = np.ones(len(x), bool)
    for _ in range(40):
        xa, sa = x1[active], scale[active]
        w = np.linalg.solve(np.eye(len(w)) + xa.T @ (xa * sa[:, None]), xa.T @ (sa * y[active]))
        now = y * (x1 @ w) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights and bias by Newton steps."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        h = x1.T @ (x1 * (p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, x1.T @ (p - y) + ridge * w)
    return w


def counted(text: str | None) -> tuple[list[str], np.ndarray]:
    """Distinct words of a text in order, and how often each occurs; of more than
    ``SAMPLE_WORDS`` those of the smallest hashes (in learning alone)."""
    found = Counter(units(text))
    names = sorted(found)
    if len(names) > SAMPLE_WORDS:
        names = sorted(sorted(names, key=lambda w: (zlib.crc32(w.encode(errors="replace")), w))[:SAMPLE_WORDS])
    return names, np.array([found[w] for w in names], np.int32)


def train(texts: list[str | None], toxic: np.ndarray) -> Machine:
    """A machine from texts and their labels (0 or 1); a constant one if a class is missing."""
    return train_counted(map(counted, texts), toxic)


def train_counted(texts: Iterable[tuple[list[str], np.ndarray]], toxic: np.ndarray) -> Machine:
    """The same from the ``counted`` words of the texts, which are read once and kept as numbers."""
    rate = float(toxic.sum()) / (len(toxic) + 1)
    if not 0 < toxic.sum() < len(toxic):
        return Machine(None, 0.0, None, rate)
    number: dict[str, int] = {}
    owned = []
    for names, times in texts:
        owned.append((np.array([number.setdefault(w, len(number)) for w in names], np.int32), times))
    words = list(number)
    n1, n0 = int(toxic.sum()), int(len(toxic) - toxic.sum())
    bad, good = _windows_of_classes(words, owned, toxic)
    # Words that toxic texts put forward: far more frequent there than chance has it.
    worth = {w: _surprise(k, good[w], n1, n0) for w, k in bad.items() if k > 2 and k * n0 > 3 * good[w] * n1}
    forward = sorted((w for w, v in worth.items() if v > SURPRISE), key=lambda w: (-worth[w], w))
    common = sorted(good, key=lambda w: (-good[w], w))
    marks = forward[:TOXIC_LANDMARKS]
    marks += [w for w in common[: 2 * CLEAN_LANDMARKS] if w not in worth][:CLEAN_LANDMARKS]
    if not forward:
        return Machine(None, 0.0, None, rate)
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    keep = values > 1e-4 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    # Words put forward, and the same with a character put in or doubled, at less weight.
    shown = forward + [v for w in forward[:TOXIC_LANDMARKS] for v in disguised(w)]
    pos_weight = np.concatenate([np.sqrt([bad[w] for w in forward]), [0.3 * np.sqrt(bad[w]) for w in forward[:TOXIC_LANDMARKS] for _ in disguised(w)]])
    positive = kernel(shown, marks) @ root
    # Clean words: the frequent ones and an even share of the others; then those found hardest.
    calm = [w for w in common if w not in worth or worth[w] <= SURPRISE]
    chosen = calm[:2000] + calm[2000 :: max(1, len(calm) // 6000)]
    neg_weight = [good[w] for w in chosen]
    negative = kernel(chosen, marks) @ root
    for r in range(3):
        x = np.vstack([positive, negative])
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        of = np.sqrt(neg_weight)
        w, bias = hinge(x, y, np.concatenate([pos_weight / pos_weight.sum(), of / of.sum()]))
        machine = Machine(_folded(marks, root @ w), bias, None, rate)
        if r == 2:
            break
        had = set(chosen)
        rest = [v for v in calm if v not in had]
        rest = rest[:: 1 + len(rest) // 50_000]
        hard = [rest[k] for k in np.argsort(-machine.margins(rest), kind="stable")[:1500]] if rest else []
        if not hard:
            break
        chosen += hard
        neg_weight += [good[w] for w in hard]
        negative = np.vstack([negative, kernel(hard, marks) @ root])
    margin = np.concatenate([machine.margins(words[lo : lo + 20_000]) for lo in range(0, len(words), 20_000)] or [np.zeros(0)])
    x = np.stack([text_features(margin[ids], times) for ids, times in owned])
    machine.curve = logistic(x, toxic.astype(float))
    return machine


def _windows_of_classes(words: list[str], owned: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray) -> tuple[Counter, Counter]:
    """In how many toxic and in how many clean texts each window of their words stands."""
    number: dict[str, int] = {}
    parts, edges = array("i"), [0]
    for w in words:
        parts.extend(number.setdefault(p, len(number)) for p in windows(w) if len(p) >= 3)
        edges.append(len(parts))
    parts, edges = np.array(parts, np.int32), np.array(edges)
    found = np.zeros((2, len(number)), np.int64)
    for (ids, _), y in zip(owned, toxic, strict=True):
        size = edges[ids + 1] - edges[ids]
        at = np.repeat(edges[ids] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum()) if len(ids) else np.zeros(0, np.int64)
        found[int(y), np.unique(parts[at])] += 1
    names = list(number)
    return tuple(Counter({names[k]: int(found[y, k]) for k in np.flatnonzero(found[y])}) for y in (1, 0))


def disguised(word: str) -> list[str]:
    """Variants with one character inserted or doubled, for learning."""
    if not 4 <= len(word) < WINDOW:
        return []
    at = [1 + (len(word) - 1) * k // 3 for k in range(3)]
    return [word[: at[0]] + "x" + word[at[0] :], word[: at[1]] + "e" + word[at[1] :], word[: at[2]] + word[at[2] - 1] + word[at[2] :]]


def _folded(marks: list[str], weights: np.ndarray) -> np.ndarray:
    """One weight for each triple from weights of the landmarks."""
    r, c, v = feature_rows(marks)
    return np.bincount(c, v * weights[r], CLASSES**3).astype(np.float32)


def _surprise(k: int, g: int, n1: int, n0: int) -> float:
    """Log-likelihood ratio of a word in k of n1 toxic and g of n0 clean texts against one rate for both."""
    part = lambda x, n, p: (x * np.log(p) if x else 0.0) + ((n - x) * np.log(1 - p) if n > x else 0.0)
    return 2 * (part(k, n1, k / n1) + part(g, n0, g / n0) - part(k, n1, (k + g) / (n1 + n0)) - part(g, n0, (k + g) / (n1 + n0)))


def _margins_of(words: list[str], seen: dict[str, float], machine: Machine) -> np.ndarray:
    new = [w for w in dict.fromkeys(words) if w not in seen]
    if new:
        if len(seen) + len(new) > KEPT_WORDS:
            seen.clear()
            new = list(dict.fromkeys(words))
        seen.update(zip(new, machine.margins(new).tolist(), strict=True))
    return np.fromiter(map(seen.__getitem__, words), float, len(words))


def score_texts(texts: list[str | None], machine: Machine, seen: dict[str, float]) -> list[float]:
    if machine.curve is None:
        return [machine.rate] * len(texts)
    x = np.stack([text_features(_margins_of(units(t), seen, machine)) for t in texts])
    linear = x @ machine.curve[:-1] + machine.curve[-1]
    return (1 / (1 + np.exp(-np.clip(linear, -500, 500)))).tolist()


def _counted_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = [(*counted(t), int(y > 0)) for t, y in zip(f["text"], f["y"], strict=True)]
        yield pd.DataFrame({"words": ["\n".join(r[0]) for r in rows], "times": [r[1].tobytes() for r in rows], "y": [r[2] for r in rows]})


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Machine:
    """A machine from labelled rows (``toxic``) whose crc32(doc_id) mod 5 is not 0.

    The sample's texts are split and counted by the executors; the driver takes their
    words row by row. Null and empty texts count as texts without words; without rows of
    both classes, or without rows, the machine is a constant."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0
    sample = labelled_sample(docs, labels, "toxic", sample_rows, where=fold).select("text", "y")
    found = sample.mapInPandas(_counted_frames, "words string, times binary, y int").toPandas()
    # The order in which rows arrive plays no part.
    found = found.sort_values(["words", "times", "y"], kind="stable")
    own = ((w.split("\n") if w else [], np.frombuffer(t, np.int32)) for w, t in zip(found["words"], found["times"], strict=True))
    return train_counted(own, found["y"].to_numpy(int))


def score_toxicity(docs: DataFrame, machine: Machine) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= 0.5).

    Only the text is an input of the score, whole and in time proportional to its length.
    Null, empty and blank texts score as a text without words; without labels of both
    classes all texts score the share of toxic ones. Equal texts score alike, repeated rows
    stay, and an empty table gives an empty result.
    Other columns are carried along; ones named like a result are replaced.
    """
    kept = docs.drop("score", "predicted")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), "score double"])
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, float] = {}
        for f in frames:
            if len(f):
                yield f.assign(score=score_texts(f["text"].tolist(), shared.value, seen))
        seen.clear()
        release()

    return kept.mapInPandas(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
