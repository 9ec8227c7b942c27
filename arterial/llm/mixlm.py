"""LM scoring: online logistic mixing of hashed-context bit predictors.

The model codes a text as its words and the blanks behind them. Words are those between
single blanks (so an empty word stands between two neighbouring ones). A word is coded as
a path of bits from the root of a code tree; the blank behind it, or the end of the text,
is one of seven kinds whose probability depends on the word's last byte class. So log
probabilities of words and blanks add up to that of the text.

Tree: the training words lie on [0, 1) in the order of their bytes, each as wide as its
share of all; in front lies the escape, as wide as the share of words seen once. A word's
path are the first bits of its middle, as many as tell it apart, ``DEPTH`` at most: deeper
words share the path of a bucket, and a word in a bucket has its share of the bucket's
count. A word behind the escape is spelled in bytes (``spelling``). The depth follows the
corpus.

Bits: predictors see the node alone, and the node with the previous word, the two previous
words, the last frequent word and the two last frequent ones. Each pair of context and
node is hashed into a table of bit counts over all training texts. A predictor is the log
odds of its counts. The gate, the depth with how many contexts were seen, picks the weights
that mix the log odds; a table over gate and mixed odds refines the result, and the mean of
both codes the bit. Words seen once count as escapes too, and are what spelling is learned
from. Weights are learned online from stretches of training texts, with each bit taken
out of its own counts and words seen once as escapes, in rounds that carry them on; the
refining table is learned along. In coding, every stretch of a text adds weights of its own,
which start at 0 and adapt along it.

Steps, each on a table of the shared folder:

1. Texts are parsed once, in batches of bounded size: each batch gives its distinct words,
   and one row with the numbers of its words in order.
2. Counts of words are summed over batches, and words get their paths.
3. Words are joined back to the batches, which become one row each.
4. Batches are read to count bits, to learn weights, and to code; all training texts are counted
   and learned from.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arterial.llm import spelling
from arterial.llm.common import Tables, release

#: Text of a batch in bytes, and texts, at most (a single longer text is a batch).
BATCH_BYTES, BATCH_TEXTS = 12_000_000, 50_000
#: Words of a stretch: weights adapt from the model's along it.
STRETCH = 128
#: Words that are worked on at a time in counting and in coding, about (a longer text is worked
#: on whole).
SLICE, CODED = 100_000, 400_000
#: Stretches that share a step of learning; a step has as many times those, ``TOGETHER`` at most, as
#: there are so many training words.
LANES, TOGETHER, LEARN_WORDS = 1024, 3, 5_000_000
#: Rounds of learning: shares of the batches, of 64, at which they end.
ROUNDS = (8, 64)
#: Longest path.
DEPTH = 10
#: Slots of a context's table as a power of two, at most and at least; slots of a row of a
#: table on its way.
SLOT_BITS, LEAST_BITS, CHUNK_BITS = 20, 12, 16
#: Words of this path length or shorter are frequent.
FREQUENT = 8
PRIOR = 0.4
#: Weights that learning starts from: the node alone, the four contexts, a constant.
START = np.array([0.6, 0.15, 0.15, 0.3, 0.2, 0.0], np.float32)
CONTEXTS = 4
#: Depth classes of the gates, and gates: how many contexts of words and of frequent words were seen.
DEPTH_CLASSES = 6
GATES = DEPTH_CLASSES * 9
#: Steps of the weights in learning (the first one) and in coding.
RATE, CODING_RATE = 0.02, 0.02
REFINE = 33
#: Mixed odds at most, and their steps a unit in coding.
MOST, FINE = 15, 64
#: Words of a matrix product of nine gates and the inputs, at most.
ALONE = 4096
#: Log odds are held in steps of 1 / 16.
ODDS = 16
#: Training words that a table of counts stands for, about.
TABLE_WORDS = 4_000_000
#: Blanks in the order of their kinds; the end of a text is the last kind.
BLANKS = b" \n\t\r\x0b\x0c"
KINDS = len(BLANKS) + 1
CLASSES = 4
_KIND_OF = np.full(256, -1, np.int8)
_KIND_OF[list(BLANKS)] = np.arange(len(BLANKS))
_MULT = np.random.default_rng(3).integers(1, 1 << 31, 8, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_NINE = np.arange(9, dtype=np.int8)[:, None]
_NODE = np.uint32(int(_MULT[6]) * int(_MULT[7]) & 0xFFFFFFFF)


# -- batches of texts -------------------------------------------------------------------


def _byte_classes() -> np.ndarray:
    """Class of a word's last byte: letter or digit, full stop, other mark; 3 is the empty word."""
    out = np.full(256, 2, np.int64)
    out[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 0
    out[list(b".!?")] = 1
    return out


_CLASS_OF = _byte_classes()


class _WordHasher:
    """Two 64-bit hashes of many words at once: sums of a number for each byte value times a power
    for its place, from running sums over a stretch of bytes. Longer words are hashed one by one."""

    BLOCK, LONG = 1 << 18, 1 << 12

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.value = rng.integers(0, 1 << 63, (2, 256), dtype=np.uint64)
        base = np.uint64(0x9E3779B97F4A7C15)
        size = self.BLOCK + self.LONG + 1
        self.power, self.inverse = (np.cumprod(np.r_[np.uint64(1), np.full(size, b)], dtype=np.uint64) for b in (base, np.uint64(pow(int(base), -1, 1 << 64))))

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """(2, words) of the words [start, end) of ``data``, in order of place."""
        out, size = np.zeros((2, len(start)), np.uint64), end - start
        short = np.flatnonzero(size <= self.LONG)
        for lo, hi in _runs(start[short] // self.BLOCK):
            some = short[lo:hi]
            first, last = start[some[0]], end[some[-1]]
            a, b = start[some] - first, end[some] - first
            for k in (0, 1):
                sums = np.zeros(last - first + 1, np.uint64)
                np.cumsum(self.value[k].take(data[first:last]) * self.power[: last - first], out=sums[1:])
                h = (sums[b] - sums[a]) * self.inverse[a] + size[some].astype(np.uint64)
                h ^= h >> np.uint64(29)
                out[k, some] = h * np.uint64(0xD6E8FEB86659FD93)
        for k in np.flatnonzero(size > self.LONG).tolist():
            word = data[start[k] : end[k]].tobytes()
            out[:, k] = xxhash.xxh3_64_intdigest(word), xxhash.xxh3_64_intdigest(word, 1)
        return out


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of equal values, as (first, behind the last)."""
    if len(values):
        edges = np.flatnonzero(np.diff(values)) + 1
        yield from zip([0, *edges.tolist()], [*edges.tolist(), len(values)], strict=True)


@lru_cache(maxsize=1)
def _hasher() -> _WordHasher:
    return _WordHasher()


class _Packing:
    """Texts of a batch, whose words are numbered as they come.

    Words are told apart by a 64-bit hash; should two share one, a second hash shows it, and the
    later word is numbered by its bytes."""

    #: Bytes of texts that are split together, about.
    TOGETHER = 1 << 21

    def __init__(self):
        # Hashes in order with their numbers; by number the second hash.
        self.keys, self.number, self.second = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.uint64)
        self.odd: dict[bytes, int] = {}
        self.names = []
        self.words, self.about, self.ids, self.train, self.bytes = [], [], [], [], 0
        self.waiting, self.held = [], 0

    def add(self, doc_id, text: str | None, train: bool) -> None:
        raw = (text or "").encode().lower()
        self.waiting.append(raw)
        self.held += len(raw) + 1
        self.bytes += len(raw) + 1
        self.ids.append(None if doc_id is None or doc_id != doc_id else int(doc_id))
        self.train.append(bool(train))
        if self.held >= self.TOGETHER:
            self.split()

    def split(self) -> None:
        """Words, blanks and facts of the texts that wait."""
        if not self.waiting:
            return
        raw = b" ".join(self.waiting) + b" "  # behind every text stands a blank, its end
        lengths = np.fromiter(map(len, self.waiting), np.int64, len(self.waiting)) + 1
        self.waiting, self.held = [], 0
        data, stops = np.frombuffer(raw, np.uint8), np.cumsum(lengths) - 1
        kind = _KIND_OF.take(data)
        end = np.flatnonzero(kind >= 0)
        start = np.concatenate([[0], end[:-1] + 1])
        kind = kind[end].astype(np.int64)
        behind = np.searchsorted(end, stops)
        kind[behind] = KINDS - 1
        count = np.diff(behind, prepend=-1)
        of = np.repeat(np.arange(len(count)), count)
        real = end > start
        last = np.where(real, _CLASS_OF.take(data[np.maximum(end - 1, 0)]), 3)
        table = np.bincount((of * CLASSES + last) * KINDS + kind, minlength=len(count) * CLASSES * KINDS).reshape(len(count), -1)
        self.about.append(np.concatenate([np.stack([count, np.bincount(of, real, len(count)).astype(np.int64), lengths], 1), table], 1))
        hashes = _hasher()(data, start, end)
        keys, first, inverse = np.unique(hashes[0], return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, keys)
        had = np.zeros(len(keys), bool)
        had[place < len(self.keys)] = (self.keys[place[place < len(self.keys)]] == keys[place < len(self.keys)])
        numbers, new = np.empty(len(keys), np.int32), np.flatnonzero(~had)
        numbers[had] = self.number[place[had]]
        numbers[new] = self._named(raw, start[first[new]], end[first[new]], hashes[1, first[new]])
        self.keys, self.number = np.insert(self.keys, place[new], keys[new]), np.insert(self.number, place[new], numbers[new])
        words = numbers[inverse]
        for at in np.flatnonzero(self.second[words] != hashes[1]).tolist():
            name = raw[start[at] : end[at]]
            if name not in self.odd:
                self.odd[name] = int(self._named(raw, start[at : at + 1], end[at : at + 1], hashes[1, at : at + 1])[0])
            words[at] = self.odd[name]
        self.words.append(words)

    def _named(self, raw: bytes, start: np.ndarray, end: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Numbers of new words."""
        had = len(self.names)
        self.names += [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        self.second = np.concatenate([self.second, second])
        return np.arange(had, len(self.names), dtype=np.int32)

    def packed(self, batch: int) -> Iterator[pd.DataFrame]:
        """Rows of the distinct words of the batch, and last one row on its texts."""
        self.split()
        about, train, words = np.concatenate(self.about), np.array(self.train, bool), np.concatenate(self.words)
        # Frequent words get small numbers.
        order = np.argsort(-np.bincount(words, minlength=len(self.names)), kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        words = rank[words]
        trained = np.bincount(words[np.repeat(train, about[:, 0])], minlength=len(order))
        empty = -1
        for lo in range(0, len(order), 50_000):
            names = [self.names[k] for k in order[lo : lo + 50_000].tolist()]
            empty = lo + names.index(b"") if b"" in names else empty
            yield pd.DataFrame({"batch": batch, "word": names, "number": np.arange(lo, lo + len(names), dtype=np.int32), "trained": trained[lo : lo + 50_000], "texts": None})
        null = np.array([i is None for i in self.ids], bool)
        whole = np.array([i or 0 for i in self.ids], np.int64)
        planes = words.view(np.uint8).reshape(-1, 4).T  # high bytes are mostly 0
        head = zlib.compress(np.int64(empty).tobytes() + whole.tobytes() + null.tobytes() + train.tobytes() + about.tobytes() + planes.tobytes(), 1)
        yield pd.DataFrame({"batch": [batch], "word": [None], "number": np.full(1, -1, np.int32), "trained": [len(train)], "texts": [head]})


@dataclass
class Batch:
    """Texts of a batch: ids, null ids, training marks, facts (words, real words, bytes, counts of
    class and kind), the numbers of all words in order, and that of the empty word (-1: none)."""

    ids: np.ndarray
    null: np.ndarray
    train: np.ndarray
    about: np.ndarray
    words: np.ndarray
    empty: int

    @classmethod
    def unpacked(cls, head: bytes, n: int) -> Batch:
        raw, width = zlib.decompress(head), 3 + CLASSES * KINDS  # copied from, as views would hold it
        empty, ids = np.frombuffer(raw, np.int64, 1)[0], np.frombuffer(raw, np.int64, n, 8).copy()
        null, train = np.frombuffer(raw, bool, n, 8 + 8 * n).copy(), np.frombuffer(raw, bool, n, 8 + 9 * n).copy()
        about = np.frombuffer(raw, np.int64, n * width, 8 + 10 * n).reshape(n, -1).copy()
        words = np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=8 + 10 * n + 8 * n * width).reshape(4, -1).T).view(np.int32).ravel()
        return cls(ids, null, train, about, words, int(empty))

    def some(self, texts: np.ndarray) -> Batch:
        """The texts of these places, in order."""
        lengths = self.about[:, 0]
        own = np.zeros(len(lengths), bool)
        own[texts] = True
        return Batch(self.ids[own], self.null[own], self.train[own], self.about[own], self.words[np.repeat(own, lengths)], self.empty)

    def slices(self, size: int) -> Iterator[np.ndarray]:
        """Places of neighbouring texts with about ``size`` words."""
        group = np.cumsum(self.about[:, 0]) // size
        return (np.flatnonzero(group == g) for g in np.unique(group))


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    batch, now = TaskContext.get().partitionId() << 24, _Packing()
    for f in frames:
        for i, t, y in zip(f["doc_id"].astype(object), f["text"], f["train"], strict=True):
            now.add(i, t, y)
            if now.bytes >= BATCH_BYTES or len(now.ids) >= BATCH_TEXTS:
                yield from now.packed(batch)
                batch, now = batch + 1, _Packing()
                release()
    if now.ids:
        yield from now.packed(batch)
    del now
    release()


# -- the code tree ----------------------------------------------------------------------


def tree_depth(total: int) -> int:
    """Longest path for so many training words."""
    return min(DEPTH, max(4, int(total).bit_length() - 8))


def code_words(starts: np.ndarray, counts: np.ndarray, total: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Paths (bits behind a leading 1) of words on neighbouring intervals, and which of them
    share a bucket. Paths of words are no beginnings of each other, buckets apart."""
    middle = np.floor((starts + counts / 2) / total * 2.0**52).astype(np.int64)
    bits = np.ceil(np.log2(total / counts)).astype(np.int64) + 1
    # Bits that a word has in common with its neighbours, and one more, tell it apart.
    apart = np.full((2, len(middle)), 52)
    if len(middle) > 1:
        same = 53 - np.frexp((middle[1:] ^ middle[:-1]).astype(float))[1]  # with the bit that differs
        apart[0, 1:], apart[1, :-1] = same, same
    bits = np.maximum(1, np.minimum(bits, apart.max(0)))
    shared, bits = bits > depth, np.minimum(bits, depth)
    return (middle >> (52 - bits)) | (np.int64(1) << bits), shared


def _coded_vocabulary(tables: Tables, known: DataFrame, n_known: int, escapes: int, total: int, depth: int) -> tuple[DataFrame, np.ndarray, int]:
    """(word, c, path) of the training words (word, c), the counts of buckets by path (0: none),
    and the path of the escape."""
    parts = max(1, -(-n_known // 200_000))
    ordered = tables.keep(known.repartitionByRange(parts, "word").withColumn("part", F.spark_partition_id()))
    # One row for each 200,000 words.
    sums = sorted((r["part"], r["c"]) for r in ordered.groupBy("part").agg(F.sum("c").alias("c")).collect())
    before = dict(zip([p for p, _ in sums], escapes + np.cumsum([0, *(c for _, c in sums)])[:-1].astype(float), strict=True))

    def code(key, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("word", kind="stable")
        c = f["c"].to_numpy(float)
        path, shared = code_words(before[key[0]] + np.cumsum(c) - c, c, total, depth)
        return pd.DataFrame({"word": f["word"], "c": f["c"], "path": path, "shared": shared})

    coded = tables.keep(ordered.groupBy("part").applyInPandas(code, "word binary, c long, path int, shared boolean"))
    # One row for each bucket, 2 ** DEPTH at most.
    buckets = np.zeros(2 << depth)
    for r in coded.where("shared").groupBy("path").agg(F.sum("c").alias("all")).collect():
        buckets[r["path"]] = r["all"]
    # The escape lies alone at the front, so its own width tells it apart.
    escape, _ = code_words(np.zeros(1), np.array([float(escapes)]), total, 52)
    tables.drop(ordered)
    return coded.select("word", "c", "path"), buckets, int(escape[0])


# -- bits -------------------------------------------------------------------------------


@dataclass
class Contexts:
    """Of every word of a batch its path and the hashes of its contexts (contexts, words)."""

    path: np.ndarray
    hashes: np.ndarray


def word_contexts(path: np.ndarray, rare: np.ndarray, lengths: np.ndarray) -> Contexts:
    """Paths of all words in order, which words are seen once or never, and the number of words
    of each text. In front of others, rare words are all alike."""
    hashes, lo = np.empty((CONTEXTS, len(path)), np.uint32), 0
    for a, b in _runs(np.cumsum(lengths) // SLICE):
        hi = lo + int(lengths[a:b].sum())
        hashes[:, lo:hi] = _context_hashes(path[lo:hi], rare[lo:hi], lengths[a:b])
        lo = hi
    return Contexts(path, hashes)


def _context_hashes(path: np.ndarray, rare: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The hashes of ``word_contexts`` for some texts."""
    n = len(path)
    first = np.repeat((np.cumsum(lengths) - lengths).astype(np.int32), lengths)  # where the word's text begins
    at, seen = np.arange(n, dtype=np.int32), np.where(rare, 1, path).astype(np.uint32)

    def back(where: np.ndarray) -> np.ndarray:
        """Paths of the words at these places, 1 for rare ones; 0 in front of the text."""
        return np.where(where >= first, seen[np.maximum(where, 0)], np.uint32(0))

    frequent = np.maximum.accumulate(np.where((seen > 1) & (seen < (2 << FREQUENT)), at, np.int32(-1))) if n else at
    before = np.concatenate([np.full(1, -1, np.int32), frequent[:-1]]) if n else at  # the last frequent word before each place
    second = np.where(before >= first, before[np.maximum(before, 0)], -1)
    one, two, near, far = back(at - 1), back(at - 2), back(before), back(second)
    hashes = np.stack([one * _MULT[0], (one * _MULT[1]) ^ (two * _MULT[2]) + np.uint32(1), near * _MULT[3] + np.uint32(2), (near * _MULT[4]) ^ (far * _MULT[5]) + np.uint32(3)])
    return hashes ^ (hashes >> np.uint32(15))


def slots(hashes: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """Slots of contexts (contexts, words) at the words' nodes; the hashes come times ``_MULT[7]``."""
    h = hashes + node.view(np.uint32) * _NODE
    h >>= np.uint32(32 - bits)
    return h.view(np.int32)


def path_bits(path: np.ndarray) -> np.ndarray:
    """Lengths of paths."""
    return np.frexp(path.astype(np.float32))[1] - 1


def count_paths(contexts: Contexts, keep: np.ndarray, alone: np.ndarray, table: np.ndarray) -> None:
    """Add the bits of the kept words to ``alone`` (2, nodes) and ``table`` (contexts, 2, slots)."""
    size = table.shape[-1]
    where = np.flatnonzero(keep)
    for lo in range(0, len(where), 100_000):
        some = where[lo : lo + 100_000]
        path = contexts.path[some]
        length = path_bits(path)
        order = np.argsort(-length.astype(np.int8), kind="stable")
        path, hashes, length = path[order], contexts.hashes.take(some[order], 1) * _MULT[7], length[order]
        until = [np.searchsorted(-length, -d) for d in range(length[0] if len(length) else 0)]
        if not until:
            continue
        nodes = [path[:n] >> (length[:n] - d) for d, n in enumerate(until)]
        ones = [(path[:n] >> (length[:n] - d - 1)) & 1 for d, n in enumerate(until)]
        one = np.float32(1)
        for d, n in enumerate(until):
            high = ones[d] * np.int32(size)
            np.add.at(alone.reshape(-1), nodes[d] + ones[d] * np.int32(alone.shape[1]), one)
            at = slots(hashes[:, :n], nodes[d], size.bit_length() - 1) + high
            for k in range(CONTEXTS):
                np.add.at(table[k].reshape(-1), at[k], one)


@dataclass
class PathModel:
    """Log odds of the nodes alone and of contexts at nodes, weights and refinement by gate."""

    alone: np.ndarray  # (nodes) float32
    odds: np.ndarray  # (contexts, slots) int8, in steps of 1 / ODDS
    weights: np.ndarray  # (gates, inputs)
    refine: np.ndarray  # (gates, REFINE) probabilities
    buckets: np.ndarray  # training count of all words of a path that is a bucket's, else 0


def log_odds(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + np.float32(PRIOR)) / (n0 + np.float32(PRIOR)))


def refine_cell(mixed: np.ndarray) -> np.ndarray:
    return np.minimum(np.maximum(np.rint(mixed * 2 + REFINE // 2), 0), REFINE - 1).astype(np.int64)


def gates_of(depth: int, seen: np.ndarray) -> np.ndarray:
    return min(depth // 3, DEPTH_CLASSES - 1) * 9 + seen


def stretches(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each stretch its text, its first word and its number of words."""
    each = -(-lengths // STRETCH)
    text = np.repeat(np.arange(len(lengths)), each)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
    start = np.repeat(np.cumsum(lengths) - lengths, each) + nth * STRETCH
    return text, start, np.minimum(STRETCH, lengths[text] - nth * STRETCH)


def lane_words(contexts: Contexts, start: np.ndarray, size: np.ndarray) -> Iterator[tuple]:
    """Word by word, all stretches side by side, longest first: (lanes, paths, their lengths, hashes
    for ``slots``, how many have a bit at each depth), longest paths first."""
    fall = -size
    for t in range(int(size[0]) if len(size) else 0):
        lanes = np.searchsorted(fall, -t)  # those with a word at t
        at = start[:lanes] + t
        path = contexts.path[at]
        length = path_bits(path)
        order = np.argsort(-length.astype(np.int8), kind="stable")
        hashes = contexts.hashes.take(at[order], 1)  # row by row, which indexing wouldn't keep
        hashes *= _MULT[7]
        yield order, path[order], length[order], hashes, (lanes - np.cumsum(np.bincount(length)))[:-1].tolist()


def seen_contexts(odds: np.ndarray) -> np.ndarray:
    """How many contexts of words, times 3, and of frequent words were seen, by log odds (contexts, words)."""
    seen = (odds != 0).view(np.int8)
    out = seen[0] + seen[1]
    out *= np.int8(3)
    out += seen[2]
    out += seen[3]
    return out


def chosen(seen: np.ndarray) -> np.ndarray:
    """A 1 for each word at its gate of the nine of a depth, else 0: (gates, words)."""
    return (_NINE == seen).astype(np.float32)


def picked(weights: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """Weights (inputs, nine gates) of each word, by ``chosen``. A product with a 1 and eight 0 is exact and
    faster than taking; blocks are so small that the library starts no threads."""
    out = np.empty((len(weights), gate.shape[1]), np.float32)
    for lo in range(0, gate.shape[1], ALONE):
        out[:, lo : lo + ALONE] = weights @ gate[:, lo : lo + ALONE]
    return out


def gate_sums(x: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """Sums of inputs (inputs, words) by gate, (gates, inputs), in blocks as in ``picked``."""
    return sum((gate[:, lo : lo + ALONE] @ x[:, lo : lo + ALONE].T).astype(float) for lo in range(0, x.shape[1], ALONE))


def mix(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Mixed odds of inputs (inputs, words), within bounds; the weights are used up."""
    weights *= x
    mixed = weights.sum(0)
    np.maximum(mixed, np.float32(-MOST), out=mixed)
    return np.minimum(mixed, np.float32(MOST), out=mixed)


def code_stretches(contexts: Contexts, start: np.ndarray, size: np.ndarray, model: PathModel) -> np.ndarray:
    """log10 probability of the paths of each stretch, longest first. A stretch adds to the model's
    weights its own, which start at 0 and adapt along it."""
    own = np.zeros((len(START), len(start)), np.float32)
    base, bits = np.ascontiguousarray(model.weights.T, np.float32), model.odds.shape[1].bit_length() - 1
    table, tables = model.odds.reshape(-1), (np.arange(CONTEXTS, dtype=np.int32) << bits)[:, None]
    out, rate = np.zeros(len(start)), np.float32(CODING_RATE)
    # Probabilities, plain and refined, at mixed odds in steps of 1 / FINE.
    fine = (np.arange(2 * MOST * FINE + 1) / FINE - MOST).astype(np.float32)
    plain = (1 / (1 + np.exp(-fine))).astype(np.float32)
    both_of = (plain + model.refine[:, refine_cell(fine)]) / 2
    for lane, path, length, hashes, until in lane_words(contexts, start, size):
        w, now = own.take(lane, 1), np.ones(len(lane))
        for d, n in enumerate(until):
            node = path[:n] >> (length[:n] - (d + 1))
            one = (node & 1).astype(np.float32)
            node >>= 1
            x = np.empty((len(START), n), np.float32)
            x[0], x[-1] = model.alone.take(node), 0.3
            at = slots(hashes[:, :n], node, bits)
            at += tables
            odds = table.take(at)
            np.multiply(odds, np.float32(1 / ODDS), out=x[1:-1])
            seen, low = seen_contexts(odds), gates_of(d, 0)
            weights = picked(base[:, low : low + 9], chosen(seen))
            weights += w[:, :n]
            mixed = mix(x, weights)
            cell = (mixed * np.float32(FINE) + np.float32(MOST * FINE + 0.5)).astype(np.intp)
            p = plain.take(cell)
            cell += seen.astype(np.intp) * len(fine)
            # A bit's probability: that of a one, or what is left of it.
            now[:n] *= np.maximum(np.abs(1 - one - both_of[low : low + 9].take(cell)), np.float32(1e-6))
            x *= rate * (one - p)
            w[:, :n] += x
        own[:, lane] = w
        out[lane] += np.log10(now)
    return out


@dataclass
class Learner:
    """Weights (gates, inputs), steps learned, how often each gate was used, and refinement counts."""

    weights: np.ndarray = field(default_factory=lambda: np.tile(START.astype(float), (GATES, 1)))
    steps: int = 0
    used: np.ndarray = field(default_factory=lambda: np.zeros(GATES))
    refine: np.ndarray = field(default_factory=lambda: np.zeros((GATES, REFINE, 2)))


def left_out(tables: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Log odds of tables of counts, in which a bit is taken out of its own slot: (..., bit, slots), as
    coding holds them."""
    out = {"letters": spelling.left_out(tables["letters"])}
    less = lambda t, bit: log_odds(np.maximum(t[0] - np.float32(1 - bit), 0), np.maximum(t[1] - np.float32(bit), 0))
    out["alone"] = np.stack([less(tables["alone"], bit) for bit in (0, 1)])
    out["near"] = np.stack([[np.rint(ODDS * less(t, bit)).clip(-127, 127).astype(np.int8) for bit in (0, 1)] for t in tables["near"]])
    return out


def learn_stretches(contexts: Contexts, start: np.ndarray, size: np.ndarray, alone: np.ndarray, table: np.ndarray, learner: Learner) -> None:
    """One online pass over training stretches, with ``left_out`` odds: every bit is taken out of its
    own counts."""
    slots_, nodes, w = table.shape[-1], alone.shape[-1], learner.weights
    bits, alone, table = slots_.bit_length() - 1, alone.reshape(-1), table.reshape(-1)
    tables = (np.arange(CONTEXTS, dtype=np.int32) * np.int32(2 * slots_))[:, None]
    for _, path, length, hashes, until in lane_words(contexts, start, size):
        for d, n in enumerate(until):
            node = path[:n] >> (length[:n] - (d + 1))
            bit = node & 1
            node >>= 1
            x = np.empty((len(START), n), np.float32)
            x[0], x[-1] = alone.take(node + bit * np.int32(nodes)), 0.3
            at = slots(hashes[:, :n], node, bits)
            at += tables
            at += bit * np.int32(slots_)
            odds = table.take(at)
            np.multiply(odds, np.float32(1 / ODDS), out=x[1:-1])
            # The gates of a depth are neighbours.
            seen, own = seen_contexts(odds), slice(gates_of(d, 0), gates_of(d, 0) + 9)
            gate = chosen(seen)
            mixed = mix(x, picked(w[own].T.astype(np.float32), gate))
            cell = (seen.astype(np.intp) * REFINE + refine_cell(mixed)) * 2 + bit
            cells = np.bincount(cell, minlength=9 * REFINE * 2).reshape(9, REFINE, 2)
            mass = cells.sum((1, 2))
            learner.refine[own] += cells
            learner.used[own] += mass
            learner.steps += 1
            x *= bit.astype(np.float32) - 1 / (1 + np.exp(-mixed))
            # A step for each word of the mean, as many as there are up to a hundred.
            step = RATE / (1 + learner.steps / 4000) ** 0.5 * np.sqrt(np.minimum(mass, 100)) / np.maximum(mass, 1)
            w[own] += step[:, None] * gate_sums(x, gate)


# -- the model over batches -------------------------------------------------------------


def _joined(f: pd.DataFrame) -> pd.DataFrame:
    """The rows of a batch as one: its texts, and counts and paths by number, with the bytes of
    words seen once or never. ``bytes`` of the row without a number are the texts."""
    head = f["number"].to_numpy() < 0
    n, texts = int(f.loc[head, "c"].iloc[0]), f.loc[head, "bytes"].iloc[0]
    f = f[~head].sort_values("number")
    c, path = f["c"].to_numpy(np.int64), f["path"].to_numpy(np.int32)
    words = zlib.compress(c.tobytes() + path.tobytes() + b" ".join(f["bytes"][c <= 1]), 1)
    return pd.DataFrame({"n": [n], "n_words": [len(f)], "texts": [texts], "words": [words], "place": [zlib.crc32(texts) % 64]})


@dataclass
class Words:
    """Counts and paths of a batch's words, and numbers and bytes of those seen once or never."""

    c: np.ndarray
    path: np.ndarray
    numbers: np.ndarray
    names: list[bytes]

    def bytes_of(self, numbers: np.ndarray) -> list[bytes]:
        return [self.names[k] for k in np.searchsorted(self.numbers, numbers).tolist()]


def _read(f: pd.DataFrame) -> Iterator[tuple[Batch, Words]]:
    for n, m, texts, words in f[["n", "n_words", "texts", "words"]].itertuples(index=False):
        raw = zlib.decompress(words)
        c = np.frombuffer(raw, np.int64, m).copy()
        own = Words(c, np.frombuffer(raw, np.int32, m, 8 * m).copy(), np.flatnonzero(c <= 1), raw[12 * m :].split(b" "))
        del raw
        yield Batch.unpacked(texts, n), own


def spelled(b: Batch, words: Words, contexts: Contexts, at: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The words at these places in bytes, and their outer contexts: the last frequent word, the two last."""
    return words.bytes_of(b.words[at]), contexts.hashes[2:4, at]


def cut_table(table: np.ndarray, name: str) -> Iterator[pd.DataFrame]:
    """The rows of a task's table for ``summed_table``; parts without counts are left out."""
    rows = table.reshape(-1, min(1 << CHUNK_BITS, table.shape[-1]))
    for k in np.flatnonzero(rows.any(1)):
        yield pd.DataFrame({"name": [name], "task": [TaskContext.get().partitionId()], "part": [int(k)], "counts": [zlib.compress(rows[k].tobytes(), 1)]})


def _added(f: pd.DataFrame) -> pd.DataFrame:
    total = np.frombuffer(zlib.decompress(f["counts"].iloc[0]), np.float32).copy()
    for c in f["counts"].iloc[1:]:
        total += np.frombuffer(zlib.decompress(c), np.float32)
    return f.iloc[:1].assign(counts=[zlib.compress(total.tobytes(), 1)])


def summed_tables(parts: DataFrame, shapes: dict[str, tuple[int, ...]], tasks: int) -> dict[str, np.ndarray]:
    """The sums of the float32 tables that ``tasks`` tasks have cut to (name, task, part, counts).

    Many are added up in two levels, so that a task holds the rows of some tables at a time."""
    made = "name string, task long, part int, counts binary"
    if tasks > 32:
        parts = parts.groupBy("name", "part", F.pmod("task", F.lit(math.isqrt(tasks)))).applyInPandas(lambda f: _added(f), made)
    out = {k: np.zeros(v, np.float32) for k, v in shapes.items()}
    # The tables themselves, whose sizes are bounded.
    for r in parts.groupBy("name", "part").applyInPandas(lambda f: _added(f), made).collect():
        to = out[r["name"]]
        to.reshape(-1, min(1 << CHUNK_BITS, to.shape[-1]))[r["part"]] = np.frombuffer(zlib.decompress(r["counts"]), np.float32)
    return out


@dataclass
class Learners:
    """What is learned of paths and of spelling: learners, and for spelling how often each gate was
    used and refinement counts."""

    path: Learner = field(default_factory=Learner)
    letters: spelling.Learner = field(default_factory=lambda: spelling.Learner(np.tile(spelling.START, (spelling.GATES, 1))))
    used: np.ndarray = field(default_factory=lambda: np.zeros(spelling.GATES))
    refine: np.ndarray = field(default_factory=lambda: np.zeros((spelling.GATES, spelling.REFINE, 2)))


def count_batch(b: Batch, words: Words, escape: int, tables: dict[str, np.ndarray]) -> None:
    """Add the training texts of a batch to the tables of counts."""
    b = b.some(np.flatnonzero(b.train))
    for part in (b.some(texts) for texts in b.slices(SLICE)):
        c = words.c[part.words]
        contexts = word_contexts(words.path[part.words], c <= 1, part.about[:, 0])
        count_paths(contexts, np.ones(len(c), bool), tables["alone"], tables["near"])
        once = np.flatnonzero(c == 1)
        count_paths(Contexts(np.full(len(once), escape, np.int32), contexts.hashes[:, once]), np.ones(len(once), bool), tables["alone"], tables["near"])
        for lo in range(0, len(once), 50_000):
            names, outer = spelled(part, words, contexts, once[lo : lo + 50_000])
            spelling.count_bits(names, tables["letters"], outer)


def learn_batch(b: Batch, words: Words, escape: int, tables: dict[str, np.ndarray], learners: Learners, together: int) -> None:
    """Learn on from the batch's training texts, and their words seen once, with tables of counts or
    what ``left_out`` made of them; a step has ``together`` times the stretches."""
    odds = tables if tables["near"].dtype == np.int8 else left_out(tables)
    b = b.some(np.flatnonzero(b.train))
    for part in (b.some(texts) for texts in b.slices(LANES * STRETCH * together)):
        c, lengths = words.c[part.words], part.about[:, 0]
        own = word_contexts(words.path[part.words], c <= 1, lengths)
        contexts = Contexts(np.where(c == 1, np.int32(escape), own.path), own.hashes)
        once = np.flatnonzero(c == 1)
        for lo in range(0, len(once), 50_000):
            names, outer = spelled(part, words, contexts, once[lo : lo + 50_000])
            _, used, refine = spelling.learn_weights(names, None, learners.letters, outer, odds["letters"], together)
            learners.used, learners.refine = learners.used + used, learners.refine + refine
        _, first, size = stretches(lengths)
        order = np.argsort(-size, kind="stable")
        for lo in range(0, len(order), LANES * together):
            some = order[lo : lo + LANES * together]
            learn_stretches(contexts, first[some], size[some], odds["alone"], odds["near"], learners.path)


def fit_models(batches: DataFrame, total: int, depth: int, escape: int, once: int, buckets: np.ndarray) -> tuple[PathModel, spelling.BitModel]:
    """Bit counts over all training texts, of ``total`` words and ``once`` seen once, then weights
    and refinement from all of their stretches."""
    spark = batches.sparkSession
    nodes = 1 << max(depth + 1, escape.bit_length())
    bits = min(SLOT_BITS, max(LEAST_BITS, int(total).bit_length() - 6))
    letter_bits = min(spelling.TABLE_BITS, max(spelling.LEAST_BITS, (8 * once).bit_length()))
    shapes = {"alone": (2, nodes), "near": (CONTEXTS, 2, 1 << bits), "letters": (spelling.PREDICTORS, 2, 1 << letter_bits)}

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = {k: np.zeros(v, np.float32) for k, v in shapes.items()}
        for f in frames:
            for b, words in _read(f):
                count_batch(b, words, escape, tables)
                release()
        for name, t in tables.items():
            yield from cut_table(t, name)
        tables.clear()
        release()

    together = int(min(TOGETHER, max(1, total // LEARN_WORDS)))
    tasks = int(min(2 * spark.sparkContext.defaultParallelism, max(1, total // TABLE_WORDS)))
    tables = summed_tables(batches.coalesce(tasks).mapInPandas(count, "name string, task long, part int, counts binary"), shapes, tasks)
    shared = spark.sparkContext.broadcast(left_out(tables))

    def learning(start: Learners):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now = Learners(Learner(start.path.weights.copy(), start.path.steps), spelling.Learner(start.letters.weights.copy(), start.letters.steps))
            for f in frames:
                for b, words in _read(f):
                    learn_batch(b, words, escape, shared.value, now, together)
                    release()
            for name, learner, used, refine in (("near", now.path, now.path.used, now.path.refine), ("letters", now.letters, now.used, now.refine)):
                if used.any():
                    yield pd.DataFrame({"name": [name], "weights": [learner.weights.tobytes()], "steps": [learner.steps], "used": [used.tobytes()], "refine": [refine.tobytes()]})
            release()

        return run

    now, low = Learners(), 0
    for high in ROUNDS:
        got = batches.where(f"place >= {low} AND place < {high}").mapInPandas(learning(now), "name string, weights binary, steps long, used binary, refine binary").collect()
        for name, learner, refine in (("near", now.path, now.path.refine), ("letters", now.letters, now.refine)):
            used, weights = np.full((len(learner.weights), 1), 1e-9), learner.weights * 1e-9
            for r in (r for r in got if r["name"] == name):
                u = np.frombuffer(r["used"])[:, None]
                used, weights = used + u, weights + np.frombuffer(r["weights"]).reshape(len(u), -1) * u
                refine += np.frombuffer(r["refine"]).reshape(refine.shape)
                learner.steps = max(learner.steps, r["steps"])
            learner.weights = weights / used
        low = high
    shared.destroy()
    near, letters, alone = tables["near"], tables["letters"], tables["alone"]
    odds = np.stack([np.rint(ODDS * log_odds(t[0], t[1])).clip(-127, 127).astype(np.int8) for t in near])
    return (
        PathModel(log_odds(alone[0], alone[1]), odds, now.path.weights, refined(now.path.refine), buckets),
        spelling.BitModel(spelling.log_odds(letters[:, 0], letters[:, 1]), now.letters.weights, refined(now.refine)),
    )


def refined(counts: np.ndarray) -> np.ndarray:
    """Probabilities from refinement counts; cells without bits stand at their own odds."""
    cell = 1 / (1 + np.exp(-(np.arange(REFINE) - REFINE // 2) / 2))
    smooth = counts + np.stack([1 - cell, cell], 1)[None] * 4
    return (smooth[..., 1] / smooth.sum(-1)).astype(np.float32)


def kind_log10(counts: np.ndarray) -> np.ndarray:
    """log10 probabilities of kinds in each class, from training counts of (class, kind)."""
    c = counts.reshape(CLASSES, KINDS).astype(float) + 0.5
    return np.log10(c / c.sum(1, keepdims=True)).ravel()


def mix_scores(docs: DataFrame, folds: int = 5, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte and
    n_alone of every row of ``docs`` (doc_id, text).

    Texts whose crc32(doc_id) mod ``folds`` is ``held_out`` are scored but not learned from.
    The base is a smoothed unigram model over words and one end; ``score`` is the model's
    log10 probability of the lower-cased text with its blanks, and bits_per_byte its cost over
    the bytes of the text and one end; n_alone counts its distinct words that no other training
    text holds. A null text is an empty one: an end alone. A null id is learned from. Equal texts get equal scores, up to roundings; very long texts are read and
    coded whole. An empty table gives an empty result; extra columns are dropped.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    out_of = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held_out, F.lit(False))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (~out_of).alias("train"))
    rows = tables.keep(source.mapInPandas(_batches, "batch long, word binary, number int, trained long, texts binary"))
    heads, own = rows.where("word IS NULL"), rows.where("word IS NOT NULL")
    vocabulary = tables.keep(own.groupBy("word").agg(F.sum("trained").alias("c")))

    real = (F.length("word") > 0) & (F.col("c") > 0)
    got = vocabulary.agg(F.sum(F.when(real, F.col("c"))), F.count(F.when(real, 1)), F.count(F.when(F.col("c") == 1, 1)), F.sum("c"), F.count(F.when(F.col("c") > 0, 1))).first()
    ends, kinds = 0, np.zeros(CLASSES * KINDS, np.int64)
    for r in heads.select("texts", "trained").mapInPandas(_head_sums, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        if r["k"] < 0:
            ends = r["n"]
        else:
            kinds[r["k"]] = r["n"]
    n, v = (got[0] or 0) + ends, got[1] + (ends > 0)
    once, words = got[2], got[3] or 0
    depth = tree_depth(words)
    escapes = max(once + 1, words >> (depth - 2))  # its path is no deeper than others
    total = words + escapes
    known, buckets, escape = _coded_vocabulary(tables, vocabulary.where("c > 0"), got[4], escapes, total, depth)
    unknown = vocabulary.where("c = 0").select("word", "c", F.lit(escape).cast("int").alias("path"))
    coded = tables.keep(known.unionByName(unknown))
    # A word of many batches is a hot key of this join, which adaptive execution splits.
    rare = F.when(F.col("c") <= 1, F.col("word")).alias("bytes")
    placed = own.select("batch", "word", "number").join(coded.hint("merge"), "word").select("batch", "number", "c", "path", rare)
    texts_of = heads.select("batch", "number", F.col("trained").alias("c"), F.lit(0).cast("int").alias("path"), F.col("texts").alias("bytes"))
    packed = placed.unionByName(texts_of).groupBy("batch").applyInPandas(lambda f: _joined(f), "n long, n_words long, texts binary, words binary, place int")
    batches = tables.keep(packed)
    tables.drop(rows, vocabulary, coded)
    models = fit_models(batches, total, depth, escape, once, buckets)
    denominator, kind_lp = n + 0.5 * (v + 1), kind_log10(kinds)
    shared = spark.sparkContext.broadcast(models)

    def code(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for b, words in _read(f):
                yield from _scored(b, words, *shared.value, n, ends, denominator, kind_lp)
                release()
        release()

    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double, n_alone long"
    return batches.mapInPandas(code, out)


def bucket_shares(words: Words, paths: PathModel) -> np.ndarray:
    """log10 of the share of each known word in its bucket, 0 without one."""
    whole = paths.buckets[np.minimum(words.path, len(paths.buckets) - 1)]
    return np.where((whole > 0) & (words.c > 0), np.log10(np.maximum(words.c, 1) / np.maximum(whole, 1)), 0.0)


def code_batch(b: Batch, words: Words, paths: PathModel, letters: spelling.BitModel, kind_lp: np.ndarray) -> np.ndarray:
    """log10 probability of each text of a batch."""
    share = bucket_shares(words, paths)
    return np.concatenate([_coded(b.some(texts), words, share, paths, letters, kind_lp) for texts in b.slices(CODED)])


def _coded(b: Batch, words: Words, share: np.ndarray, paths: PathModel, letters: spelling.BitModel, kind_lp: np.ndarray) -> np.ndarray:
    lengths, texts, c = b.about[:, 0], len(b.ids), words.c[b.words]
    of, contexts = np.repeat(np.arange(texts, dtype=np.int32), lengths), word_contexts(words.path[b.words], c <= 1, lengths)
    score = np.bincount(of, share[b.words], texts) + b.about[:, 3:] @ kind_lp
    unknown = np.flatnonzero(c == 0)
    for lo in range(0, len(unknown), 50_000):
        at = unknown[lo : lo + 50_000]
        names, outer = spelled(b, words, contexts, at)
        score += np.bincount(of[at], spelling.score_words(names, letters, outer), texts)
    text, start, size = stretches(lengths)
    order = np.argsort(-size, kind="stable")
    return score + np.bincount(text[order], code_stretches(contexts, start[order], size[order], paths), texts)


def _scored(b: Batch, words: Words, paths: PathModel, letters: spelling.BitModel, n: int, ends: int, denominator: float, kind_lp: np.ndarray) -> Iterator[pd.DataFrame]:
    """The result rows of a batch, some texts at a time."""
    share, empty = bucket_shares(words, paths), np.arange(len(words.c)) == b.empty
    base = np.where(empty, 0.0, np.log10((words.c + 0.5) / denominator))
    # Only words that this batch alone holds can be a text's own.
    inside = np.bincount(b.words[np.repeat(b.train, b.about[:, 0])], minlength=len(words.c)) >= words.c
    for part in (b.some(texts) for texts in b.slices(CODED)):
        texts, score = len(part.ids), _coded(part, words, share, paths, letters, kind_lp)
        of = np.repeat(np.arange(texts, dtype=np.int32), part.about[:, 0])
        unknown = np.bincount(of[((words.c == 0) & ~empty)[part.words]], minlength=texts)
        # Words that no other training text holds: their count is that of this text alone.
        some = inside[part.words]
        pair, own = np.unique(of[some] * np.int64(len(words.c)) + part.words[some], return_counts=True)
        alone = words.c[pair % len(words.c)] <= own * part.train[pair // len(words.c)]
        yield pd.DataFrame({
            "doc_id": pd.arrays.IntegerArray(part.ids.copy(), part.null.copy()), "held_out": ~part.train, "n_tokens": part.about[:, 1] + 1,
            "n_known": part.about[:, 1] - unknown + int(ends > 0), "train_tokens": np.full(texts, n),
            "base_score": np.bincount(of, base[part.words], texts) + np.log10((ends + 0.5) / denominator), "score": score, "bits_per_byte": score / -np.log10(2) / part.about[:, 2],
            "n_alone": np.bincount(pair[alone] // len(words.c), minlength=texts),
        })


def _head_sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Training ends (k = -1) and counts of class and kind of a partition's batches."""
    total = np.zeros(1 + CLASSES * KINDS, np.int64)
    for f in frames:
        for head, n in zip(f["texts"], f["trained"], strict=True):
            b = Batch.unpacked(head, int(n))
            total += np.concatenate([[b.train.sum()], b.about[b.train, 3:].sum(0)])
    yield pd.DataFrame({"k": np.arange(-1, CLASSES * KINDS), "n": total})
