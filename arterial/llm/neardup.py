"""Near duplicates by min-max hashing, exact links and connected components.

Signatures: each permutation of the shingle hashes yields two values, its minimum and its
maximum, so a signature of 2 P values costs P hash evaluations; both agree between two
sets with the probability of their Jaccard similarity, and the two are drawn from
opposite ends, which lowers the variance of the share of agreements. Bands are made of
these values; ``banding`` chooses them by the similarity asked for, so that a pair right
at it shares no band once in 500,000.

Links: documents with equal sets are one class from the start. Documents that share a
band form a bucket. Rather than list the pairs of a bucket, rounds link across components:

* First every document is compared with one partner, the member of all of its buckets
  that shares most bands with others; links that hold on the full sets join components.
* Then, in round r, a bucket that still spans components compares about 16**r of its
  members (all, in small ones) with its members in other components. The work ends when
  no bucket spans components, or when all members of those that do were compared.

Before a pair of a later round is listed, its similarity is bounded from above: bit k of a
set's sketch is the parity of its hashes that fall to k, so two sketches differ in no more
bits than the sets have members that the other lacks. Copies of one text, each changed
elsewhere, that aren't linked are told apart by that without listing them.

So a large group of copies costs a comparison or two for each document, and no pair that
shares a band and could join two components goes unchecked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arterial.llm.common import Tables, release

#: Chance that a pair at the similarity asked for shares no band, and values of a signature, at most.
MISS, VALUES = 2e-6, 180
#: Buckets of this many documents or fewer compare all pairs across components at once.
SMALL_BUCKET = 24
#: Words of 64 bits in a sketch, each a column of its own where pairs are met: small enough
#: that the comparison is compiled as a whole.
SKETCH = 16
#: Word hashes that a task keeps, and texts that it works on at a time.
KEPT_WORDS, STEP_ROWS = 150_000, 500

_FINAL = np.uint64(0xD6E8FEB86659FD93)


def _odd(rng: np.random.Generator, n: int) -> np.ndarray:
    return (rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


_PLACE = _odd(np.random.default_rng(20240301), 64)


def banding(percent: int) -> tuple[int, int]:
    """Rows and bands for a similarity: as many rows a band as ``VALUES`` allow with the
    bands that ``MISS`` asks for; 6 by 28 at 85 percent, 5 by 34 at 80."""
    bands = lambda rows: 1 if percent >= 100 else math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** rows)))
    rows = 1
    while rows < 16 and (rows + 1) * bands(rows + 1) <= VALUES:
        rows += 1
    return rows, bands(rows)


@lru_cache(maxsize=None)
def _constants(rows: int, bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multipliers and summands of the permutations, and the multipliers within a band."""
    rng = np.random.default_rng(20240229)
    n = -(-rows * bands // 2)
    return _odd(rng, n), rng.integers(0, 1 << 63, n, dtype=np.uint64), _odd(rng, rows)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _FINAL
    return h ^ (h >> np.uint64(32))


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII blanks alone
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    size = min(width, n)
    out = np.full(n - size + 1, size, np.uint64)  # the length takes part
    for k in range(size):
        out += h[k : k + len(out)] * _PLACE[k]
    return np.unique(_mixed(out))


def minmax_bands(shingles: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """Band keys of a set with members; the number of a band takes part in its keys."""
    mult, add, within = _constants(rows, bands)
    low = np.full(len(mult), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(mult), np.uint64)
    for at in range(0, len(shingles), 1024):
        h = _mixed(shingles[at : at + 1024, None] * mult + add)
        low, high = np.minimum(low, h.min(0)), np.maximum(high, h.max(0))
    values = np.concatenate([low, high])[: rows * bands].reshape(bands, rows)
    return _mixed((values * within).sum(1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * _FINAL)


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    """``SKETCH`` words; each bit is the parity of the hashes that fall to it."""
    n = 64 * SKETCH
    odd = np.bincount((shingles >> np.uint64(64 - n.bit_length() + 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _signatures(width: int, rows: int, bands: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in (g.iloc[lo : lo + STEP_ROWS] for g in frames for lo in range(0, len(g), STEP_ROWS)):
            made = []
            for t in f["text"]:
                s = shingle_hashes(t, width)
                x = int(np.bitwise_xor.reduce(s)) if len(s) else 0
                own = (minmax_bands(s, rows, bands).view(np.int64), parity_sketch(s)) if len(s) else (None, None)
                made.append((len(s), np.uint64(x).view(np.int64), s.sum(dtype=np.uint64).view(np.int64), *own))
            out = pd.DataFrame(made, columns=["n_shingles", "__x", "__s", "__bands", "__sketch"])
            out.insert(0, "doc_id", f["doc_id"].to_numpy())
            yield out
        _words.clear()  # the worker lives on
        release()

    return run


def _sets(width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in (g.iloc[lo : lo + STEP_ROWS] for g in frames for lo in range(0, len(g), STEP_ROWS)):
            yield pd.DataFrame({"id": f["doc_id"], "shingles": [shingle_hashes(t, width).view(np.int64) for t in f["text"]]})
        _words.clear()
        release()

    return run


def merged(tables: Tables, components: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` (id, comp) after joining the components of each link (a, b), pairs of components.

    Labels are the smallest id of a component. Each round points every component at the
    smallest neighbour it knows of and follows the pointers once, so the rounds are about
    the logarithm of a chain of links."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = tables.keep(both.distinct())
    labels = tables.keep(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("to")))
    while True:
        known = labels.select(F.col("a").alias("b"), F.col("to").alias("near"))
        least = edges.join(known, "b").groupBy("a").agg(F.min("near").alias("near"))
        stepped = labels.join(least, "a").select("a", F.least("to", "near").alias("new"), "to")
        jump = labels.select(F.col("a").alias("new"), F.col("to").alias("jump"))
        to = F.least("new", F.coalesce("jump", "new"))
        stepped = tables.keep(stepped.join(jump, "new", "left").select("a", to.alias("to"), (to < F.col("to")).alias("moved")))
        tables.drop(labels)
        labels = stepped
        if not stepped.where("moved").head(1):
            break
    out = components.join(labels.select(F.col("a").alias("comp"), "to"), "comp", "left")
    out = tables.keep(out.select("id", F.coalesce("to", "comp").alias("comp")))
    tables.drop(edges, labels)
    return out


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) with 100 * intersection >= percent * union, on the full sets."""
    side = lambda name: sets.select(F.col("id").alias(name), F.col("shingles").alias(f"s_{name}"))
    both = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    common = F.size(F.array_intersect("s_a", "s_b"))
    return both.where(100 * common >= percent * (F.size("s_a") + F.size("s_b") - common)).select("a", "b")


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text).

    Words are separated by ASCII blanks, A-Z lower-cased; sets are distinct shingles of
    ``width`` words, or the whole sequence of a shorter text. Documents are linked when
    100 * intersection >= ``percent`` * union; a component takes its smallest doc_id.
    Null, empty and blank texts have no set, link with nothing and are kept. Rows repeated
    under one id are one document if their texts have one set, else they link what each of
    them links. A null id links with nothing, has a null component and is kept. Very long
    texts are read whole. An empty table gives an empty result; extra columns are dropped.
    """
    tables = Tables(docs.sparkSession)
    made = "doc_id long, n_shingles long, __x long, __s long, __bands array<long>, __sketch array<long>"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = tables.keep(texts.mapInPandas(_signatures(width, *banding(percent)), made))
    key = ["n_shingles", "__x", "__s"]
    takes_part = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    real = signed.where(takes_part)
    classes = tables.keep(real.groupBy(*key).agg(F.min("doc_id").alias("id"), F.min("__bands").alias("__bands"), F.min("__sketch").alias("sketch")))
    # A document and its class; ids of several sets tie their classes together.
    rows = tables.keep(real.select("doc_id", *key).join(classes.select(*key, "id"), key).select("doc_id", "n_shingles", "id"))
    several = tables.keep(rows.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("last")).where("a < last").select("doc_id", "a"))
    ties = rows.join(several, "doc_id").where("a <> id").select("a", F.col("id").alias("b")).distinct()

    banded = classes.select("id", "n_shingles", F.explode("__bands").alias("key"))
    crowded = banded.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = tables.keep(banded.join(crowded, "key").select("key", "m", "id", "n_shingles"))
    # Priority: members whose bands are shared most, so that members of one group agree on
    # whom they meet first, and that is one close to most.
    degree = tables.keep(members.groupBy("id").agg(F.sum("m").alias("degree")))
    wanted = texts.join(degree.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    sets = tables.keep(wanted.mapInPandas(_sets(width), "id long, shingles array<long>"))
    rank = F.struct((-F.col("degree")).alias("d"), F.xxhash64("id").alias("h"), F.col("id").alias("id"), F.col("n_shingles").alias("n"))
    ranked = members.join(degree, "id")
    heads = ranked.groupBy("key").agg(F.min(rank).alias("head"))
    first = members.join(heads, "key").where(F.col("id") != F.col("head.id")).groupBy("id", "n_shingles").agg(F.min("head").alias("head"))
    pairs = _fitting(first.select(F.col("id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("head.id").alias("b"), F.col("head.n").alias("n_b")), percent)
    linked = tables.keep(_similar(pairs, sets, percent).union(ties))
    components = merged(tables, classes.select("id", F.col("id").alias("comp")).distinct(), linked)
    tables.drop(linked)

    sketches = classes.select("id", "n_shingles", "sketch")
    share = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    live = members
    for r in range(1, 16):
        placed = live.join(components, "id").select("key", "m", "id", "n_shingles", "comp")
        spans = placed.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("key")
        spanning = tables.keep(placed.join(spans, "key"))
        tables.drop(live)
        live = spanning.select("key", "m", "id", "n_shingles")
        biggest = spanning.agg(F.max("m")).first()[0]
        if biggest is None:
            break
        drawn = tables.keep(spanning.join(sketches, ["id", "n_shingles"]).select("key", "m", "id", "n_shingles", "comp", *(F.col("sketch")[k].alias(f"k{k}") for k in range(SKETCH))))
        probes = drawn.where((F.col("m") <= SMALL_BUCKET) | (share * F.col("m") < F.lit(float(1 << 4 * r))))
        probes = probes.select("key", F.col("id").alias("p"), F.col("n_shingles").alias("n_p"), F.col("comp").alias("c_p"), *(F.col(f"k{k}").alias(f"p{k}") for k in range(SKETCH)))
        # Of two probes, the pair is met once.
        once = (F.col("m") > SMALL_BUCKET) | (F.col("id") < F.col("p"))
        met = drawn.join(probes.hint("merge"), "key").where((F.col("comp") != F.col("c_p")) & once & _may_link(percent))
        fresh = tables.keep(met.select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct())
        links = tables.keep(_similar(fresh, sets, percent)) if fresh.head(1) else None
        if links is not None and links.head(1):
            named = components.select(F.col("id").alias("a"), F.col("comp").alias("x"))
            other = components.select(F.col("id").alias("b"), F.col("comp").alias("y"))
            across = links.join(named, "a").join(other, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
            before, components = components, merged(tables, components, across)
            tables.drop(before)
        tables.drop(drawn, fresh, *([] if links is None else [links]))
        if (1 << 4 * r) >= biggest or biggest <= SMALL_BUCKET:  # every member of a live bucket has been a probe
            break
    tables.drop(sets, classes, several, degree)
    found = rows.join(components, "id").select("doc_id", "n_shingles", F.col("comp").alias("component_id"))
    alone = signed.where(~takes_part).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _may_link(percent: int) -> Column:
    """Whether the sizes and sketches of (n_shingles, k0, ...) and (n_p, p0, ...) allow the similarity.

    With d members not in common of n in both sets it is (n - d) / (n + d), and d is no
    less than the bits that differ."""
    n = F.col("n_shingles") + F.col("n_p")
    sized = 100 * F.least("n_shingles", "n_p") >= percent * F.greatest("n_shingles", "n_p")
    differ = sum((F.bit_count(F.col(f"k{k}").bitwiseXOR(F.col(f"p{k}"))) for k in range(SKETCH)), F.lit(0))
    return sized & ((100 - percent) * n >= (100 + percent) * differ)


def _fitting(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a < b) whose set sizes allow the similarity."""
    sized = pairs.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return sized.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


NEAR_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS sh
  FROM d
), n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
x AS (SELECT doc_id, unnest(sh) AS g FROM s),
hit AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM hit JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS id, doc_id AS m FROM n UNION SELECT ways.b, reach.m FROM reach JOIN ways ON reach.id = ways.a),
least AS (SELECT id, min(m) AS component_id FROM reach GROUP BY id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN least ON id = doc_id
"""
