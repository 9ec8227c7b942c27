"""Exact top-k inner products by dual-tree search over cover trees.

Rows are packed into blocks of at most ``BLOCK`` vectors and queries into chunks of at most
``CHUNK``; each carries a cover tree (children lie within the parent's covering radius and
apart from each other) that is built once and written with it to the shared checkpoint
folder. Chunks and groups of blocks meet in cells, one grouped task each, so neither side
is on the driver or in every task, and a block goes only to chunks that its root's bound
allows. For nodes Q and R with centres q, r and covering radii a, b no pair below them
scores more than

    <q, r> + a |r| + b |q| + a b,

so the pair of nodes is dropped when that is below the worst kth score in Q. The kth
scores start from a seed of rows scored exactly, so blocks prune from the first pair on.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arterial.llm.common import Tables

BLOCK, CHUNK, SEED_ROWS = 4096, 16384, 2048
#: Blocks of a cell, at most about; chunks up to which their roots go to every task.
CELL_BLOCKS, ROOTS = 16, 4096
LEAF, FAN_OUT, BASE = 32, 32, 1.5
#: Rows of leaves, best bounds first, that meet a query group between two looks at its worst score.
STEP_ROWS = 1024
#: Products of sums below this are exact in doubles.
_EXACT = 2.0**52


class CoverTree:
    """Nodes in arrays: centre row, covering radius, children [first, last), rows [start, stop) of ``order``."""

    def __init__(self, x: np.ndarray):
        self.x = x
        centre, radius, first, last, start, stop = [], [], [], [], [], []
        order: list[np.ndarray] = []
        queue, at = [np.arange(len(x))], 0
        placed = 0
        while at < len(queue):
            rows = queue[at]
            at += 1
            far = np.sqrt(((x[rows] - x[rows[0]]) ** 2).sum(1))
            reach = float(far.max())
            centre.append(rows[0])
            radius.append(reach)
            if len(rows) <= LEAF or reach == 0:
                first.append(0), last.append(0)
                start.append(placed), stop.append(placed + len(rows))
                order.append(rows)
                placed += len(rows)
                continue
            # Farthest rows become centres until all lie within the smaller radius.
            owner, n = np.zeros(len(rows), int), 1
            while n < FAN_OUT and (worst := int(far.argmax())) is not None and far[worst] > reach / BASE:
                d = np.sqrt(((x[rows] - x[rows[worst]]) ** 2).sum(1))
                near = d < far
                far[near], owner[near] = d[near], n
                n += 1
            first.append(len(queue)), last.append(len(queue) + n)
            start.append(0), stop.append(0)
            for k in range(n):
                own = np.flatnonzero(owner == k)
                queue.append(rows[own[np.argsort(far[own], kind="stable")]])
        as_int = lambda v: np.array(v, np.int64)
        self.centre, self.radius = as_int(centre), np.array(radius)
        self.first, self.last, self.start, self.stop = map(as_int, (first, last, start, stop))
        self.order = np.concatenate(order) if order else np.zeros(0, np.int64)
        self.norm = np.sqrt((x[self.centre] ** 2).sum(1)) if len(x) else np.zeros(0)

    _PARTS = ("centre", "radius", "first", "last", "start", "stop", "order", "norm")

    def packed(self) -> bytes:
        """The tree without its rows."""
        return pickle.dumps([getattr(self, p) for p in self._PARTS])

    @classmethod
    def unpacked(cls, tree: bytes, x: np.ndarray) -> CoverTree:
        out = cls.__new__(cls)
        out.x = x
        for p, v in zip(cls._PARTS, pickle.loads(tree), strict=True):
            setattr(out, p, v)
        return out

    def rows(self, nodes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.order[self.start[n] : self.stop[n]] for n in nodes])


class TopK:
    """Best k (score, id) of each query; equal scores go to the smaller id."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray):
        self.own, self.k, self.floor = ids, k, floor
        self.score = np.full((len(ids), k), -np.inf)
        self.id = np.full((len(ids), k), np.iinfo(np.int64).max)

    def worst(self, q: np.ndarray) -> float:
        """The worst kth score of these queries, or what the seed rows promise."""
        return float(np.maximum(self.score[q, -1], self.floor[q]).min())

    def add(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        # Few rows reach a kth score, so only those are sorted in.
        reach = scores >= np.maximum(self.score[q, -1], self.floor[q])[:, None]
        hit, found = reach.any(1), reach.any(0)
        if not found.any():
            return
        q, scores, ids = q[hit], scores[np.ix_(hit, found)], ids[found]
        scores = np.where(self.own[q][:, None] == ids[None, :], -np.inf, scores)
        s = np.concatenate([self.score[q], scores], 1)
        i = np.concatenate([self.id[q], np.broadcast_to(ids, scores.shape)], 1)
        i = np.where(np.isneginf(s), np.iinfo(np.int64).max, i)
        best = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[q], self.id[q] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)


def dual_search(queries: CoverTree, data: CoverTree, ids: np.ndarray, top: TopK) -> None:
    """Bring ``top`` up to date with all rows of ``data``."""
    if not len(queries.x) or not len(data.x):
        return

    def bounds(q: int, nodes: np.ndarray) -> np.ndarray:
        dots = data.x[data.centre[nodes]] @ queries.x[queries.centre[q]]
        a, b = queries.radius[q], data.radius[nodes]
        most = dots + a * data.norm[nodes] + b * queries.norm[q] + a * b
        return most + 1e-9 * np.abs(most) + 1e-6  # roundings must not lose a tie

    below = {}  # rows of each query node, bottom up
    for q in range(len(queries.centre) - 1, -1, -1):
        kids = range(queries.first[q], queries.last[q])
        below[q] = np.concatenate([below[c] for c in kids]) if len(kids) else queries.order[queries.start[q] : queries.stop[q]]
    stack = [(0, np.array([0]))]
    while stack:
        q, nodes = stack.pop()
        rows = below[q]
        nodes = nodes[bounds(q, nodes) >= top.worst(rows)]
        if not len(nodes):
            continue
        inner = data.last[nodes] > data.first[nodes]
        grown = np.concatenate([nodes[~inner], *[np.arange(data.first[n], data.last[n]) for n in nodes[inner]]])
        if queries.last[q] > queries.first[q]:
            stack += [(c, grown) for c in range(queries.first[q], queries.last[q])]
        elif inner.any():
            stack.append((q, grown))
        else:
            most = bounds(q, nodes)
            best_first = np.argsort(-most)
            nodes, most = nodes[best_first], most[best_first]
            ends = np.cumsum(data.stop[nodes] - data.start[nodes])
            at = 0
            while at < len(nodes) and most[at] >= top.worst(rows):
                to = int(np.searchsorted(ends, ends[at] + STEP_ROWS))
                found = data.rows(nodes[at:to])
                top.add(rows, queries.x[rows] @ data.x[found].T, ids[found])
                at = to


def exact_scores(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether inner products of these rows are exact in doubles."""
    if not a.size or not b.size:
        return True
    return float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < _EXACT


def _search_big(q: np.ndarray, x: np.ndarray, ids: np.ndarray, top: TopK) -> dict:
    """For components too large for doubles: whole numbers of any size, held to 64 bits in the result."""
    best = {}
    whole = x.astype(object)
    for n, row in enumerate(q.astype(object)):
        scored = sorted((-int(s), int(i)) for s, i in zip(whole @ row, ids, strict=True) if i != top.own[n])[: top.k]
        best[n] = [(max(-(1 << 63), min((1 << 63) - 1, -s)), i) for s, i in scored]
    return best


def _packing(size: int):
    """Packs rows (id, v) of one length into blocks of at most ``size``, each with its tree."""

    def packed(dim: int, rows: list) -> pd.DataFrame:
        ids = np.array([r[0] for r in rows], np.int64)
        x = np.array([r[1] for r in rows], np.int64).reshape(len(rows), dim)
        tree = CoverTree(x.astype(float)).packed() if exact_scores(x, x) else None
        return pd.DataFrame({"dim": [dim], "ids": [ids.tobytes()], "x": [x.tobytes()], "tree": [tree]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for f in frames:
            for i, v in zip(f["id"], f["v"], strict=True):
                rows = held.setdefault(len(v), [])
                rows.append((i, v))
                if len(rows) == size:
                    yield packed(len(v), held.pop(len(v)))
        for dim, rows in held.items():
            yield packed(dim, rows)

    return run


def _unpack(dim: int, ids: bytes, x: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(x, np.int64).reshape(len(i), dim)


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v): whole-number vectors floor(scale * x). Rows without an id and vectors that
    are null or hold null or non-finite components take no part."""
    v = F.col(vector_col)
    good = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).alias("v"))


def top_k_products(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every`` the k
    rows of highest inner product, all rows but those with the query's id.

    Exact. Ties go to the smaller id. Vectors meet only vectors of their own length; a
    query that meets no other row has no result. Rows repeated under one id are each a
    candidate of their own, and their queries share one list. An empty table gives an
    empty result. Scores beyond 64 bits are held to the largest 64-bit number.
    """
    spark = vectors.sparkSession
    tables = Tables(spark)
    whole = quantised(vectors, id_col, vector_col, scale)
    queries = whole.where(F.col("id") % every == 0)
    n = queries.count()
    chunks, made = max(1, math.ceil(n / CHUNK)), "dim int, ids binary, x binary, tree binary"
    # The seed: rows of the first blocks' heads, a bounded number.
    seed = whole.limit(SEED_ROWS).toPandas() if n else pd.DataFrame({"id": [], "v": []})
    shared = spark.sparkContext.broadcast(seed)

    def floors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for dim, i, x in f[["dim", "ids", "x"]].itertuples(index=False):
                ids, rows = _unpack(dim, i, x)
                out.append(_floor(ids, rows, shared.value[shared.value["v"].map(len) == dim], dim, k).tobytes())
            yield f.assign(floor=out)

    own = queries.repartition(chunks, "id").mapInPandas(_packing(CHUNK), made).mapInPandas(floors, made + ", floor binary")
    met = tables.keep(own.withColumn("i", F.monotonically_increasing_id()))
    blocks = tables.keep(whole.mapInPandas(_packing(BLOCK), made)) if n else met.select("dim", "ids", "x", "tree")
    shared.destroy()
    n_blocks = blocks.count()
    groups = max(1, min(n_blocks, max(math.ceil(n_blocks / CELL_BLOCKS), 2 * spark.sparkContext.defaultParallelism)))
    dealt = blocks.withColumn("j", F.pmod(F.xxhash64("ids", "x"), F.lit(groups)))
    if met.count() <= ROOTS:
        roots = spark.sparkContext.broadcast(met.mapInPandas(_roots, "i long, dim int, centre binary, radius double, norm double, floor double").toPandas())
        right = dealt.mapInPandas(_meeting(roots), made + ", j long, i long")
    else:
        right = dealt.join(met.select("i", "dim"), "dim")
    left = met.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>")))
    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(_searching(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _roots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each chunk the root's centre, its covering radius and norm, and the least kth score promised."""
    for f in frames:
        rows = []
        for r in f.itertuples(index=False):
            ids, x = _unpack(r.dim, r.ids, r.x)
            if r.tree is None:  # met by all blocks
                rows.append((r.i, r.dim, b"", np.inf, 0.0, -np.inf))
            else:
                t = CoverTree.unpacked(r.tree, x)
                rows.append((r.i, r.dim, x[t.centre[0]].astype(float).tobytes(), t.radius[0], t.norm[0], np.frombuffer(r.floor).min()))
        yield pd.DataFrame(rows, columns=["i", "dim", "centre", "radius", "norm", "floor"])


def _meeting(roots):
    """Every block once for each chunk of its length that its root's bound allows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(len(f)):
                block = f.iloc[at : at + 1]
                dim, tree = block["dim"].iloc[0], block["tree"].iloc[0]
                own = roots.value[roots.value["dim"] == dim]
                if tree is not None and len(own):
                    _, x = _unpack(dim, block["ids"].iloc[0], block["x"].iloc[0])
                    t = CoverTree.unpacked(tree, x)
                    r, b = x[t.centre[0]].astype(float), t.radius[0]
                    dots = np.array([np.frombuffer(c) @ r if c else 0.0 for c in own["centre"]])
                    most = dots + own["radius"] * t.norm[0] + b * own["norm"] + own["radius"] * b
                    own = own[~(most + 1e-9 * np.abs(most) + 1e-6 < own["floor"])]
                for i in own["i"]:
                    yield block.assign(i=i)

    return run


def _searching(k: int):
    """The best k of a cell for each of its queries, as far as they can be among the best of all."""

    def run(chunk: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64),) * 3]
        for c in chunk.itertuples(index=False):
            qids, qx = _unpack(c.dim, c.ids, c.x)
            floor = np.frombuffer(c.floor)
            top, tree = TopK(qids, k, floor), None
            for b in blocks.itertuples(index=False):
                ids, rows = _unpack(b.dim, b.ids, b.x)
                if c.tree is not None and b.tree is not None and exact_scores(qx, rows):
                    tree = tree or CoverTree.unpacked(c.tree, qx.astype(float))
                    dual_search(tree, CoverTree.unpacked(b.tree, rows.astype(float)), ids, top)
                else:
                    best = [(qids[q], i, s) for q, found in _search_big(qx, rows, ids, top).items() for s, i in found]
                    out += [tuple(np.array(v, np.int64) for v in zip(*best, strict=True))] if best else []
            q, col = np.nonzero((top.score >= floor[:, None]) & ~np.isneginf(top.score))
            out.append((qids[q], top.id[q, col], top.score[q, col].astype(np.int64)))
        return pd.DataFrame({name: np.concatenate([o[at] for o in out]) for at, name in enumerate(("query_id", "vec_id", "score"))})

    return run


def _floor(ids: np.ndarray, x: np.ndarray, seed: pd.DataFrame, dim: int, k: int) -> np.ndarray:
    """For each query the kth best score over the seed rows, which its true kth can't be below."""
    floor = np.full(len(ids), -np.inf)
    if len(seed) <= k:
        return floor
    rows, own = np.array(seed["v"].tolist(), np.int64).reshape(len(seed), dim), seed["id"].to_numpy(np.int64)
    if not exact_scores(x, rows):
        return floor
    for at in range(0, len(ids), 1024):
        s = x[at : at + 1024].astype(float) @ rows.T.astype(float)
        s[ids[at : at + 1024, None] == own[None, :]] = -np.inf
        floor[at : at + 1024] = -np.partition(-s, k - 1, axis=1)[:, k - 1]
    return floor


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id,
         CAST(list_sum([z[1] * z[2] for z in list_zip(q.e, r.e)]) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id AND len(q.e) = len(r.e)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
