"""Dual graph, similarity weights, transition table, derived graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arterial.functions import scalar as S


def shared_key_edges(members: DataFrame, node: str, key: str) -> DataFrame:
    """(src, dst): distinct pairs of nodes that share a key, in both directions, no self pairs."""
    m = members.select(F.col(key).alias("k"), F.col(node).alias("n")).where("k IS NOT NULL AND n IS NOT NULL").distinct()
    return m.withColumnRenamed("n", "src").join(m.withColumnRenamed("n", "dst"), "k").where("src <> dst").select("src", "dst").distinct()


def vertex_edges(roads: DataFrame, id_col: str = "fid", points: str = "points") -> DataFrame:
    """Dual graph of polylines: (src, dst) with src < dst where two roads share any vertex."""
    v = roads.select(F.col(id_col).alias("n"), F.explode(points).alias("p")).distinct()
    return v.withColumnRenamed("n", "src").join(v.withColumnRenamed("n", "dst"), "p").where("src < dst").select("src", "dst").distinct()


def similarity(nodes: DataFrame, features: Sequence[str] = ("length",), noise: float = 0.0, seed: int = 7) -> DataFrame:
    """(id, sim): 1 minus the distance to the best corner of the scaled features, over the
    largest distance; 1 for all when all distances are 0.

    A feature that the nodes don't have counts 0. ``noise``: a normal deviate for each node
    (ids are whole numbers then), shared by its features; scaled values are moved up when one
    falls below 0. Extremes are one-row aggregates, joined back."""
    cols = [(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in nodes.columns else F.lit(0.0)).alias(f) for f in features]
    x = nodes.select("id", *cols)
    ends = x.agg(*[F.min(f).alias(f"{f}_lo") for f in features], *[F.max(f).alias(f"{f}_hi") for f in features])
    x = x.crossJoin(F.broadcast(ends))  # one row
    scaled = [F.when(F.col(f"{f}_hi") == F.col(f"{f}_lo"), 0.0).otherwise((F.col(f) - F.col(f"{f}_lo")) / (F.col(f"{f}_hi") - F.col(f"{f}_lo"))).alias(f) for f in features]
    x = x.select("id", *scaled)
    if noise:
        deviate = S.normal(seed, F.col("id")) * F.lit(float(noise))
        x = x.select("id", *[(F.col(f) + deviate).alias(f) for f in features])
        low = x.agg(*[F.least(F.min(f), F.lit(0.0)).alias(f"{f}_low") for f in features])
        x = x.crossJoin(F.broadcast(low)).select("id", *[(F.col(f) - F.col(f"{f}_low")).alias(f) for f in features])
    best = x.agg(*[F.max(f).alias(f"{f}_best") for f in features])
    gap = sum((F.pow(F.col(f) - F.col(f"{f}_best"), F.lit(2.0)) for f in features), F.lit(0.0))
    d = x.crossJoin(F.broadcast(best)).select("id", F.sqrt(gap).alias("d"))
    worst = d.agg(F.max("d").alias("worst"))
    return d.crossJoin(F.broadcast(worst)).select("id", F.when(F.col("worst") == 0, 1.0).otherwise(1 - F.col("d") / F.col("worst")).alias("sim"))


def transition(edges: DataFrame, sim: DataFrame) -> DataFrame:
    """(src, dst, p): p = sim(dst) over the sum of sim over the targets of src; 0 for a zero sum.

    Edges are made distinct; a target without similarity raises. The sum is aggregated and
    joined, not a window, so a hub's edges needn't meet in one task."""
    e = edges.select("src", "dst").distinct().join(sim.select(F.col("id").alias("dst"), "sim"), "dst", "left")
    e = e.withColumn("sim", F.when(F.col("sim").isNull(), F.raise_error(F.concat(F.lit("no similarity for node "), F.col("dst").cast("string")))).otherwise(F.col("sim")))
    out = e.groupBy("src").agg(F.sum("sim").alias("out"))
    return e.join(out, "src").select("src", "dst", F.when(F.col("out") == 0, 0.0).otherwise(F.col("sim") / F.col("out")).alias("p"))


def sum_normalised(nodes: DataFrame, value: str) -> DataFrame:
    """(id, value): each value over the sum of all; 0 for all where the sum is 0."""
    total = nodes.agg(F.sum(F.col(value).cast("double")).alias("total"))
    share = F.when(F.abs("total") <= 1e-15, 0.0).otherwise(F.col(value).cast("double") / F.col("total"))
    return nodes.crossJoin(F.broadcast(total)).select("id", share.alias("value"))  # one row


#: Nodes up to which a dense matrix is made.
DENSE_NODES = 5_000


def damped(p: DataFrame, nodes: DataFrame, alpha: float = 0.85, value: str = "p") -> DataFrame:
    """(src, dst, ``value``): alpha times the value plus (1 - alpha) / n, for every pair of nodes (id).

    A dense matrix by its nature, so only for up to ``DENSE_NODES`` nodes; ``rank.pagerank`` and
    ``rank.quantum_pagerank`` damp without one."""
    ids = nodes.select("id").distinct()
    n = ids.count()
    if n > DENSE_NODES:
        raise ValueError(f"{n} nodes make too large a dense matrix")
    cells = ids.select(F.col("id").alias("src")).crossJoin(F.broadcast(ids.select(F.col("id").alias("dst"))))
    return cells.join(p, ["src", "dst"], "left").select("src", "dst", (alpha * F.coalesce(value, F.lit(0.0)) + (1 - alpha) / max(n, 1)).alias(value))


def adjacency(p: DataFrame) -> DataFrame:
    """(src, dst, a): 1 where p is not 0."""
    return p.where("p <> 0").select("src", "dst", F.lit(1.0).alias("a"))


def column_normalised(a: DataFrame) -> DataFrame:
    """(src, dst, v): each value over the sum of its column."""
    total = a.groupBy("dst").agg(F.sum("a").alias("t"))
    return a.join(total, "dst").select("src", "dst", (F.col("a") / F.col("t")).alias("v"))


def weighted_digraph(p: DataFrame, sim: DataFrame) -> DataFrame:
    """(s, t, w): edges turned round, weighted p * sim(dst), where p is not 0."""
    return p.where("p <> 0").join(sim.select(F.col("id").alias("dst"), "sim"), "dst").select(F.col("dst").alias("s"), F.col("src").alias("t"), (F.col("p") * F.col("sim")).alias("w"))


def induced_subgraph(edges: DataFrame, nodes: DataFrame, chosen: DataFrame, features: Sequence[str] = ("length",), compat: bool = False) -> DataFrame:
    """Weighted digraph of the chosen nodes (id), normalised anew on them.

    Weights are p * sim(dst) as in the whole graph; ``compat`` weighs by p alone."""
    ids = chosen.select("id").distinct()
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    sim = similarity(nodes.join(ids, "id", "left_semi"), features)
    p = transition(inside, sim)
    if compat:
        return p.where("p <> 0").select(F.col("dst").alias("s"), F.col("src").alias("t"), F.col("p").alias("w"))
    return weighted_digraph(p, sim)
