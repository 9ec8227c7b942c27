"""Weighted shortest paths and path efficiency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arterial.functions import scalar as S
from arterial.operators.iterate import cut


def shortest_paths(edges: DataFrame, sources: DataFrame | None = None, most_hops: int = 10_000) -> DataFrame:
    """(i, j, d): least weights from the sources (all nodes with an edge out, by default) along
    directed ``edges`` (s, t, w); (i, i) has distance 0.

    Frontier relaxation: only distances that a round has improved are extended in the next,
    until none is; more rounds than ``most_hops`` are an error. Work and rows follow sources
    times nodes, so give a bounded set of sources on a large network. Nodes may be structs."""
    e = cut(edges.groupBy("s", "t").agg(F.min("w").alias("w")))
    roots = (sources.select(F.col("id").alias("i")) if sources is not None else e.select(F.col("s").alias("i"))).distinct()
    known = cut(roots.select("i", F.col("i").alias("j"), F.lit(0).cast(e.schema["w"].dataType).alias("d")))
    frontier = known
    for _ in range(most_hops):
        reached = frontier.join(e, F.col("j") == F.col("s")).groupBy("i", F.col("t").alias("j")).agg(F.min(F.col("d") + F.col("w")).alias("d"))
        better = cut(reached.join(known.withColumnRenamed("d", "was"), ["i", "j"], "left").where("was IS NULL OR d < was").select("i", "j", "d"))
        if not better.head(1):
            return known
        known = cut(known.unionByName(better).groupBy("i", "j").agg(F.min("d").alias("d")))
        frontier = better
    raise RuntimeError(f"paths still get shorter after {most_hops} hops")


def pair_sample(pairs: DataFrame, most: int = 1000, seed: int = 11) -> DataFrame:
    """At most ``most`` pairs (i, j) of whole numbers, by a seeded number of each."""
    return pairs.select("i", "j").orderBy(S.uniform(seed, F.col("i"), F.col("j")), "i", "j").limit(most)


def path_efficiency(whole: DataFrame, part: DataFrame) -> DataFrame:
    """One row, efficiency: the mean of distance in the whole over distance in the part, over
    pairs with both above 0; infinity without such pairs. Tables are (i, j, d)."""
    both = whole.join(part.withColumnRenamed("d", "dp"), ["i", "j"]).where("d > 0 AND dp > 0")
    return both.agg(F.coalesce(F.avg(F.col("d") / F.col("dp")), F.lit(float("inf"))).alias("efficiency"))


def connectivity(whole: DataFrame, parts: DataFrame, settings: Sequence[str] = ("method", "alpha", "noise"), sources: int = 100, most: int = 1000, seed: int = 11) -> DataFrame:
    """(settings..., efficiency): path efficiency of every selection against the whole network.

    ``whole``: (s, t, w); ``parts``: (settings..., s, t, w), the networks of the selections.
    Paths start from ``sources`` seeded nodes, so that work follows the nodes, and every
    selection is judged by up to ``most`` pairs that it and the whole connect; infinity
    without such pairs. All settings are computed side by side."""
    nodes = whole.select(F.col("s").alias("id")).union(whole.select(F.col("t").alias("id"))).distinct()
    roots = cut(nodes.orderBy(S.uniform(seed + 1, F.col("id")), "id").limit(sources))
    far = shortest_paths(whole, roots)
    key = F.struct(*settings).alias("setting")
    at = lambda c: F.struct("setting", F.col(c).alias("node"))
    keyed = parts.select(key, "s", "t", "w")
    # One row for each setting.
    every = parts.select(key).distinct()
    inner = shortest_paths(keyed.select(at("s").alias("s"), at("t").alias("t"), "w"), every.crossJoin(F.broadcast(roots)).select(at("id").alias("id")))
    inner = inner.where("d > 0").select(F.col("i.setting").alias("setting"), F.col("i.node").alias("i"), F.col("j.node").alias("j"), F.col("d").alias("dp"))
    both = inner.join(far.where("d > 0"), ["i", "j"])
    order = Window.partitionBy("setting").orderBy(S.uniform(seed, F.col("i"), F.col("j")), "i", "j")
    ratios = both.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).groupBy("setting").agg(F.avg(F.col("d") / F.col("dp")).alias("efficiency"))
    return every.join(ratios, "setting", "left").select("setting.*", F.coalesce("efficiency", F.lit(float("inf"))).alias("efficiency"))
