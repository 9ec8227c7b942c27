"""GraphSAGE scoring: neighbour means as aggregations, dense products in Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arterial.functions import scalar as S


@dataclass
class SageLayer:
    """Weights of one layer, and its batch norm (weight, bias, mean, variance) if it has one."""

    own: np.ndarray
    neighbour: np.ndarray
    bias: np.ndarray
    norm: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = None
    relu: bool = True


@dataclass
class SageModel:
    layers: list[SageLayer] = field(default_factory=list)


def neighbour_mean(x: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, mean): mean of the features of the sources of edges into id. ``x``: (id, x array).

    Messages go from src to dst only; give both directions for an undirected graph."""
    sent = edges.select("src", "dst").join(x.withColumnRenamed("id", "src"), "src")
    mean = Summarizer.mean(array_to_vector(F.col("x")))
    return sent.groupBy(F.col("dst").alias("id")).agg(vector_to_array(mean).alias("mean"))


def sage_layer(x: DataFrame, edges: DataFrame, layer: SageLayer) -> DataFrame:
    """(id, x) after a layer: own and mean features times their weights; without neighbours the mean is 0."""
    joined = x.join(neighbour_mean(x, edges), "id", "left")

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width = layer.neighbour.shape[0]
        for f in frames:
            if not len(f):
                continue
            own = np.stack([np.asarray(v, float) for v in f["x"]])
            mean = np.stack([np.zeros(width) if m is None else np.asarray(m, float) for m in f["mean"]])
            y = own @ layer.own + mean @ layer.neighbour + layer.bias
            if layer.norm is not None:
                w, b, m, v = layer.norm
                y = (y - m) / np.sqrt(v + 1e-5) * w + b
            if layer.relu:
                y = np.maximum(y, 0)
            yield pd.DataFrame({"id": f["id"], "x": list(y)})

    return joined.mapInPandas(apply, f"id {dict(x.dtypes)['id']}, x array<double>")


def sage_scores(x: DataFrame, edges: DataFrame, model: SageModel) -> DataFrame:
    """(id, score): probability of class 1, the softmax of the last layer's two outputs."""
    for layer in model.layers:
        x = sage_layer(x, edges, layer)
    a, b = F.col("x")[0], F.col("x")[1]
    return x.select("id", (1 / (1 + F.exp(a - b))).alias("score"))


def road_scores(parts: DataFrame) -> DataFrame:
    """(fid, score): the highest score of a road's parts (fid, score)."""
    return parts.groupBy("fid").agg(F.max("score").alias("score"))


def feature_noise(x: DataFrame, noise: float, seed: int = 7) -> DataFrame:
    """Features times 1 + noise * a normal deviate, seeded by id and place, so reruns agree."""
    return x.withColumn("x", F.transform("x", lambda v, k: v * (1 + noise * S.normal(seed, F.col("id"), k))))


def compounded_noise(x: DataFrame, levels: Sequence[float], seed: int = 7) -> list[DataFrame]:
    """The features under each noise level in turn, each level on top of those before it."""
    out = []
    for k, noise in enumerate(levels):
        x = feature_noise(x, noise, seed + k)
        out.append(x)
    return out


def save_model(spark: SparkSession, model: SageModel, path: str) -> None:
    """The layers of a model as one JSON document."""
    dense = lambda a: None if a is None else np.asarray(a).tolist()
    layers = [{"own": dense(x.own), "neighbour": dense(x.neighbour), "bias": dense(x.bias), "norm": None if x.norm is None else [dense(v) for v in x.norm], "relu": x.relu} for x in model.layers]
    spark.createDataFrame([(json.dumps(layers),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str) -> SageModel:
    (text,) = (r[0] for r in spark.read.text(path, wholetext=True).collect())  # one small document
    return SageModel([SageLayer(np.array(x["own"]), np.array(x["neighbour"]), np.array(x["bias"]), x["norm"] and tuple(map(np.array, x["norm"])), x["relu"]) for x in json.loads(text)])


def split_masks(nodes: DataFrame, train: float = 0.7, val: float = 0.15, prime: int = 2654435761) -> DataFrame:
    """(id, part): train, val or test by exact counts in the order of a multiplicative hash of the id.

    Ranks come from counts of 256 hash ranges and places inside them, not from one sorted task."""
    h = F.pmod(F.pmod(F.col("id"), F.lit(1 << 31)) * F.lit(prime), F.lit(1 << 32))
    rows = nodes.select("id", h.alias("h")).withColumn("r", F.shiftright("h", 24))
    sizes = rows.groupBy("r").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("r", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("r")) - F.col("n")).alias("start"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"))
    at = F.row_number().over(Window.partitionBy("r").orderBy("h", "id")) - 1
    ranked = rows.withColumn("at", at).join(F.broadcast(starts), "r").withColumn("rank", F.col("start") + F.col("at"))  # 256 rows
    first, second = F.floor(F.col("total") * train), F.floor(F.col("total") * (train + val))
    return ranked.select("id", F.when(F.col("rank") < first, "train").when(F.col("rank") < second, "val").otherwise("test").alias("part"))


def propagated(x: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """(id, x): own features, and the means one and more hops away, side by side."""
    out, level = x, x
    for k in range(hops):
        level = level.select("id").join(neighbour_mean(level, edges), "id", "left").join(x.select("id", F.transform("x", lambda v: v * 0).alias("zero")), "id").select("id", F.coalesce("mean", "zero").alias("x"))
        out = out.join(level.withColumnRenamed("x", f"x{k}"), "id").select("id", F.concat("x", f"x{k}").alias("x"))
    return out


def train_propagated(x: DataFrame, edges: DataFrame, labels: DataFrame, hops: int = 2, rounds: int = 100):
    """A logistic model on propagated features of labelled nodes (id, label): the linear stand-in
    for training a SAGE network. Returns the fitted model and the features it takes."""
    from pyspark.ml.classification import LogisticRegression

    features = propagated(x, edges, hops).select("id", array_to_vector("x").alias("features"))
    fitted = LogisticRegression(maxIter=rounds, standardization=True).fit(features.join(labels.select("id", F.col("label").cast("double").alias("label")), "id"))
    return fitted, features


def evaluate(fitted, features: DataFrame, labels: DataFrame) -> DataFrame:
    """One row, accuracy of a fitted model on labelled nodes."""
    seen = fitted.transform(features).join(labels.select("id", F.col("label").cast("double").alias("label")), "id")
    return seen.agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))


def training_schedule(losses: Sequence[float], patience: int = 50, stop: int = 100, factor: float = 0.5, rate: float = 1e-3) -> tuple[list[float], int]:
    """Learning rates by epoch under a plateau rule, and the epoch at which training stops early."""
    best, since, rates, wait = float("inf"), 0, [], 0
    for epoch, loss in enumerate(losses):
        if loss < best:
            best, since, wait = loss, 0, 0
        else:
            since, wait = since + 1, wait + 1
        if wait > patience:
            rate, wait = rate * factor, 0
        rates.append(rate)
        if since >= stop:
            return rates, epoch
    return rates, len(losses) - 1
