"""Loops over DataFrames: cutting lineage and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _folder(spark: SparkSession) -> str:
    """The checkpoint folder, which the driver and all executors share."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="arterial-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df computed once, its lineage cut by a checkpoint in the folder that the session names in
    spark.checkpoint.dir; a temporary one where none is set and all runs in one process, as in
    tests. A cluster without the setting is an error, as its machines share no such folder."""
    _folder(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """df computed once, its lineage cut by a compressed table in the folder of ``cut``. Shuffle files
    of the computation go as soon as it is done, where those of a checkpoint wait for a collection."""
    spark = df.sparkSession
    path, was = f"{_folder(spark)}/kept-{uuid.uuid4().hex}", spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if was is None:
            spark.conf.unset(CLEAN_SHUFFLES)
        else:
            spark.conf.set(CLEAN_SHUFFLES, was)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of ``nodes`` (id) under undirected ``edges`` (src, dst); the smallest id names it.

    Every round takes the smallest label among neighbours and follows labels once, so the
    rounds grow with the logarithm of the longest chain."""
    both = cut(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = cut(nodes.select("id", F.col("id").alias("component")).distinct())
    while True:
        near = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy("src").agg(F.min("component").alias("near"))
        step = labels.join(near.withColumnRenamed("src", "id"), "id", "left").select("id", "component", F.least("component", F.coalesce("near", "component")).alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("component").alias("jump"))
        step = cut(step.join(jump, "new", "left").select("id", "component", F.least("new", F.coalesce("jump", "new")).alias("next")))
        labels = step.select("id", F.col("next").alias("component"))
        if not step.where("next < component").head(1):
            return labels
