"""Tables of a data folder, read as the engine's own shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arterial.functions import geometry as G


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def part_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as roads: id, length (retail price), fclass (size)."""
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("length"), F.col("p_size").cast("double").alias("fclass"))


def vector_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as polylines: fid, label, points."""
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("fid"), "label", G.points_of("embedding").alias("points"))
