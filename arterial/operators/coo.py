"""Sparse matrices as (row, col, val) tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product; cells are the sums over the shared index."""
    right = b.select(F.col("row").alias("k"), F.col("col").alias("to"), F.col("val").alias("y"))
    return a.withColumnRenamed("col", "k").join(right, "k").groupBy("row", F.col("to").alias("col")).agg(F.sum(F.col("val") * F.col("y")).alias("val"))


def matvec(a: DataFrame, x: DataFrame) -> DataFrame:
    """(row, val): the matrix times a vector (row, val)."""
    v = x.select(F.col("row").alias("col"), F.col("val").alias("x"))
    return a.join(v, "col").groupBy("row").agg(F.sum(F.col("val") * F.col("x")).alias("val"))


def scale(a: DataFrame, s: float) -> DataFrame:
    return a.withColumn("val", F.col("val") * F.lit(float(s)))


def scale_complex(a: DataFrame, re: float, im: float) -> DataFrame:
    """(row, col, re, im): a real matrix times a complex number."""
    return a.select("row", "col", (F.col("val") * F.lit(float(re))).alias("re"), (F.col("val") * F.lit(float(im))).alias("im"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum of two matrices, absent cells being 0."""
    return a.select("row", "col", "val").unionByName(b.select("row", "col", "val")).groupBy("row", "col").agg(F.sum("val").alias("val"))


def minus_identity(a: DataFrame, s: float, n: DataFrame) -> DataFrame:
    """a - s I, the diagonal being that of ``n`` (row)."""
    return add(a, n.select("row", F.col("row").alias("col"), F.lit(-float(s)).alias("val")))


def half_reflection(a: DataFrame, theta: float, n: DataFrame) -> DataFrame:
    """(row, col, re, im) of cos(t/2) I - i sin(t/2) A with t = theta * pi, for A with A A = I."""
    import math

    t = theta * math.pi / 2
    diagonal = n.select("row", F.col("row").alias("col"), F.lit(math.cos(t)).alias("re"), F.lit(0.0).alias("im"))
    rest = a.select("row", "col", F.lit(0.0).alias("re"), (F.col("val") * F.lit(-math.sin(t))).alias("im"))
    return diagonal.unionByName(rest).groupBy("row", "col").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def blocked(a: DataFrame, size: int) -> DataFrame:
    """Cells with their block (block_row, block_col), for partitioned storage."""
    return a.withColumn("block_row", F.floor(F.col("row") / size)).withColumn("block_col", F.floor(F.col("col") / size))


def block_count(matrix: DataFrame, size: int) -> int:
    """Blocks that hold a cell."""
    return blocked(matrix, size).select("block_row", "block_col").distinct().count()


#: Cells up to which a dense array is made on the driver.
DENSE_CELLS = 25_000_000


def to_dense(matrix: DataFrame, rows: int, cols: int) -> np.ndarray:
    """The matrix (row, col, val) as an array; cells that are given twice add up, cells outside are an error."""
    if rows * cols > DENSE_CELLS:
        raise ValueError(f"{rows} by {cols} is too large for an array")
    got = matrix.groupBy("row", "col").agg(F.sum("val").alias("val")).toPandas()
    out = np.zeros((rows, cols))
    out[got["row"].to_numpy(), got["col"].to_numpy()] = got["val"].to_numpy(float)
    return out
