"""Selection of the top share of a network by cumulative length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arterial.operators.iterate import cut

#: Rows of a range that running totals are computed in, about.
ONE_RANGE_ROWS = 100_000


def running(rows: DataFrame, amount: str, ids_descend: bool = True) -> DataFrame:
    """``rows`` (id, value, ...) with upto: the sum of ``amount`` in order of value, descending, and
    id, this row included.

    Large tables are dealt to ranges of value and id, as many as their rows ask for, so that
    equal values need not meet in one task: totals of the ranges are summed in order, and only a
    range is ordered by a window."""
    order = (F.desc("value"), F.desc("id") if ids_descend else F.asc("id"))
    n = rows.count()
    if n <= ONE_RANGE_ROWS:
        return rows.withColumn("upto", F.sum(amount).over(Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    placed = cut(rows.repartitionByRange(max(2, -(-n // ONE_RANGE_ROWS)), *order).withColumn("__range", F.spark_partition_id()))
    totals = placed.groupBy("__range").agg(F.sum(amount).alias("__t"))
    before = totals.withColumn("__before", F.coalesce(F.sum("__t").over(Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__t")
    inner = F.sum(amount).over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    # A row for each 100,000 is broadcast.
    return placed.withColumn("__in", inner).join(F.broadcast(before), "__range").withColumn("upto", F.col("__before") + F.col("__in")).drop("__range", "__in", "__before")


def select_by_length(ranking: DataFrame, lengths: DataFrame, ratios: Sequence[float] = (0.2, 0.4, 0.6)) -> DataFrame:
    """(ratio, id, length): rows in order of rank until their length reaches the ratio of the
    total; the row that reaches it is taken too.

    ``ranking``: (id, value); ``lengths``: (id, length), a null length counts 0."""
    sized = lengths.select("id", F.coalesce(F.col("length").cast("double"), F.lit(0.0)).alias("length"))
    total = sized.agg(F.sum("length").alias("total"))
    summed = running(ranking.select("id", "value").join(sized, "id"), "length")
    wanted = F.explode(F.array(*[F.lit(float(r)) for r in ratios])).alias("ratio")
    rows = summed.crossJoin(F.broadcast(total)).select("id", "length", "upto", "total", wanted)
    return rows.where(F.col("upto") - F.col("length") < F.col("ratio") * F.col("total")).select("ratio", "id", "length")
