"""Capped water-filling: mix sources to target weights.

Native: DataFrame functions only. One pass over the texts counts words and
aggregates them by (source, slice), a slice being one of ``SLICES`` ranges of a
seeded hash of the document. Everything after that works on this small table:

* Water level: with total T, weights w and caps ``max_epochs * size``, the target
  of a source is ``min(cap, w * level)``. Clamping a source only raises the level,
  so the loop keeps one number: the level over the sources not yet clamped. It
  ends when a round clamps no further source.
* Repetitions: target / size = whole + fraction. Every document is taken ``whole``
  times; the fraction takes the slices in order until the words they hold reach
  it. The documents of the slice in which it is reached give the same share of
  their words each, so a source's words differ from its target by roundings in
  one slice only, without ordering the documents of a source. With ``whole`` the
  fraction is made of whole documents instead: the slice is cut again by further bits
  of the hash, and the documents of the last range, one in ``SLICES`` squared of the
  source, are taken in order of the hash as long as half of a document still fits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arterial.llm.common import WORD, Tables

#: Ranges of the document hash. A source's slices are one row each in the small table.
SLICES = 4096
#: Sources up to which their plan (a row each) is broadcast.
BROADCAST_SOURCES = 50_000


def word_count(text: str | Column) -> Column:
    """Number of words; 0 for a null text."""
    text = F.col(text) if isinstance(text, str) else text
    # One character for each word, then the blanks go: cheaper than an array of all words.
    marks = F.regexp_replace(F.regexp_replace(text, WORD, "\u0001"), r"[\x20\x09-\x0D]+", "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def source_weights(sources: DataFrame, weights: Sequence[float]) -> DataFrame:
    """``sources`` (one row for each source) with its weight: the given ones in turn by
    code point order of the name, null last."""
    # Ranges of names are counted, then numbered each by itself, as sources may be many.
    by_name = F.col("source").asc_nulls_last()
    ranged = Tables(sources.sparkSession).keep(sources.repartitionByRange(by_name).withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    # A row for each partition.
    before = sizes.select("__range", (F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__range")) - F.col("__n")).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("__range").orderBy(by_name)) - 1 + F.col("__before")
    at = F.pmod(nth, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at + 1).cast("int"))
    return ranged.join(F.broadcast(before), "__range").withColumn("weight", weight).drop("__range", "__before")


def water_level(sources: DataFrame, max_epochs: float) -> float:
    """The level for ``sources`` (source_size, weight): targets are min(cap, weight * level)
    and add up to the sum of all sizes. 0.0 without any words."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    total = sources.agg(F.sum("source_size").cast("double")).first()[0] or 0.0
    level, clamped = 0.0, -1
    while True:
        # In the first round nothing is clamped but sources without a word.
        held = cap <= F.col("weight") * F.lit(level)
        row = sources.agg(
            F.sum(F.when(held, cap).otherwise(0.0)).alias("full"),
            F.sum(F.when(held, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.sum(held.cast("long")).alias("n"),
        ).first()
        if not row["open"] or row["n"] == clamped:
            return level
        level, clamped = max(level, (total - row["full"]) / row["open"]), row["n"]


def mix_to_targets(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: float = 3, seed: int = 17, whole: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with size, source_size, target, epochs, and
    taken: the words of the document that the mix takes, repeats counted. With ``whole``
    it is a multiple of the size, and a source's words differ from its target by half a
    document or so; without, by roundings.

    Null texts and texts of blanks have size 0 and are taken 0 times. A null source is
    a source, the last in order. Equal rows get equal results. A source without words
    has target 0. An empty table gives an empty result. Texts of any length are counted
    whole. Columns of ``docs`` named as one of the results are replaced; others stay as
    they are.

    A run with the same seed takes the same words. Documents of one source are never
    brought together: a source that holds a third of all rows is as even as any other.
    """
    made = ("size", "source_size", "weight", "target", "epochs", "taken")
    placed = docs.drop(*made).withColumn("__at", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"), F.crc32("text")))
    placed = placed.withColumn("__slice", F.pmod("__at", F.lit(SLICES)).cast("int"))
    base = placed.withColumn("size", word_count("text"))
    slices = base.groupBy("source", "__slice").agg(F.sum("size").alias("words")).cache()
    sources = source_weights(slices.groupBy("source").agg(F.sum("words").alias("source_size")), weights).cache()
    level = water_level(sources, max_epochs)

    target = F.least(F.col("source_size") * F.lit(float(max_epochs)), F.col("weight") * F.lit(level))
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = sources.withColumn("target", target).withColumn("epochs", epochs).withColumn("__whole", F.floor("epochs"))
    # Few sources go to every task, so that a hot one isn't brought together; a join deals with many.
    few = sources.count() <= BROADCAST_SOURCES
    asked = plan.select(F.col("source").alias("__source"), (F.col("target") - F.col("__whole") * F.col("source_size")).alias("asked"))
    cut = _reached(slices.withColumnRenamed("__slice", "at"), asked).withColumnsRenamed({"__source": "__cut_source", "at": "__cut", "left": "__left", "words": "__cut_words"})
    if whole:
        cut = _whole_documents(placed, cut, few)
        fraction = F.when((F.col("__slice") < F.col("__cut")) | (F.col("__slice") == F.col("__cut")) & _upto("__edge", "__last"), F.col("size")).otherwise(0)
    else:
        share = F.round(F.col("size") * (F.col("__left") / F.col("__cut_words")))
        fraction = F.when(F.col("__slice") < F.col("__cut"), F.col("size")).when(F.col("__slice") == F.col("__cut"), share).otherwise(0)
    plan = plan.withColumnRenamed("source", "__plan_source").join(cut, F.col("__plan_source").eqNullSafe(F.col("__cut_source")), "left")
    joined = base.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("__plan_source")), "left")
    # Whole epochs leave nothing to a cut; at the cap the fraction is 0.
    taken = F.least(F.col("__whole") * F.col("size") + F.coalesce(fraction, F.lit(0)), F.col("size") * F.lit(max_epochs))
    out = joined.withColumn("taken", F.coalesce(taken, F.lit(0)).cast("long"))
    return out.drop("__plan_source", "__cut_source", "__slice", "__at", "__cut", "__left", "__cut_words", "__edge", "__last", "__whole", "weight")


def _reached(ranges: DataFrame, asked: DataFrame) -> DataFrame:
    """For each source of ``asked`` (__source, asked) the range (source, at, words) in which the
    words asked for are reached, taking ranges in order: (__source, at, words, left), the
    last being what is asked of the range. Sources whose words don't reach it have no row."""
    order = Window.partitionBy("source").orderBy("at")
    summed = ranges.withColumn("before", F.sum("words").over(order) - F.col("words"))
    both = summed.join(asked, F.col("source").eqNullSafe(F.col("__source")))
    hit = both.where((F.col("before") <= F.col("asked")) & (F.col("before") + F.col("words") > F.col("asked")))
    return hit.select("__source", "at", "words", (F.col("asked") - F.col("before")).alias("left"))


def _upto(edge: str, last: str) -> Column:
    """Whether a document of the cut slice lies before the last one taken."""
    within = F.pmod(F.shiftrightunsigned("__at", 12), F.lit(SLICES)).cast("int")
    return (within < F.col(edge)) | (within == F.col(edge)) & (F.col("__at") <= F.col(last))


def _whole_documents(placed: DataFrame, cut: DataFrame, few: bool) -> DataFrame:
    """``cut`` with __edge and __last: the range of further hash bits within the slice, and the
    hash of its last document, up to which documents make up what is asked of the slice."""
    slim = cut.select(F.col("__cut_source").alias("__source"), "__cut", F.col("__left").alias("asked"))
    inside = placed.select("source", "text", "__at", "__slice").join(F.broadcast(slim) if few else slim, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__slice") == F.col("__cut")))
    at = F.pmod(F.shiftrightunsigned("__at", 12), F.lit(SLICES)).cast("int")
    ranges = inside.select("source", "__at", at.alias("at"), word_count("text").alias("words")).groupBy("source", "at", "__at").agg(F.sum("words").alias("words")).cache()
    edge = _reached(ranges.groupBy("source", "at").agg(F.sum("words").alias("words")), slim.select("__source", "asked"))
    edge = edge.select(F.col("__source").alias("__edge_source"), F.col("at").alias("__edge"), F.col("left").alias("asked"))
    last = ranges.join(edge, F.col("source").eqNullSafe(F.col("__edge_source")) & (F.col("at") == F.col("__edge")))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("__at"))
    last = last.withColumn("upto", upto).where(F.col("upto") - F.col("words") / 2 <= F.col("asked"))
    last = last.groupBy("source", "__edge").agg(F.max("__at").alias("__last")).withColumnRenamed("source", "__last_source")
    ends = edge.drop("asked").join(last.drop("__edge"), F.col("__edge_source").eqNullSafe(F.col("__last_source")), "left").drop("__last_source")
    # Before the edge all are taken, in it none where not even the first fits.
    return cut.join(ends, F.col("__cut_source").eqNullSafe(F.col("__edge_source")), "left").drop("__edge_source")
