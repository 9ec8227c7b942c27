"""Files: node and edge tables, result documents, sparse blocks, selections."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_SCHEMA = "OBJECTID INT, fclass DOUBLE, Shape_Length DOUBLE"


@dataclass
class Config:
    """Settings of a run."""

    noise: list[float] = field(default_factory=lambda: [0.0])
    alphas: list[float] = field(default_factory=lambda: [0.85])
    max_iterations: int = 100
    tolerance: float = 1e-9
    ratios: list[float] = field(default_factory=lambda: [0.2, 0.4, 0.6])
    damping: str = "state"


def read_config(spark: SparkSession, path: str) -> Config:
    """Settings from a nested JSON document; keys that are absent keep their defaults."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one small document
    d = json.loads(text).get("roadselect", {})
    out, walk = Config(), d.get("applyu", {})
    out.noise = [float(x) for x in d.get("global", {}).get("noise", out.noise)]
    out.alphas = [float(x) for x in walk.get("alpha_s", out.alphas)]
    out.max_iterations = int(walk.get("max_iterations", out.max_iterations))
    out.tolerance = float(walk.get("tolerance", out.tolerance))
    out.ratios = [float(x) for x in d.get("resultprocess", {}).get("zoomratio", out.ratios)]
    return out


def read_nodes(spark: SparkSession, path: str, schema: str = NODE_SCHEMA) -> DataFrame:
    """A node table with a header; numbers that can't be read are 0.0, ids whole."""
    fields = [x.split() for x in schema.split(",")]
    raw = spark.read.option("header", True).option("encoding", "UTF-8").schema(", ".join(f"{n} STRING" for n, _ in fields)).csv(path)
    cast = lambda n, t: F.trim(n).cast("int").alias(n) if t == "INT" else F.coalesce(F.trim(n).try_cast("double"), F.lit(0.0)).alias(n)
    return raw.select(*[cast(n, t) for n, t in fields])


def read_edges(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(src, dst) from the second and third fields of a near table. A line that isn't blank and
    holds no two numbers there is an error, but for the first line of a file with a header."""
    parts = F.split(F.trim("value"), ",")
    lines = spark.read.text(path).where(F.trim("value") != "")
    pair = lines.select("value", F.trim(F.get(parts, F.lit(1))).try_cast("int").alias("src"), F.trim(F.get(parts, F.lit(2))).try_cast("int").alias("dst"))
    bad = F.col("src").isNull() | F.col("dst").isNull()
    # A header has no numbers at all in these fields.
    titles = F.lit(header) & F.col("src").isNull() & F.col("dst").isNull() & (F.size(F.split("value", ",")) > 2)
    said = F.raise_error(F.concat(F.lit("not an edge: "), F.col("value")))
    return pair.where(~(bad & titles)).select(F.when(bad, said.cast("int")).otherwise(F.col("src")).alias("src"), F.when(bad, said.cast("int")).otherwise(F.col("dst")).alias("dst"))


def write_csv(df: DataFrame, path: str, delimiter: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", delimiter).csv(path)


def write_results(results: DataFrame, path: str) -> None:
    """Rankings (method, alpha, noise, id, value, position), a part for each setting; writing a
    setting again replaces it alone."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method", "alpha", "noise").parquet(path)


def result_documents(results: DataFrame) -> DataFrame:
    """(alpha, noise, sortindex, value): ids in order and values by id, as text lists. A list is
    one cell, as the document format has it, so this is for rankings of a document's size."""
    by = F.sort_array(F.collect_list(F.struct("position", "id")))
    values = F.sort_array(F.collect_list(F.struct("id", "value")))
    return results.groupBy("alpha", "noise").agg(F.to_json(F.transform(by, lambda x: x["id"])).alias("sortindex"), F.to_json(F.transform(values, lambda x: x["value"])).alias("value"))


def write_document(results: DataFrame, path: str) -> None:
    """The rankings (alpha, noise, id, value, position) as one JSON document
    alpha -> noise -> {sortindex, value}, as ``read_ranking`` takes it."""
    docs = result_documents(results.select(*(F.col(c).cast("string").alias(c) for c in ("alpha", "noise")), "id", "value", "position"))
    inner = docs.groupBy("alpha").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("noise", F.struct("sortindex", "value"))))).alias("of"))
    # One document: a list for each setting.
    texts = inner.select("alpha", F.to_json("of").alias("of")).groupBy().agg(F.concat(F.lit("{"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("alpha", "of"))), lambda x: F.concat(F.lit('"'), x["alpha"], F.lit('": '), x["of"])), ", "), F.lit("}")).alias("value"))
    texts.coalesce(1).write.mode("overwrite").text(path)


def read_ranking(spark: SparkSession, path: str) -> DataFrame:
    """(alpha, noise, id, position) of a ranking document alpha -> noise -> {sortindex, value}."""
    text = spark.read.text(path, wholetext=True)
    inner = F.from_json("value", "map<string,map<string,struct<sortindex:string,value:string>>>")
    a = text.select(F.explode(inner).alias("alpha", "rest")).select("alpha", F.explode("rest").alias("noise", "doc"))
    ids = F.from_json(F.col("doc.sortindex"), "array<int>")
    return a.select("alpha", "noise", F.posexplode(ids).alias("at", "id")).select("alpha", "noise", "id", (F.col("at") + 1).alias("position"))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """(noise, id, position) of a ranking document noise -> {sorted}."""
    text = spark.read.text(path, wholetext=True)
    docs = text.select(F.explode(F.from_json("value", "map<string,struct<sorted:string>>")).alias("noise", "doc"))
    return docs.select("noise", F.posexplode(F.from_json(F.col("doc.sorted"), "array<int>")).alias("at", "id")).select("noise", "id", (F.col("at") + 1).alias("position"))


def write_blocks(matrix: DataFrame, path: str, size: int) -> None:
    """A sparse matrix, a folder for each block."""
    from arterial.operators.coo import blocked

    blocked(matrix, size).write.mode("overwrite").partitionBy("block_row", "block_col").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("row", "col", "val")


def read_block(spark: SparkSession, path: str, row: int, col: int) -> DataFrame:
    """The cells of one block; only its folder is read."""
    return spark.read.parquet(path).where((F.col("block_row") == row) & (F.col("block_col") == col)).select("row", "col", "val")


def write_selection(selected: DataFrame, path: str) -> None:
    """Selected roads (method, ratio, alpha, noise, ...), a part for each setting."""
    selected.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method", "ratio", "alpha", "noise").parquet(path)
