"""Coordinate systems of layers: what a .prj file says, and projection to metres."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arterial.functions import geometry as G

GEOGRAPHIC, PROJECTED = "geographic", "projected"


def crs_of(text: str | None) -> str:
    """Whether well-known text describes degrees or metres; without text it is an error."""
    head = (text or "").lstrip("\ufeff \t\r\n").upper()
    if head.startswith(("GEOGCS", "GEOGCRS", "GEODCRS")):
        return GEOGRAPHIC
    if head.startswith(("PROJCS", "PROJCRS")):
        return PROJECTED
    raise ValueError("the layer has no coordinate system" if not head else f"unknown coordinate system {head[:40]}")


def read_prj(spark: SparkSession, path: str) -> DataFrame:
    """(layer, name, kind) of the .prj files under a path; kind is null where it isn't known."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.prj").text(path)
    head = F.upper(F.regexp_replace("value", r"^[\uFEFF\s]+", ""))
    kind = F.when(head.rlike("^(GEOGCS|GEOGCRS|GEODCRS)"), GEOGRAPHIC).when(head.rlike("^(PROJCS|PROJCRS)"), PROJECTED)
    name = F.regexp_extract("value", r'\[\s*"([^"]*)"', 1)
    return files.select(F.regexp_replace(F.input_file_name(), r"\.prj$", "").alias("layer"), name.alias("name"), kind.alias("kind"))


def _moved(column: str, project) -> Column:
    """Points, or parts of points, each projected."""
    point = lambda p: F.struct(*(v.alias(n) for v, n in zip(project(p["x"], p["y"]), "xy", strict=True)))
    return F.transform(column, lambda x: F.transform(x, point)) if column == "parts" else F.transform(column, point)


def ensure_crs(roads: DataFrame, column: str = "points", crs: str | None = None) -> DataFrame:
    """Roads in metres: degrees (also where no system is known) are projected to web mercator."""
    return roads if crs == PROJECTED else roads.withColumn(column, _moved(column, G.web_mercator))


def utm_of(minx: float, miny: float, maxx: float, maxy: float) -> tuple[int, bool]:
    """Zone, and whether it is the southern half, of the middle of bounds in degrees."""
    return math.floor(((minx + maxx) / 2 + 180) / 6) + 1, (miny + maxy) / 2 < 0


def to_utm(roads: DataFrame, zone: int, south: bool, column: str = "points") -> DataFrame:
    """Roads in degrees projected to one UTM zone."""
    return roads.withColumn(column, _moved(column, lambda x, y: G.utm(x, y, F.lit(zone), F.lit(south))))
