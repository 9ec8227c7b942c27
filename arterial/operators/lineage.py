"""Source-data preparation: merge, clip, drop, export of layers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arterial.functions import geometry as G


def merge_layers(layers: Sequence[DataFrame]) -> DataFrame:
    """All rows of all layers; fields are matched by name, missing ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), layers)


def drop_fields(layer: DataFrame, fields: Sequence[str]) -> DataFrame:
    return layer.drop(*fields)


def drop_fourth(layer: DataFrame) -> DataFrame:
    """The layer without its fourth column, as near tables are exported."""
    return layer.drop(layer.columns[3]) if len(layer.columns) > 3 else layer


def export_fields(layer: DataFrame, names: dict[str, str]) -> DataFrame:
    """The named fields under their new names."""
    return layer.select(*[F.col(a).alias(b) for a, b in names.items()])


def update_schema(layer: DataFrame, types: dict[str, str], defaults: dict[str, object] | None = None) -> DataFrame:
    """The layer with the named fields in new types, values that can't be read being null; a field
    that it lacks is added with its default, or null."""
    defaults = defaults or {}
    made = {c: (F.col(c).try_cast(t) if c in layer.columns else F.lit(defaults.get(c)).cast(t)) for c, t in types.items()}
    return layer.withColumns(made)


def attribute_table(layer: DataFrame, geometry: Sequence[str] = ("points", "parts", "geometry")) -> DataFrame:
    """All fields but the geometry, as text; null becomes ''."""
    return layer.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in layer.columns if c not in geometry])


def checked_lines(layer: DataFrame) -> DataFrame:
    """The layer; raises where a line has fewer than two points."""
    bad = F.col("points").isNull() | (F.size("points") < 2)
    return layer.withColumn("points", F.when(bad, F.raise_error(F.lit("not a line: fewer than two points"))).otherwise(F.col("points")))


def with_length_km(layer: DataFrame, name: str = "length") -> DataFrame:
    return layer.withColumn(name, G.great_circle_length("points"))


def clip_lines(layer: DataFrame, polygon: Sequence[tuple[float, float]]) -> DataFrame:
    """(fid, part, points): the parts of lines inside a simple polygon.

    Each segment is cut at the polygon's edges and pieces whose middle is inside are
    chained; lines that miss the polygon's bounds never reach Python."""
    xs, ys = [p[0] for p in polygon], [p[1] for p in polygon]
    px, py = F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"])
    near = layer.where((F.array_max(px) >= min(xs)) & (F.array_min(px) <= max(xs)) & (F.array_max(py) >= min(ys)) & (F.array_min(py) <= max(ys)))
    ring = list(zip(polygon, [*polygon[1:], polygon[0]], strict=True))

    def inside(x: float, y: float) -> bool:
        hit = False
        for (ax, ay), (bx, by) in ring:
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                hit = not hit
        return hit

    def cuts(ax: float, ay: float, bx: float, by: float) -> list[float]:
        at = {0.0, 1.0}
        for (cx, cy), (dx, dy) in ring:
            ux, uy, vx, vy = bx - ax, by - ay, dx - cx, dy - cy
            cross = ux * vy - uy * vx
            if cross:
                t = ((cx - ax) * vy - (cy - ay) * vx) / cross
                s = ((cx - ax) * uy - (cy - ay) * ux) / cross
                if 0 < t < 1 and 0 <= s <= 1:
                    at.add(t)
        return sorted(at)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for fid, pts in zip(f["fid"], f["points"], strict=True):
                parts: list[list[dict]] = []
                open_ = False
                for a, b in zip(pts, pts[1:], strict=False):
                    t = cuts(a["x"], a["y"], b["x"], b["y"])
                    for t0, t1 in zip(t, t[1:], strict=False):
                        at = lambda k, a=a, b=b: {"x": a["x"] + k * (b["x"] - a["x"]), "y": a["y"] + k * (b["y"] - a["y"])}
                        middle = at((t0 + t1) / 2)
                        if inside(middle["x"], middle["y"]):
                            parts = parts if open_ else [*parts, [at(t0)]]
                            parts[-1].append(at(t1))
                            open_ = True
                        else:
                            open_ = False
                rows += [(fid, k, p) for k, p in enumerate(parts)]
            yield pd.DataFrame(rows, columns=["fid", "part", "points"])

    return near.select("fid", "points").mapInPandas(run, f"fid {dict(layer.dtypes)['fid']}, part int, points array<struct<x:double,y:double>>")
