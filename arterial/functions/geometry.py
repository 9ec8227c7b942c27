"""Geometry as column expressions on arrays of points (struct<x double, y double>)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RADIUS = 6378137.0


def points_of(flat: str) -> Column:
    """An array x0, y0, x1, y1, ... as points."""
    pair = lambda k: F.struct(F.element_at(flat, (2 * k + 1).cast("int")).cast("double").alias("x"), F.element_at(flat, (2 * k + 2).cast("int")).cast("double").alias("y"))
    last = (F.size(flat) / 2).cast("int") - 1
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), pair)).otherwise(F.array().cast("array<struct<x:double,y:double>>"))


def segments_of(points: str | Column) -> Column:
    """Consecutive pairs: array of struct<ax, ay, bx, by>."""
    p = F.col(points) if isinstance(points, str) else points
    make = lambda k: F.struct(p[k]["x"].alias("ax"), p[k]["y"].alias("ay"), p[k + 1]["x"].alias("bx"), p[k + 1]["y"].alias("by"))
    empty = F.array().cast("array<struct<ax:double,ay:double,bx:double,by:double>>")
    return F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(0), F.size(p) - 2), make)).otherwise(empty)


def line_length(points: str) -> Column:
    """Planar length; 0 for fewer than two points."""
    step = lambda s: F.sqrt((s["bx"] - s["ax"]) * (s["bx"] - s["ax"]) + (s["by"] - s["ay"]) * (s["by"] - s["ay"]))
    return F.aggregate(segments_of(points), F.lit(0.0), lambda t, s: t + step(s))


def direction(dx: Column, dy: Column) -> Column:
    """Direction in degrees, from 0 to below 180."""
    return F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0))


def vertex_directions(points: str) -> Column:
    """For each vertex the direction to the next one; for the last, of the step to it."""
    p = F.col(points)
    n = F.size(p)
    at = lambda k: F.least(k, n - 2)
    one = lambda k: direction(p[at(k) + 1]["x"] - p[at(k)]["x"], p[at(k) + 1]["y"] - p[at(k)]["y"])
    return F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<double>"))


def direction_gap(a: Column, b: Column) -> Column:
    """Difference of two directions, from 0 to 90."""
    d = F.abs(a - b)
    return F.least(d, 180.0 - d)


def total_bounds(vertices: DataFrame) -> DataFrame:
    """One row minx, miny, maxx, maxy of (x, y)."""
    return vertices.agg(F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"))


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:3857 of degrees."""
    return F.radians(lon) * RADIUS, RADIUS * F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180.0) / 6.0) + 1).cast("int")


def utm(lon: Column, lat: Column, zone: Column | None = None, south: Column | None = None) -> tuple[Column, Column]:
    """Easting and northing on WGS 84 by the Krueger series to the third order; the zone and
    the half of the globe are each point's own unless given."""
    south = lat < 0 if south is None else south
    zone = utm_zone(lon) if zone is None else zone
    f = 1 / 298.257223563
    n = f / (2 - f)
    a_bar = RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for k, c in enumerate(alpha, 1):
        east = east + c * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        north = north + c * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return 500000.0 + 0.9996 * a_bar * east, F.when(south, 10000000.0).otherwise(0.0) + 0.9996 * a_bar * north


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Haversine distance in metres (an approximation of the geodesic one, within 0.6 %)."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return 2 * 6371008.8 * F.asin(F.sqrt(h))


def great_circle_length(points: str) -> Column:
    """Length in km of a line in degrees."""
    return F.aggregate(segments_of(points), F.lit(0.0), lambda t, s: t + great_circle(s["ax"], s["ay"], s["bx"], s["by"]) / 1000.0)


def point_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point to a segment."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / square)))
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def clipped_span(ax: Column, ay: Column, bx: Column, by: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """Where a segment enters and leaves a closed rectangle, as shares of its length; it misses
    the rectangle where it leaves before it enters."""

    def span(a: Column, b: Column, low: Column, high: Column) -> tuple[Column, Column]:
        d = b - a
        inside = (a >= low) & (a <= high)
        enter = F.when(d == 0, F.when(inside, 0.0).otherwise(2.0)).otherwise(F.least((low - a) / d, (high - a) / d))
        leave = F.when(d == 0, F.when(inside, 1.0).otherwise(-1.0)).otherwise(F.greatest((low - a) / d, (high - a) / d))
        return enter, leave

    (ex, lx), (ey, ly) = span(ax, bx, x1, x2), span(ay, by, y1, y2)
    return F.greatest(F.lit(0.0), ex, ey), F.least(F.lit(1.0), lx, ly)


def with_crossed_cells(segments: DataFrame, cell: float | Column, reach: float = 0.0) -> DataFrame:
    """``segments`` (ax, ay, bx, by, ...), a row for each cell (cx, cy) of a square grid in which
    a point within ``reach`` of the segment may lie.

    Column by column, only the cells beside the segment's course there: their number follows
    its length, not the area of its bounds."""
    cell = F.lit(float(cell)) if isinstance(cell, (int, float)) else cell
    low, high = F.least("ax", "bx") - reach, F.greatest("ax", "bx") + reach
    out = segments.withColumn("cx", F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell))))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    at = lambda x, end: F.when(dx == 0, end).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - F.col("ax")) / dx)))
    one = F.col("ay") + at(F.col("cx") * cell - reach, 0.0) * dy
    two = F.col("ay") + at((F.col("cx") + 1) * cell + reach, 1.0) * dy
    slack = reach + cell * 1e-9  # roundings
    return out.withColumn("cy", F.explode(F.sequence(F.floor((F.least(one, two) - slack) / cell), F.floor((F.greatest(one, two) + slack) / cell))))


def contact_type(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """How line a (from a0 to a1) touches b: 1 start-end, 2 start-start, 3 end-start, 4 end-end, else 0."""
    return F.when(a0 == b1, 1).when(a0 == b0, 2).when(a1 == b0, 3).when(a1 == b1, 4).otherwise(0)


def corner_angle(node: Column, a: Column, b: Column) -> Column:
    """Whole degrees between the rays from a node to two points, rounded half to even; null
    when a point is the node."""
    ax, ay, bx, by = a["x"] - node["x"], a["y"] - node["y"], b["x"] - node["x"], b["y"] - node["y"]
    size = F.sqrt((ax * ax + ay * ay) * (bx * bx + by * by))
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / size))
    return F.when(size > 0, F.bround(F.degrees(F.acos(cos)), 0).cast("int"))


def contact_angle(a: Column, b: Column, kind: Column) -> Column:
    """Angle between two point arrays at their contact of the given type."""
    first, second, last, before = (lambda p: p[0]), (lambda p: p[1]), (lambda p: F.element_at(p, -1)), (lambda p: F.element_at(p, -2))
    return (
        F.when(kind == 1, corner_angle(first(a), second(a), before(b)))
        .when(kind == 2, corner_angle(first(a), second(a), second(b)))
        .when(kind == 3, corner_angle(last(a), before(a), second(b)))
        .when(kind == 4, corner_angle(last(a), before(a), before(b)))
    )


def joined_points(a: Column, b: Column, kind: Column) -> Column:
    """The points of a and b as one line at their contact, the shared point once."""
    n = F.size(a)
    without_first, without_last = F.slice(a, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(a, F.lit(1), F.greatest(n - 1, F.lit(0)))
    return (
        F.when(kind == 1, F.concat(b, without_first)).when(kind == 2, F.concat(F.reverse(b), without_first)).when(kind == 3, F.concat(without_last, b)).otherwise(F.concat(without_last, F.reverse(b)))
    )


def well_known_text(points: str) -> Column:
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(points, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")"))
