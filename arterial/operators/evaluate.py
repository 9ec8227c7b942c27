"""Evaluation of a selection: coverage, grid density, retain rate, regression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arterial.functions import geometry as G
from arterial.functions.crs import GEOGRAPHIC, ensure_crs, to_utm, utm_of
from arterial.operators.iterate import cut


def parts_of(roads: DataFrame, parts: str = "parts") -> DataFrame:
    """Lines of multipart roads with orig_id and a part number; roads (fid, parts, ...)."""
    return roads.withColumnRenamed("fid", "orig_id").select("*", F.posexplode(parts).alias("part", "points")).drop(parts)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with fid, counting from 0 in the given order.

    Ranges of the order are counted, then numbered each by itself."""
    ranged = cut(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    # A row for each partition.
    before = sizes.select("__range", (F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__range")) - F.col("__n")).alias("__before"))
    at = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return ranged.withColumn("__at", at).join(F.broadcast(before), "__range").withColumn("fid", F.col("__before") + F.col("__at")).drop("__range", "__at", "__before")


def single_lines(roads: DataFrame) -> DataFrame:
    """Roads of one part (parts); null and empty geometries are none."""
    return roads.where(F.size("parts") == 1)


def chosen_multiparts(roads: DataFrame, ids: DataFrame, multipart_only: bool = False) -> DataFrame:
    """Roads (fid, parts) whose fid is among ``ids`` (id). ``multipart_only`` leaves out those of one part."""
    kept = roads.where(F.size("parts") > 1) if multipart_only else roads
    return kept.join(ids.select(F.col("id").alias("fid")).distinct(), "fid", "left_semi")


def matched_roads(roads: DataFrame, reference: DataFrame, reach: float = 100.0, tolerance: float = 30.0) -> DataFrame:
    """Distinct fid of ``roads`` (fid, points) with a vertex nearer than ``reach`` to a line of
    ``reference`` (points) whose direction there differs by ``tolerance`` degrees at most.

    Reference segments are dealt to the grid cells along their course, widened by ``reach``; a
    vertex is looked up in its own cell alone, and done with at its first hit."""
    cell = 4 * reach
    vertex = roads.where(F.size("points") > 1).select("fid", F.explode(F.arrays_zip(F.col("points").alias("p"), G.vertex_directions("points").alias("d"))).alias("v"))
    vertex = vertex.select("fid", F.col("v.p.x").alias("x"), F.col("v.p.y").alias("y"), F.col("v.d").alias("d")).distinct()
    vertex = vertex.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    s = reference.select(F.explode(G.segments_of("points")).alias("s")).select("s.*").distinct()
    s = s.withColumn("along", G.direction(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))
    s = G.with_crossed_cells(s, cell, reach).withColumnsRenamed({"cx": "sx", "cy": "sy"})
    near = G.point_segment(*(F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by"))) < reach
    along = G.direction_gap(F.col("d"), F.col("along")) <= tolerance
    met = (F.col("cx") == F.col("sx")) & (F.col("cy") == F.col("sy")) & along & near
    return vertex.join(s, met, "left_semi").select("fid").distinct()


def road_match(roads: DataFrame, reference: DataFrame, road_crs: str | None = None, reference_crs: str | None = None, reach: float = 100.0, tolerance: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """(fid of matched roads, one row total_length, matched_length, coverage) of multipart roads
    (fid, parts) against reference roads (fid, parts).

    Degrees are projected to metres, parts become lines, and reference lines whose bounds
    miss those of the roads, widened by ``reach``, are left out."""
    lines, other = (parts_of(ensure_crs(x, "parts", c)).select(F.col("orig_id").alias("fid"), "points") for x, c in ((roads, road_crs), (reference, reference_crs)))
    bounds = G.total_bounds(lines.select(F.explode("points").alias("p")).select("p.x", "p.y"))
    matched = matched_roads(lines, in_bounds(other, bounds, reach), reach, tolerance)
    return matched, coverage(lines, matched)


def density_report(roads: DataFrame, part: DataFrame, crs: str | None = None, rows: int = 10, cols: int = 10) -> DataFrame:
    """One row of density metrics of a selection (points) against all roads (points), on a grid
    over the bounds of all roads; degrees are projected to the UTM zone of their middle.

    Layers without roads give a row of counts alone."""
    if crs is None or crs == GEOGRAPHIC:
        middle = G.total_bounds(roads.select(F.explode("points").alias("p")).select("p.x", "p.y")).first()  # one row
        if middle["minx"] is not None:
            zone, south = utm_of(middle["minx"], middle["miny"], middle["maxx"], middle["maxy"])
            roads, part = to_utm(roads, zone, south), to_utm(part, zone, south)
    bounds = G.total_bounds(roads.select(F.explode("points").alias("p")).select("p.x", "p.y"))
    return density_metrics(density_pairs(grid_density(roads, bounds, rows, cols), grid_density(part, bounds, rows, cols)))


def coverage(roads: DataFrame, matched: DataFrame) -> DataFrame:
    """One row total_length, matched_length, coverage (percent; 0 without length)."""
    sized = roads.select("fid", G.line_length("points").alias("length")).join(matched.select("fid", F.lit(1).alias("hit")), "fid", "left")
    got = sized.agg(F.coalesce(F.sum("length"), F.lit(0.0)).alias("total_length"), F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("length"))), F.lit(0.0)).alias("matched_length"))
    share = F.when(F.col("total_length") == 0, 0.0).otherwise(100 * F.col("matched_length") / F.col("total_length"))
    return got.select("total_length", "matched_length", share.alias("coverage"))


def in_bounds(roads: DataFrame, bounds: DataFrame, reach: float) -> DataFrame:
    """Roads (points) whose bounds meet the one-row ``bounds`` widened by ``reach``."""
    xs, ys = F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"])
    b = bounds.select(*[F.col(c).alias(f"__{c}") for c in ("minx", "miny", "maxx", "maxy")])
    meets = (F.array_max(xs) >= F.col("__minx") - reach) & (F.array_min(xs) <= F.col("__maxx") + reach) & (F.array_max(ys) >= F.col("__miny") - reach) & (F.array_min(ys) <= F.col("__maxy") + reach)
    return roads.crossJoin(F.broadcast(b)).where(meets).drop("__minx", "__miny", "__maxx", "__maxy")


def grid(bounds: DataFrame, rows: int = 10, cols: int = 10) -> DataFrame:
    """(grid_id 'i-j', gi, gj, x1, y1, x2, y2, area) of the one-row bounds."""
    cells = bounds.select("*", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("gi")).select("*", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("gj"))
    dx, dy = (F.col("maxx") - F.col("minx")) / cols, (F.col("maxy") - F.col("miny")) / rows
    cells = cells.withColumn("x1", F.col("minx") + F.col("gj") * dx).withColumn("y1", F.col("miny") + F.col("gi") * dy)
    cells = cells.withColumn("x2", F.col("minx") + (F.col("gj") + 1) * dx).withColumn("y2", F.col("miny") + (F.col("gi") + 1) * dy)
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return cells.select(F.concat_ws("-", "gi", "gj").alias("grid_id"), "gi", "gj", "x1", "y1", "x2", "y2", area.alias("area"))


def grid_polygons(cells: DataFrame) -> DataFrame:
    """(grid_id, area, wkt): the cells of a grid as polygons, for a table that other tools read."""
    at = lambda x, y: F.concat_ws(" ", F.col(x).cast("string"), F.col(y).cast("string"))
    ring = F.concat_ws(", ", at("x1", "y1"), at("x2", "y1"), at("x2", "y2"), at("x1", "y2"), at("x1", "y1"))
    return cells.select("grid_id", "area", F.concat(F.lit("POLYGON (("), ring, F.lit("))")).alias("wkt"))


def grid_density(roads: DataFrame, bounds: DataFrame, rows: int = 10, cols: int = 10) -> DataFrame:
    """(grid_id, road_length, density) for every cell; roads (points).

    Lines are united: where segments of one straight line overlap, whole or in part, the
    overlap counts once (lines are alike up to the ninth digit of course and offset)."""
    s = roads.select(F.explode(G.segments_of("points")).alias("s")).select("s.*")
    # A segment and its reverse are one: the smaller end comes first.
    one, two = F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))
    s = s.select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b")).distinct()
    s = s.select(F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))
    s = s.crossJoin(F.broadcast(bounds))
    dx, dy = (F.col("maxx") - F.col("minx")) / cols, (F.col("maxy") - F.col("miny")) / rows
    # One cell more on either side than the bounds touch, for lines along an edge.
    at = lambda v, least, step, n, more: F.greatest(F.lit(0), F.least(F.lit(n - 1), (F.floor((v - F.col(least)) / step) + more).cast("int")))
    s = s.withColumn("gj", F.explode(F.sequence(at(F.least("ax", "bx"), "minx", dx, cols, -1), at(F.greatest("ax", "bx"), "minx", dx, cols, 1))))
    s = s.withColumn("gi", F.explode(F.sequence(at(F.least("ay", "by"), "miny", dy, rows, -1), at(F.greatest("ay", "by"), "miny", dy, rows, 1))))
    cells = grid(bounds, rows, cols)
    inside = s.join(F.broadcast(cells), ["gi", "gj"])  # rows * cols cells
    enter, leave = G.clipped_span(*(F.col(c) for c in ("ax", "ay", "bx", "by", "x1", "y1", "x2", "y2")))
    dx_, dy_ = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    inside = inside.select("grid_id", "ax", "ay", "bx", "by", enter.alias("enter"), leave.alias("leave"), F.sqrt(dx_ * dx_ + dy_ * dy_).alias("len")).where("leave > enter")
    # A straight line by its course and its distance from the origin, places along it.
    ux, uy = dx_ / F.col("len"), dy_ / F.col("len")
    line = [(F.round(c, 9) + 0.0).alias(n) for c, n in ((ux, "ux"), (uy, "uy"), (F.col("ax") * uy - F.col("ay") * ux, "off"))]
    start = F.col("ax") * ux + F.col("ay") * uy
    pieces = inside.select("grid_id", *line, (start + F.col("enter") * F.col("len")).alias("p"), (start + F.col("leave") * F.col("len")).alias("q"), ((F.col("leave") - F.col("enter")) * F.col("len")).alias("own"))
    upto = F.max("q").over(Window.partitionBy("grid_id", "ux", "uy", "off").orderBy("p", "q").rowsBetween(Window.unboundedPreceding, -1))
    new = pieces.withColumn("upto", upto).withColumn("new", F.when(F.col("upto").isNull() | (F.col("upto") <= F.col("p")), F.col("own")).otherwise(F.greatest(F.lit(0.0), F.col("q") - F.col("upto"))))
    sums = new.groupBy("grid_id").agg(F.sum("new").alias("road_length"))
    out = cells.join(sums, "grid_id", "left").withColumn("road_length", F.coalesce("road_length", F.lit(0.0)))
    return out.select("grid_id", "area", "road_length", F.when(F.col("area") == 0, 0.0).otherwise(F.col("road_length") / F.col("area")).alias("density"))


def retain_rate(orig: Column, sub: Column) -> Column:
    """Share of a cell's density that is kept; an empty cell keeps all if it stays empty, else nothing."""
    return F.when(orig < 1e-10, F.when(sub < 1e-10, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sub / orig)))


def density_pairs(orig: DataFrame, sub: DataFrame) -> DataFrame:
    """(grid_id, orig_density, sub_density, retain)."""
    both = orig.select("grid_id", F.col("density").alias("orig_density")).join(sub.select("grid_id", F.col("density").alias("sub_density")), "grid_id", "left").fillna(0.0, ["sub_density"])
    return both.withColumn("retain", retain_rate(F.col("orig_density"), F.col("sub_density")))


def density_metrics(pairs: DataFrame) -> DataFrame:
    """One row over cells with density: counts, mean and deviation of the retain rate, r and r squared."""
    valid = F.col("orig_density") > 1e-10
    got = pairs.agg(
        F.count(F.lit(1)).alias("cells"), F.count(F.when(valid, 1)).alias("valid_cells"), F.avg(F.when(valid, F.col("retain"))).alias("mean_retain"),
        F.coalesce(F.stddev_samp(F.when(valid, F.col("retain"))), F.lit(0.0)).alias("std_retain"), F.corr(F.when(valid, F.col("orig_density")), F.when(valid, F.col("sub_density"))).alias("pearson"),
    )
    return got.withColumn("r2", F.col("pearson") * F.col("pearson"))


def power_fit(points: DataFrame) -> DataFrame:
    """One row a, b, r2_log, r2 of r = a * s ** -b by least squares of logarithms; points (s, r) above 0."""
    logs = points.where("s > 0 AND r > 0").select("s", "r", F.ln("s").alias("x"), F.ln("r").alias("y"))
    fit = logs.agg(F.regr_slope("y", "x").alias("k"), F.regr_intercept("y", "x").alias("c"), F.regr_r2("y", "x").alias("r2_log"), F.avg("r").alias("m"))
    fit = fit.select(F.exp("c").alias("a"), (-F.col("k")).alias("b"), "r2_log", "m")
    predicted = F.col("a") * F.pow("s", -F.col("b"))
    square = lambda c: F.pow(c, F.lit(2.0))
    out = logs.crossJoin(F.broadcast(fit)).groupBy("a", "b", "r2_log").agg((1 - F.sum(square(F.col("r") - predicted)) / F.sum(square(F.col("r") - F.col("m")))).alias("r2"))
    return out
