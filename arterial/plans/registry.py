"""Registered queries: the operators applied to whole tables.

Floating results are rounded where the order of a sum may show in the last digits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arterial.functions import geometry as G
from arterial.functions import scalar as S
from arterial.operators import circuit, coo, evaluate, graph, lineage, paths, rank, sage, select, stroke
from arterial.plans.oracles import DEMO, ORACLES, POLYGON
from arterial.sources.tables import part_nodes, table, vector_lines

__all__ = ["ORACLES", "QUERIES", "flagship"]

#: Edge length that stands for the 100 m buffer on vector lines.
REACH = 0.005


def _edges(spark, d):
    return graph.shared_key_edges(table(spark, d, "lineitem"), "l_partkey", "l_orderkey")


def _sim(spark, d):
    return graph.similarity(part_nodes(spark, d))


def _p(spark, d):
    return graph.transition(_edges(spark, d), _sim(spark, d))


def _start(spark, d):
    return _sim(spark, d).withColumnRenamed("sim", "value")


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Parts ranked by three PageRank steps over shared orders, the top 40 % of the length kept."""
    values, _ = rank.pagerank(_p(spark, d), _start(spark, d), 0.85, 3)
    return select.select_by_length(_rounded(values, value=9), part_nodes(spark, d), [0.4]).orderBy("id")


def _quantised(spark, d, digits):
    near = lambda p: F.struct((F.round(p["x"], digits) + 0.0).alias("x"), (F.round(p["y"], digits) + 0.0).alias("y"))
    return vector_lines(spark, d).withColumn("points", F.transform("points", near))


def _ends_quantised(spark, d):
    """Lines whose two ends lie on coordinates of two digits."""
    near = lambda p: F.struct((F.round(p["x"], 2) + 0.0).alias("x"), (F.round(p["y"], 2) + 0.0).alias("y"))
    n = F.size("points")
    return vector_lines(spark, d).withColumn("points", F.transform("points", lambda p, k: F.when((k == 0) | (k == n - 1), near(p)).otherwise(p)))


def _placed(spark, d):
    """Lines laid out side by side on a square lattice, as the roads of a town are."""
    at = lambda k: F.struct((k["x"] + 0.3 * (F.col("fid") % 150)).alias("x"), (k["y"] + 0.3 * F.floor(F.col("fid") / 150)).alias("y"))
    return vector_lines(spark, d).withColumn("points", F.transform("points", at))


def _vertices(spark, d):
    return vector_lines(spark, d).select("fid", "label", F.posexplode("points").alias("at", "p")).select("fid", "label", "at", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def _bounds(spark, d):
    return G.total_bounds(_vertices(spark, d))


def _densities(spark, d):
    lines, bounds = vector_lines(spark, d), _bounds(spark, d)
    return evaluate.density_pairs(evaluate.grid_density(lines, bounds), evaluate.grid_density(lines.where("label < 5"), bounds))


def _matched(spark, d):
    lines = vector_lines(spark, d)
    return evaluate.matched_roads(lines.where("label < 5"), lines.where("label >= 5"), REACH, 30.0)


def _trade(spark, d):
    """Directed weighted graph of nations: customers' nations to suppliers' nations."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    customer, supplier = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    joined = line.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).join(customer, F.col("c_custkey") == F.col("o_custkey")).join(supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    return joined.groupBy(F.col("c_nationkey").alias("s"), F.col("s_nationkey").alias("t")).agg((1 + F.sum("q") % 97).cast("long").alias("w"))


def _inside(spark, d):
    """Weighted graph of the nations of three regions."""
    keep = table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("id"))
    return _trade(spark, d).join(keep.withColumnRenamed("id", "s"), "s", "left_semi").join(keep.withColumnRenamed("id", "t"), "t", "left_semi")


def _a(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("row"), F.col("l_linenumber").cast("long").alias("col")).agg(F.sum("l_quantity").alias("val"))


def _b(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("row"), F.ascii("l_returnflag").cast("long").alias("col")).agg(F.sum("l_tax").alias("val"))


def _square(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("row"), (1 + F.col("l_quantity").cast("long") % 7).alias("col")).agg(F.count(F.lit(1)).cast("double").alias("val"))


def _cells(df: DataFrame, **digits: int) -> DataFrame:
    return _rounded(df.withColumnRenamed("row", "row_"), **digits)


def _fclass(spark, d):
    names = {"STANDARD": "motorway", "SMALL": "trunk", "MEDIUM": "primary", "LARGE": "secondary", "ECONOMY": "tertiary", "PROMO": "residential"}
    first = F.split("p_type", " ")[0]
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), first), F.lit("path"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), kind.alias("fclass"))


def reclass_fclass(spark, d):
    return _fclass(spark, d).select("id", S.reclass("fclass").alias("level8"), S.reclass("fclass", S.LINK_LEVELS).alias("level_link"))


def merge_layers(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return lineage.merge_layers([a, b])


def explode_parts(spark, d):
    parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size("points") / 8).cast("int") - 1), lambda k: F.slice("points", k * 8 + 1, F.lit(8)))
    roads = vector_lines(spark, d).select("fid", parts.alias("parts"))
    return evaluate.parts_of(roads).select("orig_id", "part", F.size("points").alias("points"))


def _parts(spark, d):
    """Lines as roads of parts of eight points."""
    parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size("points") / 8).cast("int") - 1), lambda k: F.slice("points", k * 8 + 1, F.lit(8)))
    return vector_lines(spark, d).select("fid", "label", parts.alias("parts"))


def road_match(spark, d):
    """Coverage of one half of the lines by the other, from degrees to metres."""
    roads = _parts(spark, d)
    stats = evaluate.road_match(roads.where("label < 5").drop("label"), roads.where("label >= 5").drop("label"), reach=500.0)[1]
    return _rounded(stats, total_length=1, matched_length=1, coverage=4)


def density_report(spark, d):
    lines = vector_lines(spark, d)
    return _rounded(evaluate.density_report(lines, lines.where("label < 5")), mean_retain=4, std_retain=4, pearson=4, r2=4)


def connectivity(spark, d):
    """Path efficiency of the trade of some regions against all trade."""
    trade, parts = _trade(spark, d), None
    for n in (3, 4):
        keep = table(spark, d, "nation").where(f"n_regionkey < {n}").select(F.col("n_nationkey").alias("id"))
        one = trade.join(keep.withColumnRenamed("id", "s"), "s", "left_semi").join(keep.withColumnRenamed("id", "t"), "t", "left_semi").select(F.lit(f"regions{n}").alias("method"), "s", "t", "w")
        parts = one if parts is None else parts.unionByName(one)
    return _rounded(paths.connectivity(trade, parts, ["method"]), efficiency=6)


def sampled_pairs(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("i"))
    return paths.pair_sample(n.crossJoin(F.broadcast(n.withColumnRenamed("i", "j"))), 100)  # 25 nations


def damped_transition(spark, d):
    trade = _trade(spark, d)
    p = trade.join(trade.groupBy("s").agg(F.sum("w").alias("o")), "s").select(F.col("s").alias("src"), F.col("t").alias("dst"), (F.col("w") / F.col("o")).alias("p"))
    return _rounded(graph.damped(p, table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))), p=9)


def qwalk_metrics(spark, d):
    pairs = rank.walk_pairs(_p(spark, d))
    return _rounded(rank.nodes_metrics(pairs, rank.walk_nodes(pairs, 2)), delta_mean=6, angle_mean=4, mean_abs=9, delta=6, angle=4)


def score_ranking(spark, d):
    scores = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.round(F.col("embedding")[0].cast("double"), 2).alias("value"))
    return rank.ranked(scores, ids_descend=False).select("id", "position")


def scalar_forms(spark, d):
    n = F.col("o_orderkey") % 4
    tiles = F.size(S.tiled(F.array(F.lit(1), F.lit(2), F.lit(3)), n.cast("int")))
    whole = S.is_close(F.col("o_totalprice"), F.round("o_totalprice"), rtol=1e-6)
    return table(spark, d, "orders").select("o_orderkey", whole.alias("whole"), S.binary_text(F.col("o_orderkey") % 64, 6).alias("bits"), tiles.alias("tiles"))


def _features(spark, d):
    return part_nodes(spark, d).select("id", F.array(F.col("length"), F.col("fclass")).alias("x"))


def sage_mean_layer(spark, d):
    mean = part_nodes(spark, d).select("id").join(sage.neighbour_mean(_features(spark, d), _edges(spark, d)), "id", "left")
    at = lambda k, n: F.round(F.coalesce(F.col("mean")[k], F.lit(0.0)), n)
    return mean.select("id", at(0, 9).alias("mean_length"), at(1, 9).alias("mean_fclass"))


def sage_layer(spark, d):
    x = part_nodes(spark, d).select("id", F.array(F.col("length") / 1000, F.col("fclass") / 50).alias("x"))
    layer = sage.SageLayer(np.array([[0.5, -0.2], [-0.25, 0.4]]), np.array([[0.1, 0.6], [0.3, -0.1]]), np.array([0.0314159265358979, -0.0271828182845905]))
    out = sage.sage_layer(x, _edges(spark, d), layer)
    return out.select("id", F.round(F.col("x")[0], 6).alias("h0"), F.round(F.col("x")[1], 6).alias("h1"))


def sage_noise(spark, d):
    return sage.feature_noise(_features(spark, d), 0.1).select("id", F.round(F.col("x")[0], 4).alias("length"))


def measure_marginal(spark, d):
    """Current node of the prepared state: uniform, whatever the transition matrix."""
    gates, n = circuit.initial_state(DEMO, 0.85)
    state = circuit.state_table(spark, gates, 1 + 2 * n)
    return _rounded(circuit.marginal(state, [1, 2]), prob=9)


def circuit_averages(spark, d):
    """Running averages of the walk circuit's current node over three lengths."""
    shots = None
    for k in (1, 2, 3):
        gates, qubits = circuit.walk_circuit(DEMO, 0.85, k)
        one = circuit.marginal(circuit.state_table(spark, gates, qubits), [1, 2]).withColumn("step", F.lit(k))
        shots = one if shots is None else shots.unionByName(one)
    return _rounded(circuit.running_average(shots), average=9, delta=9)


def select_ratios(spark, d):
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.round("o_totalprice").alias("length"))
    return select.select_by_length(s.select("id", F.col("length").alias("value")), s)


def topk_ranking(spark, d):
    values, _ = rank.pagerank(_p(spark, d), _start(spark, d), 0.85, 1)
    return rank.ranked(_rounded(values, value=9)).select("id", "position")


def qwalk_change(spark, d):
    _, one, two = rank.walk_nodes(rank.walk_pairs(_p(spark, d)), 2)
    return _rounded(rank.nodes_change(two, one), delta=6, angle=4)


def power_fit(spark, d):
    points = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"), F.count(F.lit(1)).cast("double").alias("r"))
    return _rounded(evaluate.power_fit(points), a=6, b=6, r2_log=6, r2=6)


QUERIES = {
    "dual_graph_edges": _edges,
    "vertex_dual_graph": lambda s, d: graph.vertex_edges(_quantised(s, d, 3)),
    "node_similarity": lambda s, d: _rounded(_sim(s, d), sim=6),
    "node_similarity_multi": lambda s, d: _rounded(graph.similarity(part_nodes(s, d), ["length", "fclass"]), sim=6),
    "node_similarity_noise": lambda s, d: _rounded(graph.similarity(part_nodes(s, d), ["length"], noise=0.1), sim=6),
    "transition_matrix": lambda s, d: _rounded(_p(s, d), p=6),
    "adjacency": lambda s, d: graph.adjacency(_p(s, d)),
    "column_normalise": lambda s, d: _rounded(graph.column_normalised(graph.adjacency(_p(s, d))), v=6),
    "reversed_weighted_graph": lambda s, d: _rounded(graph.weighted_digraph(_p(s, d), _sim(s, d)), w=6),
    "induced_subgraph": lambda s, d: _rounded(graph.induced_subgraph(_edges(s, d), part_nodes(s, d), table(s, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("id"))), w=6),
    "pagerank_1": lambda s, d: _rounded(rank.pagerank(_p(s, d), _start(s, d), 0.85, 1)[0], value=6),
    "pagerank_3": lambda s, d: _rounded(rank.pagerank(_p(s, d), _start(s, d), 0.85, 3)[0], value=6),
    "pagerank_diff": lambda s, d: _rounded(rank.change_norm(rank.pagerank(_p(s, d), _start(s, d), 0.85, 3)[0], rank.pagerank(_p(s, d), _start(s, d), 0.85, 2)[0]), diff=6),
    "qwalk_start": lambda s, d: _rounded(rank.walk_start(_p(s, d)).select("i", "j", "a"), a=9),
    "qwalk_step1": lambda s, d: _rounded(rank.walk_step(rank.walk_start(_p(s, d))).select("i", "j", "a"), a=9),
    "qwalk_avg3": lambda s, d: _rounded(rank.quantum_pagerank(_p(s, d), part_nodes(s, d), 0.85, 3), value=9),
    "qwalk_norm": lambda s, d: _rounded(rank.nodes_norm(rank.walk_nodes(rank.walk_pairs(_p(s, d)), 2)[-1]), norm=6),
    "qwalk_change": qwalk_change,
    "topk_ranking": topk_ranking,
    "select_ratios": select_ratios,
    "polyline_length": lambda s, d: vector_lines(s, d).select("fid", F.round(G.line_length("points"), 6).alias("length")),
    "vertex_direction": lambda s, d: _rounded(vector_lines(s, d).select("fid", F.posexplode(G.vertex_directions("points")).alias("at", "direction")), direction=4),
    "bounds": _bounds,
    "project_3857": lambda s, d: _vertices(s, d).select("fid", "at", *[F.round(c, 3).alias(n) for c, n in zip(G.web_mercator(F.col("x"), F.col("y")), "xy", strict=True)]),
    "project_utm": lambda s, d: _vertices(s, d).select("fid", "at", *[F.round(c, 3).alias(n) for c, n in zip(G.utm(F.col("x"), F.col("y")), "xy", strict=True)]),
    "great_circle_km": lambda s, d: vector_lines(s, d).select("fid", F.round(G.great_circle_length("points"), 6).alias("km")),
    "endpoint_contact": lambda s, d: stroke.endpoint_pairs(_ends_quantised(s, d)).select("a", "b", "kind"),
    "angle_between": lambda s, d: stroke.endpoint_pairs(_ends_quantised(s, d)),
    "stroke_merge": lambda s, d: stroke.strokes(_ends_quantised(s, d), ["label"]).select("fid", "label", F.size("points").alias("n_points")),
    "stroke_paired": lambda s, d: stroke.paired_strokes(_ends_quantised(s, d), ["label"]),
    "near_table": lambda s, d: stroke.near_table(_placed(s, d)),
    "clip_to_boundary": lambda s, d: lineage.clip_lines(vector_lines(s, d), POLYGON).select("fid", "part", F.size("points").alias("n_points")),
    "grid_density": lambda s, d: _rounded(evaluate.grid_density(vector_lines(s, d), _bounds(s, d)).select("grid_id", "road_length", "density"), road_length=6, density=4),
    "retain_rate": lambda s, d: _rounded(_densities(s, d).select("grid_id", "retain"), retain=6),
    "density_corr": lambda s, d: _rounded(evaluate.density_metrics(_densities(s, d)), mean_retain=6, std_retain=6, pearson=6, r2=6),
    "buffer_match": _matched,
    "buffer_match_coverage": lambda s, d: _rounded(evaluate.coverage(vector_lines(s, d).where("label < 5"), _matched(s, d)), total_length=4, matched_length=4, coverage=4),
    "power_fit": power_fit,
    "shortest_paths": lambda s, d: paths.shortest_paths(_trade(s, d)),
    "path_efficiency": lambda s, d: _rounded(paths.path_efficiency(paths.shortest_paths(_trade(s, d)), paths.shortest_paths(_inside(s, d))), efficiency=6),
    "coo_matmul": lambda s, d: _cells(coo.multiply(_a(s, d), _b(s, d)), val=4),
    "coo_matvec": lambda s, d: _cells(coo.matvec(_a(s, d), table(s, d, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("row")).agg(F.sum("l_discount").alias("val"))), val=4),
    "coo_scalar": lambda s, d: _cells(coo.scale(_a(s, d), 2.5)),
    "complex_scale": lambda s, d: _cells(coo.scale_complex(_a(s, d), 0.5, -1.5)),
    "coo_minus_identity": lambda s, d: _cells(coo.minus_identity(_square(s, d), 2.0, _square(s, d).select("row").distinct())),
    "coo_reflection": lambda s, d: _cells(coo.half_reflection(_square(s, d), 0.5, _square(s, d).select("row").distinct()), re=6, im=4),
    "reclass_fclass": reclass_fclass,
    "merge_layers": merge_layers,
    "drop_fields": lambda s, d: lineage.drop_fields(table(s, d, "events"), ["ts", "user_id", "props"]),
    "attribute_table": lambda s, d: lineage.attribute_table(table(s, d, "part").select("p_partkey", "p_name", "p_brand", "p_size")),
    "explode_parts": explode_parts,
    "safe_float": lambda s, d: table(s, d, "events").select("event_id", S.safe_float("event_type").alias("of_type"), S.safe_float("user_id").alias("of_user")),
    "parse_props_json": lambda s, d: table(s, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k")),
    "max_score_per_road": lambda s, d: _rounded(sage.road_scores(table(s, d, "embeddings").select(F.col("label").alias("fid"), (1 / (1 + F.exp(-F.col("embedding")[0].cast("double")))).alias("score"))), score=6),
    "sage_mean_layer": sage_mean_layer,
    "sage_layer": sage_layer,
    "sage_noise": sage_noise,
    "train_split": lambda s, d: sage.split_masks(table(s, d, "documents").select(F.col("doc_id").alias("id"))),
    "measure_marginal": measure_marginal,
    "circuit_averages": circuit_averages,
    "road_match": road_match,
    "density_report": density_report,
    "connectivity": connectivity,
    "sampled_pairs": sampled_pairs,
    "damped_transition": damped_transition,
    "sum_normalised": lambda s, d: _rounded(graph.sum_normalised(part_nodes(s, d), "length"), value=12),
    "qwalk_metrics": qwalk_metrics,
    "score_ranking": score_ranking,
    "scalar_forms": scalar_forms,
    "numbered_parts": lambda s, d: evaluate.numbered(evaluate.parts_of(_parts(s, d)), "orig_id", "part").select("orig_id", "part", "fid"),
}
