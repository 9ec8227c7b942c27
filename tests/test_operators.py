"""Operators against small worked cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arterial.functions import geometry as G
from arterial.functions import scalar as S
from arterial.operators import circuit, coo, evaluate, lineage, paths, sage, select, stroke
from arterial.operators.iterate import connected_components
from arterial.sources import files, shapefile

LINES = "fid long, kind string, points array<struct<x:double,y:double>>"


def lines(spark, *rows):
    return spark.createDataFrame([(k, kind, [{"x": float(x), "y": float(y)} for x, y in pts]) for k, kind, pts in rows], LINES)


def test_power_fit_of_the_published_points(spark):
    s = [250000.0, 1000000.0] * 6
    r = [0.2149, 0.0712, 0.2302, 0.0788, 0.3378, 0.1014, 0.3380, 0.1274, 0.4209, 0.1354, 0.3349, 0.1038]
    got = evaluate.power_fit(spark.createDataFrame(list(zip(s, r, strict=True)), "s double, r double")).first()
    assert (got.b, got.a, got.r2_log, got.r2) == pytest.approx((0.800857, 6404.397, 0.848668, 0.796821), rel=1e-5)


def test_strokes_follow_the_straight_pair(spark):
    roads = lines(spark, (1, "a", [(0, 0), (1, 0)]), (2, "a", [(1, 0), (2, 0.1)]), (3, "a", [(1, 0), (1, 1)]), (4, "b", [(2, 0.1), (3, 0.1)]))
    got = {r.fid: [(p.x, p.y) for p in r.points] for r in stroke.strokes(roads, ["kind"]).collect()}
    assert got == {1: [(0, 0), (1, 0), (2, 0.1)], 3: [(1, 0), (1, 1)], 4: [(2, 0.1), (3, 0.1)]}
    paired = {r.fid: r.stroke for r in stroke.paired_strokes(roads, ["kind"]).collect()}
    assert paired == {1: 1, 2: 1, 3: 3, 4: 4}
    pairs = {(r.a, r.b): (r.kind, r.angle) for r in stroke.endpoint_pairs(roads).collect()}
    assert pairs[(1, 2)] == (3, 174) and pairs[(1, 3)] == (3, 90) and (1, 4) not in pairs


def test_contact_columns_agree_with_the_loop(spark):
    a, b = [(0, 0), (1, 0), (1, 1)], [(3, 1), (2, 2), (1, 1)]
    for x, y in ((a, b), (b, a), (a[::-1], b), (b, a[::-1])):
        pair = lines(spark, (1, "a", x), (2, "a", y))
        got = stroke.endpoint_pairs(pair).first()
        kind = stroke._touch(x, y)
        assert (got.kind, got.angle) == (kind, stroke._angle(x, y, kind))
        joined = pair.where("fid = 1").select(F.col("points").alias("p")).crossJoin(pair.where("fid = 2").select(F.col("points").alias("q")))
        pts = joined.select(G.joined_points(F.col("p"), F.col("q"), F.lit(kind)).alias("j")).first().j
        assert [(p.x, p.y) for p in pts] == [(float(u), float(v)) for u, v in stroke._joined(x, y, kind)]


def test_near_table_finds_crossings(spark):
    roads = lines(spark, (1, "", [(0, 0), (2, 2)]), (2, "", [(0, 2), (2, 0)]), (3, "", [(5, 5), (6, 6)]), (4, "", [(2, 2), (3, 2)]))
    assert sorted(map(tuple, stroke.near_table(roads).collect())) == [(1, 2), (1, 4), (2, 1), (4, 1)]


def test_grid_density_and_metrics(spark):
    roads = lines(spark, (1, "", [(0, 0), (10, 0)]), (2, "", [(0, 10), (10, 10)]), (3, "", [(10, 0), (0, 0)]))
    bounds = G.total_bounds(roads.select(F.explode("points").alias("p")).select("p.*"))
    cells = {r.grid_id: r.road_length for r in evaluate.grid_density(roads, bounds, 2, 2).collect()}
    assert cells == {"0-0": 5, "0-1": 5, "1-0": 5, "1-1": 5}
    pairs = spark.createDataFrame([("a", 2.0, 1.0), ("b", 0.0, 0.0), ("c", 0.0, 1.0), ("d", 1.0, 3.0)], "g string, o double, s double")
    assert [r[0] for r in pairs.orderBy("g").select(evaluate.retain_rate(F.col("o"), F.col("s"))).collect()] == [0.5, 1.0, 0.0, 1.0]


def test_matching_needs_nearness_and_direction(spark):
    ref = lines(spark, (9, "", [(0, 0), (1000, 0)]))
    roads = lines(spark, (1, "", [(0, 50), (900, 60)]), (2, "", [(500, 50), (500, 900)]), (3, "", [(0, 500), (900, 500)]))
    got = evaluate.matched_roads(roads, ref, 100, 30)
    assert [r.fid for r in got.collect()] == [1]
    share = evaluate.coverage(roads, got).first()
    assert share.coverage == pytest.approx(100 * share.matched_length / share.total_length) and 30 < share.coverage < 40


def test_paths_against_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    edges = {(int(a), int(b)): int(w) for a, b, w in zip(rng.integers(0, 12, 40), rng.integers(0, 12, 40), rng.integers(1, 9, 40), strict=True) if a != b}
    d = {(i, j): 0 if i == j else edges.get((i, j), math.inf) for i in range(12) for j in range(12)}
    for k in range(12):
        for i in range(12):
            for j in range(12):
                d[i, j] = min(d[i, j], d[i, k] + d[k, j])
    got = {(r.i, r.j): r.d for r in paths.shortest_paths(spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "s long, t long, w long")).collect()}
    sources = {a for a, _ in edges}
    assert got == {k: v for k, v in d.items() if v < math.inf and k[0] in sources}
    assert paths.path_efficiency(spark.createDataFrame([], "i long, j long, d long"), spark.createDataFrame([], "i long, j long, d long")).first()[0] == math.inf


def test_matrix_algebra_against_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 3, (5, 4)).astype(float), rng.integers(0, 3, (4, 6)).astype(float)
    table = lambda m: spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "row long, col long, val double")
    dense = lambda df, shape, c="val": np.array([[{(r.row, r.col): r[c] for r in rows}.get((i, j), 0) for j in range(shape[1])] for i in range(shape[0])]) if (rows := df.collect()) is not None else None
    assert np.allclose(dense(coo.multiply(table(a), table(b)), (5, 6)), a @ b)
    q = rng.integers(0, 3, (4, 4)).astype(float)
    n = spark.createDataFrame([(k,) for k in range(4)], "row long")
    assert np.allclose(dense(coo.minus_identity(table(q), 2, n), (4, 4)), q - 2 * np.eye(4))
    half = coo.half_reflection(table(q), 0.5, n)
    assert np.allclose(dense(half, (4, 4), "re"), math.cos(math.pi / 4) * np.eye(4)) and np.allclose(dense(half, (4, 4), "im"), -math.sin(math.pi / 4) * q)


def test_components(spark):
    ids = spark.createDataFrame([(k,) for k in range(1, 41)], "id long")
    chain = spark.createDataFrame([(k, k + 1) for k in range(1, 30)] + [(35, 33)], "src long, dst long")
    got = dict(map(tuple, connected_components(ids, chain).collect()))
    assert all(got[k] == 1 for k in range(1, 31)) and got[35] == got[33] == 33 and got[40] == 40


def test_running_totals_in_ranges(spark, monkeypatch):
    rows = spark.range(1, 501).select("id", (F.col("id") % 37).cast("double").alias("value"), F.lit(1.0).alias("w"))
    plain = {r.id: r.upto for r in select.running(rows, "w").collect()}
    monkeypatch.setattr(select, "ONE_RANGE_ROWS", 10)
    assert {r.id: r.upto for r in select.running(rows, "w").collect()} == plain
    assert sorted(plain.values()) == [float(k) for k in range(1, 501)]


def test_sage_layer_and_noise(spark):
    x = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0]), (3, [5.0, 6.0])], "id long, x array<double>")
    edges = spark.createDataFrame([(2, 1), (3, 1), (1, 2)], "src long, dst long")
    layer = sage.SageLayer(np.eye(2), 10 * np.eye(2), np.zeros(2))
    got = {r.id: r.x for r in sage.sage_layer(x, edges, layer).collect()}
    assert got == {1: [41.0, 52.0], 2: [13.0, 24.0], 3: [5.0, 6.0]}
    assert sage.feature_noise(x, 0.1).collect() == sage.feature_noise(x, 0.1).collect()
    parts = [r.part for r in sage.split_masks(spark.range(200).toDF("id")).collect()]
    assert [parts.count(k) for k in ("train", "val", "test")] == [140, 30, 30]
    last = sage.SageModel([layer])
    assert all(0 < r.score < 1 for r in sage.sage_scores(x, edges, last).collect())
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "id long, label int")
    fitted, features = sage.train_propagated(x, edges, labels, hops=1)
    assert sage.evaluate(fitted, features, labels).first().accuracy == 1.0
    assert sage.training_schedule([1.0] * 200)[1] == 100


def test_circuits(spark):
    g = np.array([[0.25, 0.45, 0.3, 0.4], [0.3, 0.15, 0.4, 0.4], [0.4, 0.25, 0.1, 0.1], [0.05, 0.15, 0.2, 0.1]])
    p = [0.4, 0.1, 0.3, 0.2]
    angles = circuit.rotation_angles(p)
    assert angles == pytest.approx([2 * math.acos(math.sqrt(0.5)), 2 * math.acos(math.sqrt(0.6))])
    assert circuit.rotation_angles(p, sine=True) == pytest.approx(angles)
    for make in (circuit.walk_circuit, circuit.plain_circuit):
        gates, qubits = make(g, 0.85, 2)
        state = circuit.simulate(gates, qubits)
        assert (state**2).sum() == pytest.approx(1.0)
        back = circuit.simulate(gates + circuit.inverse(gates), qubits)
        assert back[0] == pytest.approx(1.0)
    shots = spark.createDataFrame([(1, 0, 0.5), (2, 0, 0.3)], "step int, node long, prob double")
    assert [(round(r.average, 9), round(r.delta, 9)) for r in circuit.running_average(shots).orderBy("step").collect()] == [(0.5, 0.5), (0.4, -0.1)]
    init, n = circuit.initial_state(g, 0.85)
    assert len(circuit.zero_reflection(init, 1 + 2 * n)) == 2 * len(init) + 2 * (1 + 2 * n) + 1


def test_scalars_and_projection(spark):
    row = spark.createDataFrame([(" 2.5 ", "x", "[1,2]", None)], "a string, b string, c string, d string")
    got = row.select(S.safe_float("a"), S.safe_float("b"), S.number_list("c"), S.trimmed_text("d"), S.half_even(F.lit(2.5)), S.clipped(F.lit(9.0), 0, 1)).first()
    assert list(got) == [2.5, 0.0, [1, 2], "", 2.0, 1.0]
    east, north = spark.range(1).select(*G.utm(F.lit(9.0), F.lit(45.0))).first()
    assert (east, north) == pytest.approx((500000.0, 4982950.4), abs=0.5)
    x, y = spark.range(1).select(*G.web_mercator(F.lit(180.0), F.lit(45.0))).first()
    assert (x, y) == pytest.approx((20037508.34, 5621521.49), abs=0.01)
    kinds = spark.createDataFrame([("trunk_link",), ("trunk",), ("footway",)], "k string")
    assert [tuple(r) for r in kinds.select(S.reclass("k"), S.reclass("k", S.LINK_LEVELS)).collect()] == [(1, 7), (7, 7), (1, 1)]
    assert S.percent_tag(0.29) == 28


def test_layers(spark):
    a, b = spark.createDataFrame([(1, "x")], "id long, name string"), spark.createDataFrame([(2,)], "id long")
    assert sorted(map(tuple, lineage.merge_layers([a, b]).collect())) == [(1, "x"), (2, None)]
    assert lineage.drop_fourth(spark.createDataFrame([(1, 2, 3, 4, 5)], "a int, b int, c int, d int, e int")).columns == ["a", "b", "c", "e"]
    roads = lines(spark, (1, "", [(-1, 0.5), (2, 0.5)]), (2, "", [(5, 5), (6, 6)]))
    clipped = lineage.clip_lines(roads, [(0, 0), (1, 0), (1, 1), (0, 1)]).collect()
    assert [(r.fid, [(p.x, p.y) for p in r.points]) for r in clipped] == [(1, [(0, 0.5), (1, 0.5)])]
    with pytest.raises(Exception, match="fewer than two points"):
        lineage.checked_lines(lines(spark, (1, "", [(0, 0)]))).collect()
    assert lineage.attribute_table(roads).columns == ["fid", "kind"]


def test_shapefile_round_trip(spark, tmp_path):
    records = [[[(0.0, 0.0), (1.0, 1.0)]], [[(2.0, 2.0), (3.0, 3.0)], [(4.0, 4.0), (5.0, 5.0)]]]
    (tmp_path / "road.shp").write_bytes(shapefile.encode_shapes(records))
    (tmp_path / "road.dbf").write_bytes(shapefile.encode_attributes([{"name": "Übergang"}, {"name": "b "}]))
    got = sorted(shapefile.read_shapefiles(spark, str(tmp_path)).collect(), key=lambda r: r.fid)
    assert [[[(p.x, p.y) for p in part] for part in r.parts] for r in got] == records
    assert [r.attributes["name"] for r in got] == ["Übergang", "b"]


def test_file_tables(spark, tmp_path):
    (tmp_path / "n.txt").write_text("OBJECTID,fclass,Shape_Length\n1,2,0.5\n2,x,1.5\n")
    (tmp_path / "e.txt").write_text("a,IN,NEAR\n1,1,2\n2,2,1\n")
    assert [tuple(r) for r in files.read_nodes(spark, str(tmp_path / "n.txt")).collect()] == [(1, 2.0, 0.5), (2, 0.0, 1.5)]
    assert [tuple(r) for r in files.read_edges(spark, str(tmp_path / "e.txt")).collect()] == [(1, 2), (2, 1)]
    m = spark.createDataFrame([(0, 0, 1.0), (5, 1, 2.0)], "row long, col long, val double")
    files.write_blocks(m, str(tmp_path / "m"), 4)
    assert [tuple(r) for r in files.read_block(spark, str(tmp_path / "m"), 1, 0).collect()] == [(5, 1, 2.0)]
    results = spark.createDataFrame([("c", "0.85", "0", 2, 0.7, 1), ("c", "0.85", "0", 1, 0.3, 2)], "method string, alpha string, noise string, id int, value double, position int")
    files.write_results(results, str(tmp_path / "r"))
    files.write_results(results, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2
    doc = files.result_documents(results).first()
    (tmp_path / "doc.json").write_text('{"0.85": {"0": {"sortindex": "%s", "value": "%s"}}}' % (doc.sortindex, doc.value))
    assert [r.id for r in files.read_ranking(spark, str(tmp_path / "doc.json")).orderBy("position").collect()] == [2, 1]


def test_crossed_cells_cover_the_reach(spark):
    rng = np.random.default_rng(8)
    rows = [tuple(float(v) for v in rng.uniform(-5, 5, 4)) for _ in range(40)] + [(1.0, 1.0, 1.0, 4.0), (2.0, 2.0, 2.0, 2.0), (-3.0, 0.5, 3.0, 0.5)]
    s = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, ax double, ay double, bx double, by double")
    cells = {}
    for r in G.with_crossed_cells(s, 0.5, 0.2).collect():
        cells.setdefault(r.k, set()).add((r.cx, r.cy))
    for k, (ax, ay, bx, by) in enumerate(rows):
        for _ in range(200):
            t, turn, far = rng.uniform(), rng.uniform(0, 2 * math.pi), rng.uniform(0, 0.2)
            x, y = ax + t * (bx - ax) + far * math.cos(turn), ay + t * (by - ay) + far * math.sin(turn)
            assert (math.floor(x / 0.5), math.floor(y / 0.5)) in cells[k]
        boxes = (abs(bx - ax) / 0.5 + 3) * (abs(by - ay) / 0.5 + 3)
        assert len(cells[k]) <= boxes


def test_partial_overlaps_count_once(spark):
    roads = lines(spark, (1, "", [(0, 0), (6, 0)]), (2, "", [(4, 0), (10, 0)]), (3, "", [(9, 0), (5, 0)]), (4, "", [(0, 10), (10, 10)]), (5, "", [(0, 0), (10, 10)]), (6, "", [(2, 2), (5, 5)]))
    bounds = G.total_bounds(roads.select(F.explode("points").alias("p")).select("p.*"))
    got = evaluate.grid_density(roads, bounds, 1, 1).first()
    assert got.road_length == pytest.approx(20 + math.sqrt(200))


def test_road_match_and_density_of_layers(spark):
    part = "array<array<struct<x:double,y:double>>>"
    pts = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    roads = spark.createDataFrame([(1, [pts((0, 0), (0.01, 0)), pts((0.02, 0), (0.03, 0.0001))]), (2, [pts((0, 0.5), (0.01, 0.5))])], f"fid long, parts {part}")
    reference = spark.createDataFrame([(7, [pts((0, 0.0005), (0.03, 0.0005))]), (8, [pts((50, 50), (51, 51))])], f"fid long, parts {part}")
    matched, stats = evaluate.road_match(roads, reference)
    got = stats.first()
    assert [r.fid for r in matched.collect()] == [1] and got.matched_length == pytest.approx(0.02 * G.RADIUS * math.pi / 180, rel=1e-3)
    assert got.coverage == pytest.approx(100 * 2 / 3, rel=1e-3)
    assert evaluate.road_match(roads.limit(0), reference)[1].first().coverage == 0
    flat = roads.select("fid", F.flatten("parts").alias("points"))
    whole = evaluate.density_report(flat, flat).first()
    assert whole.cells == 100 and whole.mean_retain == 1.0 and whole.r2 == pytest.approx(1.0)
    assert [r.fid for r in evaluate.single_lines(roads).collect()] == [2]
    ids = spark.createDataFrame([(1,), (2,), (2,)], "id long")
    assert [r.fid for r in evaluate.chosen_multiparts(roads, ids, True).collect()] == [1] and evaluate.chosen_multiparts(roads, ids).count() == 2
    numbered = evaluate.numbered(evaluate.parts_of(roads), "orig_id", "part").orderBy("fid").collect()
    assert [(r.fid, r.orig_id, r.part) for r in numbered] == [(0, 1, 0), (1, 1, 1), (2, 2, 0)]


def test_coordinate_systems(spark, tmp_path):
    from arterial.functions import crs

    assert crs.crs_of('GEOGCS["GCS_WGS_1984",DATUM["D"]]') == crs.GEOGRAPHIC and crs.crs_of('  PROJCS["UTM"]') == crs.PROJECTED
    with pytest.raises(ValueError, match="no coordinate system"):
        crs.crs_of(" ")
    (tmp_path / "a.prj").write_text('GEOGCS["GCS_WGS_1984",DATUM["D"]]')
    (tmp_path / "b.prj").write_text('LOCAL["x"]')
    got = {r.name: r.kind for r in crs.read_prj(spark, str(tmp_path)).collect()}
    assert got == {"GCS_WGS_1984": "geographic", "x": None}
    assert crs.utm_of(113.0, 30.0, 115.0, 31.0) == (50, False) and crs.utm_of(-1.0, -3.0, -0.5, -1.0) == (30, True)


def test_connectivity_of_selections(spark):
    edges = [(a, b, 1.0) for a in range(5) for b in (a - 1, a + 1) if 0 <= b < 5] + [(0, 4, 1.0), (4, 0, 1.0)]
    whole = spark.createDataFrame(edges, "s long, t long, w double")
    parts = spark.createDataFrame([("all", *e) for e in edges] + [("line", *e) for e in edges if {e[0], e[1]} != {0, 4}] + [("one", 9, 8, 1.0)], "method string, s long, t long, w double")
    got = {r.method: r.efficiency for r in paths.connectivity(whole, parts, ["method"]).collect()}
    ring = lambda i, j: min((i - j) % 5, (j - i) % 5)
    assert got["all"] == 1.0 and got["one"] == math.inf
    assert got["line"] == pytest.approx(np.mean([ring(i, j) / abs(i - j) for i in range(5) for j in range(5) if i != j]))
    pairs = spark.createDataFrame([(i, j) for i in range(20) for j in range(20)], "i long, j long")
    assert paths.pair_sample(pairs, 7).collect() == paths.pair_sample(pairs.repartition(3), 7).collect()
    with pytest.raises(RuntimeError, match="hops"):
        paths.shortest_paths(whole, most_hops=1)


def test_damping_and_metrics(spark):
    from arterial.operators import graph, rank

    nodes = spark.createDataFrame([(1, 2.0), (2, 6.0)], "id long, length double")
    p = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "src long, dst long, p double")
    assert {(r.src, r.dst): round(r.p, 9) for r in graph.damped(p, nodes, 0.8).collect()} == {(1, 1): 0.1, (1, 2): 0.9, (2, 1): 0.9, (2, 2): 0.1}
    assert {r.id: r.value for r in graph.sum_normalised(nodes, "length").collect()} == {1: 0.25, 2: 0.75}
    assert {r.value for r in graph.sum_normalised(nodes.withColumn("length", F.lit(0.0)), "length").collect()} == {0.0}
    assert {r.id: r.sim for r in graph.similarity(nodes, ["length", "absent"]).collect()} == {1: 0.0, 2: 1.0}
    states = [spark.createDataFrame([(1, 1, a), (1, 2, b)], "i long, j long, a double") for a, b in ((1.0, 0.0), (0.0, 1.0), (1.0, 0.0))]
    got = rank.state_metrics(states).first()
    assert (got.delta, got.angle) == pytest.approx((math.sqrt(2), 90.0)) and got.mean_abs == pytest.approx(1 / 6)
    assert got.delta_mean == pytest.approx(math.hypot(1 / 6, 1 / 6)) and got.angle_mean == pytest.approx(math.degrees(math.acos(0.5 / math.hypot(0.5, 0.5) / math.hypot(2 / 3, 1 / 3))))
    ties = spark.createDataFrame([(3, 1.0), (1, 1.0), (2, 5.0)], "id long, value double")
    assert [r.id for r in rank.ranked(ties, ids_descend=False).orderBy("position").collect()] == [2, 1, 3]


def test_noise_and_model_files(spark, tmp_path):
    x = spark.range(2000).select(F.col("id"), F.array(F.lit(1.0), F.lit(2.0)).alias("x"))
    seen = np.array([r.x[0] - 1 for r in sage.feature_noise(x, 0.1).collect()]) / 0.1
    assert abs(seen.mean()) < 0.1 and 0.9 < seen.std() < 1.1 and abs(np.corrcoef(seen[1:], seen[:-1])[0, 1]) < 0.08
    first, second = sage.compounded_noise(x, [0.1, 0.2])
    assert first.first().x != second.first().x
    layer = sage.SageLayer(np.eye(2), 2 * np.eye(2), np.ones(2), (np.ones(2), np.zeros(2), np.zeros(2), np.ones(2)), relu=False)
    sage.save_model(spark, sage.SageModel([layer]), str(tmp_path / "m"))
    back = sage.load_model(spark, str(tmp_path / "m")).layers[0]
    assert np.array_equal(back.neighbour, layer.neighbour) and np.array_equal(back.norm[3], np.ones(2)) and not back.relu


def test_more_scalars(spark):
    got = spark.range(1).select(S.is_close(F.lit(1.0), F.lit(1.0 + 1e-9)), S.is_close(F.lit(1.0), F.lit(1.1)), S.binary_text(F.lit(5), 4), S.binary_text(F.lit(21), 4), S.tiled(F.array(F.lit(1), F.lit(2)), 2)).first()
    assert list(got) == [True, False, "0101", "10101", [1, 2, 1, 2]]


def test_shapefile_sink_round_trip(spark, tmp_path):
    part = "array<array<struct<x:double,y:double>>>"
    pts = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    rows = [("c", "0.4", 1, "a", [pts((0, 0), (1, 1)), pts((2, 2), (3, 3))]), ("c", "0.4", 10, None, [pts((5, 5), (6, 6))]), ("c", "0.4", 2, "b", [pts((7, 7), (8, 8))]), ("q", "0.2", 1, "a", [pts((0, 0), (1, 1))]), ("q", "0.2", 3, "z", [])]
    roads = spark.createDataFrame(rows, f"method string, ratio string, fid long, fclass string, parts {part}")
    names = shapefile.write_shapefiles(roads, str(tmp_path / "out"), ["method", "ratio"], prj='GEOGCS["GCS_WGS_1984"]')
    assert names == ["c_0.4", "q_0.2"] and (tmp_path / "out" / "q_0.2.prj").read_text().startswith("GEOGCS")
    back = {}
    for r in shapefile.read_shapefiles(spark, str(tmp_path / "out")).collect():
        back.setdefault(r.layer.rsplit("/", 1)[1], []).append((r.fid, r.attributes["fid"], r.attributes["fclass"], [[(p.x, p.y) for p in q] for q in r.parts]))
    assert sorted(back["c_0.4"]) == [(0, "1", "a", [[(0, 0), (1, 1)], [(2, 2), (3, 3)]]), (1, "2", "b", [[(7, 7), (8, 8)]]), (2, "10", "", [[(5, 5), (6, 6)]])]
    shx = (tmp_path / "out" / "c_0.4.shx").read_bytes()
    assert len(shx) == 100 + 3 * 8 and int.from_bytes(shx[100:104], "big") == 50


def test_documents_and_bad_edges(spark, tmp_path):
    results = spark.createDataFrame([("0.85", "0", 2, 0.7, 1), ("0.85", "0", 1, 0.3, 2), ("0.5", "0.1", 1, 0.9, 1)], "alpha string, noise string, id int, value double, position int")
    files.write_document(results, str(tmp_path / "doc"))
    back = files.read_ranking(spark, str(tmp_path / "doc")).collect()
    assert sorted((r.alpha, r.noise, r.position, r.id) for r in back) == [("0.5", "0.1", 1, 1), ("0.85", "0", 1, 2), ("0.85", "0", 2, 1)]
    (tmp_path / "e.txt").write_text("a,IN,NEAR\n1,1,2\n2,x,1\n\n")
    with pytest.raises(Exception, match="not an edge: 2,x,1"):
        files.read_edges(spark, str(tmp_path / "e.txt")).collect()
    (tmp_path / "c.json").write_text('{"roadselect": {"global": {"noise": [0, 0.1]}, "applyu": {"alpha_s": [0.5], "max_iterations": 7}}}')
    config = files.read_config(spark, str(tmp_path / "c.json"))
    assert (config.noise, config.alphas, config.max_iterations, config.ratios) == ([0.0, 0.1], [0.5], 7, [0.2, 0.4, 0.6])


def test_small_forms(spark, tmp_path):
    m = spark.createDataFrame([(0, 0, 1.0), (5, 1, 2.0), (5, 1, 0.5)], "row long, col long, val double")
    assert coo.block_count(m, 4) == 2 and coo.to_dense(m, 6, 2)[5, 1] == 2.5 and coo.to_dense(m, 6, 2).sum() == 3.5
    with pytest.raises(ValueError, match="too large"):
        coo.to_dense(m, 10**5, 10**5)
    layer = spark.createDataFrame([("1", "x"), ("z", "y")], "a string, b string")
    got = lineage.update_schema(layer, {"a": "int", "c": "double"}, {"c": 2}).collect()
    assert [(r.a, r.b, r.c) for r in got] == [(1, "x", 2.0), (None, "y", 2.0)]
    assert lineage.export_fields(layer, {"b": "name"}).columns == ["name"]
    cells = evaluate.grid(spark.createDataFrame([(0.0, 0.0, 2.0, 2.0)], "minx double, miny double, maxx double, maxy double"), 2, 2)
    first = evaluate.grid_polygons(cells).where("grid_id = '0-0'").first()
    assert first.wkt == "POLYGON ((0.0 0.0, 1.0 0.0, 1.0 1.0, 0.0 1.0, 0.0 0.0))" and first.area == 1.0
    (tmp_path / "g.json").write_text('{"0": {"sorted": "[3, 1, 2]"}, "0.1": {"sorted": "[1]"}}')
    assert sorted(map(tuple, files.read_scores(spark, str(tmp_path / "g.json")).collect())) == [("0", 1, 2), ("0", 2, 3), ("0", 3, 1), ("0.1", 1, 1)]
    files.write_selection(spark.createDataFrame([("c", "0.4", "0.85", "0", 1)], "method string, ratio string, alpha string, noise string, fid int"), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where("method = 'c' AND ratio = 0.4").count() == 1
    bounds = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0)], "minx double, miny double, maxx double, maxy double")
    roads = lines(spark, (1, "", [(1.5, 0.5), (2, 2)]), (2, "", [(3, 3), (4, 4)]), (3, "", [(0.2, 0.2), (0.4, 0.4)]))
    assert sorted(r.fid for r in evaluate.in_bounds(roads, bounds, 0.6).collect()) == [1, 3]


def test_text_forms_and_files(spark, tmp_path):
    roads = lines(spark, (1, "a", [(0, 0), (0, 1)]))
    got = lineage.with_length_km(roads).select("length", G.well_known_text("points").alias("wkt"), S.list_text(F.array(F.lit(1), F.lit(2))).alias("text")).first()
    assert got.length == pytest.approx(111.195, abs=0.01) and got.wkt == "LINESTRING (0.0 0.0, 0.0 1.0)" and got.text == "[1,2]"
    files.write_csv(lineage.attribute_table(roads), str(tmp_path / "c"), ";")
    assert [tuple(r) for r in spark.read.option("header", True).option("sep", ";").csv(str(tmp_path / "c")).collect()] == [("1", "a")]
    m = spark.createDataFrame([(0, 0, 1.0), (5, 1, 2.0)], "row long, col long, val double")
    files.write_blocks(m, str(tmp_path / "b"), 4)
    assert sorted(map(tuple, files.read_blocks(spark, str(tmp_path / "b")).collect())) == [(0, 0, 1.0), (5, 1, 2.0)]
    nodes = evaluate.parts_of(spark.createDataFrame([(4, [[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 1.0}]])], "fid long, parts array<array<struct<x:double,y:double>>>"))
    assert nodes.columns == ["orig_id", "part", "points"]
