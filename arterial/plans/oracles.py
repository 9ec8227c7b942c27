"""SQL of the registered queries, for the same tables."""

from __future__ import annotations

import math

import numpy as np

from arterial.operators import circuit

ALPHA = "CAST(0.85 AS DOUBLE)"
REST = "CAST(0.15 AS DOUBLE)"

NODES = "nodes AS (SELECT p_partkey AS id, p_retailprice AS length, CAST(p_size AS DOUBLE) AS fclass FROM part)"
EDGES = """m AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS n FROM lineitem),
edges AS MATERIALIZED (SELECT DISTINCT a.n AS src, b.n AS dst FROM m a JOIN m b ON a.k = b.k WHERE a.n <> b.n)"""
SIM = """ends AS (SELECT min(length) AS lo, max(length) AS hi FROM nodes),
scaled AS (SELECT id, CASE WHEN hi = lo THEN CAST(0 AS DOUBLE) ELSE (length - lo) / (hi - lo) END AS x FROM nodes, ends),
dist AS (SELECT id, sqrt((x - b) * (x - b)) AS d FROM scaled, (SELECT max(x) AS b FROM scaled)),
sim AS MATERIALIZED (SELECT id, CASE WHEN w = 0 THEN CAST(1 AS DOUBLE) ELSE 1 - d / w END AS sim FROM dist, (SELECT max(d) AS w FROM dist))"""
TRANS = """outs AS MATERIALIZED (SELECT src, sum(sim) AS o FROM edges JOIN sim ON id = dst GROUP BY src),
p AS MATERIALIZED (SELECT e.src, e.dst, CASE WHEN o = 0 THEN CAST(0 AS DOUBLE) ELSE s.sim / o END AS p
      FROM edges e JOIN sim s ON s.id = e.dst JOIN outs USING (src))"""
BASE = f"WITH {NODES}, {EDGES}, {SIM}, {TRANS}"


def pagerank_ctes(steps: int) -> str:
    parts = ["x0 AS (SELECT id, sim AS value FROM sim)"]
    for k in range(steps):
        parts.append(f"""x{k + 1} AS (SELECT n.id, {ALPHA} * coalesce(f.v, 0) + {REST} / (SELECT count(*) FROM nodes) * (SELECT sum(value) FROM x{k}) AS value
 FROM nodes n LEFT JOIN (SELECT dst, sum(value * p) AS v FROM p JOIN x{k} ON x{k}.id = p.src GROUP BY dst) f ON f.dst = n.id)""")
    return ", ".join(parts)


def pagerank(steps: int) -> str:
    return f"{BASE}, {pagerank_ctes(steps)} SELECT id, round(value, 6) AS value FROM x{steps}"


def walk_ctes(steps: int) -> str:
    parts = ["""cells AS (SELECT coalesce(a.src, b.dst) AS i, coalesce(a.dst, b.src) AS j, coalesce(sqrt(a.p), 0) AS qij, coalesce(sqrt(b.p), 0) AS qji
 FROM (SELECT * FROM p WHERE p <> 0) a FULL JOIN (SELECT * FROM p WHERE p <> 0) b ON a.src = b.dst AND a.dst = b.src)""",
             "s0 AS (SELECT i, j, qij, qji, qij / (SELECT sqrt(sum(qij * qij)) FROM cells) AS a FROM cells)"]
    for k in range(steps):
        parts.append(f"h{k} AS (SELECT i, j, qij, qji, 2 * qji * sum(qji * a) OVER (PARTITION BY j) - a AS a FROM s{k})")
        parts.append(f"s{k + 1} AS (SELECT i, j, qij, qji, 2 * qij * sum(qij * a) OVER (PARTITION BY i) - a AS a FROM h{k})")
    return ", ".join(parts)


def quantum(steps: int) -> str:
    shots = " UNION ALL ".join(
        f"SELECT j AS id, {ALPHA} * sum(a * a) + 2 * sqrt({ALPHA} * {REST}) / (SELECT count(*) FROM nodes) * sum(a) + {REST} / (SELECT count(*) FROM nodes) AS m FROM s{k} GROUP BY j"
        for k in range(steps + 1)
    )
    return f"""{BASE}, {walk_ctes(steps)}, shots AS ({shots})
SELECT n.id, round(coalesce(v.m / {steps + 1}, {REST} / (SELECT count(*) FROM nodes)), 9) AS value
FROM nodes n LEFT JOIN (SELECT id, sum(m) AS m FROM shots GROUP BY id) v USING (id)"""


LINES = """v AS (SELECT vec_id AS fid, label, [CAST(x AS DOUBLE) for x in embedding] AS e FROM embeddings),
pts AS (SELECT fid, label, k, e[2 * k - 1] AS x, e[2 * k] AS y FROM (SELECT *, unnest(range(1, len(e) // 2 + 1)) AS k FROM v)),
segs AS (SELECT a.fid, a.label, a.k, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM pts a JOIN pts b ON a.fid = b.fid AND b.k = a.k + 1)"""


def mod180(dx: str, dy: str) -> str:
    return f"((degrees(atan2({dy}, {dx})) % 180) + 180) % 180"


def span(a: str, b: str, low: str, high: str) -> tuple[str, str]:
    inside = f"({a} >= {low} AND {a} <= {high})"
    return (
        f"CASE WHEN {b} = {a} THEN CASE WHEN {inside} THEN 0 ELSE 2 END ELSE least(({low} - {a}) / ({b} - {a}), ({high} - {a}) / ({b} - {a})) END",
        f"CASE WHEN {b} = {a} THEN CASE WHEN {inside} THEN 1 ELSE -1 END ELSE greatest(({low} - {a}) / ({b} - {a}), ({high} - {a}) / ({b} - {a})) END",
    )


_EX, _LX = span("ax", "bx", "x1", "x2")
_EY, _LY = span("ay", "by_", "y1", "y2")
CELLS = """bounds AS (SELECT min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM pts),
cells AS (SELECT i || '-' || j AS grid_id, minx + j * (maxx - minx) / 10 AS x1, miny + i * (maxy - miny) / 10 AS y1,
   minx + (j + 1) * (maxx - minx) / 10 AS x2, miny + (i + 1) * (maxy - miny) / 10 AS y2
   FROM bounds, (SELECT unnest(range(0, 10)) AS i), (SELECT unnest(range(0, 10)) AS j))"""
GRID = f"{LINES}, {CELLS}"


def density(where: str) -> str:
    return f"""SELECT grid_id, (x2 - x1) * (y2 - y1) AS area, coalesce(len, 0) AS road_length, coalesce(len, 0) / ((x2 - x1) * (y2 - y1)) AS density
 FROM cells LEFT JOIN (SELECT grid_id, sum(greatest(0, least(1, {_LX}, {_LY}) - greatest(0, {_EX}, {_EY})) * sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay))) AS len
   FROM (SELECT DISTINCT CASE WHEN f THEN ax ELSE bx END AS ax, CASE WHEN f THEN ay ELSE by_ END AS ay, CASE WHEN f THEN bx ELSE ax END AS bx, CASE WHEN f THEN by_ ELSE ay END AS by_ FROM (SELECT *, ax < bx OR ax = bx AND ay <= by_ AS f FROM segs WHERE {where})), cells GROUP BY grid_id) USING (grid_id)"""


def density_pairs(lines: str) -> str:
    return f"""{lines}, {CELLS}, orig AS ({density('true')}), sub AS ({density('label < 5')}),
pairs AS (SELECT grid_id, o.density AS orig_density, s.density AS sub_density,
  CASE WHEN o.density < 1e-10 THEN CASE WHEN s.density < 1e-10 THEN 1 ELSE 0 END ELSE greatest(0, least(1, s.density / o.density)) END AS retain
  FROM orig o JOIN sub s USING (grid_id))"""


def density_metrics(lines: str, digits: int = 6) -> str:
    valid = "FILTER (WHERE orig_density > 1e-10)"
    return f"""WITH {density_pairs(lines)} SELECT count(*) AS cells, count(*) {valid} AS valid_cells, round(avg(retain) {valid}, {digits}) AS mean_retain,
round(coalesce(stddev_samp(retain) {valid}, 0), {digits}) AS std_retain, round(corr(orig_density, sub_density) {valid}, {digits}) AS pearson, round(pow(corr(orig_density, sub_density) {valid}, 2), {digits}) AS r2 FROM pairs"""


DENSITY_PAIRS = density_pairs(LINES)

COVER = f"""{LINES}, vert AS (SELECT a.fid, a.x, a.y, {mod180('coalesce(b.x, a.x) - coalesce(CASE WHEN b.x IS NULL THEN c.x END, a.x)', 'coalesce(b.y, a.y) - coalesce(CASE WHEN b.y IS NULL THEN c.y END, a.y)')} AS d
  FROM pts a LEFT JOIN pts b ON b.fid = a.fid AND b.k = a.k + 1 LEFT JOIN pts c ON c.fid = a.fid AND c.k = a.k - 1 WHERE a.label < 5),
ref AS (SELECT ax, ay, bx, by_, {mod180('bx - ax', 'by_ - ay')} AS d, (bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) AS q FROM segs WHERE label >= 5),
near AS (SELECT v.fid, v.x - (ax + t * (bx - ax)) AS ex, v.y - (ay + t * (by_ - ay)) AS ey, least(abs(v.d - rd), 180 - abs(v.d - rd)) AS gap
  FROM (SELECT vert.*, ax, ay, bx, by_, ref.d AS rd, CASE WHEN q = 0 THEN 0 ELSE greatest(0, least(1, ((vert.x - ax) * (bx - ax) + (vert.y - ay) * (by_ - ay)) / q)) END AS t
        FROM vert JOIN ref ON vert.x BETWEEN least(ax, bx) - 0.005 AND greatest(ax, bx) + 0.005 AND vert.y BETWEEN least(ay, by_) - 0.005 AND greatest(ay, by_) + 0.005) v),
hit AS (SELECT DISTINCT fid FROM near WHERE sqrt(ex * ex + ey * ey) < 0.005 AND gap <= 30),
sized AS (SELECT fid, sum(sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay))) AS length FROM segs WHERE label < 5 GROUP BY fid)"""

NATIONS = """trade AS (SELECT c_nationkey AS s, s_nationkey AS t, CAST(1 + sum(CAST(l_quantity AS BIGINT)) % 97 AS BIGINT) AS w
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2),
d0 AS (SELECT s AS i, t AS j, min(w) AS d FROM (SELECT s, t, w FROM trade UNION ALL SELECT s, s, 0 FROM trade) GROUP BY 1, 2)"""


def closure(base: str, rounds: int = 5) -> str:
    return ", ".join(f"{base}{k + 1} AS (SELECT a.i, b.j, min(a.d + b.d) AS d FROM {base}{k} a JOIN {base}{k} b ON a.j = b.i GROUP BY 1, 2)" for k in range(rounds))


PATHS = f"WITH {NATIONS}, {closure('d')}"
_INSIDE = "(SELECT n_nationkey FROM nation WHERE n_regionkey < 3)"
EFFICIENCY = f"""{PATHS}, e0 AS (SELECT * FROM d0 WHERE i IN {_INSIDE} AND j IN {_INSIDE}), {closure('e')}
SELECT round(coalesce(avg(d5.d / e5.d), CAST('inf' AS DOUBLE)), 6) AS efficiency FROM d5 JOIN e5 USING (i, j) WHERE d5.d > 0 AND e5.d > 0"""

A = "a AS (SELECT l_suppkey AS row_, CAST(l_linenumber AS BIGINT) AS col, sum(l_quantity) AS val FROM lineitem GROUP BY 1, 2)"
B = "b AS (SELECT CAST(l_linenumber AS BIGINT) AS row_, CAST(ascii(l_returnflag) AS BIGINT) AS col, sum(l_tax) AS val FROM lineitem GROUP BY 1, 2)"
SQUARE = "a AS (SELECT l_linenumber AS row_, 1 + CAST(l_quantity AS BIGINT) % 7 AS col, CAST(count(*) AS DOUBLE) AS val FROM lineitem GROUP BY 1, 2)"

FCLASS = """CASE split_part(p_type, ' ', 1) WHEN 'STANDARD' THEN 'motorway' WHEN 'SMALL' THEN 'trunk' WHEN 'MEDIUM' THEN 'primary' WHEN 'LARGE' THEN 'secondary'
 WHEN 'ECONOMY' THEN 'tertiary' WHEN 'PROMO' THEN 'residential' ELSE 'path' END"""



def real(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


def uniform(seed: int, *numbers: str) -> str:
    """The number between 0 and 1 that ``functions.scalar.uniform`` makes of whole numbers."""
    h = f"CAST({seed} AS BIGINT)"
    for n in numbers:
        h = f"(({h} * 48271 + CAST({n} AS BIGINT) % 2147483647) % 2147483647)"
    for _ in range(3):
        h = f"[(z * z + 40692) % 2147483647 for z in [{h}]][1]"
    return f"((CAST({h} AS DOUBLE) + {real(0.5)}) / {real(2147483647.0)})"


def normal(seed: int, *numbers: str) -> str:
    return f"(sqrt(-2 * ln({uniform(2 * seed, *numbers)})) * cos(2 * pi() * {uniform(2 * seed + 1, *numbers)}))"


def utm(lon: str, lat: str, zone: str, south: str) -> tuple[str, str]:
    """Easting and northing by the Krueger series to the third order."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    scale = 0.9996 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    e = 2 * n**0.5 / (1 + n)
    phi, lam = f"radians({lat})", f"radians({lon} - ({zone} * 6 - 183))"
    t = f"sinh(atanh(sin({phi})) - {real(e)} * atanh({real(e)} * sin({phi})))"
    xi, eta = f"atan2({t}, cos({lam}))", f"atanh(sin({lam}) / sqrt(1 + pow({t}, 2)))"
    east, north = eta, xi
    for k, c in enumerate((n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240), 1):
        east += f" + {real(c)} * cos({2 * k} * {xi}) * sinh({2 * k} * {eta})"
        north += f" + {real(c)} * sin({2 * k} * {xi}) * cosh({2 * k} * {eta})"
    return f"500000 + {real(scale)} * ({east})", f"CASE WHEN {south} THEN 10000000 ELSE 0 END + {real(scale)} * ({north})"


UTM_X, UTM_Y = utm("x", "y", "(floor((x + 180) / 6) + 1)", "y < 0")
_X, _Y = utm("r.x", "r.y", "zone", "south")
_V, _PTS, _SEGS = LINES.split(",\npts AS ")[0], "(" + LINES.split(",\npts AS (")[1].split(",\nsegs AS ")[0], LINES.split(",\nsegs AS ")[1]
#: Lines projected to the UTM zone of their middle.
UTM_LINES = f"""{_V}, raw AS {_PTS}, middle AS (SELECT floor(((min(x) + max(x)) / 2 + 180) / 6) + 1 AS zone, (min(y) + max(y)) / 2 < 0 AS south FROM raw),
pts AS MATERIALIZED (SELECT fid, label, k, {_X} AS x, {_Y} AS y FROM raw r, middle), segs AS {_SEGS}"""
#: Parts of eight points of lines in web mercator metres; a part's lines end with it.
MERCATOR_PARTS = f"""{_V}, raw AS {_PTS},
pts AS MATERIALIZED (SELECT fid, label, k, (k - 1) // 8 AS part, 6378137 * radians(x) AS x, 6378137 * ln(tan(pi() / 4 + radians(y) / 2)) AS y FROM raw),
segs AS (SELECT a.fid, a.label, a.k, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM pts a JOIN pts b ON a.fid = b.fid AND b.k = a.k + 1 AND a.part = b.part)"""


def road_match(reach: float) -> str:
    one, two = mod180("b.x - a.x", "b.y - a.y"), mod180("a.x - c.x", "a.y - c.y")
    return f"""WITH {MERCATOR_PARTS}, vert AS (SELECT a.fid, a.x, a.y, CASE WHEN b.x IS NULL THEN {two} ELSE {one} END AS d
  FROM pts a LEFT JOIN pts b ON b.fid = a.fid AND b.k = a.k + 1 AND a.part = b.part LEFT JOIN pts c ON c.fid = a.fid AND c.k = a.k - 1 AND a.part = c.part WHERE a.label < 5),
ref AS (SELECT ax, ay, bx, by_, {mod180('bx - ax', 'by_ - ay')} AS d, (bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) AS q FROM segs WHERE label >= 5),
near AS (SELECT v.fid, v.x - (ax + t * (bx - ax)) AS ex, v.y - (ay + t * (by_ - ay)) AS ey, least(abs(v.d - rd), 180 - abs(v.d - rd)) AS gap
  FROM (SELECT vert.*, ax, ay, bx, by_, ref.d AS rd, CASE WHEN q = 0 THEN 0 ELSE greatest(0, least(1, ((vert.x - ax) * (bx - ax) + (vert.y - ay) * (by_ - ay)) / q)) END AS t
        FROM vert JOIN ref ON vert.x BETWEEN least(ax, bx) - {reach} AND greatest(ax, bx) + {reach} AND vert.y BETWEEN least(ay, by_) - {reach} AND greatest(ay, by_) + {reach}) v),
hit AS (SELECT DISTINCT fid FROM near WHERE sqrt(ex * ex + ey * ey) < {reach} AND gap <= 30),
sized AS (SELECT fid, sum(sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay))) AS length FROM segs WHERE label < 5 GROUP BY fid)
SELECT round(sum(length), 1) AS total_length, round(coalesce(sum(length) FILTER (WHERE hit.fid IS NOT NULL), 0), 1) AS matched_length,
round(100 * coalesce(sum(length) FILTER (WHERE hit.fid IS NOT NULL), 0) / sum(length), 4) AS coverage FROM sized LEFT JOIN hit USING (fid)"""


def corner(node: str, a: str, b: str) -> str:
    """Whole degrees between the rays from a node to two points, each a struct."""
    d = lambda p, c: f"({p}.{c} - {node}.{c})"
    size = f"sqrt(({d(a, 'x')} * {d(a, 'x')} + {d(a, 'y')} * {d(a, 'y')}) * ({d(b, 'x')} * {d(b, 'x')} + {d(b, 'y')} * {d(b, 'y')}))"
    cos = f"({d(a, 'x')} * {d(b, 'x')} + {d(a, 'y')} * {d(b, 'y')}) / {size}"
    return f"CASE WHEN {size} > 0 THEN CAST(round_even(degrees(acos(greatest(-1, least(1, {cos})))), 0) AS INTEGER) END"


#: Lines whose ends lie on two digits: first and last points (s, t) and those next to them (s2, t2).
ENDS = f"""{LINES}, r AS (SELECT fid, label, {{'x': round(e[1], 2) + 0.0, 'y': round(e[2], 2) + 0.0}} AS s, {{'x': e[3], 'y': e[4]}} AS s2,
 {{'x': round(e[len(e) // 2 * 2 - 1], 2) + 0.0, 'y': round(e[len(e) // 2 * 2], 2) + 0.0}} AS t, {{'x': e[len(e) // 2 * 2 - 3], 'y': e[len(e) // 2 * 2 - 2]}} AS t2 FROM v)"""
CONTACTS = f"""{ENDS}, c AS (SELECT a.fid AS a, b.fid AS b, CASE WHEN a.s = b.t THEN 1 WHEN a.s = b.s THEN 2 WHEN a.t = b.s THEN 3 WHEN a.t = b.t THEN 4 ELSE 0 END AS kind,
 a.s AS as_, a.s2 AS as2, a.t AS at_, a.t2 AS at2, b.s2 AS bs2, b.t2 AS bt2 FROM r a JOIN r b ON a.fid < b.fid)"""
PAIRED = f"""WITH RECURSIVE {ENDS}, ends AS (SELECT fid, label, 0 AS last, s AS at_, s2 AS to_ FROM r UNION ALL SELECT fid, label, 1, t, t2 FROM r),
pairs AS (SELECT * FROM (SELECT a.fid, a.last, b.fid AS fid2, b.last AS last2, {corner('a.at_', 'a.to_', 'b.to_')} AS angle FROM ends a JOIN ends b ON a.label = b.label AND a.at_ = b.at_ AND a.fid <> b.fid) WHERE angle >= 60),
pick AS (SELECT fid, last, fid2, last2 FROM (SELECT *, row_number() OVER (PARTITION BY fid, last ORDER BY angle DESC, fid2, last2) AS nth FROM pairs) WHERE nth = 1),
ways AS (SELECT DISTINCT a.fid AS p, a.fid2 AS q FROM pick a JOIN pick b ON a.fid = b.fid2 AND a.last = b.last2 AND a.fid2 = b.fid AND a.last2 = b.last),
reach AS (SELECT fid AS id, fid AS m FROM r UNION SELECT ways.q, reach.m FROM reach JOIN ways ON reach.id = ways.p)
SELECT id AS fid, min(m) AS stroke FROM reach GROUP BY id"""


def _turn(p: str, q: str, r: str) -> str:
    (px, py), (qx, qy), (rx, ry) = (x.split() for x in (p, q, r))
    return f"sign(({qx} - {px}) * ({ry} - {py}) - ({qy} - {py}) * ({rx} - {px}))"


NEAR = f"""WITH {_V}, raw AS {_PTS}, pts AS MATERIALIZED (SELECT fid, label, k, x + {real(0.3)} * CAST(fid % 150 AS DOUBLE) AS x, y + {real(0.3)} * floor(fid / 150) AS y FROM raw), segs AS MATERIALIZED {_SEGS},
box AS (SELECT fid, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2 FROM pts GROUP BY fid),
near AS (SELECT a.fid AS f, b.fid AS g FROM box a JOIN box b ON a.fid < b.fid AND a.x2 >= b.x1 AND b.x2 >= a.x1 AND a.y2 >= b.y1 AND b.y2 >= a.y1),
met AS (SELECT DISTINCT f, g FROM near JOIN segs a ON a.fid = f JOIN segs b ON b.fid = g
 WHERE greatest(a.ax, a.bx) >= least(b.ax, b.bx) AND greatest(b.ax, b.bx) >= least(a.ax, a.bx) AND greatest(a.ay, a.by_) >= least(b.ay, b.by_) AND greatest(b.ay, b.by_) >= least(a.ay, a.by_)
 AND {_turn('a.ax a.ay', 'a.bx a.by_', 'b.ax b.ay')} * {_turn('a.ax a.ay', 'a.bx a.by_', 'b.bx b.by_')} <= 0
 AND {_turn('b.ax b.ay', 'b.bx b.by_', 'a.ax a.ay')} * {_turn('b.ax b.ay', 'b.bx b.by_', 'a.bx a.by_')} <= 0)
SELECT f AS src, g AS dst FROM met UNION ALL SELECT g, f FROM met"""


def connectivity(*regions: int) -> str:
    inside = lambda n: f"(SELECT n_nationkey FROM nation WHERE n_regionkey < {n})"
    ctes = ", ".join(f"e{n}_0 AS (SELECT * FROM d0 WHERE i IN {inside(n)} AND j IN {inside(n)}), {closure(f'e{n}_')}" for n in regions)
    rows = " UNION ALL ".join(f"SELECT 'regions{n}' AS method, round(coalesce(avg(d5.d / e.d), CAST('inf' AS DOUBLE)), 6) AS efficiency FROM d5 JOIN e{n}_5 e USING (i, j) WHERE d5.d > 0 AND e.d > 0" for n in regions)
    return f"{PATHS}, {ctes} {rows}"


ORACLES = {
    "dual_graph_edges": f"WITH {EDGES} SELECT src, dst FROM edges",
    "vertex_dual_graph": f"WITH {LINES}, q AS (SELECT DISTINCT fid, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y FROM pts) SELECT DISTINCT a.fid AS src, b.fid AS dst FROM q a JOIN q b USING (x, y) WHERE a.fid < b.fid",
    "node_similarity": f"WITH {NODES}, {SIM} SELECT id, round(sim, 6) AS sim FROM sim",
    "node_similarity_multi": f"""WITH {NODES}, ends AS (SELECT min(length) AS l0, max(length) AS l1, min(fclass) AS f0, max(fclass) AS f1 FROM nodes),
d AS (SELECT id, sqrt(pow((length - l0) / (l1 - l0) - 1, 2) + pow((fclass - f0) / (f1 - f0) - 1, 2)) AS d FROM nodes, ends)
SELECT id, round(1 - d / (SELECT max(d) FROM d), 6) AS sim FROM d""",
    "transition_matrix": f"{BASE} SELECT src, dst, round(p, 6) AS p FROM p",
    "adjacency": f"{BASE} SELECT src, dst, CAST(1 AS DOUBLE) AS a FROM p WHERE p <> 0",
    "column_normalise": f"{BASE} SELECT src, dst, round(CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY dst), 6) AS v FROM p WHERE p <> 0",
    "reversed_weighted_graph": f"{BASE} SELECT dst AS s, src AS t, round(p * sim, 6) AS w FROM p JOIN sim ON id = dst WHERE p <> 0",
    "induced_subgraph": f"""WITH nodes AS (SELECT p_partkey AS id, p_retailprice AS length FROM part WHERE p_size <= 25), m AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS n FROM lineitem),
edges AS (SELECT DISTINCT a.n AS src, b.n AS dst FROM m a JOIN m b ON a.k = b.k WHERE a.n <> b.n AND a.n IN (SELECT id FROM nodes) AND b.n IN (SELECT id FROM nodes)), {SIM}, {TRANS}
SELECT dst AS s, src AS t, round(p * sim, 6) AS w FROM p JOIN sim ON id = dst WHERE p <> 0""",
    "pagerank_1": pagerank(1),
    "pagerank_3": pagerank(3),
    "pagerank_diff": f"{BASE}, {pagerank_ctes(3)} SELECT round(sqrt(sum(pow(a.value - b.value, 2))), 6) AS diff FROM x3 a JOIN x2 b USING (id)",
    "qwalk_start": f"{BASE}, {walk_ctes(0)} SELECT i, j, round(a, 9) AS a FROM s0",
    "qwalk_step1": f"{BASE}, {walk_ctes(1)} SELECT i, j, round(a, 9) AS a FROM s1",
    "qwalk_avg3": quantum(3),
    "qwalk_norm": f"{BASE}, {walk_ctes(2)} SELECT round(sum(a * a), 6) AS norm FROM s2",
    "qwalk_change": f"{BASE}, {walk_ctes(2)} SELECT round(sqrt(sum(pow(x.a - y.a, 2))), 6) AS delta, round(degrees(acos(greatest(-1, least(1, sum(x.a * y.a) / sqrt(sum(x.a * x.a) * sum(y.a * y.a)))))), 4) AS angle FROM s2 x JOIN s1 y USING (i, j)",
    "topk_ranking": f"{BASE}, {pagerank_ctes(1)} SELECT id, row_number() OVER (ORDER BY round(value, 9) DESC, id DESC) AS position FROM x1",
    "polyline_length": f"WITH {LINES} SELECT fid, round(sum(sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay))), 6) AS length FROM segs GROUP BY fid",
    "vertex_direction": f"WITH {LINES} SELECT a.fid, CAST(a.k - 1 AS INTEGER) AS at, round(CASE WHEN b.x IS NULL THEN {mod180('a.x - c.x', 'a.y - c.y')} ELSE {mod180('b.x - a.x', 'b.y - a.y')} END, 4) AS direction FROM pts a LEFT JOIN pts b ON b.fid = a.fid AND b.k = a.k + 1 LEFT JOIN pts c ON c.fid = a.fid AND c.k = a.k - 1",
    "bounds": f"WITH {LINES} SELECT min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM pts",
    "project_3857": f"WITH {LINES} SELECT fid, CAST(k - 1 AS INTEGER) AS at, round(6378137 * radians(x), 3) AS x, round(6378137 * ln(tan(pi() / 4 + radians(y) / 2)), 3) AS y FROM pts",
    "endpoint_contact": f"""WITH {LINES}, q AS (SELECT fid, e, len(e) // 2 AS n FROM v), r AS (SELECT fid, round(e[1], 2) + 0.0 AS sx, round(e[2], 2) + 0.0 AS sy, round(e[2 * n - 1], 2) + 0.0 AS tx, round(e[2 * n], 2) + 0.0 AS ty FROM q),
c AS (SELECT a.fid AS a, b.fid AS b, CASE WHEN a.sx = b.tx AND a.sy = b.ty THEN 1 WHEN a.sx = b.sx AND a.sy = b.sy THEN 2 WHEN a.tx = b.sx AND a.ty = b.sy THEN 3 WHEN a.tx = b.tx AND a.ty = b.ty THEN 4 ELSE 0 END AS kind FROM r a JOIN r b ON a.fid < b.fid)
SELECT a, b, CAST(kind AS INTEGER) AS kind FROM c WHERE kind > 0""",
    "grid_density": f"WITH {GRID}, orig AS ({density('true')}) SELECT grid_id, round(road_length, 6) AS road_length, round(density, 4) AS density FROM orig",
    "retain_rate": f"WITH {DENSITY_PAIRS} SELECT grid_id, round(retain, 6) AS retain FROM pairs",
    "density_corr": density_metrics(LINES),
    "buffer_match": f"WITH {COVER} SELECT fid FROM hit",
    "buffer_match_coverage": f"WITH {COVER} SELECT round(sum(length), 4) AS total_length, round(coalesce(sum(CASE WHEN hit.fid IS NOT NULL THEN length END), 0), 4) AS matched_length, round(100 * coalesce(sum(CASE WHEN hit.fid IS NOT NULL THEN length END), 0) / sum(length), 4) AS coverage FROM sized LEFT JOIN hit USING (fid)",
    "power_fit": """WITH g AS (SELECT o_custkey, sum(o_totalprice) AS s, CAST(count(*) AS DOUBLE) AS r FROM orders GROUP BY 1), l AS (SELECT *, ln(s) AS x, ln(r) AS y FROM g WHERE s > 0),
f AS (SELECT exp(regr_intercept(y, x)) AS a, -regr_slope(y, x) AS b, regr_r2(y, x) AS r2_log, avg(r) AS m FROM l)
SELECT round(a, 6) AS a, round(b, 6) AS b, round(r2_log, 6) AS r2_log, round(1 - sum(pow(r - a * pow(s, -b), 2)) / sum(pow(r - m, 2)), 6) AS r2 FROM l, f GROUP BY a, b, r2_log""",
    "shortest_paths": f"{PATHS} SELECT i, j, CAST(d AS BIGINT) AS d FROM d5",
    "path_efficiency": EFFICIENCY,
    "coo_matmul": f"WITH {A}, {B} SELECT a.row_ AS row_, b.col AS col, round(sum(a.val * b.val), 4) AS val FROM a JOIN b ON a.col = b.row_ GROUP BY 1, 2",
    "coo_matvec": f"WITH {A} SELECT a.row_ AS row_, round(sum(a.val * x.val), 4) AS val FROM a JOIN (SELECT CAST(l_linenumber AS BIGINT) AS k, sum(l_discount) AS val FROM lineitem GROUP BY 1) x ON a.col = x.k GROUP BY 1",
    "coo_scalar": f"WITH {A} SELECT row_, col, val * 2.5 AS val FROM a",
    "complex_scale": f"WITH {A} SELECT row_, col, CAST(val * 0.5 AS DOUBLE) AS re, CAST(val * -1.5 AS DOUBLE) AS im FROM a",
    "coo_minus_identity": f"WITH {SQUARE}, d AS (SELECT row_, col, val FROM a UNION ALL SELECT DISTINCT row_, CAST(row_ AS BIGINT), CAST(-2 AS DOUBLE) FROM a) SELECT CAST(row_ AS BIGINT) AS row_, col, sum(val) AS val FROM d GROUP BY 1, 2",
    "coo_reflection": f"WITH {SQUARE}, d AS (SELECT row_, col, CAST(0 AS DOUBLE) AS re, -sin(pi() / 4) * val AS im FROM a UNION ALL SELECT DISTINCT row_, CAST(row_ AS BIGINT), cos(pi() / 4), CAST(0 AS DOUBLE) FROM a) SELECT CAST(row_ AS BIGINT) AS row_, col, round(sum(re), 6) AS re, round(sum(im), 4) AS im FROM d GROUP BY 1, 2",
    "reclass_fclass": f"SELECT p_partkey AS id, CAST(CASE {FCLASS} WHEN 'motorway' THEN 8 WHEN 'trunk' THEN 7 WHEN 'primary' THEN 6 WHEN 'secondary' THEN 5 WHEN 'tertiary' THEN 4 WHEN 'unclassified' THEN 3 WHEN 'residential' THEN 2 ELSE 1 END AS INTEGER) AS level8, CAST(CASE {FCLASS} WHEN 'motorway' THEN 8 WHEN 'trunk' THEN 7 WHEN 'primary' THEN 7 WHEN 'secondary' THEN 5 WHEN 'tertiary' THEN 4 WHEN 'service' THEN 3 WHEN 'residential' THEN 2 ELSE 1 END AS INTEGER) AS level_link FROM part",
    "merge_layers": "SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, s_nationkey, NULL FROM supplier",
    "drop_fields": "SELECT event_id, event_type, value FROM events",
    "attribute_table": "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, coalesce(p_name, '') AS p_name, coalesce(p_brand, '') AS p_brand, coalesce(CAST(p_size AS VARCHAR), '') AS p_size FROM part",
    "explode_parts": f"WITH {LINES} SELECT fid AS orig_id, CAST(part AS INTEGER) AS part, CAST(count(*) AS INTEGER) AS points FROM (SELECT fid, (k - 1) // 8 AS part FROM pts) GROUP BY 1, 2",
    "safe_float": "SELECT event_id, coalesce(try_cast(event_type AS DOUBLE), 0) AS of_type, coalesce(try_cast(CAST(user_id AS VARCHAR) AS DOUBLE), 0) AS of_user FROM events",
    "parse_props_json": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "max_score_per_road": "SELECT label AS fid, round(max(1 / (1 + exp(-CAST(embedding[1] AS DOUBLE)))), 6) AS score FROM embeddings GROUP BY label",
    "sage_mean_layer": f"WITH {NODES}, {EDGES} SELECT n.id, round(coalesce(m.a, 0), 9) AS mean_length, round(coalesce(m.b, 0), 9) AS mean_fclass FROM nodes n LEFT JOIN (SELECT dst, avg(length) AS a, avg(fclass) AS b FROM edges JOIN nodes ON id = src GROUP BY dst) m ON m.dst = n.id",
    "sage_layer": f"WITH {NODES}, {EDGES}, f AS (SELECT n.id, n.length / 1000 AS x, n.fclass / 50 AS y, coalesce(a, 0) AS mx, coalesce(b, 0) AS my FROM nodes n LEFT JOIN (SELECT dst, avg(length / 1000) AS a, avg(fclass / 50) AS b FROM edges JOIN nodes ON id = src GROUP BY dst) g ON g.dst = n.id) SELECT id, round(greatest(0, 0.5 * x - 0.25 * y + 0.1 * mx + 0.3 * my + CAST('0.0314159265358979' AS DOUBLE)), 6) AS h0, round(greatest(0, -0.2 * x + 0.4 * y + 0.6 * mx - 0.1 * my - CAST('0.0271828182845905' AS DOUBLE)), 6) AS h1 FROM f",
    "train_split": "WITH h AS (SELECT doc_id AS id, row_number() OVER (ORDER BY ((doc_id % 2147483648) * 2654435761) % 4294967296, doc_id) - 1 AS r, count(*) OVER () AS n FROM documents) SELECT id, CASE WHEN r < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN r < floor(n * CAST(0.85 AS DOUBLE)) THEN 'val' ELSE 'test' END AS part FROM h",
    "select_ratios": """WITH s AS (SELECT o_orderkey AS id, CAST(round(o_totalprice) AS BIGINT) AS length FROM orders), c AS (SELECT id, length, sum(length) OVER (ORDER BY length DESC, id DESC ROWS UNBOUNDED PRECEDING) AS upto, sum(length) OVER () AS total FROM s)
SELECT ratio, id, CAST(length AS DOUBLE) AS length FROM c, (SELECT CAST(unnest([0.2, 0.4, 0.6]) AS DOUBLE) AS ratio) WHERE upto - length < ratio * total""",
}
_DEGREES = "2 * 6371008.8 * asin(sqrt(pow(sin(radians(by_ - ay) / 2), 2) + cos(radians(ay)) * cos(radians(by_)) * pow(sin(radians(bx - ax) / 2), 2))) / 1000"
ORACLES |= {
    "node_similarity_noise": f"""WITH {NODES}, ends AS (SELECT min(length) AS lo, max(length) AS hi FROM nodes),
scaled AS (SELECT id, CASE WHEN hi = lo THEN CAST(0 AS DOUBLE) ELSE (length - lo) / (hi - lo) END + {normal(7, 'id')} * {real(0.1)} AS x FROM nodes, ends),
up AS (SELECT id, x - (SELECT least(min(x), 0) FROM scaled) AS x FROM scaled), dist AS (SELECT id, abs(x - (SELECT max(x) FROM up)) AS d FROM up)
SELECT id, round(1 - d / (SELECT max(d) FROM dist), 6) AS sim FROM dist""",
    "sage_noise": f"WITH {NODES} SELECT id, round(length * (1 + {real(0.1)} * {normal(7, 'id', '0')}), 4) AS length FROM nodes",
    "project_utm": f"WITH {LINES} SELECT fid, CAST(k - 1 AS INTEGER) AS at, round({UTM_X}, 3) AS x, round({UTM_Y}, 3) AS y FROM pts",
    "great_circle_km": f"WITH {LINES} SELECT fid, round(sum({_DEGREES}), 6) AS km FROM segs GROUP BY fid",
    "angle_between": f"""WITH {CONTACTS} SELECT a, b, CAST(kind AS INTEGER) AS kind, CASE kind WHEN 1 THEN {corner('as_', 'as2', 'bt2')} WHEN 2 THEN {corner('as_', 'as2', 'bs2')}
 WHEN 3 THEN {corner('at_', 'at2', 'bs2')} ELSE {corner('at_', 'at2', 'bt2')} END AS angle FROM c WHERE kind > 0""",
    "stroke_paired": PAIRED,
    "near_table": NEAR,
    "road_match": road_match(500.0),
    "density_report": density_metrics(UTM_LINES, 4),
    "connectivity": connectivity(3, 4),
    "sampled_pairs": f"SELECT a.n_nationkey AS i, b.n_nationkey AS j FROM nation a, nation b ORDER BY {uniform(11, 'i', 'j')}, i, j LIMIT 100",
    "damped_transition": f"""WITH {NATIONS}, sums AS (SELECT s, CAST(sum(w) AS DOUBLE) AS o FROM trade GROUP BY s)
SELECT a.n_nationkey AS src, b.n_nationkey AS dst, round({ALPHA} * coalesce(w / o, 0) + {REST} / (SELECT count(*) FROM nation), 9) AS p
FROM nation a CROSS JOIN nation b LEFT JOIN trade ON s = a.n_nationkey AND t = b.n_nationkey LEFT JOIN sums ON sums.s = a.n_nationkey""",
    "sum_normalised": f"WITH {NODES} SELECT id, round(length / (SELECT sum(length) FROM nodes), 12) AS value FROM nodes",
    "qwalk_metrics": f"""{BASE}, {walk_ctes(2)}, c AS (SELECT i, j, (s0.a + s1.a) / 2 AS x, (s0.a + s1.a + s2.a) / 3 AS y, s1.a AS u, s2.a AS v FROM s0 JOIN s1 USING (i, j) JOIN s2 USING (i, j))
SELECT round(sqrt(sum(pow(x - y, 2))), 6) AS delta_mean, round(degrees(acos(greatest(-1, least(1, sum(x * y) / sqrt(sum(x * x) * sum(y * y)))))), 4) AS angle_mean, round(avg(abs(x - y)), 9) AS mean_abs,
round(sqrt(sum(pow(u - v, 2))), 6) AS delta, round(degrees(acos(greatest(-1, least(1, sum(u * v) / sqrt(sum(u * u) * sum(v * v)))))), 4) AS angle FROM c""",
    "score_ranking": "SELECT vec_id AS id, row_number() OVER (ORDER BY round(CAST(embedding[1] AS DOUBLE), 2) DESC, vec_id) AS position FROM embeddings",
    "scalar_forms": """SELECT o_orderkey, abs(o_totalprice - round(o_totalprice)) <= 1e-8 + 1e-6 * abs(round(o_totalprice)) AS whole,
CASE WHEN o_orderkey % 64 = 0 THEN '000000' ELSE lpad(bin(o_orderkey % 64), 6, '0') END AS bits, CAST(o_orderkey % 4 * 3 AS INTEGER) AS tiles FROM orders""",
    "numbered_parts": f"WITH {LINES}, q AS (SELECT DISTINCT fid AS orig_id, CAST((k - 1) // 8 AS INTEGER) AS part FROM pts) SELECT orig_id, part, row_number() OVER (ORDER BY orig_id, part) - 1 AS fid FROM q",
}

#: The 4 by 4 matrix that the circuit queries load.
DEMO = np.array([[0.25, 0.45, 0.3, 0.4], [0.3, 0.15, 0.4, 0.4], [0.4, 0.25, 0.1, 0.1], [0.05, 0.15, 0.2, 0.1]])


def simulated(steps: int) -> tuple[str, list[int]]:
    """CTEs g (gates) and s (step, v: all amplitudes after so many gates) of the walk circuit, and
    how many gates prepare the state and make each of its double rounds.

    The gates are the engine's, their application is this query's: a swap is three controlled
    NOTs, every other gate a two by two matrix on its target where its controls hold."""
    r = math.sqrt(0.5)
    rows = []

    def add(target: int, controls: dict[int, int], m: tuple) -> None:
        numbers = [len(rows) + 1, 1 << target, sum(1 << q for q in controls), sum(b << q for q, b in controls.items())]
        rows.append(f"({', '.join(map(str, numbers))}, {', '.join(real(float(x)) for x in m)})")

    start, lengths = circuit.initial_state(DEMO, 0.85)[0], []
    gates, qubits = circuit.walk_circuit(DEMO, 0.85, steps)
    each = (len(gates) - len(start)) // steps
    for k, (name, targets, controls, angle) in enumerate(gates):
        if k >= len(start) and (k - len(start)) % each == 0 or k == len(start):
            lengths.append(len(rows))
        c, z = math.cos(angle / 2), math.sin(angle / 2)
        if name == "swap":
            a, b = targets
            for one, other in ((a, b), (b, a), (a, b)):
                add(other, {**controls, one: 1}, (0, 1, 1, 0))
        else:
            add(targets[0], controls, {"ry": (c, -z, z, c), "h": (r, r, r, -r), "x": (0, 1, 1, 0), "z": (1, 0, 0, -1)}[name])
    lengths.append(len(rows))
    n = 1 << qubits
    new = "CASE WHEN b & cmask <> cval THEN v[b + 1] WHEN b & tmask = 0 THEN m0 * v[b + 1] + m1 * v[(b | tmask) + 1] ELSE m2 * v[xor(b, tmask) + 1] + m3 * v[b + 1] END"
    return f"""g(step, tmask, cmask, cval, m0, m1, m2, m3) AS (VALUES {', '.join(rows)}),
s AS (SELECT 0 AS step, [CAST(CASE WHEN b = 0 THEN 1 ELSE 0 END AS DOUBLE) for b in range({n})] AS v
  UNION ALL SELECT g.step, [{new} for b in range({n})] FROM s JOIN g ON g.step = s.step + 1),
p AS (SELECT step, (b >> 1 & 1) * 2 + (b >> 2 & 1) AS node, sum(v[b + 1] * v[b + 1]) AS prob FROM s, (SELECT unnest(range({n})) AS b) WHERE step IN ({', '.join(map(str, lengths))}) GROUP BY 1, 2)""", lengths


#: The polygon that lines are clipped to.
POLYGON = [(-0.15, -0.15), (0.15, -0.15), (0.2, 0.1), (0.0, 0.2), (-0.15, 0.15)]
_RING = ", ".join(f"({real(ax)}, {real(ay)}, {real(bx)}, {real(by)})" for (ax, ay), (bx, by) in zip(POLYGON, [*POLYGON[1:], POLYGON[0]], strict=True))
_CROSS = "((bx - ax) * (ry2 - ry) - (by_ - ay) * (rx2 - rx))"
CLIP = f"""WITH {LINES}, ring(rx, ry, rx2, ry2) AS (VALUES {_RING}),
hits AS (SELECT fid, k, ((rx - ax) * (ry2 - ry) - (ry - ay) * (rx2 - rx)) / {_CROSS} AS t, ((rx - ax) * (by_ - ay) - (ry - ay) * (bx - ax)) / {_CROSS} AS u FROM segs, ring WHERE {_CROSS} <> 0),
cuts AS (SELECT fid, k, t FROM hits WHERE t > 0 AND t < 1 AND u >= 0 AND u <= 1 UNION SELECT fid, k, CAST(unnest([0, 1]) AS DOUBLE) FROM segs),
pieces AS (SELECT * FROM (SELECT fid, k, t, lead(t) OVER (PARTITION BY fid, k ORDER BY t) AS t1 FROM cuts) WHERE t1 IS NOT NULL),
mid AS (SELECT fid, k, t, ax + (t + t1) / 2 * (bx - ax) AS x, ay + (t + t1) / 2 * (by_ - ay) AS y FROM pieces JOIN segs USING (fid, k)),
ins AS (SELECT fid, k, t, count(*) FILTER (WHERE (ry > y) <> (ry2 > y) AND x < (rx2 - rx) * (y - ry) / (ry2 - ry) + rx) % 2 = 1 AS i FROM mid, ring GROUP BY fid, k, t),
marked AS (SELECT fid, k, t, i, CASE WHEN i AND NOT coalesce(lag(i) OVER (PARTITION BY fid ORDER BY k, t), false) THEN 1 ELSE 0 END AS first FROM ins),
placed AS (SELECT fid, i, sum(first) OVER (PARTITION BY fid ORDER BY k, t) - 1 AS part FROM marked)
SELECT fid, CAST(part AS INTEGER) AS part, CAST(count(*) + 1 AS INTEGER) AS n_points FROM placed WHERE i GROUP BY fid, part"""

_CIRCUIT, _AFTER = simulated(3)
ORACLES |= {
    "clip_to_boundary": CLIP,
    "measure_marginal": f"WITH RECURSIVE {_CIRCUIT} SELECT CAST(node AS BIGINT) AS node, round(prob, 9) AS prob FROM p WHERE step = {_AFTER[0]}",
    "circuit_averages": f"""WITH RECURSIVE {_CIRCUIT}, k AS (SELECT CASE step {' '.join(f'WHEN {n} THEN {i}' for i, n in enumerate(_AFTER))} END AS step, node, prob FROM p),
a AS (SELECT step, node, avg(prob) OVER (PARTITION BY node ORDER BY step) AS average FROM k WHERE step > 0)
SELECT CAST(step AS INTEGER) AS step, CAST(node AS BIGINT) AS node, round(average, 9) AS average, round(average - coalesce(lag(average) OVER (PARTITION BY node ORDER BY step), 0), 9) AS delta FROM a""",
}
