"""Five roads with known results to eight digits."""

import math

import pytest

from arterial.operators import graph, rank, select

LENGTHS = {1: 10.0, 2: 6.0, 3: 4.0, 4: 2.0, 5: 1.0}
CONTACTS = [(1, 2), (1, 3), (2, 3), (3, 4), (4, 5)]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame(list(LENGTHS.items()), "id long, length double").cache()


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(CONTACTS + [(b, a) for a, b in CONTACTS], "src long, dst long").cache()


@pytest.fixture(scope="module")
def sim(nodes):
    return graph.similarity(nodes).cache()


@pytest.fixture(scope="module")
def p(edges, sim):
    return graph.transition(edges, sim).cache()


def values(df):
    return {r[0]: r[1] for r in df.collect()}


def close(got, want, digits=8):
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=0.6 * 10**-digits), k


def test_similarity(sim):
    close(values(sim), {1: 1, 2: 0.55555556, 3: 0.33333333, 4: 0.11111111, 5: 0})


def test_transition(p):
    got = {(r.src, r.dst): r.p for r in p.collect()}
    close(got, {(1, 2): 0.625, (1, 3): 0.375, (2, 1): 0.75, (2, 3): 0.25, (3, 1): 0.6, (3, 2): 0.33333333, (3, 4): 0.06666667, (4, 3): 1, (4, 5): 0, (5, 4): 1})


@pytest.mark.parametrize(
    ("steps", "want", "norm"),
    [
        (1, [0.58416667, 0.68569444, 0.59125, 0.07888889, 0.06], 0.5108940889),
        (3, [0.63695941, 0.61433337, 0.55169899, 0.13700823, 0.06], 0.2016257186),
    ],
)
def test_pagerank(p, sim, steps, want, norm):
    got, norms = rank.pagerank(p, sim.withColumnRenamed("sim", "value"), 0.85, steps, tol=-1.0)
    close(values(got), dict(enumerate(want, 1)))
    assert norms[-1] == pytest.approx(norm, abs=1e-9)


def test_pagerank_settles_and_selects(p, sim, nodes):
    got, norms = rank.pagerank(p, sim.withColumnRenamed("sim", "value"), 0.85, 100, tol=2e-4)
    assert len(norms) < 100
    close(values(got), {1: 0.69628604, 2: 0.57850649, 3: 0.52448657, 4: 0.14072091, 5: 0.06}, 3)
    assert sum(values(got).values()) == pytest.approx(2.0, abs=1e-9)
    chosen = select.select_by_length(got, nodes).collect()
    assert sorted((r.ratio, r.id) for r in chosen) == [(0.2, 1), (0.4, 1), (0.6, 1), (0.6, 2)]
    assert [r.id for r in rank.ranked(got).orderBy("position").collect()] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize(
    ("steps", "want"),
    [(1, [0.37690876, 0.34699916, 0.32948557, 0.22074485, 0.03]), (3, [0.3844871, 0.33467823, 0.33103493, 0.22453015, 0.03])],
)
def test_quantum_walk(p, nodes, steps, want):
    close(values(rank.quantum_pagerank(p, nodes, 0.85, steps)), dict(enumerate(want, 1)))


def test_walk_keeps_its_norm(p):
    state = rank.walk_step(rank.walk_start(p))
    assert sum(r.a**2 for r in state.collect()) == pytest.approx(1.0)
    change = rank.state_change(state, rank.walk_start(p)).first()
    assert change.delta == pytest.approx(2 * math.sin(math.radians(change.angle) / 2), abs=1e-9)


def test_weighted_digraph(p, sim):
    got = {(r.s, r.t): r.w for r in graph.weighted_digraph(p, sim).collect()}
    close(got, {(2, 1): 0.347222, (3, 1): 0.125, (1, 2): 0.75, (3, 2): 0.083333, (1, 3): 0.6, (2, 3): 0.185185, (4, 3): 0.007407, (3, 4): 0.333333, (4, 5): 0.111111}, 6)


def test_induced_subgraph_weights(edges, nodes, spark):
    chosen = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    plain = {(r.s, r.t): r.w for r in graph.induced_subgraph(edges, nodes, chosen, compat=True).collect()}
    assert plain[(1, 3)] == pytest.approx(0.75)
    scaled = {(r.s, r.t): r.w for r in graph.induced_subgraph(edges, nodes, chosen).collect()}
    assert scaled[(1, 3)] == pytest.approx(0.75) and (3, 1) not in scaled


def test_equal_lengths_and_noise(spark, nodes):
    flat = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id long, length double")
    assert values(graph.similarity(flat)) == {1: 1.0, 2: 1.0}
    a, b = values(graph.similarity(nodes, noise=0.1)), values(graph.similarity(nodes, noise=0.1))
    assert a == b and max(a.values()) == 1.0 and min(a.values()) == 0.0


def test_missing_node_raises(spark, sim):
    with pytest.raises(Exception, match="no similarity"):
        graph.transition(spark.createDataFrame([(1, 99)], "src long, dst long"), sim).collect()
