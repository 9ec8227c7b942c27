"""The quantum walk held by its nodes against the walk over all cells."""

import math
import random
from pathlib import Path

import pytest

from arterial.operators import rank
from arterial.operators.iterate import CLEAN_SHUFFLES
from arterial.plans.registry import QUERIES


@pytest.fixture(scope="module")
def p(spark):
    """Rows that don't add up to 1, arcs of one direction, a loop, a 0, a node on its own pair."""
    rng = random.Random(4)
    arcs = {(rng.randrange(30), rng.randrange(30)) for _ in range(160)} | {(7, 7), (100, 101)}
    rows = [(a, b, rng.random() / 4) for a, b in sorted(arcs)] + [(100, 102, 0.0)]
    return spark.createDataFrame(rows, "src long, dst long, p double").localCheckpoint()


@pytest.fixture(scope="module")
def both(p):
    """States 0 to 3 as cells and as nodes, and the pairs."""
    cells = [rank.walk_start(p).localCheckpoint()]
    for _ in range(3):
        cells.append(rank.walk_step(cells[-1]).localCheckpoint())
    pairs = rank.walk_pairs(p)
    return cells, rank.walk_nodes(pairs, 3, measured=True), pairs


def test_measurements_agree(both):
    for cells, nodes in zip(*both[:2], strict=True):
        got = {r.id: r.m for r in rank.measure_nodes(nodes, 40, 0.85).collect()}
        want = {r.id: r.m for r in rank.measure(cells, 40, 0.85).collect()}
        assert got == pytest.approx(want, abs=1e-12)


def test_changes_and_norm_agree(both):
    cells, nodes, pairs = both
    assert rank.nodes_norm(nodes[2]).first().norm == pytest.approx(sum(r.a * r.a for r in cells[2].collect()))
    assert tuple(rank.nodes_change(nodes[3], nodes[2]).first()) == pytest.approx(tuple(rank.state_change(cells[3], cells[2]).first()))
    for n in (2, 4):
        assert tuple(rank.nodes_metrics(pairs, nodes[:n]).first()) == pytest.approx(tuple(rank.state_metrics(cells[:n]).first()))
    with pytest.raises(ValueError):
        rank.nodes_metrics(pairs, nodes[:1])


def test_no_arcs(spark, p):
    nodes = spark.createDataFrame([(1,), (2,)], "id long")
    assert [r.value for r in rank.quantum_pagerank(p.where("false"), nodes, 0.85, 2).collect()] == pytest.approx([0.075] * 2)


def written(spark) -> int:
    folder = spark.sparkContext.getCheckpointDir()
    return sum(f.stat().st_size for f in Path(folder.removeprefix("file:")).rglob("*") if f.is_file()) if folder else 0


@pytest.mark.parametrize("name", ["qwalk_avg3", "qwalk_change", "qwalk_metrics", "qwalk_norm"])
def test_cells_are_written_once(spark, name):
    folder = "/root/testdata/sf0.001"
    cells, before, setting = QUERIES["dual_graph_edges"](spark, folder).count(), written(spark), spark.conf.get(CLEAN_SHUFFLES)
    rows = QUERIES[name](spark, folder).collect()
    assert rows and all(x is not None and math.isfinite(x) for r in rows for x in r)
    assert written(spark) - before < 24 * cells and spark.conf.get(CLEAN_SHUFFLES) == setting
