"""Every registered query with SQL against that SQL, on the smallest tables."""

import glob
import os

import pytest

from arterial.plans import registry

DATA = "/root/testdata/sf0.001"
#: Queries whose joins are wide are left to the driver's larger run.
QUICK = [
    "dual_graph_edges", "node_similarity", "node_similarity_multi", "transition_matrix", "column_normalise", "reversed_weighted_graph", "induced_subgraph",
    "pagerank_1", "qwalk_start", "topk_ranking", "select_ratios", "polyline_length", "vertex_direction", "bounds", "project_3857", "endpoint_contact",
    "grid_density", "density_corr", "power_fit", "coo_matmul", "coo_minus_identity", "reclass_fclass", "merge_layers", "attribute_table", "explode_parts",
    "safe_float", "parse_props_json", "max_score_per_road", "sage_mean_layer", "train_split", "measure_marginal", "circuit_averages", "clip_to_boundary",
    "node_similarity_noise", "sage_noise", "project_utm", "great_circle_km", "angle_between", "stroke_paired", "near_table", "road_match", "density_report",
    "sampled_pairs", "damped_transition", "sum_normalised", "score_ranking", "scalar_forms", "numbered_parts",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def rows(df):
    shown = lambda v: str(round(v, 9) + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(shown(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", QUICK)
def test_query_agrees_with_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_names():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_flagship(spark):
    assert 0 < registry.flagship(spark, DATA).count() < 200
