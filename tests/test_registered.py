"""Registered queries against their SQL on the small tables.

By default a spread of queries runs; ``ALL_QUERIES=1`` runs every one.
"""

import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

import __spark_entry__ as entry  # noqa: E402
from check import TABLES, table_of  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
SPREAD = ["dominant_color", "palette_info", "detect_background", "trim_transparent", "slice_tiles", "assemble_images", "fn_lab",
          "fn_seam_distance", "nearest_palette", "kmeans_palette_lab", "median_cut_palette", "block_representative_auto",
          "finalist_reduce_mixed", "fit_frames_contain", "ascii_text", "detect_pitch", "grid_vote", "suggest_tile_grids",
          "sharpen", "contour_candidates", "local_delta", "material_maps", "connected_components_tiled", "structure_probe",
          "dark_features", "connected_palette", "grid_quality", "asset_search", "reconcile_catalog", "path_conflicts", "full_recipes",
          "branch_rows", "merge_plan", "resolve_linked_cels", "validate_recipes", "step_report", "composite_cels",
          "layers_in_band", "stream_latest_revision", "revision_conflicts", "online_sessions"]


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", list(SQL) if os.environ.get("ALL_QUERIES") else SPREAD)
def test_matches_sql(spark, engine, name):
    df = QUERIES[name](spark, SF)
    result = engine.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert table_of(df.columns, df.collect()) == table_of(names, result.fetchall())


def test_entry_has_rows(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(len(r.top_colors) == 3 for r in rows)


def test_names_are_registered():
    assert set(SQL) <= set(QUERIES)
    assert set(SPREAD) <= set(SQL)
