import duckdb
import pytest

import __spark_entry__ as entry
from check import compare
from cairn.fixtures import TABLES, Tables
from cairn.operators import rules as R
from cairn.plans.lineage import ensure_checkpoint_dir
from tests.conftest import SMALL

SAMPLE = [
    "station_inside_polygon", "observation_rules_added_errors", "dated_recode", "merge_update_coordinates", "error_summary_by_levels",
    "bilinear_grid_value", "bicubic_grid_value", "frame_transformation", "station_pairs_in_range", "nearest_neighbours", "order_pair_status",
    "horizontal_direction", "round_orientation_eliminated", "station_text_ingest", "observation_csv_ingest", "solution_file_ingest",
    "positions_by_bearing_intersection", "level_normal_matrix",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, duck, name):
    frame = entry.queries()[name](spark, SMALL)
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert compare(frame.columns, [tuple(r) for r in frame.collect()], names, result.fetchall()) is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.FLAGSHIP in entry.queries()


def test_entry_runs(spark):
    frame = entry.entry(spark)
    assert frame.count() > 0
    assert frame.columns[:2] == ["data_file", "class_method"]


def test_rules_leave_plain_rows_alone(spark):
    t = Tables(spark, SMALL)
    out = R.apply_rules(t.mixed, [])
    assert out.count() == t.mixed.count()
    assert out.filter("error_factor <> 1.0 OR ignored").count() == 0


def test_checkpoints_use_the_named_folder(spark):
    assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)


def test_top_k_is_limited_below_the_shuffle(spark):
    plan = entry.queries()["worst_residuals"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
