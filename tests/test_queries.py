"""Registered queries against their SQL on the smallest tables; tests/check.py runs them all at any size."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare

SF = "/root/testdata/sf0.001"

NAMES = ["sample_report", "sizes_2d", "extents_3d", "support_2d", "overlaps_disks", "overlaps_spheres", "overlaps_one_sample",
         "points_in_particles", "nearest_neighbor", "refreshed_neighbors", "ripley_k", "two_point", "radius_histogram_auto",
         "chi_squared", "voxelize", "periodic_pairs_3d", "conformity", "constraint_terms", "imt_3d", "rve_offset", "overlap_ratio",
         "temperature_stages", "displacement", "place_grid", "phase_problems", "corpus_round_trip", "session_activity"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    message, good = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert good, message


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["sample_id", "n", "total_overlap", "vf"] and df.count() == 2
