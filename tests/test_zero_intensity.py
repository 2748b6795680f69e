"""Queries on days whose events all have intensity 0, against their SQL."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from test_queries import SF_DIR, plain, pytestmark  # noqa: F401

# Every query with SQL that reads states; two days get no intensity at all.
NAMES = [
    "abc_distance", "abc_accept", "affect_class", "affect_grid", "affect_snapshot_stats", "append_metrics", "append_metrics_again",
    "check_class_consistency", "check_ranges", "class_affect", "class_distribution", "class_entropy", "class_pressure",
    "class_transition", "dominance", "extremism", "fatigue_update_bucketed", "fill_missing_steps", "fragmentation",
    "metrics_history", "polarization", "population_summary", "write_snapshot", "step_metrics", "transition_matrix",
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("zero")
    duckdb.sql(f"""
      COPY (SELECT * FROM '{SF_DIR}/events.parquet'
            UNION ALL SELECT 900000 + i, TIMESTAMP '2024-01-05 12:00:00' + to_days(CAST(i // 2 * 7 AS INTEGER)), 900000,
                             CASE i % 2 WHEN 0 THEN 'purchase' ELSE 'error' END, 0.0e0, '{{"k": 3}}' FROM range(4) t(i))
      TO '{path}/events.parquet'""")
    return str(path)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, folder, name):
    df = entry.queries()[name](spark, folder)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(row[c]) for c in cols) for row in df.collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    rel = con.sql(entry.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(tuple(plain(row[i]) for i in at) for row in rel.fetchall())


def test_spread_of_a_day_without_intensity(spark, folder):
    """DuckDB has no standard deviation of NaN; the rows come all the same, and the other days keep their numbers."""
    rows = entry.queries()["affect_by_step"](spark, folder).collect()
    assert {r.step for r in rows if plain(r.std_valence) == "null"} == {4, 11} and len(rows) == 30
