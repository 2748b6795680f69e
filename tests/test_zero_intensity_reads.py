"""The other queries that read states, on days whose events all have intensity 0, against their SQL."""

from __future__ import annotations

import pytest

from test_queries import pytestmark  # noqa: F401
import test_zero_intensity
from test_zero_intensity import folder  # noqa: F401

NAMES = ["read_snapshot", "read_snapshots", "read_or_default", "quadrant_counts", "summary_stats", "stream_fold_events"]


@pytest.mark.parametrize("name", NAMES)
def test_readers_of_states(spark, folder, name):  # noqa: F811
    test_zero_intensity.test_same_rows_as_sql(spark, folder, name)
