"""The row before, found in ranges of a sorted table."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from echofield.functions.sequence import before_in_ranges
from echofield.session import setting


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_previous_of_every_row(spark, parts):
    rnd = random.Random(parts)
    # One key has a third of the rows, one is null, one row stands alone; times tie.
    rows = [(rnd.choice([0, 0, 0, 1, 2, 3, None, None]), rnd.randrange(50), i, rnd.choice([f"w{i}", None])) for i in range(600)] + [(99, 1, 600, "x")]
    df = spark.createDataFrame(rows, "k long, t long, id long, who string").repartition(5)
    with setting(spark, "spark.sql.shuffle.partitions", str(parts)), setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
        got = {r.id: (r.k, r.previous_who, r.previous_id) for r in before_in_ranges(df, "k", ["t", "id"], ["who", "id"]).collect()}
    want, last = {}, {}
    for k, t, i, who in sorted(rows, key=lambda r: (r[1], r[2])):
        want[i] = (k, *last.get(k, (None, None)))
        last[k] = who, i
    assert got == want


def test_small_batches_and_no_rows(spark):
    df = spark.range(300).select((F.col("id") % 2).alias("k"), "id", F.timestamp_seconds("id").alias("at"))
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "7"):
        got = {r.id: (r.previous_id, r.previous_at is None) for r in before_in_ranges(df, "k", ["id"], ["id", "at"]).collect()}
    assert got == {i: (i - 2 if i > 1 else None, i < 2) for i in range(300)}
    assert before_in_ranges(df.limit(0), "k", ["id"], ["id"]).count() == 0
