"""Looking at the row before or after within a long ordered history.

A window over a key puts the key's whole history in one task.  Here the
history is cut into blocks of steps that many tasks order at once, and only the ends of
the blocks are ordered per key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 1024
CUTS = 256


def beside(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    columns: Sequence[str],
    side: str = "previous",
    bucket: Column | None = None,
    most: int | None = None,
) -> DataFrame:
    """Add ``<side>_<column>`` from the key's previous or next row in ``order``; null at the end.

    ``bucket`` is a coarse form of the first order column (default: blocks of
    BLOCK steps of it).  Rows are looked at within (key, bucket).  The first
    and last rows of all buckets, two per bucket at most, are then looked at
    per key, which joins each bucket to its neighbour.  A bucket of a key with
    more than ``most`` rows is cut in up to CUTS pieces at quantiles of the first
    order column, a number or a time; rows that tie in it stay together.
    """
    near, far = (F.lag, F.lead) if side == "previous" else (F.lead, F.lag)
    cols, order = list(columns), list(order)
    bucket = F.floor(F.col(order[0]) / F.lit(BLOCK)) if bucket is None else bucket
    inside = Window.partitionBy(key, "_b", "_piece").orderBy(*order)
    across = Window.partitionBy(key).orderBy("_b", "_piece", *order)
    cut = _pieces(df.withColumn("_b", bucket), key, order[0], most)
    rows = cut.withColumns({
        **{f"{side}_{c}": near(c).over(inside) for c in cols},
        "_open": near(F.lit(True)).over(inside).isNull(), "_edge": far(F.lit(True)).over(inside).isNull(),
    })
    ends = rows.filter(F.col("_open") | F.col("_edge"))
    carried = ends.withColumns({f"{side}_{c}": near(c).over(across) for c in cols}).filter("_open")
    return rows.filter(~F.col("_open")).unionByName(carried).drop("_b", "_piece", "_open", "_edge")


def _pieces(df: DataFrame, key: str, by: str, most: int | None) -> DataFrame:
    """Add ``_piece``: 0, or the place among the quantiles of ``by`` in a (key, _b) of more than ``most`` rows."""
    if most is None:
        return df.withColumn("_piece", F.lit(0))
    x = F.col(by)
    marks = F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)])
    large = df.groupBy(F.col(key).alias("_k"), F.col("_b").alias("_c")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most)
    # Quantiles are taken of the large buckets alone; where there are none this costs one count.
    inside = F.col(key).eqNullSafe(F.col("_k")) & F.col("_b").eqNullSafe(F.col("_c"))
    large = df.join(large, inside, "left_semi").groupBy(F.col(key).alias("_k"), F.col("_b").alias("_c")).agg(
        F.percentile_approx(x, marks, F.lit(4 * CUTS)).alias("_cuts")
    )
    same = F.col(key).eqNullSafe(F.col("_k")) & F.col("_b").eqNullSafe(F.col("_c"))
    below = F.size(F.filter("_cuts", lambda c: c < x))
    return df.join(large, same, "left").withColumn(
        "_piece", F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(below)
    ).drop("_k", "_c", "_cuts")


def numbered(df: DataFrame, key: str, step: str, block: int = BLOCK) -> DataFrame:
    """Add position (1-based, by step within key) and size (rows of the key)."""
    inside = Window.partitionBy(key, "_b").orderBy(step)
    rows = df.withColumn("_b", F.floor(F.col(step) / F.lit(block))).withColumns({
        "_at": F.row_number().over(inside), "_edge": F.lead(step).over(inside).isNull(),
    })
    # The last row of a block carries its size.
    sizes = rows.filter("_edge").select(key, "_b", F.col("_at").alias("_n"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        key, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy(key)).alias("size"),
    )
    place: Column = F.col("_off") + F.col("_at")
    return rows.join(offsets, [key, "_b"]).select(*df.columns, place.cast("int").alias("position"), "size")


def before_in_ranges(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Add ``previous_<column>`` from the key's previous row in ``order``; null at the start.

    The rows are sorted once over the whole cluster, by key and order, in ranges
    that a sample makes even: a key with most of the rows is spread over many
    tasks, and ties are cut like other rows.  Within a range the row before is
    at hand.  Only the first row of a range may miss it; the first and last rows
    of all ranges, two per task, are looked at together.
    """
    columns = list(columns)
    names = list(dict.fromkeys([key, *order, *columns]))
    ranged = df.select(*names).repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    ranged = ranged.withColumn("_part", F.spark_partition_id())
    schema = T.StructType([*ranged.schema.fields, *(
        T.StructField(f"previous_{c}", ranged.schema[c].dataType) for c in columns
    ), T.StructField("_end", T.IntegerType())])

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
            here = table.slice(0 if last is None else 1)
            n, missing = here.num_rows, 1 if last is None else 0
            above = table.slice(0, n - missing)
            k, before = here.column(key).slice(missing), above.column(key)
            same = pc.if_else(pc.is_null(k), pc.is_null(before), pc.fill_null(pc.equal(k, before), False))
            shifted = []
            for c in columns:
                held = pc.if_else(same, above.column(c), None)
                shifted.append(pa.chunked_array([pa.nulls(missing, held.type), *held.chunks], held.type))
            ends = np.zeros(n, np.int32)
            ends[:missing] = 1
            out = pa.table([*here.columns, *shifted, pa.array(ends)], schema.names)
            yield from out.combine_chunks().to_batches()
            last = batch.slice(batch.num_rows - 1)
        if last is not None:  # the last row again, for the next range
            out = [*last.columns, *(pa.nulls(1, last.column(c).type) for c in columns), pa.array([2], pa.int32())]
            yield pa.RecordBatch.from_arrays(out, schema.names)

    rows = ranged.mapInArrow(shift, schema)
    meet = Window.orderBy("_part", "_end")
    near = F.struct(*[F.lag(c).over(meet).alias(c) for c in dict.fromkeys([key, *columns])])
    ends = rows.filter(F.col("_end") > 0).withColumn("_near", near).filter(F.col("_end") == 1)
    same = F.col("_near")[key].eqNullSafe(F.col(key))
    joined = ends.withColumns({f"previous_{c}": F.when(same, F.col("_near")[c]) for c in columns}).drop("_near")
    return rows.filter(F.col("_end") == 0).unionByName(joined).drop("_part", "_end")
