"""Shared pieces of the text operators: written tables, Arrow helpers, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofield.session import scratch_path


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back.

    This cuts the lineage: a lost executor costs a read of the written files,
    not a new run of what made them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def binary_texts(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null counts as the empty text."""
    return [v or b"" for v in column.cast("binary").to_pylist()]


def small(batch: pa.RecordBatch, column: int, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts in ``column`` have about ``size`` bytes; a longer text is a slice of its own."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    group = (np.cumsum(lengths) - lengths) // size
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    for lo, hi in zip(starts, [*starts[1:], len(lengths)]):
        yield batch.slice(lo, hi - lo)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of ``edges`` (a, b).

    Every round points each node at its smallest neighbour, follows the
    pointers to their ends, and contracts the edges to those ends.  A chain of
    pointers shortens to a quarter per pass and every component of two or more
    nodes loses at least half of them per round, so both loops are logarithmic.
    The driver sees one flag per pass.  Nodes without an edge are absent.
    """
    a, b = F.col("a"), F.col("b")
    left = shared_table(
        edges.filter(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges"
    )
    maps: list[DataFrame] = []
    while not left.isEmpty():
        ends = left.select(a.alias("node"), b.alias("other")).union(left.select(b, a))
        to = shared_table(
            ends.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("to")), "parents"
        )
        while True:
            twice = _follow(to, to)
            four = _follow(twice, twice.select("node", "to")).withColumn("moved", F.col("to") != F.col("before"))
            to = shared_table(four.select("node", "to", "moved"), "pointers")
            if to.filter("moved").isEmpty():
                break
            to = to.drop("moved")
        to = to.select("node", "to")
        maps.append(to)
        left = shared_table(
            left.join(to.select(F.col("node").alias("a"), F.col("to").alias("_a")), "a")
            .join(to.select(F.col("node").alias("b"), F.col("to").alias("_b")), "b")
            .filter(F.col("_a") != F.col("_b"))
            .select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(),
            "edges",
        )
    if not maps:
        return left.select(a.alias("node"), a.alias("root"))
    found = maps[0].select("node", F.col("to").alias("root"))
    for later in maps[1:]:
        step = later.select(F.col("node").alias("root"), F.col("to").alias("_next"))
        found = found.join(step, "root", "left").select("node", F.coalesce("_next", "root").alias("root"))
    return found


def _follow(start: DataFrame, pointers: DataFrame) -> DataFrame:
    """(node, to, before): where each pointer of ``start`` leads after one step of ``pointers``.

    An end points at itself.
    """
    step = pointers.select(F.col("node").alias("_at"), F.col("to").alias("_to"))
    return start.join(step, F.col("to") == F.col("_at")).select(
        "node", F.col("_to").alias("to"), F.col("to").alias("before")
    )
