"""Sums of many weightings of the same rows in one pass."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echofield.functions.columns import poisson_unit, uni

HELD = 1 << 22  # numbers of unfinished sums that a task holds


def poisson_weights(b: int, seed: int, salt: str, *keys: Column | str) -> Column:
    """Array of b keyed Poisson(1) weights of a row: the same as ``uni(seed, salt, *keys, repeat)`` inverted."""
    rolls = F.transform(F.sequence(F.lit(1), F.lit(b)), lambda rep: uni(seed, salt, *keys, rep))
    return F.transform(rolls, lambda u: poisson_unit(u).cast("tinyint"))


def weighted_sums(df: DataFrame, by: Sequence[str], weights: Column, values: Sequence[Column], b: int) -> DataFrame:
    """(by..., sums): per group and value, the b sums of weight times value.

    ``weights`` is an array of b numbers per row, ``values`` are numbers without
    nulls; ``sums`` has one array of b sums per value.  Each task multiplies the
    weights of its rows with their values, as matrices, and passes on one row per
    group; those rows are added up in order of the group, one at a time.  No row
    is repeated b times.
    """
    by, width = list(by), len(values)
    rows = df.select(*by, weights.alias("_w"), F.array(*[v.cast("double") for v in values]).alias("_x"))
    schema = T.StructType([rows.schema[c] for c in by] + [
        T.StructField("sums", T.ArrayType(T.ArrayType(T.DoubleType())))
    ])

    def batch_of(held: dict[tuple, np.ndarray], like: pa.Schema) -> pa.RecordBatch:
        columns = [pa.array(list(k), like.field(i).type) for i, k in enumerate(zip(*held))]
        sums = pa.array([list(s) for s in held.values()], pa.list_(pa.list_(pa.float64())))
        return pa.RecordBatch.from_arrays([*columns, sums], schema.names)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            w = batch.column(len(by)).flatten().to_numpy(zero_copy_only=False).reshape(n, b).astype(np.float64)
            x = batch.column(len(by) + 1).flatten().to_numpy(zero_copy_only=False).reshape(n, width)
            places: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in range(len(by)))) if by else [()] * n):
                places.setdefault(key, []).append(i)
            for key, at in places.items():
                part = x[at].T @ w[at] if len(at) < n else x.T @ w
                held[key] = held[key] + part if key in held else part
            if len(held) * b * width > HELD:
                yield batch_of(held, batch.schema)
                held = {}
        if held:
            yield batch_of(held, batch.schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(len(by))]
            for i in range(batch.num_rows):
                own = tuple(c[i] for c in columns)
                part = batch.column(len(by))[i].values.flatten().to_numpy(zero_copy_only=False).reshape(width, b)
                if own == key:
                    total = total + part
                    continue
                if key is not None:
                    yield batch_of({key: total}, batch.schema)
                key, total = own, part
        if key is not None:
            yield batch_of({key: total}, batch.schema)

    parts = rows.mapInArrow(multiply, schema)
    met = parts.repartition(*by).sortWithinPartitions(*by) if by else parts.repartition(1)
    return met.mapInArrow(add, schema)


def array_percentile(sorted_values: Column, p: float) -> Column:
    """Percentile of an ascending array, interpolated at position p (n - 1); null where it is empty."""
    at = (F.size(sorted_values) - 1) * F.lit(float(p))
    low = F.get(sorted_values, F.floor(at).cast("int"))
    high = F.get(sorted_values, F.ceil(at).cast("int"))
    return low + (high - low) * (at - F.floor(at))


def array_deviation(values: Column) -> Column:
    """Sample standard deviation of the numbers in an array, nulls left out; null below two."""
    kept = F.filter(values, lambda x: x.isNotNull())
    n = F.size(kept)
    # The array rides along in the fold, so that it is made once.
    mean = F.aggregate(kept, F.lit(0.0), lambda s, x: s + x, lambda s: F.try_divide(s, n))
    squares = F.aggregate(F.transform(kept, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda s, x: s + x)
    return F.when(n > 1, F.sqrt(squares / (n - 1)))
