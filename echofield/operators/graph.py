"""Degrees, clustering and neighbour aggregates over an edge table (source, target, weight)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofield.functions.columns import total
from echofield.functions.skew import hot_keys, salted_join
from echofield.functions.tables import written

PER_TASK = 1 << 18  # pairs that one task searches for triangles
COLOURS = 4  # never fewer, so that small graphs are searched by several tasks
WEDGES = 1 << 21  # paths of two edges held at once
ITEMS = 1 << 10  # items of a neighbour that travel as one list


def graph_counts(edges: DataFrame) -> DataFrame:
    """One row: num_nodes, num_edges (rows) and average_degree = edges / nodes."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node"))
    return ends.agg(
        F.count_distinct("node").alias("num_nodes"),
        (F.count(F.lit(1)) / F.lit(2)).cast("long").alias("num_edges"),
    ).withColumn(
        "average_degree",
        F.when(F.col("num_nodes") > 0, F.col("num_edges") / F.col("num_nodes")).otherwise(F.lit(0.0)),
    )


def degrees(edges: DataFrame) -> DataFrame:
    """Out-degree per source."""
    return edges.groupBy("source").agg(F.count("target").alias("degree"))


def degree_stats(edges: DataFrame) -> DataFrame:
    """max_degree, min_degree and sample standard deviation of the degree."""
    return degrees(edges).agg(
        F.max("degree").alias("max_degree"),
        F.min("degree").alias("min_degree"),
        F.stddev_samp("degree").alias("std_degree"),
    )


def degree_histogram(edges: DataFrame) -> DataFrame:
    """Nodes per degree, by ascending degree."""
    return (
        degrees(edges).groupBy("degree").agg(F.count(F.lit(1)).alias("count")).orderBy("degree")
    )


def power_law_exponent(edges: DataFrame) -> DataFrame:
    """Minus the least-squares slope of ln(count) on ln(degree) for degree > 1; NaN below 2 points."""
    points = degrees(edges).groupBy("degree").agg(F.count(F.lit(1)).alias("count")).filter("degree > 1")
    slope = F.regr_slope(F.ln("count"), F.ln("degree"))
    return points.agg(
        F.count(F.lit(1)).alias("points"),
        F.when(F.count(F.lit(1)) >= 2, -slope).otherwise(F.lit(math.nan)).alias("exponent"),
    )


def _triangles_inside(lo: np.ndarray, hi: np.ndarray, colour: np.ndarray) -> np.ndarray:
    """Triangles per node 0..n-1 among the edges of one colour triple.

    Edges point to the end with the larger degree, and for each edge the
    out-neighbours of its far end are looked up among the edges of its near
    end, WEDGES at a time.  In a triple of two colours, triangles of one colour
    alone are left to that colour's own triple.
    """
    n = len(colour)
    degree = np.bincount(lo, minlength=n) + np.bincount(hi, minlength=n)
    rank = np.empty(n, np.int64)
    rank[np.argsort(degree, kind="stable")] = np.arange(n)
    shade = np.empty(n, np.int64)
    shade[rank] = colour
    near, far = np.minimum(rank[lo], rank[hi]), np.maximum(rank[lo], rank[hi])
    keys = np.sort(near * n + far)
    near, far = keys // n, keys % n
    first = np.searchsorted(near, np.arange(n + 1))
    out = np.diff(first)
    wedges = np.cumsum(out[far])
    two = len(np.unique(colour)) == 2
    counts = np.zeros(n, np.int64)
    begin = 0
    while begin < len(near):
        done = wedges[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(wedges, done + WEDGES, "right")))
        many = out[far[begin:end]]
        edge = np.repeat(np.arange(begin, end), many)
        inside = np.arange(len(edge)) - np.repeat(np.cumsum(many) - many, many)
        third = far[first[far[edge]] + inside]
        wanted = near[edge] * n + third
        at = np.searchsorted(keys, wanted)
        closed = keys[np.minimum(at, len(keys) - 1)] == wanted
        corners = np.stack([near[edge], far[edge], third])[:, closed]
        if two:
            a, b, c = shade[corners]
            corners = corners[:, (a != b) | (b != c)]
        counts += np.bincount(corners.ravel(), minlength=n)
        begin = end
    return counts[rank]


def triangle_counts(edges: DataFrame, per_task: int = PER_TASK) -> tuple[DataFrame, DataFrame]:
    """Triangles per node (nodes in none left out) and the degree table (node, degree).

    Nodes get one of k colours by hash.  A pair of nodes is sent to the k
    triples of colours that a third node can complete, and the one task of a
    triple counts the triangles of just these colours, so each is counted once.
    k follows the data: a triple gets about ``per_task`` pairs, also where one
    node has a large share of them, and k times the pairs are shuffled in all.
    Direction and repeats of an edge do not matter.
    """
    pairs = edges.filter(F.col("source") != F.col("target")).select(
        F.least("source", "target").alias("_u"), F.greatest("source", "target").alias("_v")
    ).distinct()
    pairs = written(pairs, "pairs")
    deg = pairs.select(F.explode(F.array("_u", "_v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    share = F.sqrt(F.lit(6.0 / per_task) * total(pairs, F.count(F.lit(1))))
    hub = F.lit(2.0 / per_task) * total(deg, F.max("degree"))
    k = F.col("_k")
    sent = pairs.withColumn("_k", F.ceil(F.greatest(F.lit(float(COLOURS)), share, hub)).cast("long"))
    sent = sent.withColumns({"_cu": F.pmod(F.xxhash64("_u"), k), "_cv": F.pmod(F.xxhash64("_v"), k)})
    sent = sent.withColumn("_w", F.explode(F.sequence(F.lit(0).cast("long"), k - 1)))
    least, most = F.least("_cu", "_cv", "_w"), F.greatest("_cu", "_cv", "_w")
    triple = (least * k + (F.col("_cu") + F.col("_cv") + F.col("_w") - least - most)) * k + most

    def count(table: pa.Table) -> pa.Table:
        u, v, cu, cv = (table.column(c).to_numpy() for c in ("_u", "_v", "_cu", "_cv"))
        codes, nodes = pd.factorize(np.concatenate([u, v]))
        colour = np.empty(len(nodes), np.int64)
        colour[codes] = np.concatenate([cu, cv])
        found = _triangles_inside(codes[:len(u)], codes[len(u):], colour)
        some = np.flatnonzero(found)
        return pa.table([pa.array(nodes[some], table.schema.field("_u").type), pa.array(found[some])], ["node", "triangles"])

    kind = pairs.schema["_u"].dataType.simpleString()
    per_triple = sent.select(triple.alias("_t"), "_u", "_v", "_cu", "_cv").groupBy("_t").applyInArrow(
        count, f"node {kind}, triangles bigint")
    return per_triple.groupBy("node").agg(F.sum("triangles").alias("triangles")), deg


def local_clustering(edges: DataFrame) -> DataFrame:
    """Per node: degree, triangles and triangles / (d (d-1) / 2); 0 below two neighbours."""
    per_node, deg = triangle_counts(edges)
    d = F.col("degree").cast("double")
    tri = F.coalesce(F.col("triangles"), F.lit(0).cast("long"))
    return deg.join(per_node, "node", "left").select(
        "node", "degree", tri.alias("triangles"),
        F.when(d > 1, tri / (d * (d - 1) / 2)).otherwise(F.lit(0.0)).alias("clustering"),
    )


def clustering(edges: DataFrame, k: int | None = None) -> DataFrame:
    """One row: mean local and global clustering, and the lattice value 3(k-2)/(4(k-1)) for k."""
    lattice = F.lit(3.0 * (k - 2) / (4.0 * (k - 1))) if k and k > 1 else F.lit(None).cast("double")
    d = F.col("degree").cast("double")
    wedges = F.sum(d * (d - 1) / 2)
    return local_clustering(edges).agg(
        F.avg("clustering").alias("mean_local"),
        F.when(wedges > 0, F.sum("triangles") / wedges).otherwise(F.lit(0.0)).alias("global"),
    ).withColumn("expected_lattice", lattice)


def degree_check(
    edges: DataFrame, expected_degree: Column | float, expected_nodes: Column | int, tolerance: float = 0.1
) -> DataFrame:
    """Observed beside expected average degree and node count, with a flag for each."""
    want_d = F.lit(expected_degree) if isinstance(expected_degree, (int, float)) else expected_degree
    want_n = F.lit(expected_nodes) if isinstance(expected_nodes, int) else expected_nodes
    return graph_counts(edges).select(
        "num_nodes",
        want_n.cast("long").alias("expected_nodes"),
        "average_degree",
        want_d.cast("double").alias("expected_degree"),
    ).withColumns({
        "nodes_ok": F.col("num_nodes") == F.col("expected_nodes"),
        "degree_ok": F.abs(F.col("average_degree") - F.col("expected_degree"))
        <= F.lit(tolerance) * F.col("expected_degree"),
    })


def neighbor_activity(edges: DataFrame, interactions: DataFrame) -> DataFrame:
    """(humanId, contentId, neighbor_count): interactions of one's neighbours with each item.

    Repeats of one neighbour with one item are counted first, and the items of
    a neighbour travel as lists of about ITEMS: an edge moves one row per list
    to its source, where the lists are opened and summed, not one row per item.
    Neighbours with very many edges are spread, and so are sources with very many neighbours.
    """
    activity = interactions.groupBy(F.col("humanId").alias("target"), "contentId").agg(
        F.count(F.lit(1)).alias("_c")
    )
    many = activity.groupBy("target").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > ITEMS)
    pieces = F.coalesce(F.ceil(F.col("_n") / F.lit(ITEMS)), F.lit(1))
    lists = activity.join(many, "target", "left").groupBy(
        "target", F.pmod(F.xxhash64("contentId"), pieces).alias("_piece")
    ).agg(F.collect_list(F.struct("contentId", "_c")).alias("_items")).select(
        # Ids and counts apart, and counts of 1 left out: lists of few different bytes are shuffled small.
        "target", F.transform(F.filter("_items", lambda x: x["_c"] == 1), lambda x: x["contentId"]).alias("_once"),
        F.filter("_items", lambda x: x["_c"] > 1).alias("_more"),
    )
    ends = edges.select("source", "target")
    spread = F.pmod(F.xxhash64("target"), F.col("_salts")).cast("int")
    wide = F.broadcast(hot_keys(ends, "source"))
    dealt = ends.join(wide, "source", "left").withColumn("_at", F.coalesce(spread, F.lit(0))).drop("_salts")
    met = salted_join(dealt, lists, "target").select("source", "_at", "_once", "_more").repartition("source", "_at")
    once = F.transform("_once", lambda x: F.struct(x.alias("contentId"), F.lit(1).cast("long").alias("_c")))
    opened = met.select("source", "_at", F.explode(F.concat(once, "_more")).alias("_i")).select("source", "_at", "_i.*")
    # Summed where the lists were sent; only the sums move again.
    sums = opened.groupBy("source", "_at", "contentId").agg(F.sum("_c").alias("_c"))
    return sums.groupBy(F.col("source").alias("humanId"), "contentId").agg(F.sum("_c").alias("neighbor_count"))


def neighbor_mean(
    edges: DataFrame, state: DataFrame, columns: Sequence[str] = ("valence", "arousal"), key: str = "humanId"
) -> DataFrame:
    """Mean of each column over one's neighbours, as neighbor_<column>."""
    seen = state.select(F.col(key).alias("target"), *columns)
    return (
        salted_join(edges.select("source", "target"), seen, "target")
        .groupBy(F.col("source").alias(key))
        .agg(*[F.avg(c).alias(f"neighbor_{c}") for c in columns])
    )
