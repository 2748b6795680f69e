"""Rewired and preferential graphs whose edges depend on what became of other edges."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofield.functions.columns import HEX_DIGITS, SCALE, require, total, uni
from echofield.functions.tables import written
from echofield.operators.edges import _candidates, _first_valid, _indexed, _named, both_directions

WINDOWS = (4, 8, 16, 32)  # candidates an edge looks at per round; the last round has the rest
REPLACED = 1 << 16  # most replaced first draws that are handed to every task
RUN = 1 << 12  # nodes that are worth a task of their own


def windows(tries: int) -> list[tuple[int, int]]:
    """The numbers of the candidates of each round, first and last."""
    spans, lo = [], 1
    for size in (*WINDOWS, tries):
        if lo <= tries:
            spans.append((lo, min(tries, lo + size - 1)))
            lo += size
    return spans


def rewire_edges_settled(
    edges: DataFrame, p: float, nodes: DataFrame, key: str = "id", seed: int = 42, tries: int = 100, dense: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Move the far end of each edge with probability p; (edges, one row: chosen, moved, stayed).

    As ``rewire_edges``, but an edge that loses its new end to another draws
    again.  Rounds look at 4, 8, 16, 32 and then the rest of ``tries``
    candidate ends of the edges left: the first that makes no loop and repeats
    neither an edge of the input nor a moved one is asked for, and among edges
    that ask for the same pair the smallest keyed roll gets it.  ``stayed`` counts
    the chosen edges for which no round found an end; they keep their place.
    The edges left shrink with each round, and each round's result is written,
    so its lineage ends there.
    """
    require(0.0 <= p <= 1.0, f"p must be in [0, 1], got {p}")
    require(tries >= 1, f"tries must be at least 1, got {tries}")
    numbers, names = _indexed(nodes, key, dense)
    n = total(numbers, F.count(F.lit(1)))
    if names is not None:
        names = written(names, "names")
        of = lambda end: names.select(F.col("_name").alias(end), F.col("id").alias(f"_{end}"))
        edges = edges.join(of("source"), "source").join(of("target"), "target").select(
            F.col("_source").alias("source"), F.col("_target").alias("target")
        )
    u, v = F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")
    pairs = edges.filter(F.col("source") != F.col("target")).select(u, v).distinct()
    marked = written(pairs.withColumn("_roll", uni(seed, "rewire", "u", "v")), "rolls")
    pairs = marked.select("u", "v")
    chosen = marked.filter(F.col("_roll") < p)
    taken, left, won = pairs, chosen, None
    for lo, hi in windows(tries):
        asked = _first_valid(_candidates(left, n, seed, lo, hi), taken)
        first = asked.groupBy("_a", "_b").agg(F.min(F.struct("_roll", "u", "v")).alias("_w"))
        got = written(first.select("_a", "_b", F.col("_w.u").alias("u"), F.col("_w.v").alias("v")), "moved")
        won = got if won is None else won.unionByName(got)
        taken = taken.unionByName(got.select(F.col("_a").alias("u"), F.col("_b").alias("v")))
        left = written(left.join(got.select("u", "v"), ["u", "v"], "left_anti"), "waiting")
        if left.isEmpty():
            break
    kept = marked.join(won.select("u", "v"), ["u", "v"], "left_anti").select(F.col("u").alias("_a"), F.col("v").alias("_b"))
    moved = kept.unionByName(won.select("_a", "_b")).withColumn("weight", F.lit(1.0))
    report = chosen.agg(F.count(F.lit(1)).alias("chosen")).withColumn("stayed", total(left, F.count(F.lit(1))))
    report = report.select("chosen", (F.col("chosen") - F.col("stayed")).alias("moved"), "stayed")
    return _named(both_directions(moved), names), report


def _attached(
    batches: Iterator[pa.RecordBatch], m: int, seed: int, max_hops: int, replaced: dict[int, int]
) -> Iterator[pa.RecordBatch]:
    """The ends of a run of nodes in ascending order, see ``preferential_edges_settled``.

    ``replaced`` has the replaced draws known from the round before; those of the
    run itself are found anew on the way and hold for its later nodes at once.
    """
    known = dict(replaced)
    seeds = m * (m + 1) // 2
    draws = 64 + 16 * m * m.bit_length()

    def drawn(salt: str, keys: str, older: int) -> int:
        """The slot among ``older`` ones that the keys draw, as by ``uni``."""
        digest = hashlib.md5(f"{seed}|{salt}|{keys}".encode(), usedforsecurity=False).hexdigest()
        return math.floor(int(digest[:HEX_DIGITS], 16) / SCALE * older)

    def picked(edge: int) -> int:
        return drawn("attach", str(edge), 2 * (seeds + (edge - seeds) // m * m))

    def node(slot: int) -> int:
        """The node that holds a slot: odd ones of new edges are copies of another slot."""
        for _ in range(max_hops):
            if slot < 2 * seeds or slot % 2 == 0:
                break
            edge = slot // 2
            slot = known[edge] if edge in known else picked(edge)
        return slot // m if slot < 2 * seeds else (slot // 2 - seeds) // m + m + 1

    for batch in batches:
        ids, found, edges, slots = batch.column(0).to_pylist(), [], [], []
        for i in ids:
            first = seeds + (i - m - 1) * m
            ends: list[int] = []
            own: list[tuple[int, int]] = []
            for draw in range(draws):
                # The first m draws are those of the edges, later ones have a hash of their own.
                slot = picked(first + draw) if draw < m else drawn("attach.again", f"{first}|{draw}", 2 * first)
                end = node(slot)
                if end in ends:
                    continue
                if draw != len(ends):
                    own.append((first + len(ends), slot))
                ends.append(end)
                if len(ends) == m:
                    break
            for edge in range(first, first + m) if known else ():
                known.pop(edge, None)
            known.update(own)
            found.append(ends)
            edges.append([e for e, _ in own])
            slots.append([s for _, s in own])
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(found, kind), pa.array(edges, kind), pa.array(slots, kind)],
            ["id", "_ends", "_edges", "_slots"],
        )


def preferential_edges_settled(
    nodes: DataFrame, m: int, key: str = "id", seed: int = 42, max_hops: int = 128, dense: bool = False
) -> DataFrame:
    """Scale-free graph as by ``preferential_edges``, attaching by the degrees that edges really give.

    A new edge copies a uniformly chosen earlier slot and a slot that is itself
    a copy is followed by its hash.  A node that draws an end twice draws
    again, so some edges do not lead where their first draw led.  These replaced
    draws are found in rounds: with those known so far every run of nodes finds
    its ends alone, which tells the replaced ones anew, until they repeat; by
    induction on the nodes the result is that of adding one node after the
    other.  Among n nodes about (ln n)^2 draws are replaced, so each round makes
    the nodes once and shuffles nothing; more than REPLACED are refused.
    """
    require(m >= 1, f"m must be at least 1, got {m}")
    spark = nodes.sparkSession
    numbers, names = _indexed(nodes, key, dense)
    if names is not None:
        names = written(names, "names")
        numbers = names.select("id")
    last = numbers.agg(F.max("id")).first()[0]
    n = 0 if last is None else last + 1
    # Ids are 0..n-1, so a task can have a run of them without a shuffle.
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // RUN)))
    grow = spark.range(m + 1, max(n, m + 1), 1, parts)

    def ends(replaced: dict[int, int]) -> DataFrame:
        """(id, _ends, _edges, _slots): the m different ends of each node, the replaced draws among its edges and their slots."""
        attach = partial(_attached, m=m, seed=seed, max_hops=max_hops, replaced=replaced)
        return grow.mapInArrow(attach, "id bigint, _ends array<bigint>, _edges array<bigint>, _slots array<bigint>")

    replaced: dict[int, int] = {}
    while True:
        found = ends(replaced)
        changed = found.select(F.explode(F.arrays_zip("_edges", "_slots")).alias("_r")).select("_r._edges", "_r._slots")
        # Ordered, because a limit alone reads a few partitions at a time.
        now = {e: slot for e, slot in changed.orderBy("_edges").limit(REPLACED + 1).collect()}
        require(len(now) <= REPLACED, f"more than {REPLACED} replaced draws")
        if now == replaced:
            break
        replaced = now
    short = F.raise_error(F.lit("too few draws for m different nodes")).cast("array<bigint>")
    grown = found.select(
        F.col("id").alias("_b"), F.explode(F.when(F.size("_ends") == m, F.col("_ends")).otherwise(short)).alias("_a")
    )
    clique = spark.range(min(n, m + 1)).select(F.col("id").alias("_b")).withColumn(
        "_a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m).cast("long")))
    ).filter(F.col("_a") < F.col("_b"))
    pairs = clique.select("_a", "_b").unionByName(grown.select("_a", "_b")).withColumn("weight", F.lit(1.0))
    return _named(both_directions(pairs), names)
