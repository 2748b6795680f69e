"""Edge tables: from records, random, lattice, rewired and preferential."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofield.functions.columns import poisson_draws, require, total, uni
from echofield.functions.ranking import dense_index
from echofield.functions.sequence import before_in_ranges


def symmetrize(edges: DataFrame) -> DataFrame:
    """Each unordered pair once, stored in both directions, with the largest weight.

    Pairs are folded to (smaller, larger) first, so one shuffle removes repeats
    and the second direction is added without another.
    """
    pairs = (
        edges.filter(F.col("source") != F.col("target"))
        .groupBy(F.least("source", "target").alias("_a"), F.greatest("source", "target").alias("_b"))
        .agg(F.max("weight").alias("weight"))
    )
    return both_directions(pairs)


def both_directions(pairs: DataFrame) -> DataFrame:
    """(_a, _b, weight) -> (source, target, weight) twice per pair, without a shuffle."""
    ends = F.explode(F.array(
        F.struct(F.col("_a").alias("source"), F.col("_b").alias("target")),
        F.struct(F.col("_b").alias("source"), F.col("_a").alias("target")),
    ))
    return pairs.select(ends.alias("_e"), F.col("weight").cast("double").alias("weight")).select(
        "_e.source", "_e.target", "weight"
    )


def edges_from_sequence(
    df: DataFrame, group: str, entity: str, order: Sequence[str], bucket: str | None = None, most: int | None = None
) -> DataFrame:
    """Edges between entities that touch the same group one right after the other.

    weight counts how often the pair followed each other.  The result grows
    with the rows, never with the square of a group, and a group with most of
    the rows is ordered by many tasks (``before_in_ranges``).  ``bucket`` and
    ``most`` are taken for older callers and change nothing.
    """
    steps = before_in_ranges(df, group, order, [entity])
    x, y = F.col(entity), F.col(f"previous_{entity}")
    pairs = (
        steps.filter(y.isNotNull() & (x != y))
        .groupBy(F.least(x, y).alias("_a"), F.greatest(x, y).alias("_b"))
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
    )
    return both_directions(pairs)


def _indexed(nodes: DataFrame, key: str, dense: bool) -> tuple[DataFrame, DataFrame | None]:
    """(ids 0..n-1 in a column ``id``, their names in ``key`` or None).

    Any ids are numbered; with ``dense`` they have to be 0..n-1 themselves,
    which is checked, and no join is needed.
    """
    ids = nodes.select(F.col(key).alias("_name")).distinct()
    if not dense:
        numbered = dense_index(ids, "_name", "id")
        return numbered.select("id"), numbered
    right = (total(ids, F.min("_name")) == 0) & (total(ids, F.max("_name")) == total(ids, F.count(F.lit(1))) - 1)
    refuse = F.raise_error(F.lit("dense node ids must be 0..n-1")).cast("long")
    return ids.select(F.when(right, F.col("_name")).otherwise(refuse).alias("id")), None


def _named(edges: DataFrame, names: DataFrame | None) -> DataFrame:
    """Edges between numbers as edges between the nodes they stand for."""
    if names is None:
        return edges
    of = lambda end: names.select(F.col("id").alias(end), F.col("_name").alias(f"_{end}"))
    return edges.join(of("source"), "source").join(of("target"), "target").select(
        F.col("_source").alias("source"), F.col("_target").alias("target"), "weight"
    )


def random_edges(nodes: DataFrame, k: float, key: str = "id", seed: int = 42, dense: bool = False) -> DataFrame:
    """Random graph: every unordered pair is an edge with probability k/(n-1), independently.

    A pair is an edge when a Poisson count of mean -ln(1-p) is positive;
    drawing the counts of all pairs of one node together costs as many rows as
    edges, not as many as pairs.  ``dense`` promises ids 0..n-1 (checked).
    """
    numbers, names = _indexed(nodes, key, dense)
    n = total(numbers, F.count(F.lit(1)))
    ids = numbers.select(F.col("id").alias("source")).withColumn("_n", n)
    ids = ids.withColumn("_above", F.col("_n") - 1 - F.col("source"))
    # k >= n-1 asks for the complete graph, which no finite mean gives; 40 leaves 4e-18.
    p = F.try_divide(F.lit(float(k)), F.col("_n") - 1)
    mean = F.when(p >= 1.0, F.lit(40.0)).otherwise(-F.log1p(-p)) * F.col("_above")
    draws = poisson_draws(ids, mean, seed, "random.count", ["source"])
    target = F.col("source") + 1 + F.floor(
        uni(seed, "random.target", "source", "draw") * F.col("_above")
    )
    pairs = draws.select(F.col("source").alias("_a"), target.alias("_b")).distinct()
    return _named(both_directions(pairs.withColumn("weight", F.lit(1.0))), names)


def ring_lattice_edges(nodes: DataFrame, k: int, key: str = "id", dense: bool = False) -> DataFrame:
    """Each node i of n joined to i+1 .. i+k/2 (mod n), both directions.

    Nodes are numbered by ``dense_index``, or by themselves with ``dense``.
    Fewer than k + 1 nodes are an error.
    """
    require(k >= 2 and k % 2 == 0, f"k must be even and at least 2, got {k}")
    numbers, names = _indexed(nodes, key, dense)
    pairs = _lattice_pairs(numbers, k)
    ring = both_directions(
        pairs.select(F.least("u", "v").alias("_a"), F.greatest("u", "v").alias("_b"))
        .distinct().withColumn("weight", F.lit(1.0))
    )
    return _named(ring, names)


def _lattice_pairs(numbers: DataFrame, k: int) -> DataFrame:
    n = total(numbers, F.count(F.lit(1)))
    enough = F.when(n > k, n).otherwise(F.raise_error(F.lit(f"a lattice of degree {k} needs {k + 1} nodes")).cast("long"))
    return numbers.select(
        F.col("id").alias("u"), F.explode(F.sequence(F.lit(1), F.lit(k // 2))).alias("_j"), enough.alias("_n")
    ).select("u", F.pmod(F.col("u") + F.col("_j"), F.col("_n")).alias("v"))


def rewire_edges(
    edges: DataFrame, p: float, n: Column | None = None, seed: int = 42, tries: int = 100,
    nodes: DataFrame | None = None, key: str = "id",
) -> DataFrame:
    """Move the far end of each edge with probability p to a random node.

    The nodes are those of ``nodes``, with any ids, or 0..n-1 where only ``n`` is given.

    A new end may not make a loop, repeat an edge of the input or repeat
    another moved edge (the pair with the smaller keyed roll wins).  An edge
    that finds no valid end within ``tries`` candidates, or loses, stays as it
    was, so the number of edges never changes.
    """
    require(0.0 <= p <= 1.0, f"p must be in [0, 1], got {p}")
    require((n is None) != (nodes is None), "give either nodes or their number")
    if nodes is not None:
        numbers, names = _indexed(nodes, key, False)
        of = lambda end: names.select(F.col("_name").alias(end), F.col("id").alias(f"_{end}"))
        placed = edges.join(of("source"), "source").join(of("target"), "target").select(
            F.col("_source").alias("source"), F.col("_target").alias("target")
        )
        return _named(rewire_edges(placed, p, total(numbers, F.count(F.lit(1))), seed, tries), names)
    pairs = (
        edges.filter(F.col("source") < F.col("target"))
        .select(F.col("source").alias("u"), F.col("target").alias("v")).distinct()
    )
    marked = pairs.withColumn("_roll", uni(seed, "rewire", "u", "v"))
    moving = marked.filter(F.col("_roll") < p)
    # Most edges take their first candidate, so candidates are tried in two waves.
    first = _candidates(moving, n, seed, 1, min(4, tries))
    placed = _first_valid(first, pairs)
    if tries > 4:
        left = moving.join(placed.select("u", "v"), ["u", "v"], "left_anti")
        placed = placed.unionByName(_first_valid(_candidates(left, n, seed, 5, tries), pairs))
    winners = placed.groupBy("_a", "_b").agg(
        F.min(F.struct("_roll", "u", "v")).alias("_w")
    ).select("_a", "_b", F.col("_w.u").alias("u"), F.col("_w.v").alias("v"))
    kept = marked.join(winners.select("u", "v"), ["u", "v"], "left_anti").select(
        F.col("u").alias("_a"), F.col("v").alias("_b")
    )
    return both_directions(
        kept.unionByName(winners.select("_a", "_b")).withColumn("weight", F.lit(1.0))
    )


def _candidates(moving: DataFrame, n: Column, seed: int, lo: int, hi: int) -> DataFrame:
    tried = moving.withColumn("_t", F.explode(F.sequence(F.lit(lo), F.lit(hi))))
    end = F.floor(uni(seed, "rewire.target", "u", "v", "_t") * n).cast("long")
    return (
        tried.withColumn("_x", end).filter(F.col("_x") != F.col("u"))
        .withColumn("_a", F.least("u", "_x")).withColumn("_b", F.greatest("u", "_x"))
    )


def _first_valid(candidates: DataFrame, taken: DataFrame) -> DataFrame:
    free = candidates.join(
        taken.select(F.col("u").alias("_a"), F.col("v").alias("_b")), ["_a", "_b"], "left_anti"
    )
    first = free.groupBy("u", "v", "_roll").agg(F.min_by("_x", "_t").alias("_x"))
    return first.select(
        "u", "v", "_roll", F.least("u", "_x").alias("_a"), F.greatest("u", "_x").alias("_b")
    )


def preferential_edges(
    nodes: DataFrame, m: int, key: str = "id", seed: int = 42, max_hops: int = 128, dense: bool = False
) -> DataFrame:
    """Scale-free graph: each node from m+1 on joins m different earlier nodes, likely by degree.

    Nodes 0..m form a complete graph.  Ends of edges are numbered slots; a new
    edge copies a uniformly chosen earlier slot, which picks nodes in
    proportion to their degree (Batagelj and Brandes 2005).  A slot that is
    itself a copy is followed by hashing its number again, so every row finds
    its node alone, without joins or iteration over the data (Sanders and
    Schulz 2016).  Each hop ends the walk with probability one half.  A node
    that draws an end twice draws again with the next round's hash until it has
    m; later nodes follow the first draws, so degrees count those.
    Nodes are numbered by ``dense_index``, or by themselves with ``dense``.
    """
    require(m >= 1, f"m must be at least 1, got {m}")
    numbers, names = _indexed(nodes, key, dense)
    seed_edges = m * (m + 1) // 2
    clique = numbers.filter(F.col("id") <= m).select(F.col("id").alias("_b")).withColumn(
        "_a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m).cast("long")))
    ).filter(F.col("_a") < F.col("_b")).select("_a", "_b")

    # Slots 2e (newer node) and 2e+1 (copied end) belong to edge e >= seed_edges;
    # the first m(m+1) slots list every clique node m times.
    def newer(edge: Column) -> Column:
        return F.floor((edge - seed_edges) / F.lit(m)).cast("long") + m + 1

    def older(edge: Column) -> Column:
        return (F.lit(seed_edges) + (newer(edge) - m - 1) * m) * 2

    def pick(edge: Column) -> Column:
        return F.floor(uni(seed, "attach", edge) * older(edge)).cast("long")

    def is_copy(slot: Column) -> Column:
        return (slot >= 2 * seed_edges) & (slot % 2 == 1)

    def drawn(edge: Column, draw: Column) -> Column:
        """The node of a node's draw number ``draw``; the first m are those of its edges."""
        again = F.floor(uni(seed, "attach.again", edge, draw) * older(edge)).cast("long")
        slot = F.aggregate(
            F.sequence(F.lit(1), F.lit(max_hops)), F.when(draw < m, pick(edge + draw)).otherwise(again),
            lambda s, _: F.when(is_copy(s), pick(F.floor(s / 2).cast("long"))).otherwise(s),
        )
        node = F.when(slot < 2 * seed_edges, F.floor(slot / F.lit(m)).cast("long"))
        return node.otherwise(newer(F.floor(slot / 2).cast("long")))

    first = F.lit(seed_edges) + (F.col("id") - m - 1) * m
    # The first new node meets m + 1 others, of which m are wanted: about m ln m draws.
    draws = 64 + 16 * m * m.bit_length()
    bound = F.struct(F.array().cast("array<bigint>").alias("ends"), first.alias("edge"))

    def fill(s: Column, i: Column) -> Column:
        end = F.transform(F.array(drawn(s["edge"], i)), lambda x: F.when(
            F.array_contains(s["ends"], x), s["ends"]).otherwise(F.array_append(s["ends"], x)))[0]
        return F.when(F.size(s["ends"]) >= m, s).otherwise(F.struct(end.alias("ends"), s["edge"].alias("edge")))

    ends = F.aggregate(F.sequence(F.lit(0), F.lit(draws - 1)), bound, fill, lambda s: s["ends"])
    short = F.raise_error(F.lit("too few draws for m different nodes")).cast("array<bigint>")
    grown = numbers.filter(F.col("id") > m).select(F.col("id").alias("_b"), ends.alias("_ends")).select(
        "_b", F.explode(F.when(F.size("_ends") == m, F.col("_ends")).otherwise(short)).alias("_a")
    ).select("_a", "_b")
    pairs = clique.unionByName(grown).withColumn("weight", F.lit(1.0))
    return _named(both_directions(pairs), names)
