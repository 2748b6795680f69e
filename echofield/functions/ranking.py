"""Ranks, quantiles and inequality over whole tables without a one-task sort.

A window without a partition key (or with one hot key) runs in one task.  The
functions here first count equal values, then either cut the ordered values
into ranges that many tasks rank at once, or keep only the neighbourhood of the
wanted rank.  The results are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echofield.functions.columns import require
from echofield.functions.tables import written

_BUCKET_DIGITS = 3
SLICES = 16  # pieces of a bracket
SKETCH = 4096  # size of a stored sketch; its ranks are off by less than 0.1% nearly always


def dense_index(df: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """Number the rows 0..n-1, given a unique ``key``.

    Rows are ordered by a 3-digit hash bucket and then by key.  Each bucket is
    numbered on its own; the 4,096 bucket sizes (a fixed bound) give the offsets.
    """
    bucketed = df.withColumn(
        "_b", F.substring(F.md5(F.col(key).cast("string")), 1, _BUCKET_DIGITS)
    )
    sizes = bucketed.groupBy("_b").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_b", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_off"))
    local = F.row_number().over(Window.partitionBy("_b").orderBy(key))
    return (
        bucketed.withColumn("_local", local)
        .join(F.broadcast(offsets), "_b")
        .withColumn(name, F.col("_off") + F.col("_local") - F.lit(1))
        .drop("_b", "_local", "_off")
    )


def value_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by..., v, c): how often each value occurs, nulls left out."""
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("v"))
        .agg(F.count(F.lit(1)).alias("c"))
    )


def chunked(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Give each row the number of a contiguous range of (by, v).

    The range partitioner samples the data, so even when one group owns most
    rows its values are cut into many chunks.  Callers reduce a chunk to one
    row and combine chunk rows, so no step orders a whole group in one task.
    """
    return counts.repartitionByRange(*[F.col(b) for b in by], F.col("v")).withColumn(
        "_chunk", F.spark_partition_id()
    )


def gini(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Gini coefficient: sum((2i - n - 1) x_i) / (n sum(x)), i the 1-based rank.

    0 when a group's sum is 0.  A value with count c and L rows below it
    carries the ranks L+1..L+c, whose sum is cL + c(c+1)/2.
    """
    by = list(by)
    inside = Window.partitionBy(*by, "_chunk").orderBy("v").rowsBetween(
        Window.unboundedPreceding, -1
    )
    ranked = chunked(value_counts(df, by, value), by).withColumn(
        "_below", F.coalesce(F.sum("c").over(inside), F.lit(0))
    )
    x, c, below = F.col("v"), F.col("c").cast("double"), F.col("_below").cast("double")
    parts = ranked.groupBy(*by, "_chunk").agg(
        F.sum("c").alias("_n"),
        F.sum(c * x).alias("_sum"),
        F.sum((c * below + c * (c + 1) / 2) * x).alias("_ranked"),
    )
    # One row per chunk and group from here on: at most groups + chunks rows.
    earlier = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(earlier), F.lit(0)).cast("double")
    whole = (
        parts.withColumn("_rank_sum", F.col("_ranked") + offset * F.col("_sum"))
        .groupBy(*by)
        .agg(
            F.sum("_n").alias("n"),
            F.sum("_sum").alias("_total"),
            F.sum("_rank_sum").alias("_weighted"),
        )
    )
    n = F.col("n").cast("double")
    score = F.when(
        F.col("_total") != 0,
        (2 * F.col("_weighted") - (n + 1) * F.col("_total")) / (n * F.col("_total")),
    ).otherwise(F.lit(0.0))
    return whole.select(*by, F.coalesce(F.col("n"), F.lit(0)).alias("n"),
                        F.coalesce(score, F.lit(0.0)).alias("gini"))


def quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    kind: str = "linear",
    accuracy: int = 10_000,
) -> DataFrame:
    """Exact quantiles per group: one column ``q0, q1, ...`` per probability, and ``n``.

    ``kind="linear"`` interpolates at position p(n-1); ``kind="rank"`` takes the
    0-based row floor(p n).  A quantile sketch first brackets each wanted rank
    (four times closer than the bracket is wide; a rank outside it is an error).
    Rows outside every bracket are folded onto the nearest bracket edge below
    them, which keeps the order, so the exact ranking only sees the few distinct
    values inside the brackets, cut in SLICES at quantiles of the sketch.
    """
    by, probs = list(by), list(probs)
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    slack = 3.0 / accuracy
    sketch = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("v", F.array(*map(F.lit, _marks(probs, slack))), F.lit(4 * accuracy)).alias("_m"),
        F.min("v").alias("_min"),
        F.max("v").alias("_max"),
    )
    # A group of at most ``accuracy`` rows is kept whole: there the slack is less
    # than the one rank that interpolation reaches beyond its position.
    brackets = _brackets(sketch, by, probs, slack, F.col("n") <= accuracy)
    if by:
        # One row per group, looked up twice: written, its size is known, and unless the groups
        # are very many it is broadcast and no row moves to meet its group's bracket.
        brackets = written(brackets, "brackets")
    missed = F.raise_error(F.lit("a quantile sketch missed its rank error; raise accuracy")).cast("double")
    return _picked(rows, brackets, by, probs, kind, missed)


def quantile_sketches(df: DataFrame, value: str, by: Sequence[str] = (), k: int = SKETCH) -> DataFrame:
    """(by..., n, lowest, highest, sketch): a table to store, one KLL sketch per group (a step, a run).

    Tables of new steps can be appended to it, and ``merge_sketches`` makes
    those of any coarser groups, without another look at the rows.  Nulls and
    NaN are left out.
    """
    v = F.col(value).cast("double")
    return df.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min(v).alias("lowest"), F.max(v).alias("highest"),
        F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"),
    )


def merge_sketches(sketches: DataFrame, by: Sequence[str] = (), k: int = SKETCH) -> DataFrame:
    """The same table for coarser groups."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest"),
        F.kll_merge_agg_double(F.col("sketch"), F.lit(k)).alias("sketch"),
    )


def sketched_quantiles(sketches: DataFrame, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Approximate quantiles from stored sketches alone: by..., n, q0, q1, ..."""
    marks = F.kll_sketch_get_quantile_double(F.col("sketch"), F.array(*map(F.lit, probs)))
    return sketches.withColumn("_q", marks).select(*by, "n", *[F.col("_q")[i].alias(f"q{i}") for i in range(len(probs))])


def quantiles_from(
    df: DataFrame, value: str, probs: Sequence[float], sketches: DataFrame, by: Sequence[str] = (),
    kind: str = "linear", slack: float = 0.004,
) -> DataFrame:
    """Exact quantiles as by ``quantiles``, with brackets from stored sketches of the same rows.

    The rows are read once.  A sketch is right with high probability only, so
    the result, one row per group, is written and looked at: where a rank lay
    outside its bracket the brackets are widened, eightfold each time until
    they hold everything, and only those groups run again.
    """
    by, probs = list(by), list(probs)
    v = F.col(value).cast("double")
    rows = df.filter(v.isNotNull() & ~F.isnan(v)).select(*by, v.alias("v"))
    # KLL sketches are random: made anew they would give other brackets to each reader.
    sketches = written(sketches.select(*by, "n", "lowest", "highest", "sketch"), "sketches")
    names = [f"q{i}" for i in range(len(probs))]
    lost = F.lit(False)
    for c in names:
        lost = lost | F.col(c).isNull()
    done = None
    while True:
        marks = F.kll_sketch_get_quantile_double(F.col("sketch"), F.array(*map(F.lit, _marks(probs, slack))))
        sketch = sketches.select(*by, "n", marks.alias("_m"), F.col("lowest").alias("_min"), F.col("highest").alias("_max"))
        brackets = _brackets(sketch, by, probs, slack, F.col("n") <= F.lit(3.0 / slack))
        found = written(_picked(rows, brackets, by, probs, kind, F.lit(None).cast("double")), "quantiles")
        sound = found.filter(~lost)
        done = sound if done is None else done.unionByName(sound)
        again = found.filter(lost)
        if slack >= 1.0 or again.isEmpty():
            return done
        slack *= 8
        if by:
            sketches = sketches.join(again.select(*by), by, "left_semi")


def _marks(probs: Sequence[float], slack: float) -> list[float]:
    """The ranks to ask a sketch for: SLICES + 1 from slack below to slack above each probability."""
    return [min(1.0, max(0.0, p - slack + 2 * slack * j / SLICES)) for p in probs for j in range(SLICES + 1)]


def _brackets(sketch: DataFrame, by: Sequence[str], probs: Sequence[float], slack: float, whole: Column) -> DataFrame:
    """(by..., _s): n, the edges of each bracket and the values that cut them, from (n, _m, _min, _max).

    Ranks within the slack of either end are bracketed by the true extremes,
    and so is every rank of a group that is kept ``whole``.
    """
    def edge(at_end: bool, extreme: str, mark: int) -> Column:
        return F.col(extreme) if at_end else F.when(whole, F.col(extreme)).otherwise(F.col("_m")[mark])

    fields = [F.col("n")]
    for i, p in enumerate(probs):
        fields += [
            edge(p <= slack, "_min", i * (SLICES + 1)).alias(f"lo{i}"),
            edge(p + slack >= 1.0, "_max", i * (SLICES + 1) + SLICES).alias(f"hi{i}"),
        ]
    cuts = F.array_sort(F.array_distinct("_m")).alias("cuts")
    return sketch.select(*by, F.struct(*fields, cuts).alias("_s"))


def _picked(
    rows: DataFrame, brackets: DataFrame, by: Sequence[str], probs: Sequence[float], kind: str, missed: Column
) -> DataFrame:
    """The wanted ranks among ``rows`` (by..., v), or ``missed`` where a rank lies outside its bracket."""
    require(kind in ("linear", "rank"), f"unknown quantile kind {kind}")
    def with_brackets(df: DataFrame) -> DataFrame:
        return df.join(brackets, list(by)) if by else df.withColumn("_s", brackets.select("_s").scalar())

    tagged = with_brackets(rows)
    v, s = F.col("v"), F.col("_s")
    spans = [(s[f"lo{i}"], s[f"hi{i}"]) for i in range(len(probs))]
    kept = F.lit(False)
    for lo, hi in spans:
        kept = kept | v.between(lo, hi)
    edges = [F.when(hi < v, hi) for _, hi in spans]
    folded = F.when(kept, v).otherwise(F.greatest(*edges) if len(edges) > 1 else edges[0])
    # Only the folded value goes through the count; the brackets are looked up again for what is left.
    counts = with_brackets(tagged.select(*by, folded.alias("w"), kept.alias("_in")).groupBy(*by, "w").agg(
        F.count(F.lit(1)).alias("c"), F.count_if("_in").alias("_own")
    ))
    # How many of the sketch's marks lie below a value never falls as the value grows, and each
    # step holds about as many rows, whatever the values look like.
    below = F.size(F.filter(s["cuts"], lambda c: c < F.col("w")))
    counts = counts.withColumn("_chunk", F.when(F.col("w").isNull(), F.lit(-1)).otherwise(below))
    # Sums of chunks: SLICES rows per probability and group at most.
    earlier = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy(*by, "_chunk").agg(F.sum("c").alias("_size"))
    offsets = sums.select(*by, "_chunk", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_off"))
    inside = F.sum("c").over(
        Window.partitionBy(*by, "_chunk").orderBy(F.col("w").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = counts.withColumn("_within", inside).join(offsets, [*by, "_chunk"]).withColumn(
        "_cum", F.col("_off") + F.col("_within")
    )

    def at(rank: Column, i: int) -> Column:
        """The value of a rank.  Folded rows do not count there: the rank must fall on a row of the bracket."""
        reached = F.col("_cum") - F.col("c") + F.col("_own") > rank
        whole = reached & F.col("w").between(s[f"lo{i}"], s[f"hi{i}"])
        found = F.min(F.when(F.col("_cum") > rank, F.struct(F.col("w").alias("w"), whole.alias("ok"))))
        return F.when(found["ok"], found["w"]).otherwise(missed)

    n = s["n"]
    picks, out = [], []
    for i, p in enumerate(probs):
        if kind == "rank":
            picks.append(at(F.least(F.floor(n * F.lit(p)), n - 1), i).alias(f"q{i}"))
            out.append(F.col(f"q{i}"))
        else:
            pos = (n - 1) * F.lit(float(p))
            picks += [at(F.floor(pos), i).alias(f"_a{i}"), at(F.ceil(pos), i).alias(f"_z{i}")]
            frac = (F.col("n") - 1) * F.lit(float(p))
            a, z = F.col(f"_a{i}"), F.col(f"_z{i}")
            out.append((a + (z - a) * (frac - F.floor(frac))).alias(f"q{i}"))
    return ranked.groupBy(*by).agg(F.max(n).alias("n"), *picks).select(*by, "n", *out)
