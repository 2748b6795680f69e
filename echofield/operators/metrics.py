"""Class, engagement, inequality and polarization metrics, whole-table or per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofield import schemas as S
from echofield.functions.ranking import gini, quantiles
from echofield.functions.sequence import beside, numbered



def _rows() -> Column:
    return F.count(F.lit(1))


def _share(top: Column, n: Column) -> Column:
    return F.when(n > 0, top / n).otherwise(F.lit(0.0))


def _count(label: str, name: str = "mood") -> Column:
    return F.count_if(F.coalesce(F.col(name) == label, F.lit(False)))


def class_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n, joyCount, neutralCount, rageCount: one pass over the rows."""
    return df.groupBy(*by).agg(
        _rows().alias("n"),
        _count(S.JOY).alias("joyCount"),
        _count(S.NEUTRAL).alias("neutralCount"),
        _count(S.RAGE).alias("rageCount"),
    )


def class_distribution(df: DataFrame, by: Sequence[str] = (), classes: Sequence[str] = S.CLASSES) -> DataFrame:
    """Counts per class, zero-filled, as columns and as the map moodDistribution."""
    counts = df.groupBy(*by).agg(*[_count(c).alias(c) for c in classes])
    pairs = [x for c in classes for x in (F.lit(c), F.col(c))]
    return counts.withColumn("moodDistribution", F.create_map(*pairs))


def interaction_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Total, positive and negative interactions in one pass."""
    return df.groupBy(*by).agg(
        _rows().alias("totalInteractions"),
        _count(S.POSITIVE, "emotionType").alias("positiveInteractions"),
        _count(S.NEGATIVE, "emotionType").alias("negativeInteractions"),
    )


def avg_engagement(people: DataFrame, interactions: DataFrame) -> DataFrame:
    """Interactions per person; 0 for an empty population."""
    population = people.agg(_rows().alias("_n")).select("_n").scalar()
    n = interactions.agg(_rows().alias("_i"))
    return n.select(_share(F.col("_i"), population).alias("avgEngagement"))


def engagement_per_entity(people: DataFrame, interactions: DataFrame, key: str = "humanId") -> DataFrame:
    """Interactions per person, people without any included."""
    counts = interactions.groupBy(key).agg(_rows().alias("_e"))
    return people.select(key).join(counts, key, "left").select(
        key, F.coalesce("_e", F.lit(0).cast("long")).alias("engagement")
    )


def engagement_gini(people: DataFrame, interactions: DataFrame, key: str = "humanId") -> DataFrame:
    """Inequality of the interactions per person."""
    return gini(engagement_per_entity(people, interactions, key), "engagement")


def _polarization() -> Column:
    return _share(F.abs(F.col("rageCount") - F.col("joyCount")), F.col("n"))


def _extremism() -> Column:
    return _share(F.col("rageCount") + F.col("joyCount"), F.col("n"))


def _fragmentation() -> Column:
    return F.when(F.col("n") > 0, F.lit(1.0) - F.col("neutralCount") / F.col("n")).otherwise(F.lit(0.0))


def _entropy() -> Column:
    total = F.lit(0.0)
    for c in ("joyCount", "neutralCount", "rageCount"):
        p = F.col(c) / F.col("n")
        total = total - F.when(F.col(c) > 0, p * F.log2(p)).otherwise(F.lit(0.0))
    return total


def _dominance() -> Column:
    return _share(F.greatest("joyCount", "neutralCount", "rageCount"), F.col("n"))


def _from_counts(df: DataFrame, by: Sequence[str], name: str, value: Column) -> DataFrame:
    return class_counts(df, by).select(*by, value.alias(name))


def polarization(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """|RAGE - JOY| / n."""
    return _from_counts(df, by, "polarizationIndex", _polarization())


def extremism(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(RAGE + JOY) / n."""
    return _from_counts(df, by, "extremismRate", _extremism())


def fragmentation(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """1 - NEUTRAL / n."""
    return _from_counts(df, by, "fragmentationIndex", _fragmentation())


def class_entropy(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Shannon entropy of the class shares, in bits."""
    return _from_counts(df, by, "moodEntropy", _entropy())


def dominance(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of the most common class."""
    return _from_counts(df, by, "emotionDominanceRatio", _dominance())


def level_means(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.avg("attentionSpan").alias("averageAttention"), F.avg("fatigue").alias("averageFatigue")
    )


def rank_percentile(
    df: DataFrame, column: str, q: float, by: Sequence[str] = (), name: str = "value", approx: bool = False
) -> DataFrame:
    """The value at 0-based row floor(n q) of the sorted column; ``approx`` uses a sketch."""
    if approx:
        return df.groupBy(*by).agg(F.percentile_approx(column, q, F.lit(10_000)).alias(name))
    return quantiles(df, column, [q], by, kind="rank").select(*by, F.col("q0").alias(name))


def collapsed_count(df: DataFrame, threshold: float = S.COLLAPSE_AT, by: Sequence[str] = ()) -> DataFrame:
    """Rows with fatigue at or above the threshold."""
    return df.groupBy(*by).agg(_collapsed(threshold).alias("collapsedCount"))


def _collapsed(threshold: float) -> Column:
    return F.count_if(F.coalesce(F.col("fatigue") >= threshold, F.lit(False)))


def population_summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Size, class counts, mean levels and collapsed count in one pass."""
    return df.groupBy(*by).agg(
        _rows().alias("totalHumans"),
        _count(S.JOY).alias("joyCount"),
        _count(S.NEUTRAL).alias("neutralCount"),
        _count(S.RAGE).alias("rageCount"),
        F.avg("attentionSpan").alias("averageAttention"),
        F.avg("fatigue").alias("averageFatigue"),
        _collapsed(S.COLLAPSE_AT).alias("collapsedCount"),
    )


def step_metrics(
    state: DataFrame, interactions: DataFrame, step: str = "step", key: str = "humanId"
) -> DataFrame:
    """The whole metrics row of every step at once.

    One aggregate over the states and one over the interactions give counts
    and means; both Gini coefficients share one ranking and the fatigue
    percentile adds another.  Everything joined at the end has one row per step.
    """
    base = state.groupBy(step).agg(
        _rows().alias("n"),
        _count(S.JOY).alias("joyCount"),
        _count(S.NEUTRAL).alias("neutralCount"),
        _count(S.RAGE).alias("rageCount"),
        F.avg("attentionSpan").alias("averageAttention"),
        F.avg("fatigue").alias("averageFatigue"),
        _collapsed(S.COLLAPSE_AT).alias("collapsedCount"),
    )
    per_entity = interactions.groupBy(step, key).agg(
        _rows().alias("engagement"),
        _count(S.POSITIVE, "emotionType").alias("_pos"),
        _count(S.NEGATIVE, "emotionType").alias("_neg"),
    )
    acts = per_entity.groupBy(step).agg(
        F.sum("engagement").alias("totalInteractions"),
        F.sum("_pos").alias("positiveInteractions"),
        F.sum("_neg").alias("negativeInteractions"),
    )
    engaged = state.select(step, key, "attentionSpan").join(
        per_entity.select(step, key, "engagement"), [step, key], "left"
    )
    levels = F.explode(F.array(
        F.struct(F.lit("engagement").alias("of"), F.coalesce("engagement", F.lit(0)).cast("double").alias("x")),
        F.struct(F.lit("attention").alias("of"), F.col("attentionSpan").alias("x")),
    ))
    spread = gini(engaged.select(step, levels.alias("_l")).select(step, "_l.*"), "x", [step, "of"])
    inequality = spread.groupBy(step).agg(
        F.max(F.when(F.col("of") == "engagement", F.col("gini"))).alias("engagementGini"),
        F.max(F.when(F.col("of") == "attention", F.col("gini"))).alias("attentionGini"),
    )
    tired = quantiles(state, "fatigue", [0.95], [step], kind="rank").select(step, F.col("q0").alias("fatigueP95"))
    out = base.join(acts, step, "left").join(inequality, step, "left").join(tired, step, "left")
    zero = F.lit(0).cast("long")
    counts = {c: F.coalesce(c, zero) for c in ("totalInteractions", "positiveInteractions", "negativeInteractions")}
    out = out.withColumns(counts).withColumns({
        "avgEngagement": _share(F.col("totalInteractions"), F.col("n")),
        "polarizationIndex": _polarization(),
        "extremismRate": _extremism(),
        "fragmentationIndex": _fragmentation(),
        "moodEntropy": _entropy(),
        "emotionDominanceRatio": _dominance(),
    })
    return out.withColumnRenamed(step, "timeStep").drop("n")


def as_metrics_row(df: DataFrame) -> DataFrame:
    """Shape ``step_metrics`` output like the stored metrics table (class counts as a map)."""
    pairs = []
    for label, c in ((S.JOY, "joyCount"), (S.NEUTRAL, "neutralCount"), (S.RAGE, "rageCount")):
        pairs += [F.lit(label), F.col(c)]
    return df.withColumn("moodDistribution", F.create_map(*pairs)).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.METRICS.fields]
    )


def affect_by_step(states: DataFrame, step: str = "step") -> DataFrame:
    """Mean and sample deviation of valence and arousal, and class shares, per step."""
    n = _rows()
    return states.groupBy(step).agg(
        F.avg("valence").alias("mean_valence"), F.stddev_samp("valence").alias("std_valence"),
        F.avg("arousal").alias("mean_arousal"), F.stddev_samp("arousal").alias("std_arousal"),
        (_count(S.JOY) / n).alias("joy_fraction"),
        (_count(S.NEUTRAL) / n).alias("neutral_fraction"),
        (_count(S.RAGE) / n).alias("rage_fraction"),
    )


def affect_grid(df: DataFrame, bins: int = 50, lo: float = -1.0, hi: float = 1.0) -> DataFrame:
    """Rows per (valence, arousal) cell; the last cell is closed, empty cells are left out."""
    width = (hi - lo) / bins

    def cell(c: str) -> Column:
        return F.least(F.floor((F.col(c) - lo) / F.lit(width)), F.lit(bins - 1)).cast("int")

    inside = F.col("valence").between(lo, hi) & F.col("arousal").between(lo, hi)
    return df.filter(inside).groupBy(
        cell("valence").alias("valence_bin"), cell("arousal").alias("arousal_bin")
    ).agg(_rows().alias("count"))


def quadrant_counts(df: DataFrame) -> DataFrame:
    """Rows and shares per sign quadrant; points on an axis belong to none."""
    v, w = F.col("valence"), F.col("arousal")
    quadrants = {
        "pos_pos": (v > 0) & (w > 0), "neg_pos": (v < 0) & (w > 0),
        "neg_neg": (v < 0) & (w < 0), "pos_neg": (v > 0) & (w < 0),
    }
    aggs = [_rows().alias("n"), *[F.count_if(c).alias(q) for q, c in quadrants.items()]]
    return df.agg(*aggs).withColumns({f"{q}_share": _share(F.col(q), F.col("n")) for q in quadrants})


def trajectories(
    states: DataFrame, keys: DataFrame, key: str = "humanId", step: str = "step"
) -> DataFrame:
    """Ordered states of chosen entities with position, and start and end marks.

    Long form, one row per step: no history is packed into one value.  The key
    list is a sample, and the optimizer broadcasts it only if it is small.
    """
    chosen = states.join(keys.select(key).distinct(), key, "left_semi")
    placed = numbered(chosen.select(key, step, "valence", "arousal"), key, step)
    return placed.select(
        key, step, "valence", "arousal", "position",
        (F.col("position") == 1).alias("is_start"), (F.col("position") == F.col("size")).alias("is_end"),
    )


def affect_snapshot_stats(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Size, mean affect and class counts as a map, of one snapshot or of each group."""
    pairs = [x for c in S.CLASSES for x in (F.lit(c), _count(c))]
    return df.groupBy(*by).agg(
        _rows().alias("n"), F.avg("valence").alias("mean_valence"), F.avg("arousal").alias("mean_arousal"),
        F.create_map(*pairs).alias("mood_counts"),
    )


def spread_convergence(states: DataFrame, step: str = "step") -> DataFrame:
    """(first spread - last spread) / first spread of valence and of arousal."""
    per_step = states.groupBy(step).agg(
        F.stddev_samp("valence").alias("_v"), F.stddev_samp("arousal").alias("_a")
    )
    aggs = []
    for c, name in (("_v", "valence"), ("_a", "arousal")):
        first, last = F.min_by(c, step), F.max_by(c, step)
        aggs += [first.alias(f"{name}_first"), last.alias(f"{name}_last"),
                 F.when(first != 0, (first - last) / first).alias(f"{name}_reduction")]
    return per_step.agg(*aggs)


def transition_matrix(states: DataFrame, key: str = "humanId", step: str = "step") -> DataFrame:
    """Counts and row shares of class changes between consecutive recorded steps, all 9 cells."""
    paired = beside(states.select(key, step, "mood"), key, [step], ["mood"])
    moves = paired.select(F.col("previous_mood").alias("from_class"), F.col("mood").alias("to_class"))
    moves = moves.filter(F.col("from_class").isNotNull())
    # One row with a count per cell, so that cells and classes without moves are there too.
    pairs = [(x, y) for x in S.CLASSES for y in S.CLASSES]
    counts = moves.agg(*[
        F.count_if((F.col("from_class") == x) & (F.col("to_class") == y)).alias(f"{x}>{y}") for x, y in pairs
    ])
    cells = [
        F.struct(
            F.lit(x).alias("from_class"), F.lit(y).alias("to_class"), F.col(f"{x}>{y}").alias("n"),
            F.coalesce(F.try_divide(F.col(f"{x}>{y}"), sum((F.col(f"{x}>{z}") for z in S.CLASSES), F.lit(0))),
                       F.lit(0.0)).alias("share"),
        )
        for x, y in pairs
    ]
    return counts.select(F.inline(F.array(*cells)))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, and distinct values of each column."""
    return df.agg(_rows().alias("rows"), *[F.count_distinct(c).alias(f"distinct_{c}") for c in columns])


def describe_table(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """count, mean, std, min, quartiles and max of each column, one row per column and group."""
    # One row per value: all columns share the same passes over the table.
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns
    ]))
    keys = [*by, "column"]
    long = df.select(*by, cells.alias("_c")).select(*by, "_c.*")
    moments = long.groupBy(*keys).agg(
        F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"),
    )
    marks = quantiles(long, "x", [0.25, 0.5, 0.75], keys)
    names = ("p25", "p50", "p75")
    marks = marks.select(*keys, *[F.col(f"q{i}").alias(n) for i, n in enumerate(names)])
    return moments.join(marks, keys, "left").select(*keys, "count", "mean", "std", "min", *names, "max")
