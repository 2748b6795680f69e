"""Valence and arousal: attaching, averaging, updating and classifying."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofield import schemas as S
from echofield.functions.columns import SPAN, as_col, clip, require
from echofield.functions.sequence import beside
from echofield.functions.skew import hot_keys, salted_join


def _lookup(c: Column, table: Mapping[str, tuple[float, float]], part: int) -> Column:
    labels = [k for k, v in table.items() if v != (0.0, 0.0)]
    choice = F.when(c == labels[0], table[labels[0]][part])
    for label in labels[1:]:
        choice = choice.when(c == label, table[label][part])
    return choice.otherwise(F.lit(0.0))


def attach_item_affect(interactions: DataFrame, items: DataFrame) -> DataFrame:
    """Add contentValence, contentArousal and intensity of the item to each interaction.

    An item's own valence and arousal are used when both are set, else those of its type.
    """
    own = {c: F.col(c) if c in items.columns else F.lit(None).cast("double") for c in ("valence", "arousal")}
    has_own = own["valence"].isNotNull() & own["arousal"].isNotNull()
    affect = items.select(
        "contentId", "intensity",
        *[F.when(has_own, own[c]).otherwise(_lookup(F.col("emotionType"), S.TYPE_AFFECT, i)).alias(name)
          for i, (c, name) in enumerate((("valence", "contentValence"), ("arousal", "contentArousal")))],
    )
    return salted_join(interactions.drop("intensity"), affect, "contentId")


def weighted_affect(df: DataFrame, key: str = "humanId") -> DataFrame:
    """Intensity-weighted mean affect per entity, and the total intensity."""
    w = F.col("intensity")
    return df.groupBy(key).agg(
        F.try_divide(F.sum(F.col("contentValence") * w), F.sum(w)).alias("content_valence"),
        F.try_divide(F.sum(F.col("contentArousal") * w), F.sum(w)).alias("content_arousal"),
        F.sum(w).alias("total_intensity"),
    )


def affect_update(
    state: DataFrame,
    neighbors: DataFrame | None,
    content: DataFrame | None,
    persistence: float = S.PERSISTENCE,
    content_weight: float = 0.15,
    social_weight: float = 0.10,
    baseline_weight: float = 0.05,
    arousal_decay: float = 0.10,
    cut: float = 0.3,
    key: str = "humanId",
) -> DataFrame:
    """New valence, arousal and class from the old state, content, neighbours and baseline.

    A missing influence counts 0.  Arousal persistence is also scaled by
    (1 - arousal_decay).  Both results are limited to [-1, 1].
    """
    df = state
    for side, prefix in ((neighbors, "neighbor"), (content, "content")):
        names = [f"{prefix}_valence", f"{prefix}_arousal"]
        if side is None:
            df = df.withColumns({n: F.lit(0.0) for n in names})
        else:
            df = df.join(side.select(key, *names), key, "left")
    keep = {"valence": persistence, "arousal": persistence * (1.0 - arousal_decay)}
    fresh = {}
    for part, base in (("valence", "baselineValence"), ("arousal", "baselineArousal")):
        zero = F.lit(0.0)
        fresh[part] = clip(
            F.col(part) * F.lit(keep[part])
            + F.coalesce(F.col(f"content_{part}"), zero) * F.lit(content_weight)
            + F.coalesce(F.col(f"neighbor_{part}"), zero) * F.lit(social_weight)
            + F.coalesce(F.col(base), zero) * F.lit(baseline_weight),
            -1.0, 1.0,
        )
    extra = [f"{p}_{c}" for p in ("neighbor", "content") for c in ("valence", "arousal")]
    return affect_class(df.withColumns(fresh).drop(*extra), cut)


def affect_class(df: DataFrame, cut: float = 0.3, name: str = "mood") -> DataFrame:
    """Class from valence: JOY above ``cut``, RAGE below ``-cut``, else NEUTRAL.

    A test on arousal would not change the result: |valence| <= cut is NEUTRAL either way.
    """
    return df.withColumn(name, class_of(F.col("valence"), cut))


def class_of(v: Column, cut: float = 0.3) -> Column:
    return F.when(v > cut, S.JOY).when(v < -cut, S.RAGE).otherwise(F.lit(S.NEUTRAL))


def class_affect(df: DataFrame, label: str = "mood") -> DataFrame:
    """Set valence and arousal from the class where either is missing."""
    old = {c: F.col(c) if c in df.columns else F.lit(None).cast("double") for c in ("valence", "arousal")}
    has_both = old["valence"].isNotNull() & old["arousal"].isNotNull()
    return df.withColumns({
        c: F.when(has_both, old[c]).otherwise(_lookup(F.col(label), S.CLASS_AFFECT, i))
        for i, c in enumerate(("valence", "arousal"))
    })


def map_codes(df: DataFrame, column: str, mapping: DataFrame, out: str) -> DataFrame:
    """Replace codes by labels from a mapping table (code, label); unknown codes give null.

    The optimizer broadcasts the mapping only when its size allows it.
    """
    return df.join(
        mapping.select(F.col("code").alias(column), F.col("label").alias(out)), column, "left"
    )


def edge_affect_distance(edges: DataFrame, state: DataFrame, key: str = "humanId") -> DataFrame:
    """Edges with the Euclidean (valence, arousal) distance of their ends."""
    end = state.select(key, "valence", "arousal")
    hot = hot_keys(edges, "source")  # both directions are stored, so also the hot targets
    first = salted_join(
        edges, end.select(F.col(key).alias("source"), F.col("valence").alias("_v1"), F.col("arousal").alias("_a1")),
        "source", hot=hot,
    )
    both = salted_join(
        first, end.select(F.col(key).alias("target"), F.col("valence").alias("_v2"), F.col("arousal").alias("_a2")),
        "target", hot=hot.withColumnRenamed("source", "target"),
    )
    dv, da = F.col("_v1") - F.col("_v2"), F.col("_a1") - F.col("_a2")
    return both.select(*edges.columns, F.sqrt(dv * dv + da * da).alias("distance"))


def mean_affect_distance(edges: DataFrame, state: DataFrame, key: str = "humanId") -> DataFrame:
    """Mean distance to one's neighbours."""
    return edge_affect_distance(edges, state, key).groupBy(F.col("source").alias(key)).agg(
        F.avg("distance").alias("mean_distance")
    )


def interpolate(a: Column, b: Column, alpha: Column) -> Column:
    """a(1 - alpha) + b alpha, limited to [-1, 1]; NaN stays NaN."""
    between = as_col(a) * (F.lit(1.0) - alpha) + as_col(b) * alpha
    return F.when(F.isnan(between), between).otherwise(clip(between, -1.0, 1.0))


def fill_missing_steps(states: DataFrame, key: str = "humanId", step: str = "step") -> DataFrame:
    """All steps between each entity's first and last record, the missing ones interpolated.

    ``states`` has one row per (key, step).  A gap is made in spans of SPAN
    steps, so a row never holds more of it, however long it is.
    """
    require({key, step, "valence", "arousal"} <= set(states.columns), "states needs valence and arousal")
    ahead = beside(
        states.select(key, step, "valence", "arousal"), key, [step], [step, "valence", "arousal"], "next"
    ).withColumnsRenamed({f"next_{step}": "_s", "next_valence": "_v", "next_arousal": "_a"})
    last = F.coalesce(F.col("_s") - 1, F.col(step))
    spans = F.sequence(F.lit(0).cast("long"), F.floor((last - F.col(step)) / F.lit(SPAN)).cast("long"))
    cut = ahead.withColumns({"_to": last, "_span": F.explode(spans)})
    cut = cut.withColumn("_from", F.col(step) + F.col("_span") * SPAN)
    grid = cut.withColumn("_at", F.explode(F.sequence(F.col("_from"), F.least("_to", F.col("_from") + (SPAN - 1)))))
    alpha = (F.col("_at") - F.col(step)) / (F.col("_s") - F.col(step))
    recorded = F.col("_at") == F.col(step)
    return grid.select(
        key, F.col("_at").alias(step),
        F.when(recorded, F.col("valence")).otherwise(interpolate("valence", "_v", alpha)).alias("valence"),
        F.when(recorded, F.col("arousal")).otherwise(interpolate("arousal", "_a", alpha)).alias("arousal"),
        recorded.alias("recorded"),
    )
