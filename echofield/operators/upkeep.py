"""Attention and fatigue: one step, and folded over recorded steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofield.functions.columns import clip, require, total, uni

FANOUT = 128  # children of a node in the tree of blocks
LOW_ATTENTION = 0.5  # fixed value: attention recovers below this


def decayed(x: Column, rate: float, recovery: float, recover_on: str = "before") -> Column:
    """x(1 - rate), plus recovery when attention is low, limited to [0, 1].

    ``recover_on`` says whether "low" is judged before or after the decay.
    """
    require(recover_on in ("before", "after"), f"unknown recover_on {recover_on}")
    smaller = x * F.lit(1.0 - rate)
    judged = x if recover_on == "before" else smaller
    gain = F.when(judged < LOW_ATTENTION, F.lit(recovery)).otherwise(F.lit(0.0))
    return clip(smaller + gain, 0.0, 1.0)


def decay_recover(
    df: DataFrame, rate: float = 0.05, recovery: float = 0.02,
    recover_on: str = "before", column: str = "attentionSpan",
) -> DataFrame:
    return df.withColumn(column, decayed(F.col(column), rate, recovery, recover_on))


def fatigue_update(
    state: DataFrame, interactions: DataFrame, accumulation: float = 0.02, recovery: float = 0.01,
    key: str = "humanId",
) -> DataFrame:
    """Fatigue plus accumulation per reaction, or minus recovery when there was none."""
    counts = interactions.filter("reacted").groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce(F.col("_n"), F.lit(0))
    moved = F.col("fatigue") + n * F.lit(accumulation) - F.when(n == 0, F.lit(recovery)).otherwise(F.lit(0.0))
    return state.join(counts, key, "left").withColumn("fatigue", clip(moved, 0.0, 1.0)).drop("_n")


def fatigue_by_propensity(
    state: DataFrame, accumulation: float = 0.02, recovery: float = 0.01,
    seed: int = 42, step: int = 0, key: str = "humanId",
) -> DataFrame:
    """Fatigue grows with probability addictionCoeff and recovers otherwise."""
    engaged = uni(seed, f"fatigue.{step}", key) < F.col("addictionCoeff")
    change = F.when(engaged, F.lit(accumulation)).otherwise(F.lit(-recovery))
    return state.withColumn("fatigue", clip(F.col("fatigue") + change, 0.0, 1.0))


def fold_by_step(
    events: DataFrame,
    key: str = "humanId",
    step: str = "step",
    rule: str = "fatigue",
    start: float = 0.0,
    accumulation: float = 0.02,
    recovery: float | None = None,
    rate: float = 0.05,
    first_step: int | None = None,
    block: int = 128,
) -> DataFrame:
    """An entity's fatigue or attention after each of its recorded steps.

    Every step counts from ``first_step`` (default: the first in the table),
    recorded or not.  Rows: (key, step, n reactions, fatigue|attentionSpan).
    ``recovery`` defaults to the rule's own rate.
    """
    require(rule in ("fatigue", "attention"), f"unknown rule {rule}")
    if recovery is None:
        recovery = 0.01 if rule == "fatigue" else 0.02
    counts = events.groupBy(key, F.col(step).cast("long").alias(step)).agg(
        F.count_if(F.col("reacted")).alias("n")
    )
    origin = total(events, F.min(F.col(step).cast("long"))) if first_step is None else F.lit(first_step)
    counts = counts.withColumn("_t", F.col(step) - origin)
    if rule == "attention":
        # Attention depends on elapsed steps only: each distinct step is folded once, in
        # spans of ``block`` steps, and the rows look their level up.
        zero, t = F.lit(0).cast("long"), F.col("_t")
        level = F.aggregate(
            F.sequence(zero, F.floor(t / F.lit(block))), F.lit(float(start)),
            lambda x, span: F.aggregate(
                F.sequence(span * block, F.least(t, span * block + (block - 1))), x,
                lambda y, _: decayed(y, rate, recovery),
            ),
        )
        levels = counts.select("_t").distinct().withColumn("attentionSpan", level)
        return counts.join(levels, "_t").select(key, step, "n", "attentionSpan")
    ends = events.agg(F.min(F.col(step).cast("long")), F.max(F.col(step).cast("long"))).first()
    last = 0 if ends[1] is None else ends[1] - (ends[0] if first_step is None else first_step)
    return _fold_fatigue(counts, key, step, start, accumulation, recovery, block, last)


def _clamp(x: Column, f: Column) -> Column:
    """Apply x -> min(hi, max(lo, x + d)), the shape that clamped steps compose to."""
    return F.least(f["hi"], F.greatest(f["lo"], x + f["d"]))


def _move(d: Column) -> Column:
    return F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"), d.cast("double").alias("d"))


def _then(f: Column, g: Column) -> Column:
    """First f, then g: again a clamped shift."""
    return F.struct(
        _clamp(f["lo"], g).alias("lo"), _clamp(f["hi"], g).alias("hi"), (f["d"] + g["d"]).alias("d")
    )


def _fold_fatigue(
    counts: DataFrame, key: str, step: str, start: float, acc: float, rec: float, block: int, last: int
) -> DataFrame:
    """Scan a tree of blocks, so that no task holds an entity's whole history.

    Steps are cut into blocks and each block reduces to one clamped shift.
    FANOUT neighbouring shifts reduce to one on the next level, until FANOUT at
    most are left of an entity.  Levels then come down the tree: the level at the
    start of a node and the shifts of its children give the level at the start of
    each child, and last every block is scanned from its own.  No row holds
    more than ``block`` steps or FANOUT children.  ``last`` is the last step's distance
    from the first; it gives the height of the tree.
    """
    long_block = F.lit(block).cast("long")
    # A step without reactions is idle whether recorded or not, but recorded ones are reported.
    blocks = (
        counts.withColumn("_b", F.floor(F.col("_t") / long_block).cast("long"))
        .groupBy(key, "_b")
        .agg(F.sort_array(F.collect_list(F.struct("_t", "n", step))).alias("_recs"))
    )

    def change(n: Column) -> Column:
        return F.when(n > 0, n * F.lit(acc)).otherwise(F.lit(-rec))

    def idle(steps: Column) -> Column:
        return _move(-F.lit(rec) * steps)

    first = F.col("_b") * long_block
    zero = F.struct(first.alias("at"), _move(F.lit(0.0)).alias("f"))
    reduced = F.aggregate(
        "_recs", zero,
        lambda s, x: F.struct(
            (x["_t"] + 1).alias("at"),
            _then(_then(s["f"], idle(x["_t"] - s["at"])), _move(change(x["n"]))).alias("f"),
        ),
        lambda s: _then(s["f"], idle(first + long_block - s["at"])),
    )

    def gathered(shifts: DataFrame, parent: Column) -> DataFrame:
        """(key, _b, _kids): the shifts of neighbouring nodes under their parent, in order."""
        return shifts.groupBy(key, parent.alias("_b")).agg(
            F.sort_array(F.collect_list(F.struct(F.col("_b"), F.col("_f")))).alias("_kids"))

    def joined(kids: Column, node: Column, span: int) -> Column:
        """The shift of a node from those of its children, ``span`` steps each; missing children are idle."""
        steps, begin = F.lit(span).cast("long"), node * FANOUT
        start = F.struct(begin.alias("b"), _move(F.lit(0.0)).alias("f"))
        return F.aggregate(kids, start, lambda s, k: F.struct(
            (k["_b"] + 1).alias("b"), _then(_then(s["f"], idle((k["_b"] - s["b"]) * steps)), k["_f"]).alias("f"),
        ), lambda s: _then(s["f"], idle((begin + FANOUT - s["b"]) * steps)))

    def opened(kids: Column, begin: Column, level: Column, span: int) -> Column:
        """The level at the start of each child, from the level at the start of the node."""
        steps = F.lit(span).cast("long")
        none = F.array().cast("array<struct<_b:bigint,_x:double>>")

        def rested(s: Column, k: Column) -> Column:
            return _clamp(s["x"], idle((k["_b"] - s["b"]) * steps))

        return F.aggregate(
            kids, F.struct(begin.alias("b"), level.alias("x"), none.alias("out")),
            lambda s, k: F.struct(
                (k["_b"] + 1).alias("b"), _clamp(rested(s, k), k["_f"]).alias("x"),
                F.array_append(s["out"], F.struct(k["_b"].alias("_b"), rested(s, k).alias("_x"))).alias("out"),
            ), lambda s: s["out"])

    shifts, nodes, span, width = blocks.select(key, "_b", reduced.alias("_f")), [], block, last // block + 1
    while width > FANOUT:
        parents = gathered(shifts, F.floor(F.col("_b") / FANOUT).cast("long"))
        nodes.append((parents, span))
        shifts = parents.select(key, "_b", joined(F.col("_kids"), F.col("_b"), span).alias("_f"))
        span, width = span * FANOUT, -(-width // FANOUT)
    zero_node = F.lit(0).cast("long")
    top = gathered(shifts, zero_node)
    levels = top.select(key, F.explode(opened(F.col("_kids"), zero_node, F.lit(float(start)), span)).alias("_o"))
    for parents, span in reversed(nodes):
        levels = levels.select(key, "_o._b", "_o._x")
        down = opened(F.col("_kids"), F.col("_b") * FANOUT, F.col("_x"), span)
        levels = parents.join(levels, [key, "_b"]).select(key, F.explode(down).alias("_o"))
    starts = levels.select(key, "_o._b", "_o._x")
    out_type = f"array<struct<{step}:bigint,n:bigint,fatigue:double>>"
    scanned = F.aggregate(
        "_recs",
        F.struct(first.alias("at"), F.col("_x").alias("x"), F.array().cast(out_type).alias("out")),
        lambda s, x: _scan_one(s, x, idle, change, step),
        lambda s: s["out"],
    )
    return (
        blocks.join(starts, [key, "_b"])
        .select(key, F.explode(scanned).alias("_r"))
        .select(key, f"_r.{step}", "_r.n", "_r.fatigue")
    )


def _scan_one(s: Column, x: Column, idle, change, step: str) -> Column:
    rested = _clamp(s["x"], idle(x["_t"] - s["at"]))
    level = _clamp(rested, _move(change(x["n"])))
    row = F.struct(x[step].alias(step), x["n"].alias("n"), level.alias("fatigue"))
    return F.struct(
        (x["_t"] + 1).alias("at"), level.alias("x"), F.array_append(s["out"], row).alias("out")
    )
