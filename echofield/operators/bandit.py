"""Item scoring: engagement counts, noisy and exact bandit scores, top items, agreement tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echofield.functions.columns import gauss, require, total, uni
from echofield.functions.ranking import chunked
from echofield.functions.special import kolmogorov_tail

GAMMA_ROUNDS = 32  # a round is rejected with a chance below 5%, so all of them with one below 1e-41


def item_engagement(items: DataFrame, interactions: DataFrame, failures: bool = False) -> DataFrame:
    """Successes and failures per item, items without interactions included.

    Every interaction is a success and failures stay 0; with ``failures`` only
    reactions are successes and the others failures.
    """
    one = F.count(F.lit(1))
    good = F.count_if(F.col("reacted")) if failures else one
    stats = interactions.groupBy("contentId").agg(good.alias("_s"), one.alias("_n"))
    zero = F.lit(0.0)
    s = F.coalesce(F.col("_s").cast("double"), zero)
    return items.join(stats, "contentId", "left").select(
        "contentId", "emotionType", s.alias("successes"),
        (F.coalesce(F.col("_n").cast("double"), zero) - s).alias("failures"),
    )


def bandit_scores(
    stats: DataFrame, rate: float = 0.1, mode: str = "sqrt_total", seed: int = 42,
    keys: Sequence[str] = ("contentId",), salt: str = "bandit",
) -> DataFrame:
    """Mean reward of Beta(successes + 1, failures + 1) plus keyed noise.

    mode "sqrt_total": noise scaled by rate x sqrt(alpha + beta), which grows
    with the evidence; mode "beta_moments": by the standard deviation of the Beta.
    """
    require(mode in ("sqrt_total", "beta_moments"), f"unknown mode {mode}")
    a, b = F.col("successes") + 1.0, F.col("failures") + 1.0
    spread = F.sqrt(a + b) * F.lit(rate) if mode == "sqrt_total" else _beta_sd(a, b)
    return stats.withColumn("score", a / (a + b) + spread * gauss(seed, salt, *keys))


def _beta_sd(a: Column, b: Column) -> Column:
    n = a + b
    return F.sqrt(a * b / (n * n * (n + 1.0)))


def _gamma(shape: Column, seed: int, salt: str, keys: Sequence[str]) -> Column:
    """Gamma(``shape``) variate for shapes of 1 or more, by rejection from a cubed normal.

    With d = shape - 1/3 and v = (1 + x / (3 sqrt d))**3, d v is kept when
    ln u < x**2 / 2 + d - d v + d ln v.  Exact for every shape, at a constant
    cost: rounds are drawn until one is kept.
    """
    def attempt(d: Column, i: Column) -> Column:
        x = gauss(seed, salt + ".n", *keys, i)
        u = uni(seed, salt + ".u", *keys, i)

        def cubed(t: Column) -> Column:
            root = F.lit(1.0) + t["x"] / (F.lit(3.0) * F.sqrt(t["d"]))
            return F.struct(t["x"].alias("x"), t["u"].alias("u"), t["d"].alias("d"), (root * root * root).alias("v"))

        def kept(t: Column) -> Column:
            x, d, v = t["x"], t["d"], t["v"]
            bound = x * x / 2.0 + d - d * v + d * F.ln(v)
            return F.when((v > 0) & (F.ln(F.lit(1.0) - t["u"]) < bound), d * v)

        # One-element transforms bind a value, so that its hashes are taken once.
        drawn = F.transform(F.array(F.struct(x.alias("x"), u.alias("u"), d.alias("d"))), cubed)
        return F.transform(drawn, kept)[0]

    start = F.struct((shape.cast("double") - F.lit(1.0 / 3.0)).alias("d"), F.lit(None).cast("double").alias("g"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(GAMMA_ROUNDS)), start,
        lambda s, i: F.when(s["g"].isNotNull(), s).otherwise(F.struct(s["d"].alias("d"), attempt(s["d"], i).alias("g"))),
        lambda s: s["g"],
    )


def beta_draws(
    stats: DataFrame, seed: int = 42, keys: Sequence[str] = ("contentId",), salt: str = "beta",
    name: str = "draw",
) -> DataFrame:
    """One exact Beta(successes + 1, failures + 1) draw per row, as a ratio of two Gamma variates.

    The same way and the same work for any number of events.
    """
    ga = _gamma(F.col("successes") + 1, seed, salt + ".ga", keys)
    gb = _gamma(F.col("failures") + 1, seed, salt + ".gb", keys)
    # The two variates are columns of their own so that the ratio does not draw them twice.
    return stats.withColumns({"_ga": ga, "_gb": gb}).withColumn(
        name, F.col("_ga") / (F.col("_ga") + F.col("_gb"))
    ).drop("_ga", "_gb")


def random_scores(items: DataFrame, seed: int = 42, step: int = 0) -> DataFrame:
    """A uniform score per item."""
    return items.withColumn("score", uni(seed, f"random.{step}", "contentId"))


def score_pairs(pairs: DataFrame, item_scores: DataFrame) -> DataFrame:
    """Item scores for the given (humanId, contentId) pairs.

    The score does not depend on the person, so the full person-by-item matrix
    is never written out: consumers need it only for their candidate pairs.
    """
    scores = item_scores.select("contentId", "emotionType", "score")
    joined = pairs.select("humanId", "contentId").join(scores, "contentId")
    return joined.select("humanId", "contentId", "emotionType", "score")


def top_k_items(scores: DataFrame, k: int) -> DataFrame:
    """The k best items of each person, ties by contentId.

    The rank filter is applied per task before the shuffle, so at most k rows
    per person and task are moved.
    """
    w = Window.partitionBy("humanId").orderBy(F.col("score").desc(), "contentId")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def recommend_all(people: DataFrame, item_scores: DataFrame, k: int) -> DataFrame:
    """The k best items overall for everyone: k items reach each task as one scalar."""
    best = item_scores.orderBy(F.col("score").desc(), "contentId").limit(k)
    entry = F.struct((-F.col("score")).alias("_neg"), "contentId", "emotionType", "score")
    packed = best.agg(F.sort_array(F.collect_list(entry)).alias("_top")).select("_top").scalar()
    return people.select("humanId", F.posexplode(packed).alias("_p", "_i")).select(
        "humanId", "_i.contentId", "_i.emotionType", "_i.score", (F.col("_p") + 1).alias("rank")
    )


def selection_agreement(
    stats: DataFrame, trials: int, rate: float = 0.1, mode: str = "sqrt_total", seed: int = 42
) -> DataFrame:
    """Share of trials in which the noisy score and the exact draw pick the same item.

    Every item is repeated once per trial in place; each task keeps one best
    item per trial before the shuffle.
    """
    runs = stats.withColumn("_trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))
    keys = ["contentId", "_trial"]
    scored = beta_draws(bandit_scores(runs, rate, mode, seed, keys), seed, keys)
    picks = scored.groupBy("_trial").agg(
        F.max_by("contentId", "score").alias("_noisy"), F.max_by("contentId", "draw").alias("_exact")
    )
    same = F.count_if(F.col("_noisy") == F.col("_exact"))
    n = F.count(F.lit(1))
    return picks.agg(n.alias("trials"), same.alias("agreements"), (same / n).alias("agreement"))


def ks_two_sample(df: DataFrame, group: str, value: str, first: str, second: str) -> DataFrame:
    """Largest distance of two empirical distributions and its asymptotic p-value.

    Equal values are counted first; the ordered values are cut into chunks that
    are scanned side by side, and one row per chunk carries the running counts
    on, so no task orders all values.
    """
    both = df.filter(F.col(group).isin(first, second) & F.col(value).isNotNull())
    ones, twos = F.count_if(F.col(group) == first), F.count_if(F.col(group) == second)
    n1, n2 = total(both, ones), total(both, twos)
    counts = both.groupBy(F.col(value).cast("double").alias("v")).agg(ones.alias("a"), twos.alias("b"))
    w = Window.partitionBy("_chunk").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    scanned = chunked(counts, []).withColumns({"_a": F.sum("a").over(w), "_b": F.sum("b").over(w)})
    scanned = scanned.withColumns({"_n1": n1, "_n2": n2}).withColumn(
        "_d", F.col("_a") / F.col("_n1") - F.col("_b") / F.col("_n2")
    )
    chunks = scanned.groupBy("_chunk", "_n1", "_n2").agg(
        F.max("_d").alias("_hi"), F.min("_d").alias("_lo"), F.sum("a").alias("_sa"), F.sum("b").alias("_sb")
    )
    earlier = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        F.coalesce(F.sum("_sa").over(earlier), F.lit(0)) / F.col("_n1")
        - F.coalesce(F.sum("_sb").over(earlier), F.lit(0)) / F.col("_n2")
    )
    worst = F.greatest(F.abs(F.col("_off") + F.col("_hi")), F.abs(F.col("_off") + F.col("_lo")))
    out = chunks.withColumn("_off", before).groupBy("_n1", "_n2").agg(F.max(worst).alias("statistic"))
    en = F.col("_n1") * F.col("_n2") / (F.col("_n1") + F.col("_n2"))
    return out.select(
        F.col("_n1").alias("n1"), F.col("_n2").alias("n2"), "statistic",
        kolmogorov_tail(F.sqrt(en) * F.col("statistic")).alias("p_value"),
    )
