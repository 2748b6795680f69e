"""Who sees which item: time decay, candidate pairs and exposure probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofield import schemas as S
from echofield.functions.columns import poisson_draws, total, uni
from echofield.functions.ranking import dense_index
from echofield.operators.sampling import bernoulli_filter

TRAITS = ("attentionSpan", "addictionCoeff", "mood")
ITEM_COLUMNS = ("visibility", "emotionType", "intensity")
CANDIDATE = ("humanId", *TRAITS, "contentId", *ITEM_COLUMNS, "neighbor_count")


def visibility(items: DataFrame, now: Column | int, min_visibility: float | None = None) -> DataFrame:
    """Add 2^(-age / halfLife); 0 before creation.  Optionally drop items below a threshold."""
    age = (F.lit(now) if isinstance(now, int) else now) - F.col("createdAtStep")
    seen = F.when(age < 0, F.lit(0.0)).otherwise(
        F.pow(F.lit(2.0), -age.cast("double") / F.col("halfLife"))
    )
    out = items.withColumn("visibility", seen)
    return out if min_visibility is None else out.filter(F.col("visibility") >= min_visibility)


def pair_scores(
    pairs: DataFrame, people: DataFrame, items: DataFrame, rate: float = 0.1
) -> DataFrame:
    """attention x addiction x visibility x rate for each given (humanId, contentId) pair."""
    traits = pairs.select("humanId", "contentId").join(people.select("humanId", *TRAITS), "humanId")
    joined = traits.join(items.select("contentId", *ITEM_COLUMNS), "contentId")
    return joined.withColumn(
        "exposureProb",
        F.col("attentionSpan") * F.col("addictionCoeff") * F.col("visibility") * F.lit(rate),
    )


def sparse_pairs(
    people: DataFrame, items: DataFrame, p: Column, seed: int = 42, salt: str = "pairs"
) -> DataFrame:
    """Pairs (humanId, contentId, p), each item joining a person with probability ``p``.

    ``p`` depends on the person only.  Every pair is included independently,
    as if each had been rolled, but only included pairs are ever made: a
    Poisson number of picks of mean -n ln(1-p) is spread evenly over the n
    items, and a pair is included when it is picked at least once.
    """
    numbered = dense_index(items.select("contentId"), "contentId", "_idx")
    n = total(items, F.count(F.lit(1)))
    ready = people.select("humanId", p.alias("_p")).withColumn("_n", n)
    draws = poisson_draws(ready, -F.log1p(-F.col("_p")) * F.col("_n"), seed, salt + ".count", ["humanId"])
    placed = draws.withColumn(
        "_idx", F.floor(uni(seed, salt + ".item", "humanId", "draw") * F.col("_n")).cast("long")
    )
    return placed.select("humanId", "_p", "_idx").distinct().join(numbered, "_idx").select(
        "humanId", "contentId", F.col("_p").alias("p")
    )


def sampled_exposures(
    people: DataFrame, items: DataFrame, rate: float = 0.1, seed: int = 42
) -> DataFrame:
    """Exposures when everyone may see everything, without listing every pair.

    Each pair is exposed independently with probability attention x addiction
    x visibility x rate.  Pairs are picked at the rate of the most visible
    item and thinned to their own: with p the pair's probability and q the
    bound, Poisson thinning keeps a pick with ln(1-p) / ln(1-q).
    """
    top = total(items, F.max("visibility"))
    mine = people.withColumn("_own", F.col("attentionSpan") * F.col("addictionCoeff") * F.lit(rate))
    bound = F.least(F.col("_own") * F.col("_top"), F.lit(1.0 - 1e-12))
    numbered = dense_index(items, "contentId", "_idx")
    n = total(items, F.count(F.lit(1)))
    ready = mine.select("humanId", "_own", *TRAITS).withColumns({"_n": n, "_top": top})
    ready = ready.withColumn("_rate", -F.log1p(-bound))
    draws = poisson_draws(ready, F.col("_rate") * F.col("_n"), seed, "exposure.count", ["humanId"])
    placed = draws.withColumns({
        "_idx": F.floor(uni(seed, "exposure.item", "humanId", "draw") * F.col("_n")).cast("long"),
        "_thin": uni(seed, "exposure.thin", "humanId", "draw"),
    })
    kept = placed.join(
        numbered.select("_idx", "contentId", *ITEM_COLUMNS), "_idx"
    ).withColumn("exposureProb", F.col("_own") * F.col("visibility"))
    kept = kept.filter(F.col("_thin") * F.col("_rate") < -F.log1p(-F.least("exposureProb", F.lit(1.0 - 1e-12))))
    # A pair picked twice gives two equal rows, so whole rows can be compared.
    return _as_exposures(kept, "exposureProb").distinct()


def _as_exposures(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(
        "humanId", "contentId", "emotionType", "intensity",
        F.col("mood").alias("currentMood"), "attentionSpan", *extra,
    )


def neighbor_candidates(people: DataFrame, activity: DataFrame, items: DataFrame) -> DataFrame:
    """People with the items their neighbours touched.

    Where one item holds a large share of the rows, adaptive execution splits its
    partition by the sizes it sees; other items are neither repeated nor counted first.
    """
    traits = activity.join(people.select("humanId", *TRAITS), "humanId")
    return traits.join(items.select("contentId", *ITEM_COLUMNS), "contentId").select(*CANDIDATE)


def _fill_pairs(pairs: DataFrame, people: DataFrame, items: DataFrame) -> DataFrame:
    traits = pairs.select("humanId", "contentId").join(people.select("humanId", *TRAITS), "humanId")
    filled = traits.join(items.select("contentId", *ITEM_COLUMNS), "contentId")
    return filled.withColumn("neighbor_count", F.lit(0).cast("long")).select(*CANDIDATE)


def explore_mix(
    candidates: DataFrame, people: DataFrame, items: DataFrame,
    person_share: float = 0.1, item_share: float = 0.05, seed: int = 42,
) -> DataFrame:
    """Add exploration pairs with neighbor_count 0; one row per pair, neighbour rows win.

    A pair is explored with probability person_share x item_share.
    """
    pairs = sparse_pairs(people, items, F.lit(person_share * item_share), seed, "explore")
    mixed = candidates.select(*CANDIDATE).unionByName(_fill_pairs(pairs, people, items))
    # Everything but the count is determined by the pair, so grouping by all of it
    # gives one row per pair while the aggregate itself stays a hash aggregate.
    pair = [c for c in CANDIDATE if c != "neighbor_count"]
    return mixed.groupBy(*pair).agg(F.max("neighbor_count").alias("neighbor_count")).select(*CANDIDATE)


def cold_start(people: DataFrame, items: DataFrame, fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """Candidates when nothing is recorded yet: each pair with probability ``fraction``, count 0."""
    return _fill_pairs(
        sparse_pairs(people, items, F.lit(fraction), seed, "cold"), people, items
    )


def social_proof(df: DataFrame, base: float = 0.5) -> DataFrame:
    """Add 1 - base^neighbor_count."""
    return df.withColumn("social_proof", F.lit(1.0) - F.pow(F.lit(base), F.col("neighbor_count")))


def blend_scores(
    candidates: DataFrame, scores: DataFrame | None = None, base: float = 0.5, floor: float = 0.0
) -> DataFrame:
    """Exposure probability of each candidate.

    With scores: attention x addiction x visibility x (proof + score) / 2, a
    missing score counting 0; without: the same product with the proof alone.
    ``floor`` is the least social proof, for candidates without neighbours.
    """
    df = social_proof(candidates, base)
    proof = F.greatest("social_proof", F.lit(floor)) if floor else F.col("social_proof")
    traits = F.col("attentionSpan") * F.col("addictionCoeff") * F.col("visibility")
    if scores is None:
        return df.withColumn("exposureProb", traits * proof)
    keys = [k for k in ("humanId", "contentId") if k in scores.columns]
    scored = scores.select(*keys, "score")
    joined = df.join(scored, keys, "left")
    value = F.coalesce(F.col("score"), F.lit(0.0))
    return joined.withColumn("recommender_score", value).drop("score").withColumn(
        "exposureProb", traits * (proof * F.lit(0.5) + F.col("recommender_score") * F.lit(0.5))
    )


def expose(candidates: DataFrame, seed: int = 42, step: int = 0) -> DataFrame:
    """Roll each scored candidate and return the exposures."""
    hit = bernoulli_filter(candidates, "exposureProb", ["humanId", "contentId"], seed, f"expose.{step}")
    return _as_exposures(hit)


VISIBLE_AT = S.VISIBLE_AT
