"""Column types and fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

L, D, S, B, I = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


PEOPLE = _struct(
    humanId=L, mood=S, attentionSpan=D, addictionCoeff=D, reactionProb=D, fatigue=D,
    valence=D, arousal=D, baselineValence=D, baselineArousal=D,
)
CONTENT = _struct(contentId=L, emotionType=S, intensity=D, halfLife=D, createdAtStep=L)
EDGES = _struct(source=L, target=L, weight=D)
EXPOSURES = _struct(
    humanId=L, contentId=L, emotionType=S, intensity=D, currentMood=S, attentionSpan=D
)
INTERACTIONS = _struct(
    humanId=L, contentId=L, emotionType=S, reacted=B, emotionDelta=D, currentMood=S
)
SCORES = _struct(humanId=L, contentId=L, emotionType=S, score=D)
METRICS = T.StructType(
    [T.StructField("timeStep", L), T.StructField("moodDistribution", T.MapType(S, L))]
    + [T.StructField(n, L) for n in (
        "totalInteractions", "positiveInteractions", "negativeInteractions", "collapsedCount")]
    + [T.StructField(n, D) for n in (
        "avgEngagement", "engagementGini", "polarizationIndex", "extremismRate",
        "fragmentationIndex", "emotionDominanceRatio", "attentionGini", "averageAttention",
        "averageFatigue", "fatigueP95")]
)

# --- Fixed values: classes, affect per class and type, update rules, defaults ---

JOY, NEUTRAL, RAGE = "JOY", "NEUTRAL", "RAGE"
CLASSES = (JOY, NEUTRAL, RAGE)
POSITIVE, NEGATIVE = "POSITIVE", "NEGATIVE"
TYPES = (POSITIVE, NEUTRAL, NEGATIVE)

CLASS_VALUE = {JOY: 1, NEUTRAL: 0, RAGE: -1}
CLASS_OF_TYPE = {POSITIVE: JOY, NEUTRAL: NEUTRAL, NEGATIVE: RAGE}

# (valence, arousal)
CLASS_AFFECT = {JOY: (0.7, 0.5), NEUTRAL: (0.0, 0.0), RAGE: (-0.7, 0.8)}
TYPE_AFFECT = {POSITIVE: (0.7, 0.5), NEUTRAL: (0.0, 0.0), NEGATIVE: (-0.7, 0.8)}

# (reacted, not reacted)
TYPE_DELTA = {POSITIVE: (0.1, 0.02), NEUTRAL: (0.0, 0.0), NEGATIVE: (-0.15, -0.03)}

# Trait ranges [lo, hi) of a synthetic population and of synthetic items.
TRAITS = {
    "attentionSpan": (0.5, 1.0),
    "addictionCoeff": (0.3, 0.8),
    "reactionProb": (0.3, 0.7),
    "fatigue": (0.0, 0.1),
}
BASELINES = {"baselineValence": (-0.2, 0.2), "baselineArousal": (-0.3, 0.3)}
ITEM_RANGES = {"intensity": (0.3, 0.9), "halfLife": (5.0, 20.0)}
ITEM_TYPE_SHARES = {POSITIVE: 0.33, NEUTRAL: 0.33, NEGATIVE: 0.34}

BASE_RATE = 0.1          # class pressure per unit share
REACTION_RATE = 0.5      # reaction probability per attention x intensity
COLLAPSE_AT = 0.95
VISIBLE_AT = 0.01
PERSISTENCE = 0.70

# name -> (type, default, minimum, maximum); None means unbounded
PARAM_RULES = {
    "seed": (L, 42, None, None),
    "populationSize": (I, 10_000, 100, 1_000_000),
    "contentCount": (I, 100, 10, 10_000),
    "rageStickiness": (D, 0.3, None, None),
    "socialProofBase": (D, 0.5, None, None),
    "rageSpreadMultiplier": (D, 1.0, 0.0, 2.0),
    "joySpreadMultiplier": (D, 1.0, 0.0, 2.0),
    "attentionDecayRate": (D, 0.05, None, None),
    "attentionRecoveryRate": (D, 0.02, None, None),
    "fatigueAccumulationRate": (D, 0.02, None, None),
    "fatigueRecoveryRate": (D, 0.01, None, None),
    "contentHalfLife": (D, 10.0, 1.0, 100.0),
    "initialExposureRate": (D, 0.1, None, None),
    "networkType": (S, "ALL_TO_ALL", None, None),
    "networkM": (I, 3, 1, 10),
    "networkK": (I, 6, 2, 20),
    "networkP": (D, 0.05, 0.0, 1.0),
    "recommenderType": (S, "NONE", None, None),
    "explorationRate": (D, 0.3, 0.0, 1.0),
    "useContinuousEmotions": (B, False, None, None),
    "emotionRegressionRate": (D, 0.05, None, None),
    "arousalDecayRate": (D, 0.10, None, None),
    "contentInfluenceWeight": (D, 0.15, None, None),
    "socialInfluenceWeight": (D, 0.10, None, None),
}
INITIAL_SHARES = (0.2, 0.6)
