"""Class metrics per time bucket of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofield.operators import metrics as m


def stream_step_metrics(
    stream: DataFrame, width: str = "1 day", delay: str = "1 hour", ts: str = "ts", label: str = "mood"
) -> DataFrame:
    """Class counts, polarization, extremism and fragmentation per time bucket.

    A bucket is final when the watermark passes its end; later rows for it are
    dropped.  Rows are pre-aggregated per task, so the state holds one row per
    open bucket.
    """
    window = F.window(F.col(ts), width)
    counts = (
        stream.withWatermark(ts, delay)
        .groupBy(window.alias("_w"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.count_if(F.col(label) == c).alias(name)
              for c, name in (("JOY", "joyCount"), ("NEUTRAL", "neutralCount"), ("RAGE", "rageCount"))],
        )
    )
    return counts.select(
        F.col("_w.start").alias("bucket_start"), F.col("_w.end").alias("bucket_end"),
        "n", "joyCount", "neutralCount", "rageCount",
        m._polarization().alias("polarizationIndex"),
        m._extremism().alias("extremismRate"),
        m._fragmentation().alias("fragmentationIndex"),
    )
