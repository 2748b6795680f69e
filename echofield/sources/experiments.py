"""Runs of an experiment: metrics of all runs, parameters, registry and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echofield import schemas as S
from echofield.functions.columns import require, total

# Fixed folder layout of runs written elsewhere: <run>/data/<condition>/replicate_<n>/metrics
_CONDITION = r"/data/([^/]+)/replicate_\d+/"
_REPLICATE = r"/replicate_(\d+)/"
_RUN = r"/([^/]+)/data/"


def write_run(df: DataFrame, root: str, run: str) -> None:
    """Write one run's metrics into the table below ``root``, replacing only that run."""
    (
        df.withColumn("run", F.lit(run)).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run", "condition", "replicate").parquet(f"{root}/metrics")
    )


def read_experiment(
    spark: SparkSession, root: str, latest: bool = False, layout: str = "partitioned"
) -> DataFrame:
    """Metrics of all runs below ``root`` with run, condition and replicate columns.

    layout "partitioned" is the table of ``write_run``; "folders" takes the
    three names from <run>/data/<condition>/replicate_<n>/metrics.  Columns may
    differ between runs.  ``latest`` keeps the run whose name sorts last; in
    the partitioned table the other runs' folders are not read.
    """
    require(layout in ("partitioned", "folders"), f"unknown layout {layout}")
    reader = spark.read.option("mergeSchema", "true")
    if layout == "partitioned":
        df = reader.parquet(f"{root}/metrics").withColumns({
            "run": F.col("run").cast("string"), "condition": F.col("condition").cast("string"),
        })
    else:
        path = F.col("_metadata.file_path")
        df = reader.parquet(f"{root}/*/data/*/replicate_*/metrics").select(
            "*",
            F.regexp_extract(path, _RUN, 1).alias("run"),
            F.regexp_extract(path, _CONDITION, 1).alias("condition"),
            F.regexp_extract(path, _REPLICATE, 1).cast("int").alias("replicate"),
        )
    return df.filter(F.col("run") == total(df, F.max("run"))) if latest else df


_PARAM_TYPE = T.StructType(
    [T.StructField(n, t) for n, (t, *_) in S.PARAM_RULES.items()]
    + [T.StructField("initialMoodDistribution", T.ArrayType(T.DoubleType()))]
)


def params_from_json(df: DataFrame, column: str) -> DataFrame:
    """Parse run parameters: typed, unknown keys ignored, defaults filled in."""
    parsed = df.withColumn("_p", F.from_json(F.col(column), _PARAM_TYPE))
    values = [
        F.coalesce(F.col(f"_p.{n}"), F.lit(default).cast(t)).alias(n)
        for n, (t, default, *_) in S.PARAM_RULES.items()
    ]
    shares = F.coalesce(
        F.col("_p.initialMoodDistribution"), F.array(*[F.lit(x) for x in S.INITIAL_SHARES])
    ).alias("initialMoodDistribution")
    kept = [c for c in df.columns if c != column]
    return parsed.select(*kept, *values, shares)


def registry_lookup(
    df: DataFrame, status: str | None = None, name_like: str | None = None
) -> DataFrame:
    """Runs by status and case-insensitive part of the name, newest first."""
    if status is not None:
        df = df.filter(F.col("status") == status)
    if name_like is not None:
        df = df.filter(F.contains(F.lower("name"), F.lit(name_like.lower())))
    return df.orderBy(F.col("createdAt").desc())


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Result rows as CSV with a header (flat columns) or as JSON lines (nested columns kept)."""
    require(fmt in ("csv", "json"), f"unknown format {fmt}")
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", "true").csv(path)
    else:
        writer.json(path)


def nested_report(parts: Mapping[str, DataFrame], single: Sequence[str] = ()) -> DataFrame:
    """One row with a column per part: its rows as a list, or its only row where it is named in ``single``.

    The parts are results, a row per condition or pair of conditions.  Written as
    JSON the row is one object that holds them all.
    """
    require(len(parts) > 0, "a report needs at least one part")
    columns = []
    for name, df in parts.items():
        rows = F.sort_array(F.collect_list(F.struct(*df.columns)))
        whole = total(df, rows)
        columns.append((F.get(whole, F.lit(0)) if name in single else whole).alias(name))
    spark = next(iter(parts.values())).sparkSession
    return spark.range(1).select(*columns)


def write_nested_report(parts: Mapping[str, DataFrame], path: str, single: Sequence[str] = ()) -> None:
    """Write ``nested_report`` as one JSON object in one file below ``path``."""
    nested_report(parts, single).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
