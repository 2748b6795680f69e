"""Per-step tables: one partition per step, or one path per step as written elsewhere."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEP_FILE = r"step_(\d+)\.parquet"  # fixed format of path-encoded snapshots
STEP_FOLDER = r"step=(\d+)/"  # folders of ``write_snapshot``


def write_snapshot(df: DataFrame, path: str, step: int | None = None) -> None:
    """Write one step (or all steps of ``df``), replacing only the steps it holds.

    Dynamic partition overwrite makes a rerun of the same step idempotent.
    """
    out = df if step is None else df.withColumn("step", F.lit(step).cast("long"))
    (
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("step").parquet(path)
    )


def _with_step(schema: T.StructType | None) -> T.StructType | None:
    if schema is None:
        return None
    fields = [f for f in schema.fields if f.name != "step"]
    return T.StructType([*fields, T.StructField("step", T.LongType())])


def read_partitioned(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """All steps of a table written by ``write_snapshot``; a filter on step prunes folders."""
    reader = spark.read
    full = _with_step(schema)
    if full is not None:
        reader = reader.schema(full)
    return reader.parquet(path).withColumn("step", F.col("step").cast("long"))


def read_snapshot(
    spark: SparkSession, path: str, step: int, schema: T.StructType | None = None
) -> DataFrame:
    """One step: only its folder is listed and read."""
    reader = spark.read if schema is None else spark.read.schema(_with_step(schema))
    return reader.parquet(path).filter(F.col("step") == step).withColumn("step", F.col("step").cast("long"))


def read_snapshots(
    spark: SparkSession, glob: str, schema: T.StructType | None = None, pattern: str = STEP_FILE
) -> DataFrame:
    """All path-encoded steps matching ``glob``; the step is the first group of ``pattern`` in the path."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(glob)
    step = F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).cast("long")
    return df.select("*", step.alias("step"))


def append_metrics(df: DataFrame, path: str, step: str | None = None) -> None:
    """Append metrics rows.

    With ``step`` the table is kept in one folder per value of that column, and
    the rows replace those of the same steps: a step that runs again, after a
    failure or a retry, leaves the table as one run does.
    """
    if step is None:
        df.write.mode("append").parquet(path)
    else:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(step).parquet(path)


def metrics_history(spark: SparkSession, path: str, step: str = "timeStep") -> DataFrame:
    """All metrics rows by step, kept in folders per step or not."""
    return spark.read.parquet(path).withColumn(step, F.col(step).cast("long")).orderBy(step)


def read_or_default(
    spark: SparkSession, path: str, schema: T.StructType, default: DataFrame | None = None
) -> DataFrame:
    """The table at ``path``, else ``default``, else an empty table of the schema."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return spark.createDataFrame([], schema) if default is None else default
