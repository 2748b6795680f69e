"""State and interaction tables stored by entity, so that joining them moves no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofield.functions.columns import require
from echofield.functions.tables import written
from echofield.session import setting


def write_bucketed(
    df: DataFrame, table: str, path: str, key: str = "humanId", buckets: int = 64, step: str | None = "step"
) -> None:
    """Make ``table`` at ``path``: rows in ``buckets`` by a hash of ``key``, sorted by it, one partition per step.

    Two tables with the same key type and number of buckets are joined and
    grouped on the key without a shuffle.  Rows are dealt to their buckets
    before writing, so each step has one file per bucket.  Choose ``buckets``
    for the largest step: all rows of an entity and step lie in one file.
    """
    require(buckets >= 1, f"buckets must be at least 1, got {buckets}")
    writer = df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    if step:
        writer = writer.partitionBy(step)
    writer.option("path", path).saveAsTable(table)


def add_bucketed(df: DataFrame, table: str, key: str = "humanId", step: str | None = "step") -> None:
    """Add rows to a table made by ``write_bucketed``, replacing the steps they hold.

    A rerun of a step leaves it as one run does.  Without a step the rows are
    appended.  The rows are written aside first, since a step is usually made
    from the table's own last one, which Spark does not overwrite while reading.
    """
    spark = df.sparkSession
    columns = spark.table(table).columns
    buckets = buckets_of(spark, table)
    rows = written(df.select(*columns), "step").repartition(buckets, key)
    if not step:
        rows.write.mode("append").insertInto(table)
        return
    with setting(spark, "spark.sql.sources.partitionOverwriteMode", "dynamic"):
        rows.write.insertInto(table, overwrite=True)


def buckets_of(spark: SparkSession, table: str) -> int:
    """The number of buckets of a table."""
    found = spark.sql(f"DESCRIBE EXTENDED {table}").filter(F.col("col_name") == "Num Buckets").select("data_type").first()
    require(found is not None, f"{table} has no buckets")
    return int(found[0])


def read_step(spark: SparkSession, table: str, step: int, column: str = "step") -> DataFrame:
    """One step of a bucketed table: only its folder is read, and its buckets are known to the planner."""
    return spark.table(table).filter(F.col(column) == step)
