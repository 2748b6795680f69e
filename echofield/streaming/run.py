"""Running a streaming operator over what has arrived so far."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from echofield.session import scratch_path, setting


def parquet_stream(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str | None = None, max_files: int | None = None
) -> DataFrame:
    """Parquet files of a folder as a stream, oldest first.

    ``pattern`` selects file names; ``max_files`` bounds the files, and so the
    rows held at once, of a micro-batch.
    """
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def drain(stream: DataFrame, path: str, checkpoint: str, apart: str | None = None) -> None:
    """Process all available input into a Parquet table, exactly once, and stop.

    ``apart`` names a column whose values become folders of the table, so that
    rows marked by it lie in files of their own.
    """
    writer = stream.writeStream.format("parquet").outputMode("append")
    if apart:
        writer = writer.partitionBy(apart)
    (
        writer.option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start().awaitTermination()
    )


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which state processors with timers need.

    The session's own choice holds if it has made one, and again afterwards.
    """
    name = "spark.sql.streaming.stateStore.providerClass"
    kept = spark.conf.get(name)
    rocks = kept if "RocksDB" in kept else "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    with setting(spark, name, rocks):
        yield


def drained(spark: SparkSession, stream: DataFrame, name: str, apart: str | None = None) -> DataFrame:
    """Drain into a new table below the shared folder and read it back."""
    base = scratch_path(spark, name)
    drain(stream, f"{base}/out", f"{base}/checkpoint", apart)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
