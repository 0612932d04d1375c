"""Reading and writing topics: Kafka in production, files of records elsewhere.

Every source gives ``value`` (text), ``timestamp`` (source time) and ``offset``
(order within equal times). Every sink takes ``topic`` and ``value``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

RECORD = "value string, timestamp timestamp, offset bigint"


def kafka_source(spark: SparkSession, brokers: str, topic: str, starting: str = "latest", **options: str) -> DataFrame:
    """One topic as a stream. Needs the Kafka connector on the classpath.

    Without a checkpoint the stream starts at the latest offsets; with one it goes
    on where it stopped.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", brokers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
        .options(**options)
    )
    return reader.load().select(F.col("value").cast("string").alias("value"), "timestamp", "offset")


def file_source(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """A folder of Parquet files with the columns of :data:`RECORD` as a stream."""
    reader = spark.readStream.schema(RECORD)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def read_topic_files(spark: SparkSession, folder: str) -> DataFrame:
    """The same folder as a batch."""
    return spark.read.schema(RECORD).parquet(folder)


def kafka_sink(records: DataFrame, brokers: str) -> DataStreamWriter:
    """Writer that publishes each ``value`` to its ``topic``."""
    return (
        records.select("topic", "value")
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", brokers)
    )


def file_sink(records: DataFrame, folder: str) -> DataStreamWriter:
    """Writer that appends each ``value`` to a folder per ``topic``."""
    return (
        records.select("topic", "value")
        .writeStream.format("json")
        .partitionBy("topic")
        .option("path", folder)
        .outputMode("append")
    )


Sink = Callable[[DataFrame], DataStreamWriter]
