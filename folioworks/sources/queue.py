"""The task queue: JSON lines in a folder, where messages stay or go when they are acknowledged, or Kafka."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from folioworks.operators.tasks import publish_tasks
from folioworks.sources import acked


def publish(tasks: DataFrame, path: str) -> None:
    publish_tasks(tasks).write.mode("append").text(path)


def task_stream(spark: SparkSession, path: str, files_a_batch: int = 1) -> DataFrame:
    """value, ts (arrival) of each published task."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(path)
    return lines.selectExpr("value", "current_timestamp() as ts")


def acknowledged_task_stream(spark: SparkSession, path: str, messages_a_batch: int = 1) -> DataFrame:
    """value, ts (arrival), message (file name) of each published task, a message at a time; it is deleted when its batch is done and the next begins.

    A query that starts again goes on after its last batch. One with a new checkpoint gets whatever is not acknowledged, first
    and together what was handed out before, the last batch of the query before it included.
    """
    cloudpickle.register_pickle_by_value(acked)  # Spark's own Python process may not have this package
    spark.dataSource.register(acked.TaskQueue)
    return spark.readStream.format("task_queue").option("messages_a_batch", messages_a_batch).load(path)


def kafka_task_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The same from Kafka; needs Spark's Kafka connector on the class path."""
    rows = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return rows.selectExpr("cast(value as string) as value", "timestamp as ts")
