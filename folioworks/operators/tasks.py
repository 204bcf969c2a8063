"""Conversion tasks: parsing, validation, quarantine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a task may ask for.
MODES = ("ocr", "layout")
DEFAULT_MODE = "ocr"
SCHEMA = "file_id string, user_id string, mode string, _corrupt string"


def parse_tasks(raw: DataFrame) -> DataFrame:
    """raw: value (JSON text) and other columns. Adds file_id, user_id, mode and damaged."""
    parsed = raw.withColumn("task", F.from_json("value", SCHEMA, {"columnNameOfCorruptRecord": "_corrupt"}))
    damaged = F.col("task").isNull() | F.col("task._corrupt").isNotNull()
    return parsed.select(*raw.columns, "task.file_id", "task.user_id", F.coalesce("task.mode", F.lit(DEFAULT_MODE)).alias("mode"), damaged.alias("damaged"))


def validate_tasks(raw: DataFrame, modes: Sequence[str] | None = None) -> DataFrame:
    """Adds reason: damaged, no_file, no_user, bad_mode (only if modes are given), or null for a valid task."""
    parsed = parse_tasks(raw)
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    reason = F.when(F.col("damaged"), "damaged").when(empty("file_id"), "no_file").when(empty("user_id"), "no_user")
    if modes is not None:
        reason = reason.when(~F.col("mode").isin(*modes), "bad_mode")
    return parsed.withColumn("reason", reason).drop("damaged")


def split_tasks(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid tasks and quarantined ones."""
    return validated.filter("reason is null").drop("reason"), validated.filter("reason is not null")


def publish_tasks(tasks: DataFrame) -> DataFrame:
    """One JSON text per task, for a JSON or Kafka sink."""
    return tasks.select(F.to_json(F.struct("file_id", "user_id", "mode")).alias("value"))
