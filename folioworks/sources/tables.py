"""The users relation, from Parquet or from a database."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

USERS = "id int, email string, hashed_password string, name string, email_verified boolean"


def users_table(spark: SparkSession, path: str | None = None, **jdbc: str) -> DataFrame:
    """Parquet at path, or options of Spark's JDBC source (url, dbtable and, for parallel reads, partitionColumn and its bounds)."""
    if path is not None:
        return spark.read.schema(USERS).parquet(path)
    return spark.read.format("jdbc").options(**jdbc).load()


def load_labels(spark: SparkSession, root: str, lang: Column | None = None, depth: int = 8) -> DataFrame:
    """lang, key, value of the label files below root, one JSON document each, all languages in one scan.

    lang: from the file's path (column path); its name without the ending if not given. Documents are read as VARIANT, so
    no schema comes from any one of them; keys of nested objects are joined by dots. What lies deeper than depth is JSON text.
    """
    read = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True)
    read = read.select(F.expr("url_decode(replace(_metadata.file_path, '+', '%2B'))").alias("path"), F.try_parse_json("value").alias("v"))
    own = lang if lang is not None else F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)
    level, out = read.select(own.alias("lang"), F.lit("").alias("key"), "v"), None
    for i in range(depth):
        step = spark.sql("SELECT d.lang, concat(d.key, e.key) AS key, e.value AS v FROM {d} d, LATERAL variant_explode(d.v) AS e WHERE e.key IS NOT NULL", d=level)
        is_object = F.expr("schema_of_variant(v) LIKE 'OBJECT<%'")
        leaf = (~is_object if i < depth - 1 else F.lit(True)) & ~F.is_variant_null("v")
        leaves = step.filter(leaf).select("lang", "key", F.when(is_object, F.to_json("v")).otherwise(F.variant_get("v", "$", "string")).alias("value"))
        out = leaves if out is None else out.unionByName(leaves)
        level = step.filter(is_object).select("lang", F.concat("key", F.lit(".")).alias("key"), "v")
    return out


def load_label_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)
