"""Interface texts by language, with fallback and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FALLBACK = "en"


def flatten_labels(nested: DataFrame, lang: str) -> DataFrame:
    """lang, key, value from one nested JSON document; keys are joined by dots, from the schema."""

    def leaves(schema: StructType, path: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
        return [x for f in schema.fields for x in (leaves(f.dataType, (*path, f.name)) if isinstance(f.dataType, StructType) else [(*path, f.name)])]

    def value(path: tuple[str, ...]):
        column = F.col(f"`{path[0]}`")
        for name in path[1:]:
            column = column.getField(name)
        return column.cast("string")

    pairs = F.array(*[F.struct(F.lit(".".join(p)).alias("key"), value(p).alias("value")) for p in leaves(nested.schema)])
    return nested.select(F.explode(pairs).alias("x")).select(F.lit(lang).alias("lang"), "x.key", "x.value")


def resolve_labels(wanted: DataFrame, labels: DataFrame, fallback: str = FALLBACK) -> DataFrame:
    """wanted: lang, key, ... Adds value: of the language, else of the fallback language, else the key itself.

    Of several texts of one language and key the smallest counts, so rows of wanted never multiply.
    """
    own = labels.groupBy("lang", "key").agg(F.min("value").alias("own"))
    base = own.filter(F.col("lang") == fallback).select("key", F.col("own").alias("base"))
    joined = wanted.join(own, ["lang", "key"], "left").join(base, "key", "left")
    return joined.withColumn("value", F.coalesce("own", "base", "key")).drop("own", "base")


def label_coverage(used: DataFrame, labels: DataFrame) -> DataFrame:
    """lang, key, problem: missing in a language, missing_everywhere, or other placeholders than the fallback language has."""
    langs, keys = labels.select("lang").distinct(), labels.select("key").distinct()
    every = F.broadcast(langs).crossJoin(keys)  # languages are a handful
    missing = every.join(labels, ["lang", "key"], "left_anti").withColumn("problem", F.lit("missing"))
    nowhere = used.select("key").distinct().join(keys, "key", "left_anti").select(F.lit(None).cast("string").alias("lang"), "key", F.lit("missing_everywhere").alias("problem"))
    names = F.array_sort(F.array_distinct(F.regexp_extract_all("value", F.lit(r"\{\{(\w+)\}\}"), 1)))
    marked = labels.select("lang", "key", names.alias("names"))
    base = marked.filter(F.col("lang") == FALLBACK).select("key", F.col("names").alias("expected"))
    other = marked.join(base, "key").filter("names <> expected").select("lang", "key", F.lit("placeholders").alias("problem"))
    return missing.unionByName(nowhere).unionByName(other)
