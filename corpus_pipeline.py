"""Corpus preparation from end to end: each stage reads what the stage before wrote.

All stages take rows with nulls in any column, empty and very long texts, repeated rows, extra columns with any names and
empty tables; a null text counts as empty. The first four return the columns that they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folioworks.llm import exact, mixing, packing, simhash, toxicity
from folioworks.llm.scratch import prepare, stage_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the span tagger scores at 0.5 or more go; null and empty texts stay, repeated rows stay or go together."""
    prepare(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest identifier stays, one row of it; null identifiers are below all others."""
    prepare(spark)
    return exact.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints the document with the smallest identifier stays; rows with a null one stay."""
    prepare(spark)
    return simhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it; a null source is one of its own, ties go by identifier."""
    prepare(spark)
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; every row has one at least."""
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path(packing.VOCABULARY))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: The first stage's model can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = stage_folder(spark)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
