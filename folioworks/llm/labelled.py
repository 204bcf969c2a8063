"""Bounded training samples of labelled documents, and the held-out fold."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model may learn from: crc32 of the identifier as text, modulo five, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, target: str, most_of: dict[int, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """__id, __labels, __text of at most most_of[label] documents of each label outside the held-out fold, in hash order of their ids.

    Null labels, ids and texts are left out. Repeated label rows count once, and an id with several rows in docs has the
    smallest of its texts.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.select(F.col("doc_id").cast("long").alias("__id"), F.col(target).cast("int").alias("__label")).distinct()
    picked = None
    for label, most in most_of.items():
        some = usable.filter(F.col("__label") == label).orderBy(F.xxhash64("__id"), "__id").limit(most)
        picked = some if picked is None else picked.union(some)
    # The picked ids are bounded by most_of, so this side can be broadcast.
    return one_text(docs, picked.groupBy("__id").agg(F.sort_array(F.collect_set("__label")).alias("__labels")), id_col, text_col).select("__id", "__labels", "__text")


def distinct_texts(rows: Iterable[tuple[int, list[int], str]]) -> list[tuple[str, int]]:
    """Texts and labels of training rows in order of ids; equal texts count once."""
    texts: dict[str, int] = {}
    for _, label, text in sorted((i, label, text) for i, labels, text in rows for label in labels):
        texts.setdefault(text, label)
    return list(texts.items())


def training_texts(docs: DataFrame, labels: DataFrame, target: str, most_of: dict[int, int], id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """Texts and labels of training_rows; this bounded sample is all that reaches the driver."""
    return distinct_texts(tuple(r) for r in training_rows(docs, labels, target, most_of, id_col, text_col).collect())


def one_text(docs: DataFrame, picked: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of picked, a bounded table with one row an __id, with __text, the smallest text that docs has for the id; none without a text."""
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text")).filter("__text is not null")
    # Joined first, so that only texts of picked ids are grouped; each task keeps one of an id's texts before any travels.
    least = texts.join(F.broadcast(picked.select("__id")), "__id").groupBy("__id").agg(F.min("__text").alias("__text"))
    return least.join(F.broadcast(picked), "__id")
