"""Running values along the time line of a key, in slices of time.

A window over a key sorts the key's whole history in one task. Here the windows run inside slices of a key's time, each
slice is summed up in one row, and a window over these few rows carries what came before into each slice. A key that
holds a third of all rows spreads over as many tasks as it has slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_S = 86_400
SLICE = "__slice"


def sliced(rows: DataFrame, keys: Sequence[str], time: str, width_s: int) -> tuple[DataFrame, list[str]]:
    """rows with the number of their slice, and columns that stand for the keys and are never null, so that slices can be joined by them."""
    marks = [f"__key{i}" for i in range(len(keys))]
    plain = {m: F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for m, k in zip(marks, keys, strict=True)}
    slot = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / F.lit(width_s * 1_000_000))
    return rows.withColumns({**plain, SLICE: F.coalesce(slot, F.lit(-(1 << 62)))}), marks  # rows without a time come first


def within(marks: Sequence[str], *order: str):
    """The window of a slice."""
    return Window.partitionBy(*marks, SLICE).orderBy(*order)


def earlier(marks: Sequence[str]):
    """The window of the slices of a key before each of them."""
    return Window.partitionBy(*marks).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)


def last_of(value: Column, *order: str) -> Column:
    """The last value that is not null, as an aggregate."""
    return F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))


def cleared(rows: DataFrame, marks: Sequence[str]) -> DataFrame:
    return rows.drop(*marks, SLICE)
