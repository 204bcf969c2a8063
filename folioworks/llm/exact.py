"""Exact duplicates by content sort.

Each text is normalised (A-Z lowered, null counts as empty). The leading bytes, a digest of the whole text, the
identifier and the row's place in its table form a sort key; Spark samples splitters of that key, deals the rows into
ranges and sorts each range on disk where memory ends. Equal texts are then neighbours, and one pass compares every text
in full with the one before it. No two rows have the same key, so a text that a third of all rows share spreads over many
ranges, even where these rows have one identifier; the runs at the edges of ranges (two keys a range at most) are settled against each other afterwards, by the
SHA-256 digests of their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, fresh, numbered, sliced

HEAD_BYTES = 16
_RUNS = "id long, keep_id long, group_size long, sha binary, leads boolean, edge boolean, slot int, file string, row long"


class _Runs:
    """Runs of equal texts in one sorted range. Only identifiers and places are held until a run ends, never its texts."""

    def __init__(self) -> None:
        self.slot = TaskContext.get().partitionId()
        self.key, self.first, self.open, self.text = None, True, [], None
        self.rows: list[tuple] = []

    def add(self, key: tuple, text: str, sha: bytes, doc: tuple) -> None:
        if key != self.key:
            self.close(self.first)
            self.first = self.key is None
            self.key, self.text = key, None
        if self.text is None or text != self.text:
            self.open.append((sha, []))
            self.text = text
        self.open[-1][1].append(doc)

    def close(self, edge: bool) -> None:
        if self.key is None:
            return
        for sha, ids in self.open:
            for i, (doc, file, row) in enumerate(ids):
                self.rows.append((doc, ids[0][0], len(ids), sha, i == 0, edge, self.slot, file, row))
        self.open = []

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [()] * 9
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_(), pa.int32(), pa.string(), pa.int64()]
        names = [x.split()[0] for x in _RUNS.split(", ")]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs = _Runs()
    for batch in sliced(batches):
        doc, file, row, text, head, tag, sha = (batch.column(i).to_pylist() for i in range(7))
        for i in range(batch.num_rows):
            runs.add((head[i], tag[i]), text[i], sha[i], (doc[i], file[i], row[i]))
        if len(runs.rows) >= 5000:
            yield runs.batch()
    runs.close(True)
    yield runs.batch()


def _groups(rows: DataFrame, store: Scratch, id_col: str, text_col: str, file: str, row: str) -> DataFrame:
    """rows: numbered. What exact_groups returns, with the place of each row."""
    norm = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    given = rows.select(F.col(id_col).cast("long").alias("id"), F.col(file).alias("file"), F.col(row).alias("row"), norm.alias("norm"))
    bytes_, digest = F.col("norm").cast("binary"), F.unhex(F.sha2(F.col("norm").cast("binary"), 256))
    keyed = given.select("*", F.substring(bytes_, 1, HEAD_BYTES).alias("head"), F.xxhash64("norm").alias("tag"), digest.alias("sha"))
    ranged = keyed.repartitionByRange("head", "tag", "id", "row", "file")
    ordered = ranged.sortWithinPartitions("head", "tag", "norm", F.col("id").desc_nulls_last())
    runs = store.keep(ordered.mapInArrow(_compared, _RUNS))
    winner = F.max(F.struct("keep_id", "slot")).alias("win")
    # Two keys a range at most are at its edges, so this side is bounded by the number of ranges.
    edges = runs.filter("edge").groupBy(F.col("sha").alias("edge_sha")).agg(winner, F.sum(F.col("leads").cast("long") * F.col("group_size")).alias("total"))
    joined = runs.join(F.broadcast(edges), F.col("edge") & (F.col("sha") == F.col("edge_sha")), "left")
    own = F.struct("keep_id", "slot")
    win = F.coalesce("win", own)
    return joined.select(
        F.col("id").alias("doc_id"),
        win["keep_id"].alias("keep_id"),
        F.coalesce("total", "group_size").alias("group_size"),
        (F.col("leads") & win.eqNullSafe(own)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "file",
        "row",
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest identifier stays; among repeated rows of one identifier exactly one stays.
    A null text counts as empty and an empty text is a text like any other. A null identifier sorts below all others;
    it is kept only where no row of the group has one. A very long text is compared whole; a task holds two texts and the
    identifiers and places of one run in its range. Other columns of docs are not read. An empty table gives no rows.
    """
    store, (file, row) = Scratch(docs.sparkSession), fresh(docs, "__file", "__row")
    return _groups(numbered(docs, store, file, row), store, id_col, text_col, file, row).drop("file", "row")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_groups keeps, with all their columns; nulls and ties as there."""
    store, (file, row) = Scratch(docs.sparkSession), fresh(docs, "__file", "__row")
    rows = numbered(docs, store, file, row)
    kept = _groups(rows, store, id_col, text_col, file, row).filter("kept").select(F.col("file").alias(file), F.col("row").alias(row))
    return rows.join(kept, [file, row], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
