"""Best-fit packing of documents into token sequences.

Documents become token ids and end with a separator. Whole sequences are cut off documents that are longer than one;
what remains is dealt to many bins of work by hash, each of a few thousand pieces, and packed there by decreasing
length. A sequence has three capacities: tokens, documents, and attention cost (the sum of squared piece lengths).
Among the open sequences that can take a piece under every capacity the one with the best weighted score is taken:
either the smallest residual norm after the piece is placed, or the largest weighted dot-product of piece and residual.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, sliced
from .vocab import word_ids

VOCABULARY = "word_bpe_49k.json"
PIECES_A_TASK = 4096
DOCS_A_LOOKUP = 32


@dataclass(frozen=True)
class Capacity:
    """What one sequence may hold. By default only the tokens bind: 2048 pieces of one token each, and the attention of one whole piece."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.01, 0.05)
    rule: str = "norm"

    def limits(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], float)


def _pieces(path: str, tokens: int, separator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_ids(path)
        for batch in sliced(batches):
            rows: list[tuple] = []
            docs = batch.column(0).to_pylist()
            texts = [(t or b"").split() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for first in range(0, len(docs), DOCS_A_LOOKUP):
                some = texts[first : first + DOCS_A_LOOKUP]
                at = table.slots(list(chain.from_iterable(some)))
                flat, ends = table.ids_at(at), np.concatenate([[0], np.cumsum(table.count[0, at])])
                past = np.cumsum([len(x) for x in some])
                for i, words in enumerate(some):
                    own = flat[ends[past[i] - len(words)] : ends[past[i]]]
                    ids = np.append(own, separator).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), tokens)):
                        part = ids[start : start + tokens]
                        rows.append((docs[first + i], piece, start, len(part), zlib.crc32(part.tobytes())))
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def token_pieces(docs: DataFrame, vocabulary: str, tokens: int = 2048, separator: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the separator, cut only beyond tokens."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(_pieces(vocabulary, tokens, separator), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each piece. A piece that no bin could ever take alone under the other capacities gets its own bin."""
    limits = capacity.limits()
    weights = np.array(capacity.weights) / limits**2
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left = np.zeros((len(lengths), 3))  # residual capacities of the open bins
    name = np.zeros(len(lengths), np.int64)
    opened = n = 0
    least = int(lengths.min()) if len(lengths) else 0
    for i in order:
        need = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])
        room = left[:n]
        fits = np.flatnonzero((room >= need).all(axis=1))
        if len(fits):
            score = ((room[fits] - need) ** 2) @ weights if capacity.rule == "norm" else -(room[fits] * need) @ weights
            at = fits[int(np.argmin(score))]
        else:
            at, n = n, n + 1
            left[at], name[at] = limits, opened
            opened += 1
        bins[i], offsets[i] = name[at], capacity.tokens - left[at, 0]
        left[at] -= need
        if (left[at] < [least, 1, least**2]).any():  # full: the last open bin takes its place
            n -= 1
            left[at], name[at] = left[n], name[n]
    return bins, offsets


def _packed(capacity: Capacity):
    def run(pieces: pa.Table) -> pa.Table:
        """Arrow columns go through as they are, so that a null identifier leaves the others exact."""
        bins, offsets = best_fit(pieces.column("length").to_numpy(), capacity)
        sequences = pieces.column("task").to_numpy() * (1 << 32) + bins
        return pieces.drop_columns(["task"]).append_column("sequence_id", pa.array(sequences, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    return run


_OUT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(docs: DataFrame, vocabulary: str, capacity: Capacity = Capacity(), separator: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty; every document has its separator, so each row of docs gives one piece at least, also
    where rows repeat. A very long text is cut into as many pieces as it needs. Pieces of one length are packed in no
    particular order. Extra columns are not read; an empty table gives no rows. Whole pieces are sequences of their own.
    """
    store = Scratch(docs.sparkSession)
    pieces = store.keep(token_pieces(docs, vocabulary, capacity.tokens, separator, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    full = pieces.filter(F.col("length") == capacity.tokens)
    part = pieces.filter(F.col("length") < capacity.tokens)
    tasks = max(1, -(-part.count() // PIECES_A_TASK))
    dealt = part.withColumn("task", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(tasks))).drop("row")
    fitted = dealt.groupBy("task").applyInArrow(_packed(capacity), _OUT)
    alone = full.select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return fitted.unionByName(alone)
