"""SimHash near-duplicates by segment popcounts.

A fingerprint is cut into 16 segments of 4 bits; the number of set bits in each gives a point in a grid. Two
fingerprints that differ in d bits have points at a Manhattan distance of d at most, so points further apart than two
need no comparison. Points within two of each other share a grid cell at distance one from both: each point is put in
its own cell and those one step away (31 on average), cells are matched by an equi-join, and the two fingerprints of a
cell are compared bit by bit. A cell with more fingerprints is not expanded into pairs: its members go to a finer grid
of 32 segments of 2 bits, and those of its crowded cells to one of 64 segments of one bit. There a cell is a value one
bit away from its members, which two fingerprints share exactly if they differ in two bits or fewer, so members are
linked through it. Random fingerprints fill about 2**32 cells of the first grid and 2**48 of the second, so cells are
crowded by true neighbours alone up to about 10**8 and 10**12 different fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, spread_join
from .scratch import Scratch, fresh, sliced

SEED = 42
SHINGLE = 3
WIDTHS = (4, 2, 1)  # bits a segment of the grids, coarse to fine
ROWS_A_TASK = 20_000


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority of the XXH64 bits of the text's shingles; the text is UTF-8."""
    words = text.lower().split()
    if not words:
        return 0
    line, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hashed(line, SEED)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    values = np.array([hashed(line[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=False)], "<u8")
    votes = np.zeros(64, np.int64)
    for i in range(0, len(values), 4096):
        votes += np.unpackbits(values[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(values), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        values = np.array([simhash(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row; a null text counts as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _cells(rows: DataFrame, width: int) -> DataFrame:
    """fp, cell: the grid cell of each fingerprint and the cells one step away, packed into a long. With one bit a segment a cell is a fingerprint.

    Written with functions over arrays: an expression for each of the 65 cells would be code that no driver should compile.
    """
    fp = F.col("fp")
    if width == 1:
        steps = F.lit([0, *(1 << i if i < 63 else -(1 << 63) for i in range(64))])
        return rows.select("fp", F.explode(F.transform(steps, lambda x: fp.bitwiseXOR(x))).alias("cell"))
    room = width if width < 4 else 3  # bits that a count up to width needs
    places = F.lit(list(range(64 // width)))
    count, own = F.col("counts"), F.col("own")
    shifted = lambda x, i: F.call_function("shiftleft", x, i * room)
    segment = lambda i: F.call_function("shiftrightunsigned", fp, i * width).bitwiseAND(F.lit((1 << width) - 1))
    counted = rows.select("fp", F.transform(places, lambda i: F.bit_count(segment(i)).cast("long")).alias("counts"))
    packed = counted.withColumn("own", F.aggregate(places, F.lit(0).cast("long"), lambda x, i: x.bitwiseOR(shifted(count[i], i))))

    def moved(by: int, edge: int) -> Column:
        return F.transform(places, lambda i: F.when(count[i] != edge, own.bitwiseXOR(shifted(count[i], i)).bitwiseXOR(shifted(count[i] + by, i))))

    return packed.select("fp", F.explode(F.array_compact(F.concat(F.array(own), moved(1, width), moved(-1, 0)))).alias("cell"))


def _spread(rows: DataFrame) -> DataFrame:
    """rows (stored) in a number of tasks that follows their number: each gives up to 65, which their size does not tell."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_A_TASK))
    return rows.repartition(parts, "fp")


def links(distinct: DataFrame, store: Scratch) -> DataFrame:
    """distinct: fp long, once each, stored. Pairs a, b that connect what lies within two bits; a or b may be a value between two fingerprints."""
    found = None
    for width in WIDTHS:
        members = _cells(_spread(distinct), width)
        cells = store.keep(members.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"))
        if width > 1:
            pairs = cells.filter("n = 2").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).select("a", "b").distinct()
            distinct = store.keep(members.join(cells.filter("n > 2").select("cell"), "cell", "left_semi").select("fp").distinct())
        else:
            pairs = members.join(cells.select("cell"), "cell").filter("fp <> cell").select(F.col("fp").alias("a"), F.col("cell").alias("b"))
        found = pairs if found is None else found.union(pairs)
    return found


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of its component).

    Fingerprints at two or fewer differing bits are linked. Texts without words have fingerprint zero and are linked
    like any other; a very long text has all its shingles counted. A null identifier is ignored in the minimum. Repeated
    rows are in one component; a bit that is set in exactly half of the shingles is 0. Extra columns are not read; an
    empty table gives no rows.
    """
    store = Scratch(docs.sparkSession)
    rows = store.keep(fingerprints(docs, id_col, text_col))
    nodes = store.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    label = components(links(nodes.select("fp"), store), store).withColumnRenamed("node", "fp")
    linked = store.keep(nodes.join(label, "fp"))
    smallest = linked.groupBy("label").agg(F.min("first_id").alias("least_id"))
    found = spread_join(linked, smallest, "label", "fp").select("fp", "least_id")
    of = store.keep(nodes.join(found, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id")))
    joined = spread_join(rows, of, "fp", "doc_id")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents of a component other than that with the smallest identifier; all columns stay.

    Rows that repeat an identifier are one document and stay or go together. Rows with a null identifier stay.
    """
    (gone,) = fresh(docs, "__id")
    dropped = near_groups(docs, id_col, text_col).filter("doc_id > component_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(dropped, F.col(id_col).cast("long") == F.col(gone), "left_anti")
