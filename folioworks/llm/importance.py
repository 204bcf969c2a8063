"""Importance resampling towards a target distribution over hashed n-grams.

Words and pairs of neighbouring words of all documents and of a target text are counted by bucket; a bucket's gain is the
logarithm of its share in the target over its share in the documents, and a document's weight is the mean gain over its
occurrences. Documents are drawn without replacement by adding Gumbel noise to the weight and taking the highest sums.

Per batch an open-addressed table of NumPy arrays interns the n-grams: XXH64 keys are worked out for all occurrences at
once, probing is linear, and an entry is only taken for equal after its bytes are compared. The table has a bucket and a
count for each slot, so CRC-32 is computed once per different n-gram of a batch, counts are added up by slot, and the
slots of a document's occurrences gather their gains. A batch costs its own length in memory; texts are read twice and
never shuffled or stored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, sliced

BUCKETS = 10_000
LONGEST = 2  # words in an n-gram
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
SCALE = 1000
BYTES_A_BATCH = 1 << 20
ROWS_A_BATCH = 2000

_U64 = np.uint64
# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (_U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: What a byte is in the words: A-Z lowered, bytes of other characters than ASCII as they are, all else a space.
_LOWERED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_SHORT = 32  # XXH64 takes shorter inputs in one way, from here on the library is called


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << _U64(by)) | (x >> _U64(64 - by))


class Words:
    """The words of a batch of texts, joined by single spaces in one buffer."""

    def __init__(self, texts: list[bytes]) -> None:
        lowered = np.frombuffer(b"\0".join([*texts, b""]).translate(_LOWERED), np.uint8)
        inside = lowered != 32
        ends = (inside[:-1] & ~inside[1:]).nonzero()[0] + 1  # each text ends in a space
        starts = ((~inside[:-1]) & inside[1:]).nonzero()[0] + 1
        if len(inside) and inside[0]:
            starts = np.concatenate([[0], starts])
        size = ends - starts
        edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
        first = np.searchsorted(starts, edges)
        self.count = np.diff(first)  # words by text
        keep = inside.copy()
        keep[ends] = True
        self.data = np.concatenate([lowered[keep], np.full(_SHORT, 32, np.uint8)])  # room for chunks past the end
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size
        self.last = np.repeat(first[1:] - 1, self.count)  # last word of the text of each word

    def grams(self, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte, length, and place of the first word of each n-gram, in order of n."""
        place = np.arange(len(self.start))
        found = []
        for n in range(longest):
            at = place[place + n <= self.last]
            found.append((self.start[at], self.end[at + n] - self.start[at], at))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def chunks(self) -> np.ndarray:
        """The eight bytes from each place on as a little-endian number."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)]).astype(_U64)
        out = padded[: len(self.data)].copy()
        for i in range(1, 8):
            out |= padded[i : len(self.data) + i] << _U64(8 * i)
        return out


def xxh64(data: np.ndarray, chunks: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of many stretches of one buffer."""
    h = _U64(seed) + _P5 + size.astype(_U64)
    at = start.copy()
    for step in range(1, _SHORT // 8):
        who = (size >= 8 * step).nonzero()[0]
        k = _rotated(chunks[at[who]] * _P2, 31) * _P1
        h[who] = _rotated(h[who] ^ k, 27) * _P1 + _P4
        at[who] += 8
    who = (size & 4).nonzero()[0]
    h[who] = _rotated(h[who] ^ ((chunks[at[who]] & _U64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
    at[who] += 4
    for step in range(3):
        who = ((size & 3) > step).nonzero()[0]
        h[who] = _rotated(h[who] ^ (data[at[who]].astype(_U64) * _P5), 11) * _P1
        at[who] += 1
    h = (h ^ (h >> _U64(33))) * _P2
    h = (h ^ (h >> _U64(29))) * _P3
    h ^= h >> _U64(32)
    view = memoryview(data)
    for i in (size >= _SHORT).nonzero()[0].tolist():
        h[i] = xxhash.xxh64_intdigest(view[start[i] : start[i] + size[i]], seed)
    return h


class Interned:
    """The different n-grams of a batch in an open-addressed table; slot has the place in it of each occurrence."""

    def __init__(self, words: Words, buckets: int = BUCKETS, longest: int = LONGEST) -> None:
        self.data, chunks = words.data, words.chunks()
        self.start, self.size, self.word = words.grams(longest)
        key = xxh64(self.data, chunks, self.start, self.size)
        room = 1 << max(4, (2 * len(key)).bit_length())
        self.owner = np.full(room, -1, np.int64)  # the occurrence that an entry stands for
        self.slot = np.zeros(len(key), np.int64)
        todo = np.arange(len(key))
        at = (key & _U64(room - 1)).astype(np.int64)
        while len(todo):
            free = self.owner[at] < 0
            self.owner[at[free]] = todo[free]  # of several that ask for one slot the last one gets it
            held = self.owner[at]
            equal = key[held] == key[todo]
            equal[equal] = self._same(chunks, held[equal], todo[equal])
            self.slot[todo[equal]] = at[equal]
            todo, at = todo[~equal], (at[~equal] + 1) & (room - 1)
        self.used = (self.owner >= 0).nonzero()[0]
        view = memoryview(self.data)
        first = self.owner[self.used]
        hashed = [zlib.crc32(view[a:b]) for a, b in zip(self.start[first].tolist(), (self.start[first] + self.size[first]).tolist(), strict=True)]
        self.bucket = np.zeros(room, np.int64)
        self.bucket[self.used] = np.array(hashed, np.int64) % buckets
        self.count = np.bincount(self.slot, minlength=room)

    def _same(self, chunks: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the bytes of occurrences a and b are equal."""
        out = self.size[a] == self.size[b]
        ask = (out & (a != b)).nonzero()[0]
        done = 0
        while len(ask):
            left = self.size[a[ask]] - done
            x, y = chunks[self.start[a[ask]] + done], chunks[self.start[b[ask]] + done]
            unlike = ((x ^ y) << (_U64(8) * np.maximum(8 - left, 0).astype(_U64))) != 0  # only the bytes that belong to them
            out[ask[unlike]] = False
            ask, done = ask[~unlike & (left > 8)], done + 8
        return out


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _counted(buckets: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in sliced(batches, ROWS_A_BATCH, BYTES_A_BATCH):
            grams = Interned(Words(_texts(batch.column(0))), buckets, longest)
            total += np.bincount(grams.bucket[grams.used], weights=grams.count[grams.used], minlength=buckets).astype(np.int64)
        some = total.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Occurrences by bucket; each task adds up its own first, so what is shuffled is a row for each bucket and task."""
    parts = texts.select(F.col(text_col).alias("text")).mapInArrow(_counted(buckets, longest), "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # buckets at most
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * ln of the smoothed share in the target over that in the source) by bucket."""
    n, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    ratio = [((t + 1.0) * float(all_source + n)) / ((s + 1.0) * float(all_target + n)) for s, t in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(scale * math.log(r)) for r in ratio], np.int64)


def _noise(seed: int, doc: int | None, scale: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
    return math.floor(-scale * math.log(-math.log((h + 0.5) / 4294967296)))


_SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


def _weighed(gain: np.ndarray, seed: int, scale: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, ROWS_A_BATCH, BYTES_A_BATCH):
            words = Words(_texts(batch.column(1)))
            grams = Interned(words, len(gain), longest)
            each = gain[grams.bucket[grams.slot]]
            text = np.repeat(np.arange(len(words.count)), words.count)[grams.word]
            n = np.bincount(text, minlength=len(words.count))
            total = np.zeros(len(words.count), np.int64)
            np.add.at(total, text, each)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            score = [w + _noise(seed, doc, scale) for doc, w in zip(batch.column(0).to_pylist(), weight.tolist(), strict=True)]
            columns = [batch.column(0), *(pa.array(np.asarray(c, np.int64)) for c in (words.count, n, weight, score))]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _SCORED.split(", ")])

    return run


def weigh(docs: DataFrame, gain: np.ndarray, seed: int = SEED, scale: int = SCALE, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight (floored mean gain, 0 without words) and score (weight plus noise) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_weighed(gain, seed, scale, longest), _SCORED)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED, scale: int = SCALE, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_features, weight, score, rank (null where it is not drawn).

    Of the rows with least_words words or more the given share with the highest scores is drawn; ties go to the smaller
    identifier, a null one after all others, and repeated rows take ranks next to each other. A null or empty text has no features and weight
    0. A very long text is weighed whole. Extra columns are not read; an empty table gives no rows, an empty target gains of
    nothing but smoothing. The rank comes from a range partition by score, identifier and a stored row number, plus the
    counts of the ranges before, so no task sees more than its range even where all rows are alike.
    """
    store = Scratch(docs.sparkSession)
    gain = gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_col, buckets, longest), scale)
    scored = store.keep(weigh(docs, gain, seed, scale, longest, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    able = scored.filter(F.col("n_words") >= least_words).select("row", "score", "doc_id")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    dealt = store.keep(able.repartitionByRange(*order).sortWithinPartitions(*order).select("row", F.monotonically_increasing_id().alias("at")))
    spans = dealt.groupBy(F.shiftright("at", 33).alias("span")).agg(F.min("at").alias("low"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = spans.select("span", "low", before.alias("base"), F.floor(F.sum("n").over(Window.partitionBy()) * percent / 100).cast("long").alias("most"))  # a row a range
    ranked = dealt.join(F.broadcast(base), F.shiftright("at", 33) == F.col("span"))
    drawn = ranked.select("row", "most", (F.col("at") - F.col("low") + F.col("base") + 1).alias("rank")).filter("rank <= most").drop("most")
    return scored.join(drawn, "row", "left").select("doc_id", "n_features", "weight", "score", "rank")
