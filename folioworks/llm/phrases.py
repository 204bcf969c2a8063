"""Repeated passages found with sharded Aho-Corasick automata.

A passage repeats if one of its windows of 35 words starts more than once in the table. The texts are dealt once into
shards of about two megabytes and stored; every later step reads them there.

1. Anchors. Of the word 8-grams in each window the one with the smallest hash is its anchor, so equal windows have equal
   anchors and about one 8-gram in fourteen is one. The stretch of words whose windows share an anchor is its context.
   Anchors that occur once can't stand in a repeated window.
2. Confirmation. Where all contexts of an anchor are equal, all their windows repeat; that settles copies and the inside
   of common passages. Of the other contexts each different one has its windows hashed once and counted by anchor and
   hash with the number of times that the context occurs; those that occur twice or more repeat.
3. Passages. Maximal runs of repeated windows are cut out of the first text that has them, once for each different run.
4. Location. A shard gets the different passages that its documents' contexts call for, whichever text they were cut
   from, and compiles them into automata over word numbers, each of a bounded number of words. All documents are
   streamed through the automata of their shard, and words under a match are removed. No place in a document is known
   to this step: the automata find every occurrence, word by word.

Passages travel to documents, so one that a third of all rows share is sent once a shard, and no shard gets more
documents for it. Counts are combined before they are shuffled. A window counts as repeated if anchor and window hash
(64 bits each) agree: n different contexts of one anchor give a false pair with a chance of about 100 n**2 / 2**64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, sliced

WINDOW = 35
GRAM = 8
BYTES_A_SHARD = 2 << 20
BYTES_A_PART = 512 << 20  # of the stored texts: a task of a later step reads one part
WORDS_AN_AUTOMATON = 500_000


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the smallest value in each window of the given width; the rightmost of equals."""
    at, span = np.arange(len(values)), 1

    def meet(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(values[right] <= values[left], right, left)

    while 2 * span <= width:
        at, span = meet(at[:-span], at[span:]), 2 * span
    rest = width - span
    return meet(at[:-rest], at[rest:]) if rest else at


_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


class Rolling:
    """Hashes of stretches of words, from running sums modulo 2**64: equal words, equal hash, wherever they stand."""

    def __init__(self, docs: list[list[bytes]]) -> None:
        self.counts = np.array([len(d) for d in docs], np.int64)
        self.start = np.cumsum(self.counts) - self.counts
        n = int(self.counts.sum())
        words = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(docs)), np.uint64, n)
        powers = np.full(n + 1, _BASE, np.uint64)
        back = np.full(n + 1, _BACK, np.uint64)
        powers[0] = back[0] = 1
        self.powers = np.multiply.accumulate(powers)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * np.multiply.accumulate(back)[:n], out=self.sums[1:])

    def of(self, first: np.ndarray, past: np.ndarray) -> np.ndarray:
        """Hashes of the words from first up to past, as places in all words of the batch."""
        value = (self.sums[past] - self.sums[first]) * self.powers[first]
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        return value ^ (value >> np.uint64(32))


def anchors(rolling: Rolling, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """For all anchors of a batch: the index of the document, the hash, and the first and last window that it anchors."""
    n = len(rolling.sums) - 1
    if n < window:
        return (np.zeros(0, np.int64),) * 4
    place = np.arange(n - gram + 1)
    grams = rolling.of(place, place + gram)
    chosen = _sliding_min(grams, window - gram + 1)  # by the start of the window
    owner = np.repeat(np.arange(len(rolling.counts)), rolling.counts)[: len(chosen)]
    inside = np.arange(len(chosen)) + window <= (rolling.start + rolling.counts)[owner]  # windows across two texts are none
    at = np.flatnonzero(inside)
    chosen, owner = chosen[at], owner[at]
    new = np.ones(len(at), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    doc = owner[first]
    return doc, grams[chosen[first]].view(np.int64), at[first] - rolling.start[doc], at[last] - rolling.start[doc]


def _texts(column: pa.Array) -> list[list[bytes]]:
    return [(t or b"").split() for t in column.cast(pa.binary()).to_pylist()]


def _anchor_rows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            shards, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            docs = _texts(batch.column(2))
            rolling = Rolling(docs)
            doc, hashes, first, last = anchors(rolling, window, gram)
            begin = rolling.start[doc] + first
            whole = rolling.of(begin, begin + (last - first) + window) ^ (last - first).view(np.uint64)
            columns = [pa.array(hashes, pa.int64()), pa.array(whole.view(np.int64)), pa.array(shards[doc]), pa.array(rows[doc]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "context", "shard", "row", "first", "last"])

    return run


def _asked(texts: pa.Table, asked: pa.Table) -> Iterator[tuple[list[bytes], list[dict]]]:
    """The words of each text of a shard that rows of asked name, with these rows."""
    by_row: dict[int, list[dict]] = {}
    for x in asked.to_pylist():
        by_row.setdefault(x["row"], []).append(x)
    if by_row:
        rows, bodies = texts.column("row").to_pylist(), texts.column("text")
        for i, row in enumerate(rows):
            if row in by_row:
                yield (bodies[i].as_py() or "").encode().split(), by_row[row]


def _window_rows(window: int):
    def run(texts: pa.Table, asked: pa.Table) -> pa.Table:
        """Hashes of all windows of the contexts that are asked for."""
        out: list[tuple] = []
        for words, found in _asked(texts, asked):
            rolling = Rolling([words])
            for x in found:
                at = np.arange(x["first"], x["last"] + 1)
                out.append((x["anchor"], x["context"], x["n"], x["shard"], x["row"], x["first"], x["last"], rolling.of(at, at + window).view(np.int64)))
        columns = list(zip(*out, strict=True)) if out else [()] * 8
        names = ["anchor", "context", "n", "shard", "row", "first", "last", "windows"]
        types = [pa.int64()] * 3 + [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def _passage_rows(window: int):
    def run(texts: pa.Table, asked: pa.Table) -> pa.Table:
        """The words of each run of repeated windows; ats: windows of the context that repeat, null if all do."""
        out: list[tuple] = []
        for words, found in _asked(texts, asked):
            for x in found:
                ats = range(x["last"] - x["first"] + 1) if x["ats"] is None else sorted(x["ats"])
                low = None
                for at, after in zip(ats, [*ats[1:], None], strict=True):
                    low = at if low is None else low
                    if after != at + 1:
                        body = b" ".join(words[x["first"] + low : x["first"] + at + window])
                        out.append((x["anchor"], x["context"], xxhash.xxh64_intdigest(body) - (1 << 63), body.decode()))
                        low = None
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        names = ["anchor", "context", "passage", "body"]
        return pa.table([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True)], names=names)

    return run


class Automaton:
    """Passages as sequences of word numbers; words that no passage has are number 0."""

    def __init__(self, passages: list[list[bytes]]) -> None:
        self.number: dict[bytes, int] = {}
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for words in passages:
            self.trie.add_word(tuple([self.number.setdefault(w, len(self.number) + 1) for w in words]), len(words))
        self.trie.make_automaton()

    def mark(self, words: list[bytes], under: np.ndarray) -> None:
        """Add 1 to under where an occurrence of a passage starts, and take 1 where it has ended."""
        found = list(self.trie.iter(tuple(map(self.number.get, words, repeat(0)))))
        if found:
            ends, lengths = np.array(found).T
            np.add.at(under, ends - lengths + 1, 1)
            np.add.at(under, ends + 1, -1)


def _automata(passages: list[list[bytes]], most: int) -> Iterator[Automaton]:
    """One after the other, each of about most words, so that memory is bounded whatever a shard calls for."""
    part, size = [], 0
    for words in passages:
        part.append(words)
        size += len(words)
        if size >= most:
            yield Automaton(part)
            part, size = [], 0
    if part:
        yield Automaton(part)


def _kept_rows(most: int):
    def run(texts: pa.Table, passages: pa.Table) -> pa.Table:
        docs = _texts(texts.column("text"))
        under = [np.zeros(len(words) + 1, np.int32) for words in docs]
        for automaton in _automata(_texts(passages.column("body")), most):
            for words, marks in zip(docs, under, strict=True):
                automaton.mark(words, marks)
        removed, left = [], []
        for words, marks in zip(docs, under, strict=True):
            gone = np.cumsum(marks[:-1]) > 0
            removed.append(int(gone.sum()))
            left.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if removed[-1] else words).decode())
        columns = [texts.column("doc_id"), pa.array([len(x) for x in docs], pa.int64()), pa.array(removed, pa.int64()), pa.array(left, pa.string())]
        return pa.table(columns, names=["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def _dealt(store: Scratch, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """shard, row (a number of its own), doc_id, text: all rows of docs, stored by shard.

    The shard is a hash of the row and of the part of the table that it is read from, so rows that repeat by the million
    spread over shards too, and a row that is read once more goes to the same shard.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // BYTES_A_SHARD))
    parts = max(min(shards, int(store.spark.conf.get("spark.sql.shuffle.partitions"))), -(-size // BYTES_A_PART))
    shard = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(shards)).cast("int")
    dealt = texts.withColumn("shard", shard).repartition(parts, "shard").withColumn("row", F.monotonically_increasing_id())
    return store.keep_dealt(dealt.select("shard", "row", "doc_id", "text"), "shard", parts)


def drop_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_text (the words that stay, joined by one space).

    A word goes if a window of the given number of words that covers it starts anywhere else too, in the same text or
    another; repeated rows are texts of their own, and all places of a repeated window go, ties having no first one. A
    null text has no words; texts shorter than the window lose none. A very long text is one row of its shard: its words
    must fit a worker, while automata stay bounded. Words are what ASCII white space separates. Extra columns are not
    read; an empty table gives no rows; null identifiers are kept as they are.
    """
    store = Scratch(docs.sparkSession)
    texts = _dealt(store, docs, id_col, text_col)
    long = texts.filter(F.length("text") >= 2 * window - 1)
    by_shard = long.groupBy("shard")
    found = store.keep(long.select("shard", "row", "text").mapInArrow(_anchor_rows(window, gram), "anchor long, context long, shard int, row long, first int, last int"))
    mixed = (F.min("context") != F.max("context")).alias("mixed")
    again = store.keep(found.groupBy("anchor").agg(F.count("*").alias("n"), mixed).filter("n > 1").select("anchor", "mixed"))
    contexts = store.keep(found.join(again, "anchor"))
    store.drop(found, again)
    place = F.min(F.struct("row", "shard", "first", "last"))
    kinds = store.keep(contexts.groupBy("anchor", "context", "mixed").agg(F.count("*").alias("n"), place.alias("at")).select("anchor", "context", "mixed", "n", "at.*"))
    opened = by_shard.cogroup(kinds.filter("mixed").groupBy("shard")).applyInArrow(_window_rows(window), "anchor long, context long, n long, shard int, row long, first int, last int, windows array<long>")
    opened = store.keep(opened)
    own = ["anchor", "context", "shard", "row", "first", "last"]
    windows = opened.select(*own, "n", F.posexplode("windows").alias("at", "hash"))
    counted = store.keep(windows.groupBy("anchor", "hash").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor", "hash"))
    repeated = windows.drop("n").join(counted, ["anchor", "hash"]).groupBy(*own).agg(F.collect_list("at").alias("ats"))
    whole = kinds.filter("not mixed").select(*own, F.lit(None).cast("array<int>").alias("ats"))
    asked = store.keep(whole.unionByName(repeated))
    store.drop(kinds, opened, counted)
    cut = store.keep(by_shard.cogroup(asked.groupBy("shard")).applyInArrow(_passage_rows(window), "anchor long, context long, passage long, body string"))
    store.drop(asked)
    bodies = store.keep(cut.groupBy("anchor", "passage").agg(F.min("body").alias("body")))
    needs = store.keep(contexts.join(cut.select("anchor", "context", "passage"), ["anchor", "context"]).select("shard", "anchor", "passage").distinct())
    store.drop(contexts, cut)
    passages = store.keep(needs.join(bodies, ["anchor", "passage"]).select("shard", "body"))
    store.drop(needs, bodies)
    kept = texts.groupBy("shard").cogroup(passages.groupBy("shard"))
    return kept.applyInArrow(_kept_rows(WORDS_AN_AUTOMATON), "doc_id long, n_words long, n_removed long, kept_text string")


def digest(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def brute_force(texts: list[str], window: int = WINDOW) -> list[tuple[int, int, str]]:
    """n_words, n_removed and the digest of each text, by a table of all windows; for tests."""
    split = [t.encode().split() for t in texts]
    seen: dict[tuple, int] = {}
    for words in split:
        for i in range(len(words) - window + 1):
            seen[tuple(words[i : i + window])] = seen.get(tuple(words[i : i + window]), 0) + 1
    out = []
    for words in split:
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        left = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((len(words), sum(gone), hashlib.sha256(left).hexdigest()))
    return out
