"""Importance resampling against plain counting, and the n-gram table against dictionaries."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioworks.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def grams_of(text):
    w = words_of(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def plain(rows, target, percent=25, least=20, buckets=importance.BUCKETS):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s = Counter(bucket(g) for _, text in rows for g in grams_of(text))
    t = Counter(bucket(g) for text in target for g in grams_of(text))
    n, m = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n + buckets) / ((s[b] + 1) * (m + buckets))))
    out = []
    for i, text in rows:
        g = [gain(bucket(x)) for x in grams_of(text)]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for place, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = place + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def got_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


TEXT = st.lists(st.one_of(st.sampled_from(["The", "the", "Über", "a", "x" * 31, "y" * 32, "z" * 70, "12", ".", "-", "\0", "漢字", "\t", "{", "É"]), st.text(max_size=4)), max_size=30).map(lambda x: " ".join(x).encode("utf-8", "ignore"))


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_table_equals_dictionaries(texts):
    words = importance.Words(texts)
    table = importance.Interned(words, 97)
    want = [grams_of(t.decode()) for t in texts]
    assert words.count.tolist() == [len(words_of(t.decode())) for t in texts]
    raw = [words.data[a : a + n].tobytes().decode() for a, n in zip(table.start, table.size, strict=True)]
    assert Counter(raw) == Counter(g for w in want for g in w)
    by_slot = {}
    for gram, slot in zip(raw, table.slot.tolist(), strict=True):
        assert by_slot.setdefault(slot, gram) == gram
    assert len(set(by_slot.values())) == len(by_slot) == len(table.used)
    for slot, gram in by_slot.items():
        assert table.bucket[slot] == zlib.crc32(gram.encode()) % 97 and table.count[slot] == raw.count(gram)


def test_xxh64_equals_the_library():
    draw = random.Random(3)
    text = " ".join("".join(draw.choice("abcé9") for _ in range(draw.randrange(1, 45))) for _ in range(2000)).encode()
    words = importance.Words([text])
    start, size, _ = words.grams()
    got = importance.xxh64(words.data, words.chunks(), start, size, 42)
    assert got.tolist() == [xxhash.xxh64_intdigest(words.data[a : a + n].tobytes(), 42) for a, n in zip(start, size, strict=True)]


def test_equal_keys_are_told_apart(monkeypatch):
    """With every key the same, only the comparison of bytes separates n-grams."""
    monkeypatch.setattr(importance, "xxh64", lambda data, chunks, start, size, seed=0: np.full(len(start), 5, np.uint64))
    words = importance.Words([b"aaaaaaaax aaaaaaaay aaaaaaaax b aaaaaaaa"])
    table = importance.Interned(words, 97)
    assert len(table.used) == len(set(grams_of("aaaaaaaax aaaaaaaay aaaaaaaax b aaaaaaaa")))


def prose(n, seed, long=60):
    draw = random.Random(seed)
    stock = ["".join(draw.choice("etaoinsh") for _ in range(draw.randrange(2, 9))) for _ in range(200)]
    return [(i, " ".join(draw.choice(stock).capitalize() for _ in range(draw.randrange(1, long)))) for i in range(n)]


@pytest.mark.parametrize("percent", [25, 60])
def test_equals_plain_counting(spark, docs_of, percent):
    rows, target = prose(300, 1), [t for _, t in prose(40, 2)] + [None, ""]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    assert got_of(importance.resample(docs_of(rows), goal, percent)) == plain(rows, target, percent)


def test_odd_rows(spark, docs_of, odd_rows):
    hot = [(500, " ".join(["hot"] * 30))] * 400  # more than a third of the rows, identifier included
    rows = odd_rows + prose(200, 4) + hot + [(None, " ".join(["same"] * 25))] * 3 + [(600, "x" * 3_000_000)]
    target = spark.createDataFrame([("one two three",)], "text string")
    assert got_of(importance.resample(docs_of(rows, extra=True), target)) == plain(rows, ["one two three"])
    assert importance.resample(docs_of([]), target).count() == 0
    nothing = importance.resample(docs_of(rows), target.limit(0))
    assert got_of(nothing) == plain(rows, [])


def test_rows_that_are_alike_spread_over_ranges(spark, docs_of, monkeypatch):
    kept = []
    keep = importance.Scratch.keep
    monkeypatch.setattr(importance.Scratch, "keep", lambda self, df: kept.append(keep(self, df)) or kept[-1])
    rows = prose(2000, 5, 30) + [(7, " ".join(["hot"] * 30))] * 2000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        importance.resample(docs_of(rows).repartition(4), docs_of(rows[:5])).count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = sorted(r["count"] for r in kept[1].groupBy(F.shiftright("at", 33)).count().collect())
    assert len(sizes) >= 4 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
