from __future__ import annotations

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from folioworks.llm import components as connected
from folioworks.llm import simhash
from folioworks.llm.components import components
from folioworks.llm.scratch import Scratch


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [words[i : i + 3] for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(b" ".join(p), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids_by_fp):
    fps, parent = list(ids_by_fp), {f: f for f in ids_by_fp}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for f in fps:
        known = [i for i in ids_by_fp[f] if i is not None]
        if known:
            least[root(f)] = min([least.get(root(f), known[0]), *known])
    return {f: least.get(root(f)) for f in fps}


def check(rows, got):
    by_fp = {}
    for doc, text in rows:
        by_fp.setdefault(plain_fingerprint(text), []).append(doc)
    comp = plain_components(by_fp)
    want = sorted((doc or -1, f"{plain_fingerprint(t):016x}", comp[plain_fingerprint(t)] or -1) for doc, t in rows)
    assert sorted((r["doc_id"] or -1, r["fingerprint"], r["component_id"] or -1) for r in got) == want


def test_odd_rows(docs_of, odd_rows):
    check(odd_rows, simhash.near_groups(docs_of(odd_rows, extra=True)).collect())


def test_against_all_pairs(docs_of):
    pick = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    base = [[pick.choice(words) for _ in range(pick.randrange(4, 120))] for _ in range(60)]
    rows = []
    for i in range(400):
        text = list(base[i % 60])
        for _ in range(pick.randrange(3)):
            text[pick.randrange(len(text))] = pick.choice(words)
        rows.append((i, " ".join(text)))
    check(rows, simhash.near_groups(docs_of(rows)).collect())


def test_crowded_cells(spark):
    """Many fingerprints a few bits apart share cells; the links must join all that brute force joins."""
    pick = random.Random(3)
    centre = pick.getrandbits(64)
    fps = {centre ^ (1 << pick.randrange(64)) ^ (1 << pick.randrange(64)) ^ (1 << pick.randrange(64)) for _ in range(300)} | {pick.getrandbits(64) for _ in range(50)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    store = Scratch(spark)
    label = {r["node"]: r["label"] for r in components(simhash.links(store.keep(spark.createDataFrame(signed, "fp long")), store), store).collect()}
    want = plain_components({f: [i] for i, f in enumerate(sorted(fps))})
    groups, seen = {}, {}
    for f in fps:
        s = f - (1 << 64) if f >> 63 else f
        groups.setdefault(want[f], set()).add(label.get(s, s))
        seen.setdefault(label.get(s, s), set()).add(want[f])
    assert all(len(x) == 1 for x in groups.values()) and all(len(x) == 1 for x in seen.values())


def orders(n):
    """Identifiers along a chain: smallest at one end and second smallest at the other, by turns, in a random order."""
    zigzag = [i // 2 if i % 2 == 0 else n - 1 - i // 2 for i in range(n)]
    mixed = list(range(n))
    random.Random(6).shuffle(mixed)
    return {"worst": [0, *range(n - 1, 0, -1)], "zigzag": zigzag, "random": mixed}


@pytest.mark.parametrize("order", ["worst", "zigzag", "random"])
def test_components_of_a_chain_in_few_rounds(spark, monkeypatch, order):
    n, rounds, hooks = 1024, [], connected._hooks
    monkeypatch.setattr(connected, "_hooks", lambda edges, turn: rounds.append(turn) or hooks(edges, turn))
    chain = orders(n)[order]
    links = spark.createDataFrame([*zip(chain, chain[1:], strict=False), (5000, 5001), (7, 7)], "a long, b long")
    got = {(r["node"], r["label"]) for r in components(links, Scratch(spark)).collect()}
    assert got == {(i, 0) for i in range(n)} | {(5000, 5000), (5001, 5000)}
    assert len(rounds) <= 11  # log2 n and one


def test_components_of_stars_trees_and_random_links(spark):
    pick = random.Random(8)
    star = [(10_000, i) for i in range(2000)]  # one node in every link
    tree = [(20_000 + i, 20_000 + (i - 1) // 2) for i in range(1, 1000)]
    loose = [(30_000 + pick.randrange(900), 30_000 + pick.randrange(900)) for _ in range(400)]
    pairs = star + tree + loose
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark)).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def test_stage_keeps_one(docs_of):
    rows = [(5, "a b c d e"), (3, "A b c D e"), (9, "quite another text here"), (None, "a b c d e")]
    docs = docs_of(rows, extra=True)
    left = simhash.drop_near_copies(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] or -1 for r in left.collect()) == [-1, 3, 9]
    assert simhash.near_groups(docs_of([])).count() == 0
