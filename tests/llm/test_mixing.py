from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from folioworks.llm import mixing


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    given, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        share = (given - sum(fixed.values())) / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if share * weight[s] > 2 * sizes[s]]
        if not over:
            return fixed | {s: share * weight[s] for s in rest}
        fixed |= {s: 2.0 * sizes[s] for s in over}


def rows_of(n, seed):
    pick = random.Random(seed)
    return [(i, " ".join("w" for _ in range(pick.randrange(60))), pick.choices(["a", "b", "Z", None, "ä"], [10, 3, 1, 2, 1])[0]) for i in range(n)]


def test_targets_and_taken(docs_of):
    rows = rows_of(800, 4)
    got = mixing.mix_plan(docs_of(rows, extra=True)).collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    want, taken = plain_targets(dict(sizes)), Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for source, target in want.items():
        assert abs(taken[source] - target) <= 0.02 * target + 60
    again = mixing.mix_plan(docs_of(rows[::-1])).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)


def test_odd_rows(docs_of, odd_rows):
    docs = docs_of(odd_rows, extra=True)
    got = mixing.mix_plan(docs).collect()
    assert len(got) == len(odd_rows) and all(r["taken"] <= 2 * r["size"] for r in got)
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in got)


def test_no_words_at_all(docs_of):
    assert [r["target"] for r in mixing.mix_plan(docs_of([(1, None), (2, "")])).collect()] == [0.0, 0.0]
    assert mixing.mix_plan(docs_of([])).count() == 0 and mixing.mix(docs_of([])).count() == 0


def test_rows_follow_the_plan(docs_of):
    rows = rows_of(300, 5)
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(docs_of(rows)).collect()}
    out = Counter(r["doc_id"] for r in mixing.mix(docs_of(rows)).collect())
    assert out == Counter({k: v for k, v in plan.items() if v})


def test_a_repeated_row_spreads_over_ranges(spark, docs_of, monkeypatch):
    """A third of all rows are one row, identifier included; its copies go by row, and reruns agree."""
    rows = [(i, "w " * (i % 90), "a" if i % 3 else "b") for i in range(8000)] + [(77, "w " * 50, "a")] * 4000
    stored, keep = [], mixing.Scratch.keep
    monkeypatch.setattr(mixing.Scratch, "keep", lambda self, df: stored.append(keep(self, df)) or stored[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = docs_of(rows).repartition(5)
        plan = mixing.mix_plan(docs).collect()
        mixed = Counter((r["doc_id"], r["text"]) for r in mixing.mix(docs).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    dealt = next(s for s in stored if "at" in s.columns)
    sizes = sorted(r["count"] for r in dealt.groupBy(F.shiftright("at", 33)).count().collect())
    assert len(sizes) >= 4 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    due = Counter()
    for r in plan:
        due[r["doc_id"], r["size"]] += r["copies"]
    taken = Counter()
    for (doc, text), n in mixed.items():
        taken[doc, len(text.split())] += n
    assert taken == Counter({k: n for k, n in due.items() if n})
    assert len(plan) == len(rows) and mixed == Counter((r["doc_id"], r["text"]) for r in mixing.mix(docs).collect())
