from __future__ import annotations

import hashlib
import random

from folioworks.llm import exact


def lowered(text):
    return (text or "").encode().lower()


def expected(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(lowered(text), []).append(doc)
    return groups


def check(rows, got):
    groups = expected(rows)
    for r in got:
        ids = groups[next(k for k in groups if hashlib.sha256(k).hexdigest() == r["text_sha256"])]
        known = [i for i in ids if i is not None]
        assert r["group_size"] == len(ids) and r["keep_id"] == (max(known) if known else None)
    assert len(got) == len(rows)
    assert sum(r["kept"] for r in got) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_odd_rows(docs_of, odd_rows):
    check(odd_rows, exact.exact_groups(docs_of(odd_rows, extra=True)).collect())


def test_groups_over_many_ranges(spark, docs_of):
    pick = random.Random(1)
    rows = [(i, "same text" if i % 3 else "x" * 64 + pick.choice("abc") * pick.randrange(4)) for i in range(3000)]
    pick.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        check(rows, exact.exact_groups(docs_of(rows)).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_repeated_row_spreads_over_ranges(spark, docs_of, monkeypatch):
    """A third of all rows are one row, identifier included."""
    rows = [(i, f"text {i % 5000} and more") for i in range(8000)] + [(77, "Same row")] * 4000
    stored, keep = [], exact.Scratch.keep
    monkeypatch.setattr(exact.Scratch, "keep", lambda self, df: stored.append(keep(self, df)) or stored[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = docs_of(rows).repartition(5)
        check(rows, exact.exact_groups(docs).collect())
        left = sorted((r["doc_id"], r["text"]) for r in exact.drop_copies(docs).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert left == sorted({(max(i for i, t in rows if t == text), text) for _, text in rows})
    runs = next(s for s in stored if "slot" in s.columns)
    sizes = sorted(r["count"] for r in runs.groupBy("slot").count().collect())
    assert len(sizes) >= 4 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_places_are_alike_each_time(spark, docs_of, tmp_path):
    docs_of([(i, f"t{i}") for i in range(500)]).repartition(4).write.parquet(str(tmp_path / "t"))
    store = exact.Scratch(spark)
    for docs in (spark.read.parquet(str(tmp_path / "t")), docs_of([(i, f"t{i}") for i in range(500)]).repartition(3)):
        rows = exact.numbered(docs, store, "f", "r")
        assert rows.select("f", "r").distinct().count() == 500
        assert rows.join(rows.select("f", "r", rows["text"].alias("again")), ["f", "r"]).filter("text = again").count() == 500


def test_rows_that_stay(docs_of, odd_rows):
    docs = docs_of(odd_rows, extra=True)
    left = exact.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] or -1, len(r["text"] or "")) for r in left.collect()) == sorted({(3, 3), (2, 0), (5, 13), (6, len(odd_rows[6][1])), (7, len(odd_rows[7][1])), (8, len(odd_rows[9][1]))})


def test_empty_table(docs_of):
    assert exact.exact_groups(docs_of([])).count() == 0
    assert exact.drop_copies(docs_of([])).count() == 0
