from __future__ import annotations

import random

from folioworks.llm import phrases


def rows_with_passages():
    pick = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    draw = lambda n: [pick.choice(words) for _ in range(n)]
    passage, long_passage = draw(40), draw(90)
    rows = [draw(pick.randrange(10, 200)) for _ in range(60)]
    for i in range(0, 30, 3):
        rows[i] = rows[i][:20] + passage + rows[i][20:]
    for i in range(1, 20, 4):
        rows[i] = rows[i][:5] + long_passage[i : i + 60] + rows[i][5:]
    rows.append(draw(7) + passage[:35] + draw(3) + passage[:34])
    rows += [["same"] * 100, list(passage), passage[1:], draw(50) * 2]
    rows += [rows[2], rows[2]]
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def check(docs_of, rows, **how):
    got = phrases.drop_repeats(docs_of(rows, extra=True), **how).withColumn("h", phrases.digest(phrases.F.col("kept_text"))).collect()
    want = phrases.brute_force([t or "" for _, t in rows], how.get("window", phrases.WINDOW))
    assert sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"], r["h"]) for r in got) == sorted((d or -1, *w) for (d, _), w in zip(rows, want, strict=True))


def test_against_a_table_of_all_windows(docs_of):
    check(docs_of, rows_with_passages())


def test_other_window(docs_of):
    check(docs_of, rows_with_passages(), window=12, gram=5)


def test_odd_rows(docs_of, odd_rows):
    check(docs_of, odd_rows)


def test_many_shards_and_small_automata(docs_of, monkeypatch):
    monkeypatch.setattr(phrases, "BYTES_A_SHARD", 3_000)
    monkeypatch.setattr(phrases, "WORDS_AN_AUTOMATON", 90)
    check(docs_of, rows_with_passages())


def test_the_automata_find_the_places(docs_of, monkeypatch):
    """Without their matches no word goes: no step before hands places on."""
    monkeypatch.setattr(phrases.Automaton, "mark", lambda self, words, under: None)
    run = phrases._kept_rows(1000)
    import pyarrow as pa

    text = " ".join(f"w{i}" for i in range(60))
    texts = pa.table({"shard": [0], "row": [5], "doc_id": [1], "text": [f"a b {text} c"]})
    passages = pa.table({"shard": [0], "body": [text]})
    assert run(texts, passages).column("n_removed").to_pylist() == [0]
    monkeypatch.undo()
    assert run(texts, passages).column("n_removed").to_pylist() == [60]
    assert set(passages.column_names) == {"shard", "body"}


def test_hash_repeats_spread(docs_of):
    """A third of all rows the same, identifier included."""
    words = " ".join(f"w{i}" for i in range(80))
    check(docs_of, [(1, words)] * 40 + [(i, f"x{i} " * 50) for i in range(2, 80)])


def test_empty_table(docs_of):
    assert phrases.drop_repeats(docs_of([])).count() == 0
