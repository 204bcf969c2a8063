from __future__ import annotations

import random
import re

import duckdb

from folioworks.llm import quotes, registry
from tests.test_oracle import canonical

SCHEMA = "conv_id long, turn long, text string, line string, seq int, thread string"


def linked(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    return {(r["thread"], r["seq"]): r for r in quotes.reply_order(df).collect()}


def test_nested_quotes_and_order(spark):
    rows = [
        (1, 0, "Hello all,\nwhere is it?"),
        (1, 1, "On Monday A wrote:\n> hello ALL,\n>  where is it?\n\nIn the box."),
        (1, 2, ">> Hello all,\n>> where is it?\n> In the box.\nWhich box?"),
        (1, 3, "> where is it?\nI do not know."),
        (1, 4, "> nobody said this\nHm."),
        (1, 5, "> Which box?\n> I do not know.\nboth"),
        (2, 0, "> In the box.\nother thread"),
    ]
    got = linked(spark, rows)
    assert [got[1, i]["parent_seq"] for i in range(6)] == [None, 0, 1, 0, None, 3]
    assert [got[1, i]["depth"] for i in range(5)] == [0, 1, 2, 1, 0] and got[1, 4]["root_seq"] == 4
    assert got[1, 2]["n_quotes"] == 2 and got[1, 2]["n_linked"] == 2 and got[1, 4]["n_linked"] == 0
    assert got[1, 1]["clean_text"] == "In the box." and got[1, 2]["clean_text"] == "Which box?"
    assert got[2, 0]["parent_seq"] is None


def test_long_chain_repeats_and_nulls(spark):
    rows = [(1, 0, "start")] + [(1, i, f"> {'start' if i == 1 else f'answer {i - 1}'}\nanswer {i}") for i in range(1, 20)]
    rows += [(1, 19, "zzz"), (2, 0, None), (2, 1, ""), (None, 0, "x"), (3, None, "x"), (4, 0, "> " * 50 + "deep"), (5, 0, "\n".join(["> line"] * 3000))]
    got = linked(spark, rows)
    assert got[1, 18]["depth"] == 18 and got[1, 18]["root_seq"] == 0
    assert got[2, 0]["clean_text"] == "" and got[4, 0]["n_quotes"] == 1 and len(got) == 24
    assert linked(spark, []) == {}


def plain_links(thread):
    """seq: (parent, n_quotes, n_linked, clean text) of one thread's messages, by reading them in order."""
    flat = lambda x: re.sub(r"\s+", " ", x).strip(" ").lower()
    own, out = {}, {}
    for seq, text in sorted(thread.items()):
        lines = []
        for raw in text.split("\n"):
            mark = re.match(r"(?:[ \t]*>)+[ \t]?", raw)
            lines.append((mark.group().count(">") if mark else 0, raw[mark.end() :] if mark else raw))
        passages = []
        for i, (level, body) in enumerate(lines):
            if i == 0 or lines[i - 1][0] != level or not body.strip(" "):
                passages.append((level, []))
            if not (level == 0 and i + 1 < len(lines) and lines[i + 1][0] > 0 and re.match(quotes.ATTRIBUTION[4:], body, re.I)):
                passages[-1][1].append(body)
        links, n_quotes = [], 0
        for level, bodies in passages:
            whole = flat("\n".join(bodies))
            if level and whole:
                n_quotes += 1
                found = [own[x] for x in map(flat, bodies) if x in own]
                source = own.get(whole, max(found) if found else None)
                links += [(-level, source)] if source is not None else []
        for level, bodies in passages:
            for x in [flat("\n".join(bodies)), *map(flat, bodies)] if not level else []:
                own.setdefault(x, seq) if x else None
        clean = re.sub(r"^\n+|\n+\Z", "", "\n".join(b for level, bodies in passages if not level for b in bodies))
        out[seq] = (max(links)[1] if links else None, n_quotes, len(links), clean)
    return out


def test_random_threads_against_a_plain_linker(spark):
    """Mixed levels, partial quotes, repeated bodies, attributions and blank lines."""
    pick, rows = random.Random(21), []
    said = ["yes", "No  way", "see below", "the box is open", "Which box?", "ok", "thanks a lot"]
    for thread in range(60):
        texts = []
        for seq in range(pick.randrange(2, 9)):
            lines = []
            for _ in range(pick.randrange(3)):
                if texts:
                    mark = "> " * pick.randrange(1, 4)
                    quoted = pick.choice(texts).split("\n")
                    at = pick.randrange(len(quoted))
                    lines += [pick.choice(["On Monday B wrote:", "x schrieb :"])] * pick.randrange(2) + [mark + x for x in quoted[at : at + pick.randrange(1, 4)]]
                lines += [""] * pick.randrange(2)
            lines += [pick.choice(said) + pick.choice(["", f" {seq}"]) for _ in range(pick.randrange(4))]
            texts.append("\n".join(lines))
            rows.append((thread, seq, texts[-1]))
    got = linked(spark, rows)
    for thread in range(60):
        want = plain_links({s: t for i, s, t in rows if i == thread})
        have = {s: (r["parent_seq"], r["n_quotes"], r["n_linked"], r["clean_text"]) for (i, s), r in got.items() if i == thread}
        assert have == want, thread
        for (i, s), r in got.items():
            if i == thread and r["parent_seq"] is not None:
                above = got[thread, r["parent_seq"]]
                assert r["depth"] == above["depth"] + 1 and r["root_seq"] == above["root_seq"]


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, 0, "a")], "conv_id long, turn long, text string")
    text = quotes.reply_order(df)._jdf.queryExecution().toString()
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text


def test_repeated_turns_are_one_before_they_are_quoted(spark, tmp_path):
    """The query against its SQL where (conv_id, turn) repeats, with other roles, other texts and null texts."""
    rows = [(1, 0, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "user", "reply"), (1, 1, None, "reply"), (1, 1, "user", None), (1, 2, "user", "z\ny"), (1, 2, "tool", "c\nd"), (1, 3, "user", "end")]
    rows += [(2, 0, "user", None), (2, 0, "assistant", None), (2, 1, "user", "q"), (2, 1, "user", "p"), (2, 2, "user", None), (None, 0, "user", "a"), (None, 0, "user", "a"), (3, None, "user", "a")]
    rows += [(4, i, f"role{k % 3}", f"text {i} {k % 50}" if k % 7 else None) for i in range(3) for k in range(400)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    got = registry.queries()["op1_quotation_links"](spark, str(tmp_path)).toPandas()
    assert canonical(got) == canonical(con.execute(registry.OP1_SQL).df())
    assert [tuple(x) for x in got[(got.conv_id == 1) & (got.turn == 1)][["parent_seq", "n_quotes"]].values] == [(0, 1)]
    mails = quotes.as_mail(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert mails.count() == 10
