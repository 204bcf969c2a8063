"""Streams over several micro-batches against their batch forms."""

from __future__ import annotations

import datetime as dt
import random
import shutil
import time

from pyspark.sql import functions as F

from folioworks.operators import access, convert, status
from folioworks.sources import files
from folioworks.streaming import jobs

EVENTS = "event_id long, ts timestamp, user_id string, filename string, kind string"
LOG = "user_id string, filename string, status string, ts timestamp, seq long"


def at(minute: int) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def staged(spark, path, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(0.02)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def collected(spark, out, path, mode="append"):
    jobs.run_available(out, jobs.to_folder(f"{path}/out"), f"{path}/check", mode)
    return spark.read.parquet(f"{path}/out").drop("batch_id")


def shuffled(rows, time, batches, delay_min, seed):
    """rows by arrival, each up to delay_min late, cut into batches; then two that move the watermark."""
    draw = random.Random(seed)
    arrival = sorted((time(r) + dt.timedelta(minutes=draw.uniform(0, delay_min * 0.99)), i) for i, r in enumerate(rows))
    size = -(-len(rows) // batches)
    return [[rows[i] for _, i in arrival[k : k + size]] for k in range(0, len(rows), size)]


def stored_rows(spark, path, variable):
    """What a state variable holds after the last batch."""
    return spark.read.format("statestore").option("path", f"{path}/check").option("stateVarName", variable).load()


def test_admission_of_shuffled_events(spark, tmp_path):
    """Ten batches and a restart; events come up to an hour late and in any order."""
    draw = random.Random(2)
    kinds = ["upload", "convert", "convert", "done", "failed", "delete"]
    rows = [(i, at(7 * i), "u", f"f{draw.randrange(6)}", draw.choice(kinds)) for i in range(120)]
    rows += [(200, at(50), "u", "gone", "convert"), (201, at(40), "u", "gone", "upload"), (202, at(45), "u", "gone", "delete"), (203, at(50), "u", "same", "convert"), (204, at(50), "u", "same", "upload")]
    batches = shuffled(rows, lambda r: r[1], 10, 60, 3) + [[(900, at(20_000), "end", "end", "none")]]
    collected(spark, jobs.stream_admission(staged(spark, tmp_path / "in", batches[:4], EVENTS), "1 hour"), tmp_path)
    got = collected(spark, jobs.stream_admission(staged(spark, tmp_path / "in", batches[4:], EVENTS), "1 hour"), tmp_path)
    want = status.conversion_admission(spark.createDataFrame(rows, EVENTS))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    left = {r["key"]["filename"] for r in stored_rows(spark, tmp_path, "file").collect()}
    ends = {}
    for _, _, _, name, kind in sorted(rows):
        ends[name] = kind if kind in ("upload", "delete") else ends.get(name, "delete")
    assert left == {name for name, last in ends.items() if last == "upload"} - {"gone"}  # files that are not there have no state


def test_transitions_of_shuffled_rows(spark, tmp_path):
    draw = random.Random(4)
    rows = [("u", f"f{draw.randrange(5)}", draw.choice(["pending", "processing", "done", "failed"]), at(5 * i), i) for i in range(80)]
    batches = shuffled(rows, lambda r: r[3], 4, 60, 5) + [[("end", "end", "pending", at(20_000), 999)]]
    got = collected(spark, jobs.stream_transitions(staged(spark, tmp_path / "in", batches, LOG)), tmp_path)
    want = status.status_transitions(spark.createDataFrame(rows, LOG)).select("user_id", "filename", "seq", "status")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_grant_outcomes_of_shuffled_events(spark, tmp_path):
    """Every reason, by event, as the batch join gives; equal times, null scopes and a use before its grant among them."""
    draw = random.Random(6)
    schema = "subject string, scope string, ts timestamp, event_id long, expires_at timestamp"
    scopes = ["access", "reset", None]
    uses = [(f"s{draw.randrange(4)}", draw.choice(scopes), at(draw.randrange(600)), i, None) for i in range(80)]
    given = [(f"s{draw.randrange(4)}", draw.choice(scopes), at(m := draw.randrange(600)), None, at(m + draw.choice([5, 60, 200]))) for _ in range(12)]
    given += [("s0", "access", uses[0][2], None, at(2000)), ("s0", "access", uses[0][2], None, at(1))]
    batches = shuffled(uses + given, lambda r: r[2], 5, 60, 7) + [[("end", None, at(20_000), None, at(20_001))]]
    stream = staged(spark, tmp_path / "in", batches, schema)
    outcomes = jobs.stream_grant_outcomes(stream.filter("event_id is not null"), stream.filter("event_id is null").withColumnRenamed("ts", "issued_at"))
    got = {r["event_id"]: r["outcome"] for r in collected(spark, outcomes, tmp_path).collect()}
    table = spark.createDataFrame(uses + given, schema)
    plain = table.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("expires_at", F.col("expires_at").cast("timestamp_ntz"))
    want = access.grant_validity_join(plain.filter("event_id is not null"), plain.filter("event_id is null").withColumnRenamed("ts", "issued_at"))
    assert got == {r["event_id"]: r["outcome"] for r in want.collect()} and set(got.values()) == {"valid", "expired", "wrong_scope", "none"}


def test_uses_without_a_grant_come_out_behind_the_watermark(spark, tmp_path):
    schema = "kind string, subject string, scope string, ts timestamp, event_id long, expires_at timestamp"
    end = [("use", "end", "a", at(9_000), 90, None), ("grant", "end", "b", at(9_000), 91, at(9_001))]
    batches = [[("grant", "s", "a", at(0), 0, at(60)), ("use", "s", "a", at(5), 1, None), ("use", "s", "a", at(61), 2, None), ("use", "t", "a", at(5), 3, None)], end, end]
    stream = staged(spark, tmp_path / "in", batches, schema)
    joined = jobs.stream_grant_join(stream.filter("kind = 'use'"), stream.filter("kind = 'grant'").withColumnRenamed("ts", "issued_at"), how="left_outer")
    got = {(r["event_id"], r["subject"], r["issued_at"] is not None) for r in collected(spark, joined, tmp_path).collect()}
    assert got == {(1, "s", True), (2, "s", False), (3, "t", False)}


def test_rate_decisions_as_requests_arrive(spark, tmp_path):
    schema = "event_id long, endpoint string, key string, ts timestamp"
    draw = random.Random(8)
    rows = [(i, draw.choice(["login", "register", "free"]), draw.choice("ab"), at(i // 2)) for i in range(150)]
    rules = spark.createDataFrame([("login", 3, 600), ("register", 2, 1200), ("register", 5, 60)], "endpoint string, max_requests int, window_s long")
    out = jobs.stream_rate_limit(staged(spark, tmp_path / "in", [rows[:40], rows[40:41], rows[41:]], schema), rules)
    jobs.run_available(out, jobs.to_folder(f"{tmp_path}/out"), f"{tmp_path}/check", no_data=False)
    want = access.rate_limit(spark.createDataFrame(rows, schema), rules).select("event_id", "code")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.filter("batch_id = 0").count() == 40  # each is answered in the batch that brings it
    assert sorted(tuple(r) for r in got.select("event_id", "code").collect()) == sorted(map(tuple, want.collect()))


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "ts timestamp, key string"
    again = (at(60 * 48), "k")  # the watermark counts against late rows one batch on
    batches = [[(at(0), "k")], [again], [again], [(at(1), "k"), (at(60 * 49), "k")]]
    out = jobs.stream_rate_counts(staged(spark, tmp_path / "in", batches, schema))
    rows = collected(spark, out, tmp_path, "update").groupBy("start").agg(F.max("n").alias("n"))
    assert sorted(r["n"] for r in rows.collect()) == [1, 3]


def test_timeouts(spark, tmp_path):
    batches = [[("u", "slow", "processing", at(0), 1), ("u", "fast", "processing", at(0), 2)], [("u", "fast", "done", at(5), 3)], [("u", "other", "pending", at(60), 4)], [("u", "other", "pending", at(61), 5)]]
    got = collected(spark, jobs.stream_timeouts(staged(spark, tmp_path / "in", batches, LOG)), tmp_path)
    assert [(r["filename"], r["seq"]) for r in got.collect()] == [("slow", 1)]


def test_timeouts_equal_the_batch(spark, tmp_path):
    """600 s are in time, 600.5 s are not, wherever the batches are cut."""
    second = dt.timedelta(seconds=1)
    rows = [("u", "even", "processing", at(0), 1), ("u", "over", "processing", at(0), 2), ("u", "even", "done", at(10), 3), ("u", "over", "done", at(10) + second / 2, 4), ("u", "open", "processing", at(20), 5), ("u", "last", "pending", at(90), 6)]
    got = collected(spark, jobs.stream_timeouts(staged(spark, tmp_path / "in", [rows[:2], rows[2:4], rows[4:5], rows[5:], [("u", "last", "pending", at(91), 7)]], LOG)), tmp_path)
    want = status.stale_jobs(spark.createDataFrame(rows, LOG), F.lit(at(90) - dt.timedelta(minutes=1)))
    assert sorted(r["seq"] for r in got.collect()) == sorted(r["seq"] for r in want.collect()) == [2, 5]


def test_pages_over_many_batches(spark, tmp_path):
    """Documents grow by a page a batch; what earlier batches wrote is not read again, and the last form equals the batch conversion."""
    schema = "doc_id long, page int, text string"
    rows = [(d, p, f" text {d} {p}\n") for d in range(5) for p in range(1, 9)] + [(None, 1, "x"), (7, None, "no number"), (8, 1, None)]
    batches = [[r for r in rows if r[1] == p] for p in range(1, 9)] + [[r for r in rows if r[1] is None]]
    path = tmp_path / "out"
    for i in (0, 5):
        stream = staged(spark, tmp_path / "in", batches[i : i + 5], schema)
        jobs.stream_conversion(stream, str(path), str(tmp_path / "check"))
        for folder in (path / "results").iterdir():  # a batch needs nothing of those before
            shutil.rmtree(folder)
    paragraphs, outcome = jobs.converted(spark, str(path))
    table = spark.createDataFrame(rows, schema)
    laid, status_of = convert.run_conversion(table)
    rank = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    assert rank(outcome.filter("doc_id is not null"), "doc_id", "attempts", "pages", "status") == rank(status_of.filter("doc_id is not null"), "doc_id", "attempts", "pages", "status")
    assert rank(paragraphs, "doc_id", "seq", "page", "kind", "text") == rank(laid.filter("doc_id is not null"), "doc_id", "seq", "page", "kind", "text")


def test_a_page_that_comes_again_replaces_itself(spark, tmp_path):
    schema = "doc_id long, page int, text string"
    stream = staged(spark, tmp_path / "in", [[(1, 1, " a "), (2, 1, "x")], [(1, 2, "b")], [(1, 1, "c")]], schema)
    jobs.stream_conversion(stream, str(tmp_path / "out"), str(tmp_path / "check"), forget_s=3600)
    paragraphs, outcome = jobs.converted(spark, str(tmp_path / "out"))
    assert sorted((r["doc_id"], r["seq"], r["text"]) for r in paragraphs.collect()) == [(1, 1, "c"), (1, 2, "-- Page 2 --"), (1, 3, "b"), (2, 1, "x")]
    assert sorted((r["doc_id"], r["pages"], r["status"]) for r in outcome.collect()) == [(1, 2, "done"), (2, 1, "done")]


def test_from_task_to_status(spark, tmp_path, monkeypatch):
    store = tmp_path / "store"
    (store / "u").mkdir(parents=True)
    for name, content in [("a [1].pdf", b"one\x0c two "), ("bad.pdf", b"\xff"), ("other.pdf", b"not asked for"), ("slow.pdf", b"x")]:
        (store / "u" / name).write_bytes(content)
    opened, load = [], files.load_contents
    monkeypatch.setattr(files, "load_contents", lambda spark, paths: opened.append(paths) or load(spark, paths))
    monkeypatch.setattr(jobs, "FILES_A_READ", 1)
    ticks = iter(range(100))
    clock = lambda: at(60 * next(ticks)).replace(tzinfo=dt.timezone.utc)
    send = lambda first, *names: [(f'{{"file_id": "{n}", "user_id": "u"}}', at(0), first + i) for i, n in enumerate(names)]
    batches = [[*send(10, "a [1].pdf", "a [1].pdf", "none.pdf", "slow.pdf"), ("{broken", at(0), 99)], send(20, "bad.pdf")]
    stream = staged(spark, tmp_path / "in", batches, "value string, ts timestamp, event_id long")

    def slow():
        return lambda text: time.sleep(2 * (text == "x")) or convert.clean_page(text)

    jobs.stream_task_conversion(stream, files.list_paths(spark, str(store)), str(tmp_path / "out"), str(tmp_path / "check"), make=slow, clock=clock, seq="event_id")
    paragraphs, outcome = jobs.converted(spark, str(tmp_path / "out"), ("user_id", "filename"))
    assert [r["text"] for r in paragraphs.filter("filename like 'a%'").orderBy("seq").collect()] == ["one", "-- Page 2 --", "two"]
    ends = {"a [1].pdf": "done", "none.pdf": "failed", "slow.pdf": "done", "bad.pdf": "failed"}
    assert {r["filename"]: r["status"] for r in outcome.collect()} == ends
    log = spark.read.parquet(str(tmp_path / "out/status"))
    assert {r["filename"]: r["status"] for r in status.latest_status(log).collect()} == ends
    assert sorted(len(p) for p in opened) == [1, 1, 1] and not any("other" in p[0] for p in opened)
    rows = {(r["filename"], r["status"]): (r["ts"], r["seq"]) for r in log.collect()}
    assert rows["slow.pdf", "processing"] == (at(0), 13) and rows["slow.pdf", "done"] == (at(60), 13)
    assert rows["a [1].pdf", "processing"][1] == 10 and rows["bad.pdf", "processing"][0] == at(120)
    late = status.stale_jobs(log.withColumn("ts", F.col("ts").cast("timestamp_ntz")), F.lit("2024-01-02").cast("timestamp_ntz"))
    assert {(r["filename"], r["ran_s"]) for r in late.collect()} == {(f, 3600) for f in ends}


def test_repeated_uploads(spark, tmp_path):
    schema = "user_id string, filename string, ts timestamp, seq long"
    batches = [[("u", "f", at(0), 1)], [("u", "f", at(0), 1), ("u", "f", at(1), 2)]]
    got = collected(spark, jobs.dedup_uploads(staged(spark, tmp_path / "in", batches, schema)), tmp_path)
    assert sorted(r["seq"] for r in got.collect()) == [1, 2]


def test_conversion_replay_replaces_its_batch(spark, tmp_path):
    pages = spark.createDataFrame([(1, 1, " a "), (1, 2, "b")], "doc_id long, page int, text string")
    pages.coalesce(1).write.parquet(str(tmp_path / "in"))
    for check in ("c1", "c2"):  # a lost checkpoint runs the batch again
        stream = spark.readStream.schema(pages.schema).parquet(str(tmp_path / "in"))
        jobs.stream_conversion(stream, str(tmp_path / "out"), str(tmp_path / check))
    rows = spark.read.parquet(str(tmp_path / "out/paragraphs")).orderBy("seq").collect()
    assert [r["text"] for r in rows] == ["a", "-- Page 2 --", "b"]


def test_many_files_share_a_group(spark, tmp_path, monkeypatch):
    """State is kept by buckets of files: 200 files wait in 4 entries with a timer each, and say what the batch operators say."""
    monkeypatch.setattr(jobs, "BUCKETS", 4)
    draw = random.Random(9)
    rows = [("u", f"f{draw.randrange(200)}", draw.choice(["pending", "processing", "processing", "done", None]), at(i), i) for i in range(600)]
    table = spark.createDataFrame(rows, LOG)
    for make, want in [
        (jobs.stream_transitions, status.status_transitions(table).select("user_id", "filename", "seq", "status")),
        (jobs.stream_timeouts, status.stale_jobs(table, F.lit(at(19_000))).select("user_id", "filename", "seq")),
    ]:
        path = tmp_path / make.__name__
        collected(spark, make(staged(spark, path / "in", [rows[:300]], LOG), late="1 hour"), path)
        assert stored_rows(spark, path, "waiting").count() <= 4 and stored_rows(spark, path, "alarm").count() <= 4
        end = [("end", "end", "pending", at(20_000), 999)]
        again = staged(spark, path / "in", [rows[300:], end], LOG)
        got = collected(spark, make(again, late="1 hour"), path)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
