"""Small fixtures for the traps, models for the running windows, and plans."""

from __future__ import annotations

import datetime as dt
from contextlib import contextmanager

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioworks import views
from folioworks.functions import text as fn
from folioworks.operators import access, accounts, catalog, convert, labels, layout, metrics, status, tasks

SF_DIR = "/root/testdata/sf0.001"
NBSP = " "


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def at(minute: int) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_text_functions(spark):
    row = spark.range(1).select(
        fn.output_stem(F.lit("b.v2.PDF")).alias("a"), fn.output_stem(F.lit("nodot")).alias("b"), fn.output_stem(F.lit("trail.")).alias("c"),
        fn.full_strip(F.lit(f"{NBSP} سلام \t{NBSP}")).alias("d"), fn.elapsed_label(F.lit(3725)).alias("e"), fn.size_label(F.lit(1536)).alias("f"),
        fn.initial(F.lit("")).alias("g"), fn.initial(F.lit(None).cast("string")).alias("h"), fn.is_email(F.lit("a@b.cd\n")).alias("i"),
        fn.comma_list(F.lit(" a, ,b,")).alias("j"), fn.fill_placeholders(F.lit("{{n}}/{{m}}"), F.create_map(F.lit("n"), F.lit("1"))).alias("k"),
        fn.text_direction(F.lit("ar")).alias("l"), fn.text_direction(F.lit(None).cast("string")).alias("m"), fn.key_filename(F.lit("u/a/b")).alias("n"),
    ).first()
    assert list(row) == ["b.v2", "nodot", "trail", "سلام", "62:05", "1.5 KB", "U", "U", False, ["a", "b"], "1/{{m}}", "rtl", "ltr", "a/b"]


def test_sidecars_and_search(spark):
    names = ["a.pdf", "A.PDF", "x.docx", "x.pdf.status", "x.pdf.settings.json", "100%_done.pdf", "x.STATUS"]
    files = spark.createDataFrame([("u", n) for n in names], "user_id string, filename string")
    assert [r[0] for r in values(catalog.exclude_sidecars(files), "filename")] == sorted(["a.pdf", "A.PDF", "100%_done.pdf", "x.STATUS"])
    assert values(catalog.search_filename(files, "%_D"), "filename") == [("100%_done.pdf",)]
    assert catalog.search_filename(files, "").count() == len(names)


def test_status_default_and_last_writer(spark):
    log = spark.createDataFrame([("u", "a", "done", at(1), 2), ("u", "a", "failed", at(1), 3), ("u", "gone", "done", at(0), 1)], "user_id string, filename string, status string, ts timestamp_ntz, seq long")
    latest = status.latest_status(log)
    keys = spark.createDataFrame([("u", "a"), ("u", "none")], "user_id string, filename string")
    assert values(catalog.document_status(keys, latest), "filename", "status") == [("a", "failed"), ("none", "pending")]
    odd = keys.withColumn("status", F.lit("strange"))
    assert values(catalog.dashboard_stats(odd), "total", "converting", "converted", "failed") == [(2, 0, 0, 0)]


def simulate(events):
    state, out = {}, []
    for i, (key, kind) in enumerate(events):
        present, now = state.get(key, (False, "pending"))
        if kind == "convert":
            out.append((i, 404 if not present else 409 if now == "processing" else 200))
            now = "processing" if present else now
        elif kind in ("upload", "delete"):
            present, now = kind == "upload", "pending"
        else:
            now = kind
        state[key] = (present, now)
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from(["upload", "convert", "done", "failed", "delete"])), min_size=1, max_size=40))
def test_admission_equals_simulation(spark, events):
    rows = [(i, at(i // 3), "u", key, kind) for i, (key, kind) in enumerate(events)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id string, filename string, kind string")
    assert values(status.conversion_admission(df), "event_id", "code") == simulate(events)


def test_tasks(spark):
    raw = ['{"file_id":"a","user_id":"u"}', '{"file_id":"","user_id":"u"}', '{"file_id":"a","user_id":null}', '{"file_id":"a","user_id":"u","mode":"trial","x":1}', '{"fil', None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, value string")
    got = {r["i"]: (r["mode"], r["reason"]) for r in tasks.validate_tasks(df, tasks.MODES).collect()}
    assert got[0] == ("ocr", None) and got[1][1] == "no_file" and got[2][1] == "no_user" and got[3] == ("trial", "bad_mode") and got[4][1] == "damaged" and got[5][1] == "damaged"


def test_layout(spark):
    pages = spark.createDataFrame([(1, 10, "ten"), (1, 9, f"{NBSP}سلام{NBSP}\n\n"), (1, 1, "")], "doc_id long, page int, text string")
    rows = [tuple(r) for r in layout.build_layout(pages).orderBy("seq").select("page", "kind", "text").collect()]
    assert rows == [(1, "blank", ""), (9, "separator", "-- Page 9 --"), (9, "text", "سلام"), (9, "blank", ""), (9, "blank", ""), (10, "separator", "-- Page 10 --"), (10, "text", "ten")]
    assert layout.assemble_text(pages).first()["text"] == f"\n{NBSP}سلام{NBSP}\n\n\nten"


def test_page_errors_are_rows(spark):
    def broken():
        def page(text):
            if "bad" in text:
                raise ValueError("no")
            return text

        return page

    pages = spark.createDataFrame([(1, 1, "ok"), (1, 2, "bad"), (2, 1, None)], "doc_id long, page int, text string")
    paragraphs, outcome = convert.run_conversion(pages, broken)
    assert values(outcome, "doc_id", "status", "first_failed_page") == [(1, "failed", 2), (2, "done", None)]
    assert {r["doc_id"] for r in paragraphs.collect()} == {2}
    split = convert.split_pages(spark.createDataFrame([(1, "a\fb\f"), (2, None)], "doc_id long, text string"))
    assert values(split, "doc_id", "page", "text") == [(1, 1, "a"), (1, 2, "b"), (1, 3, ""), (2, 1, "")]


def test_histogram_bounds_and_empty_stats(spark):
    df = spark.createDataFrame([(0.5,), (40.0,), (41.0,)], "x double")
    got = {r["le"]: r["bucket_count"] for r in metrics.duration_histogram(df, "x").collect()}
    assert got[0.5] == 1 and got[40.0] == 2 and got[float("inf")] == 3
    empty = spark.createDataFrame([], "outcome string, elapsed_s double")
    row = metrics.ocr_stats(empty, empty).first()
    assert row["requests_total"] == 0 and row["avg_request_seconds"] is None and row["avg_page_seconds"] is None


def test_grants(spark):
    grants = spark.createDataFrame([("s", "a", at(0), at(10)), ("s", "a", at(5), at(8)), ("s", None, at(0), at(10))], "subject string, scope string, issued_at timestamp_ntz, expires_at timestamp_ntz")
    uses = spark.createDataFrame([(1, "s", "a", at(9)), (2, "s", "a", at(10)), (3, "s", "b", at(1)), (4, "s", None, at(1)), (5, "t", "a", at(1))], "event_id long, subject string, scope string, ts timestamp_ntz")
    assert values(access.grant_validity_join(uses, grants), "event_id", "outcome") == [(1, "valid"), (2, "expired"), (3, "wrong_scope"), (4, "valid"), (5, "none")]


def test_rate_limit_over_a_window_edge(spark):
    times = [0, 0, 0, 0, 0, 0, 1, 1]
    df = spark.createDataFrame([(i, "k", "login", at(m)) for i, m in enumerate(times)], "event_id long, key string, endpoint string, ts timestamp_ntz")
    rules = spark.createDataFrame([("login", 5, 60)], "endpoint string, max_requests int, window_s long")
    assert [c for _, c in values(access.rate_limit(df, rules), "event_id", "code")] == [200] * 5 + [429, 200, 200]


def test_accounts(spark):
    users = spark.createDataFrame([(1, "a@x.yz", None, "A", True), (7, "b@x.yz", "h", None, None)], "id int, email string, hashed_password string, name string, email_verified boolean")
    asked = spark.createDataFrame([(1, at(0), "n@x.yz", "N"), (2, at(0), "n@x.yz", "M"), (3, at(0), "a@x.yz", "Z")], "seq long, ts timestamp_ntz, email string, name string")
    assert values(accounts.register_users(users, asked), "seq", "code") == [(1, 201), (2, 400), (3, 400)]
    made = accounts.find_or_create_users(users, asked)
    assert values(made.filter("email = 'n@x.yz'"), "id", "name", "email_verified") == [(8, "N", True)] and made.count() == 3
    assert values(accounts.public_user(users), "id", "email_verified") == [(1, True), (7, False)]
    assert values(accounts.update_profile(users, asked), "id", "name") == [(1, "Z"), (7, None)]
    twice = users.unionByName(users.withColumn("email", F.upper("email")))
    assert values(accounts.identity_audit(twice), "n_rows", "n_spellings") == [(2, 2), (2, 2)]
    target = spark.createDataFrame([], "id long, extra string").schema
    assert accounts.conform_schema(users, target).columns == ["id", "extra"]


def test_labels(spark):
    nested = spark.read.json(spark.sparkContext.parallelize(['{"a": {"b": "x", "c": "y"}, "d": "z"}']))
    assert values(labels.flatten_labels(nested, "en"), "key", "value") == [("a.b", "x"), ("a.c", "y"), ("d", "z")]
    wanted = spark.createDataFrame([("de", "docs.empty"), ("fr", "status.done"), ("ar", "nothing")], "lang string, key string")
    assert values(labels.resolve_labels(wanted, views.labels_i18n(spark)), "key", "value") == [("docs.empty", "No documents"), ("nothing", "nothing"), ("status.done", "Done")]


def test_deletion_takes_derived_files(spark):
    files = spark.createDataFrame([("u", n) for n in ("x.pdf", "x.docx", "x.pdf.status", "y.pdf")], "user_id string, filename string")
    left, code, reset = catalog.delete_documents(files, spark.createDataFrame([("u", "x.pdf"), ("u", "z.pdf")], "user_id string, filename string"))
    assert values(left, "filename") == [("y.pdf",)] and values(code, "filename", "code") == [("x.pdf", 200), ("z.pdf", 404)]
    assert values(reset, "filename", "status") == [("x.pdf", "pending")]


def test_files_that_are_there(spark):
    up = spark.createDataFrame([("u", "a", 1, at(0), 1), ("u", "b", 2, at(0), 2), ("u", "b", 3, at(2), 5), ("u", "c", 4, at(3), 6)], "user_id string, filename string, size long, ts timestamp_ntz, seq long")
    gone = spark.createDataFrame([("u", "a", at(1), 3), ("u", "b", at(1), 4), ("u", "c", at(3), 5)], "user_id string, filename string, ts timestamp_ntz, seq long")
    assert values(catalog.live_files(up, gone), "filename", "size", "versions") == [("b", 3, 1), ("c", 4, 1)]


def test_no_rule_no_limit(spark):
    df = spark.createDataFrame([(i, "k", e, at(0)) for i, e in enumerate(["login", "login", "free", "free", None])], "event_id long, key string, endpoint string, ts timestamp_ntz")
    rules = spark.createDataFrame([("login", 1, 60), ("login", 5, 60)], "endpoint string, max_requests int, window_s long")
    assert [c for _, c in values(access.rate_limit(df, rules), "event_id", "code")] == [200, 429, 200, 200, 200]


def test_stripping_and_placeholders(spark):
    padded = "\x1c\x1f \t\u00a0\u2028Aa@b.cd\u3000\x1e"
    row = spark.range(1).select(
        fn.normal_email(F.lit(padded)).alias("a"), fn.comma_list(F.lit("\tx\u00a0, \x1d,y")).alias("b"), fn.full_strip(F.lit(padded)).alias("c"),
        fn.fill_placeholders(F.lit("{{a}} {{b}}{{ c }}{{d}}."), F.create_map(*[F.lit(x) for x in ("a", "{{b}}", "b", "Z", "c", "C")], F.lit("d"), F.lit(None).cast("string"))).alias("d"),
        fn.fill_placeholders(F.lit("plain"), F.create_map(F.lit("n"), F.lit("1"))).alias("e"),
    ).first()
    assert list(row) == ["aa@b.cd", ["x", "y"], padded.strip(), "{{b}} ZC{{d}}.", "plain"]


def test_length_rule_counts_line_breaks(spark):
    rows = spark.createDataFrame([("a\nb\nc\nd\n",), ("short",)], "text string")
    assert values(accounts.rule_score(rows, "text"), "band", "n") == [("Fair", 1), ("Weak", 1)]


def test_large_ids_beside_null(spark):
    big = 9007199254740993
    pages = spark.createDataFrame([(big, 1, "a"), (None, 1, "b"), (big + 2, 1, None)], "doc_id long, page int, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in convert.convert_pages(pages).collect()) == [(0, "b"), (big, "a"), (big + 2, "")]


def test_bytes_to_pages(spark):
    files = spark.createDataFrame([("u", "a", b"x\x0cy"), ("u", "b", b"\xff\xfe"), ("u", "c", None), ("u", "d", b"")], "user_id string, filename string, content binary")
    got = convert.pdf_to_pages(files).collect()
    assert sorted((r["filename"], r["page"], r["text"]) for r in got if r["error"] is None) == [("a", 1, "x"), ("a", 2, "y"), ("d", 1, "")]
    assert sorted(r["filename"] for r in got if r["error"]) == ["b", "c"] and all(r["page"] is None for r in got if r["error"])
    caps = convert.page_caps(spark.createDataFrame([("free", 5), ("free", 6), ("pro", 60), ("odd", 6), (None, 6)], "plan string, pages int"))
    assert [r["over_cap"] for r in caps.collect()] == [False, True, False, True, True]


def test_plans(spark):
    recent = plan(catalog.recent_documents(views.files_orders(spark, SF_DIR)))
    assert "WindowGroupLimit" in recent
    one = plan(catalog.scope_to_user(views.files_docs(spark, SF_DIR), "src0"))
    assert "EqualTo(source,src0)" in one and "text" not in one.split("ReadSchema")[1].split("\n")[0]
    admitted = plan(status.conversion_admission(views.file_events(spark, SF_DIR)))
    assert admitted.count(") Exchange") == 3  # both windows of a slice share one sort; the sums of slices take the same rows, then their own
    for df in (catalog.dashboard_stats(views.files_docs(spark, SF_DIR)), status.latest_status(views.status_log(spark, SF_DIR))):
        assert "Python" not in plan(df) and "Pandas" not in plan(df)


@contextmanager
def plain_tasks(spark):
    """Tasks as they are dealt, none merged or split at run time."""
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "12"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def tasks_of(df) -> list[int]:
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())


def test_a_hot_subject_and_a_hot_file_spread_over_tasks(spark):
    """A third of all rows have one key; its slices go to many tasks, and the results are those of one slice for all time."""
    n = 6000
    hot = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 997))
    ts = (F.lit(at(0)).cast("timestamp") + F.make_dt_interval(mins=F.xxhash64("id") % 60_000)).cast("timestamp_ntz")
    scope = F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("a"), F.col("id") % 2))
    uses = spark.range(n).select(hot.alias("subject"), scope.alias("scope"), ts.alias("ts"), F.col("id").alias("event_id"))
    given = spark.range(n, n + 600).select(hot.alias("subject"), scope.alias("scope"), ts.alias("issued_at"), (ts + F.make_dt_interval(hours=F.col("id") % 70)).alias("expires_at"))
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("upload", "convert", "convert", "done", "failed", "delete", "none")]), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(7)) + 1).cast("int"))
    events = spark.range(n).select(F.col("id").alias("event_id"), ts.alias("ts"), F.when(F.col("id") % 7 != 3, hot).alias("user_id"), F.lit("f").alias("filename"), kinds.alias("kind"))
    for run in (lambda **how: access.grant_validity_join(uses, given, **how), lambda **how: status.admit(events, **how)):
        with plain_tasks(spark):
            sizes = tasks_of(run())
            assert sizes[-1] <= 2 * sizes[len(sizes) // 2] and len(sizes) >= 10
            assert tasks_of(run(slice_s=10**9))[-1] > n / 4  # one slice: one task
        everything = lambda df: sorted(map(str, df.collect()))
        assert everything(run()) == everything(run(slice_s=10**9)) == everything(run(slice_s=3600))


def test_null_keys_are_keys_of_their_own(spark):
    uses = spark.createDataFrame([(None, None, at(5), 1), ("", "", at(5), 2), (None, "a", at(5), 3)], "subject string, scope string, ts timestamp_ntz, event_id long")
    given = spark.createDataFrame([(None, None, at(0), at(10))], "subject string, scope string, issued_at timestamp_ntz, expires_at timestamp_ntz")
    assert values(access.grant_validity_join(uses, given), "event_id", "outcome") == [(1, "valid"), (2, "none"), (3, "wrong_scope")]


def test_merged_accounts_equal_the_whole_log(spark, tmp_path):
    """Only the buckets of changed e-mails are written anew; order of batches and repeats do not matter."""
    schema = "seq long, ts timestamp_ntz, op string, email string, name string, hashed_password string"
    rows = [(i, at(i // 3), ["register", "rename", "verify", "oauth"][i % 4], f"e{i % 37}", f"n{i}" if i % 4 == 1 else None, f"h{i}" if i % 4 == 0 else None) for i in range(300)]
    path = str(tmp_path / "accounts")
    accounts.write_accounts(spark.createDataFrame(rows[100:200], schema), path, 16)
    held = {p: p.stat().st_mtime_ns for p in (tmp_path / "accounts").rglob("*.parquet")}
    accounts.merge_accounts(spark, spark.createDataFrame(rows[200:203], schema), path, 16)
    kept = {p for p in (tmp_path / "accounts").rglob("*.parquet") if held.get(p) == p.stat().st_mtime_ns}
    assert 1 <= len(held) - len(kept) <= 3  # three e-mails
    for batch in (rows[203:], rows[:100], rows[50:150], []):
        accounts.merge_accounts(spark, spark.createDataFrame(batch, schema), path, 16)
    columns = ("email", "first_seq", "name", "hashed_password", "email_verified")
    assert values(accounts.read_accounts(spark, path), *columns) == values(accounts.apply_user_changes(spark.createDataFrame(rows, schema)), *columns)


def test_results_of_one_stem_do_not_multiply_files(spark):
    some = spark.createDataFrame([("u", "a.pdf"), ("u", "b.pdf")], "user_id string, filename string")
    results = spark.createDataFrame([("u", "a.docx"), ("u", "a.docx"), ("u", "a.doc")], "user_id string, filename string")
    assert sorted(map(str, catalog.match_outputs(some, results).select("filename", "output").collect())) == sorted(["Row(filename='a.pdf', output='a.doc')", "Row(filename='b.pdf', output=None)"])


def test_summary_joins_lengths_not_texts(spark):
    from folioworks.plans import registry

    plan = registry.queries()["job_summary"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    joined = plan[: plan.index("Join")]
    assert "characters" in joined and "text#" not in joined
    assert "REPARTITION_BY_NUM" in joined and "ENSURE_REQUIREMENTS" not in joined  # no sums before the rows are dealt
