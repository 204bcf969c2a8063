"""Files, sidecars and the queue in a local folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioworks.operators import tasks
from folioworks.sources import files, queue, tables
from folioworks.streaming import jobs


def test_scan_status_and_bytes(spark, tmp_path):
    root = tmp_path / "store"
    (root / "u1/sub").mkdir(parents=True)
    (root / "u1/a.pdf").write_bytes(b"12345")
    (root / "u1/sub/b c.pdf").write_bytes(b"1")
    (root / "u1/a.pdf.status").write_text(" done\n")
    scanned = files.scan_files(spark, str(root))
    assert sorted((r["user_id"], r["filename"], r["size"]) for r in scanned.collect()) == [("u1", "a.pdf", 5), ("u1", "a.pdf.status", 6), ("u1", "sub/b c.pdf", 1)]
    schema = scanned._jdf.queryExecution().toString().split("ReadSchema")[-1]
    assert "content" not in schema
    assert [tuple(r) for r in files.read_status(spark, str(root)).collect()] == [("u1", "a.pdf", "done")]
    assert [(r["filename"], bytes(r["content"])) for r in files.load_pdf_bytes(spark, str(root), 3).collect()] == [("sub/b c.pdf", b"1")]


def test_queue_round_trip(spark, tmp_path):
    sent = spark.createDataFrame([("f", "u", "ocr"), ("g", "", "ocr")], "file_id string, user_id string, mode string")
    queue.publish(sent, str(tmp_path / "q"))
    out = [str(tmp_path / x) for x in ("good", "bad", "check")]
    jobs.stream_tasks(queue.task_stream(spark, str(tmp_path / "q")), *out, tasks.MODES)
    assert [r["file_id"] for r in spark.read.parquet(out[0]).collect()] == ["f"]
    assert [r["reason"] for r in spark.read.parquet(out[1]).collect()] == ["no_user"]


def test_users_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a@b.cd", None, "A", True)], tables.USERS)
    rows.write.parquet(str(tmp_path / "users"))
    assert tables.users_table(spark, str(tmp_path / "users")).schema == rows.schema


def test_write_paragraphs(spark, tmp_path):
    files.write_paragraphs(spark.createDataFrame([("u", "x")], "user_id string, text string"), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).columns == ["user_id", "text", "user_bucket"]


def test_status_rows_are_appended(spark, tmp_path):
    from folioworks.operators import status

    row = spark.createDataFrame([("u", "f", "done", None, 1)], "user_id string, filename string, status string, ts timestamp, seq long")
    for _ in range(2):
        status.write_status(row, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_labels_of_all_languages_in_one_scan(spark, tmp_path):
    """No schema comes from one file: keys, nesting and types differ between languages; arrays, nulls and what is too deep have a defined form."""
    (tmp_path / "locales").mkdir()
    (tmp_path / "locales/en.json").write_text('{"a": {"b": "x", "c": {"d": "y"}}, "n": 1, "none": null, "list": ["p", "q"]}')
    (tmp_path / "locales/ar.json").write_text('{\n "a": "سلام",\n "only.here": {"z": true}}')
    (tmp_path / "locales/broken.json").write_text("{no json")
    (tmp_path / "locales/empty.json").write_text("{}")
    got = {(r["lang"], r["key"]): r["value"] for r in tables.load_labels(spark, str(tmp_path / "locales")).collect()}
    assert got == {("en", "a.b"): "x", ("en", "a.c.d"): "y", ("en", "n"): "1", ("en", "list"): '["p","q"]', ("ar", "a"): "سلام", ("ar", "only.here.z"): "true"}
    flat = {(r["lang"], r["key"]): r["value"] for r in tables.load_labels(spark, str(tmp_path / "locales"), depth=2).collect()}
    assert flat["en", "a.c"] == '{"d":"y"}' and flat["en", "a.b"] == "x"


def test_users_over_jdbc(spark):
    """Read in parallel by a partition column; the filter goes to the database."""
    url, driver = "jdbc:derby:memory:users;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    rows = spark.range(1, 41).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("u"), "id").alias("email"), F.lit("h").alias("hashed_password"), F.lit("n").alias("name"), (F.col("id") % 2 == 0).alias("email_verified"))
    rows.write.format("jdbc").options(url=url, dbtable="users", driver=driver, createTableColumnTypes="email varchar(255), name varchar(255)").mode("overwrite").save()
    users = tables.users_table(spark, url=url, dbtable="users", driver=driver, partitionColumn="id", lowerBound="1", upperBound="41", numPartitions="4")
    assert sorted(r["id"] for r in users.collect()) == list(range(1, 41)) and users.rdd.getNumPartitions() == 4
    some = users.filter("id > 30 and email_verified").select("email")
    assert some.count() == 5
    plan = some._jdf.queryExecution().toString()
    assert "GreaterThan(ID,30)" in plan.replace("id", "ID") and "ReadSchema: struct<EMAIL:string" in plan.replace("email", "EMAIL")


def test_status_endings_and_names(spark, tmp_path):
    root = tmp_path / "store"
    (root / "u/sub").mkdir(parents=True)
    for name, text in [("a.status.status", "\n done\n\n"), ("sub/b c.sta", "\tfailed "), ("plain.status", "")]:
        (root / "u" / name).write_text(text)
    assert sorted(tuple(r) for r in files.read_status(spark, str(root)).collect()) == [("u", "a.status", "done")]
    assert [tuple(r) for r in files.read_status(spark, str(root), ".sta").collect()] == [("u", "sub/b c", "failed")]


def test_only_files_asked_for_are_opened(spark, tmp_path):
    (tmp_path / "u").mkdir()
    for name in ("a[1].pdf", "b{x}*.pdf", "c.pdf"):
        (tmp_path / "u" / name).write_text(name)
    listed = {r["filename"]: r["path"] for r in files.list_paths(spark, str(tmp_path)).collect()}
    got = files.load_contents(spark, [listed["a[1].pdf"], listed["b{x}*.pdf"]])
    assert sorted(bytes(r["content"]) for r in got.collect()) == [b"a[1].pdf", b"b{x}*.pdf"]
    assert got.filter(files.same_path(F.col("path"), F.lit(f"file://{tmp_path}/u/a[1].pdf"))).count() == 1


def test_a_second_scan_sees_only_what_differs(spark, tmp_path):
    root, manifest = tmp_path / "store", str(tmp_path / "manifest")
    (root / "u").mkdir(parents=True)
    for name in ("a.pdf", "b.pdf", "c.pdf"):
        (root / "u" / name).write_text(name)
    scan = lambda: sorted((r["filename"], r["change"]) for r in files.scan_changes(spark, str(root), manifest).collect())
    assert scan() == [("a.pdf", "added"), ("b.pdf", "added"), ("c.pdf", "added")]
    assert scan() == []
    (root / "u/b.pdf").write_text("longer than before")
    (root / "u/c.pdf").unlink()
    (root / "u/d [x].pdf").write_text("new")
    (tmp_path / "manifest/version=2").mkdir()  # a scan that did not finish
    assert scan() == [("b.pdf", "changed"), ("c.pdf", "removed"), ("d [x].pdf", "added")]
    assert scan() == []


def test_more_files_than_a_page_of_keys(spark, tmp_path):
    """Object stores list a thousand keys a page; all are there."""
    (tmp_path / "u").mkdir()
    for i in range(1100):
        (tmp_path / "u" / f"{i}.pdf").write_text("x")
    assert files.scan_files(spark, str(tmp_path)).count() == 1100


def batches_of(path):
    """A sink that writes each batch's values to a file of its own, and says after how many batches to fail."""

    def sink(fail_at=None):
        def write(batch, batch_id):
            values = sorted(r["value"] for r in batch.collect())
            if batch_id == fail_at:
                raise RuntimeError("lost")
            (path / str(batch_id)).write_text("\n".join(values))

        return write

    return sink


def test_acknowledged_queue_loses_and_repeats_nothing(spark, tmp_path):
    """A message a batch; a run that fails in mid-queue, new messages meanwhile, one with the name of an acknowledged one."""
    import os

    import pytest

    from folioworks.sources import acked

    root, out = tmp_path / "q", tmp_path / "out"
    root.mkdir()
    out.mkdir()
    sink = batches_of(out)

    def publish(name, text, age):
        (root / name).write_text(text)
        os.utime(root / name, (1_700_000_000 + age, 1_700_000_000 + age))

    for name, age in [("c", 1), ("a", 2), ("b", 3)]:
        publish(name, f"{name}1\n{name}2\n", age)
    (root / "_hidden").write_text("no message")
    run = lambda fail_at=None: jobs.run_until_empty(queue.acknowledged_task_stream(spark, str(root)), sink(fail_at), str(tmp_path / "check"))
    with pytest.raises(Exception, match="lost"):
        run(fail_at=1)
    assert sorted(p.name for p in root.iterdir() if not p.name.startswith(("_", "."))) == ["a", "b"]  # c is done and gone
    publish("c", "c3\n\ud83d".encode("utf-8", "replace").decode() + "\n", 0)  # older than what is in hand
    publish("empty", "", 9)
    run()
    got = {int(p.name): p.read_text().split("\n") for p in out.iterdir()}
    assert got[0] == ["c1", "c2"] and got[1] == ["a1", "a2"] and sorted(x for i in got for x in got[i] if x) == ["?", "a1", "a2", "b1", "b2", "c1", "c2", "c3"]
    assert [p.name for p in root.iterdir() if not p.name.startswith("_")] == ["empty"]  # the last one waits for the next batch
    assert acked.Queue(str(root)).acknowledged() == 4 and acked.Queue(str(root)).numbers(acked.TAKEN) == [5]
    publish("d", "d1", 20)
    run()
    assert sorted(p.read_text() for p in out.iterdir())[-1] == "d1"
    publish("e", "e1\n", 30)
    rows = queue.acknowledged_task_stream(spark, str(root))
    jobs.run_until_empty(rows, lambda batch, i: (out / f"new{i}").write_text(str([(r["value"], r["message"], int(r["ts"].timestamp())) for r in batch.orderBy("value").collect()])), str(tmp_path / "check2"))
    assert (out / "new0").read_text() == "[('d1', 'd', 1700000020), ('e1', 'e', 1700000030)]"  # a new checkpoint gets what is not acknowledged


def test_acknowledging_half_way(tmp_path):
    """Whatever ends an acknowledgement, the next call goes on and nothing comes twice."""
    from folioworks.sources import acked

    for name in "abc":
        (tmp_path / name).write_text(name)
    q = acked.Queue(str(tmp_path))
    assert q.take(2) == 2 and q.take(0) == 2
    q._write(2, acked.ACKED, "")  # the mark alone
    assert acked.Queue(str(tmp_path)).take(1) == 3
    assert sorted(p.name for p in tmp_path.iterdir() if p.is_file()) == ["c"] and q.name(3) == "c"
    q.acknowledge(3)
    q.acknowledge(3)
    assert q.acknowledged() == 3 and q.take(5) == 3 and [p.name for p in tmp_path.iterdir()] == [acked.JOURNAL]


def test_files_are_written_and_listed_by_tasks(spark, tmp_path):
    """No process a file and no index of all files in the driver: a scan has no file source, its rows come from tasks; names stand for themselves."""
    rows = spark.createDataFrame([("a/b%2F", str(i), f"text {i}\n") for i in range(300)] + [(None, "x", "")], "source string, doc string, text string")
    root = str(tmp_path / "store")
    files.store_files(rows, root, ("source", "doc"))
    files.store_files(rows.limit(0), root, ("source", "doc"))
    files.store_files(spark.createDataFrame([("a/b%2F", "7", "other")], rows.schema), root, ("source", "doc"))
    (tmp_path / "store/100% +.pdf").write_text("at the root")
    (tmp_path / "store/_hidden").mkdir()
    (tmp_path / "store/_hidden/a.txt").write_text("not listed")
    (tmp_path / "store/source=n").mkdir()
    (tmp_path / "store/source=n/.a").write_text("not listed")
    (tmp_path / "store/source=n/empty").write_text("")
    scanned = files.scan_files(spark, f"file:{root}")
    assert "FileScan" not in scanned._jdf.queryExecution().toString() and not scanned.inputFiles()
    got = {(r[0], r[1]): r[2] for r in scanned.select(files.plain_key(F.col("user_id")), "filename", "size").collect()}
    want = {("source=a/b%2F", f"doc={i}/part.txt"): len(f"text {i}\n") + 1 for i in range(300)}
    assert got == want | {("source=a/b%2F", "doc=7/part.txt"): 6, ("source=__HIVE_DEFAULT_PARTITION__", "doc=x/part.txt"): 1, ("100% +.pdf", "100% +.pdf"): 11}


def test_status_files_are_stored_and_read_by_tasks(spark, tmp_path, monkeypatch):
    """As Spark's file source reads them, but no task a few files and no index in the driver; small files are dealt over all cores, not by their bytes."""
    rows = spark.createDataFrame([(f"u{i % 60}", f"100% +[{i}].pdf", f" \t{'done' if i % 3 else 'failed'} ") for i in range(300)], "user_id string, filename string, text string")
    root, cores, context = tmp_path / "store", spark.sparkContext.defaultParallelism, spark.sparkContext
    context.setJobGroup("status", "files are stored")
    files.store_files(rows, str(root), ("user_id", "filename"), "sta")
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("status") for s in tracker.getJobInfo(j).stageIds]
    context.setLocalProperty("spark.jobGroup.id", None)
    assert max(s.numTasks for s in stages if s is not None) >= 2 * cores
    assert (root / "user_id=u7/filename=100%25 +[7].pdf/part.sta").read_text() == " \tdone \n"
    (root / "at root.sta").write_text(" processing\n\n")
    (root / "user_id=u0/empty.sta").write_text("")
    (root / "user_id=u0/_hidden.sta").write_text("x")
    (root / "user_id=u0/other.status").write_text("x")
    (root / "user_id=u0/bytes.sta").write_bytes(b" d\xffne ")
    read = files.read_status(spark, f"file:{root}", ".sta")
    assert "FileScan" not in read._jdf.queryExecution().toString() and not read.inputFiles()
    assert read.select(F.spark_partition_id()).distinct().count() > cores
    got = sorted(tuple(r) for r in read.collect())
    want = [(f"user_id=u{i % 60}", f"filename=100%25 +[{i}].pdf/part", "done" if i % 3 else "failed") for i in range(300)]
    assert got == sorted([*want, ("at root.sta", "at root", "processing"), ("user_id=u0", "bytes", "d�ne")])
    monkeypatch.setattr(files, "_local", lambda spark, root: None)  # as in any other file system
    assert sorted(tuple(r) for r in files.read_status(spark, str(root), ".sta").collect()) == got


def test_status_files_of_any_file_system(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "_local", lambda spark, root: None)
    rows = spark.createDataFrame([("u", "a.pdf", "  done ")], "user_id string, filename string, text string")
    files.store_files(rows, str(tmp_path / "store"), ("user_id", "filename"), "sta")
    assert [p.read_text() for p in tmp_path.glob("store/user_id=u/filename=a.pdf/part*.sta")] == ["  done \n"]
    assert [r["status"] for r in files.read_status(spark, str(tmp_path / "store"), ".sta").collect()] == ["done"]


def test_query_of_status_files_has_no_file_source(spark):
    from folioworks.plans import registry

    read = registry.queries()["read_status"](spark, "/root/testdata/sf0.001")
    assert "FileScan" not in read._jdf.queryExecution().toString() and not read.inputFiles()


def test_files_beside_each_other(spark, tmp_path):
    """Named by their last key, a folder for the keys before it; a file that comes again is replaced."""
    rows = spark.createDataFrame([("u", "a/b.pdf", "  done "), ("u", "c.pdf", "failed"), (None, "c.pdf", "pending")], "user_id string, filename string, text string")
    root = tmp_path / "store"
    files.store_files(rows, str(root), ("user_id", "filename"), "sta", beside=True)
    files.store_files(rows.filter("text = 'failed'").withColumn("text", F.lit("done")), str(root), ("user_id", "filename"), "sta", beside=True)
    found = {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file()}
    assert found == {"user_id=u/filename=a%2Fb.pdf.sta": "  done \n", "user_id=u/filename=c.pdf.sta": "done\n", "user_id=__HIVE_DEFAULT_PARTITION__/filename=c.pdf.sta": "pending\n"}
    assert sorted(tuple(r) for r in files.read_status(spark, str(root), ".sta").filter("user_id = 'user_id=u'").collect()) == [("user_id=u", "filename=a%2Fb.pdf", "done"), ("user_id=u", "filename=c.pdf", "done")]


def test_query_of_status_files_in_any_file_system(spark, monkeypatch):
    """Spark's writer makes a folder for each file: the rows are the same."""
    from folioworks.plans import registry

    run = lambda: sorted(tuple(r) for r in registry.queries()["read_status"](spark, "/root/testdata/sf0.001").collect())
    got = run()
    monkeypatch.setattr(files, "_local", lambda spark, root: None)
    assert got == run() and len(got) > 100
