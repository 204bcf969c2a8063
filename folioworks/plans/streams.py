"""Registered streaming queries: each runs its stream to the end over the table's files and returns what it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioworks import views as v
from folioworks.operators import tasks
from folioworks.session import shared_folder, ship_package
from folioworks.sources import files, queue
from folioworks.streaming import jobs

_TASK_DOCUMENTS = """, asked AS (SELECT user_id, file_id AS filename, arg_min(event_id, (ts, event_id)) AS seq FROM tasks WHERE NOT damaged AND coalesce(file_id, '') <> ''
    AND coalesce(user_id, '') <> '' GROUP BY ALL), held AS (SELECT DISTINCT user_id, filename FROM uploads), pages AS (SELECT doc_id::VARCHAR AS user_id, count(*) AS n FROM doc_pages GROUP BY 1),
    documents_of AS (SELECT a.user_id, a.filename, a.seq, CASE WHEN h.user_id IS NULL OR p.n IS NULL THEN 'failed' ELSE 'done' END AS status, CASE WHEN h.user_id IS NULL THEN 0 ELSE coalesce(p.n, 0) END AS pages
    FROM asked a LEFT JOIN held h ON h.user_id = a.user_id AND h.filename = a.filename LEFT JOIN pages p ON p.user_id = a.user_id)"""

_TASK_ROWS = v.with_views("tasks") + """SELECT event_id, CASE WHEN damaged THEN NULL ELSE file_id END AS file_id, CASE WHEN damaged THEN NULL ELSE user_id END AS user_id,
    CASE WHEN damaged THEN 'ocr' ELSE coalesce(mode, 'ocr') END AS mode, CASE WHEN damaged THEN 'damaged' WHEN coalesce(file_id, '') = '' THEN 'no_file'
    WHEN coalesce(user_id, '') = '' THEN 'no_user' WHEN coalesce(mode, 'ocr') NOT IN ('ocr', 'layout') THEN 'bad_mode' END AS reason FROM tasks"""

STREAM_SQL: dict[str, str] = {
    "stream_tasks": _TASK_ROWS,
    "acknowledged_queue": _TASK_ROWS,
    "stream_status": v.with_views("latest") + "SELECT user_id, filename, status FROM latest",
    "stream_admission": v.with_views("coded") + "SELECT event_id, code FROM coded WHERE kind = 'convert'",
    "stream_rate_counts": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, user_id::VARCHAR AS key, count(*) AS n FROM events GROUP BY ALL",
    "stream_histogram": v.with_views("page_timings") + "SELECT le, count(*) FILTER (elapsed_s <= le) AS bucket_count, count(*) AS total_count, "
    "round(sum(elapsed_s), 2) AS total_sum FROM page_timings, unnest([0.5, 1, 2, 3, 5, 10, 20, 40, 'infinity'::DOUBLE]) AS u(le) GROUP BY le",
    "stream_grant_join": v.with_views("uses", "grants") + "SELECT u.event_id, g.subject, g.scope, g.issued_at FROM uses u JOIN grants g ON g.subject = u.subject AND g.scope = u.scope AND g.issued_at <= u.ts AND u.ts < g.expires_at",
    "stream_transitions": v.with_views("status_log") + "SELECT user_id, filename, seq, status FROM (SELECT *, lag(status) OVER (PARTITION BY user_id, filename ORDER BY ts, seq) AS previous "
    "FROM status_log) WHERE previous = 'processing' AND status IN ('done', 'failed')",
    "stream_timeouts": v.with_views("status_log") + "SELECT user_id, filename, seq FROM (SELECT *, epoch_us(least(coalesce(lead(ts) OVER (PARTITION BY user_id, filename ORDER BY ts, seq), "
    "until), until)) - epoch_us(ts) AS ran FROM status_log, (SELECT max(ts) - INTERVAL 1 MINUTE AS until FROM status_log)) WHERE status = 'processing' AND ran > 600000000",
    "stream_histogram_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, le, count(*) FILTER (value <= le) AS bucket_count, count(*) AS total_count, round(sum(value), 2) AS total_sum "
    "FROM events, unnest([0.5, 1, 2, 3, 5, 10, 20, 40, 'infinity'::DOUBLE]) AS u(le) WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL",
    "dedup_uploads": v.with_views("uploads") + "SELECT user_id, filename, seq, size FROM uploads",
    "task_queue": v.with_views("tasks") + "SELECT file_id, user_id, coalesce(mode, 'ocr') AS mode FROM tasks WHERE NOT damaged AND coalesce(file_id, '') <> '' AND coalesce(user_id, '') <> '' "
    "AND coalesce(mode, 'ocr') IN ('ocr', 'layout')",
    "stream_conversion": v.with_views("doc_pages") + r"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, line_no) AS seq, page,
        CASE WHEN line_no = 0 THEN 'separator' WHEN text = '' THEN 'blank' ELSE 'text' END AS kind, text
        FROM (SELECT doc_id, page, line_no, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS text FROM (SELECT doc_id, page, unnest(ls) AS raw, generate_subscripts(ls, 1) AS line_no
              FROM (SELECT doc_id, page, string_split(coalesce(text, ''), chr(10)) AS ls FROM doc_pages))
              UNION ALL SELECT doc_id, page, 0, '-- Page ' || page || ' --' FROM doc_pages WHERE page > 1)""",
    "stream_task_conversion": v.with_views("tasks", "uploads", "doc_pages") + _TASK_DOCUMENTS + " SELECT user_id, filename, status, pages FROM documents_of",
    "stream_task_status": v.with_views("tasks", "uploads", "doc_pages") + _TASK_DOCUMENTS + """ SELECT user_id, filename, 'processing' AS status, seq, 1 AS place FROM documents_of
        UNION ALL SELECT user_id, filename, status, seq, 2 FROM documents_of""",
    "stream_grant_outcomes": v.with_views("uses", "grants") + """SELECT u.event_id, CASE WHEN bool_or(g.scope = u.scope AND u.ts < g.expires_at) THEN 'valid' WHEN bool_or(g.scope = u.scope) THEN 'expired'
        WHEN count(g.subject) > 0 THEN 'wrong_scope' ELSE 'none' END AS outcome FROM uses u LEFT JOIN grants g ON g.subject = u.subject AND g.issued_at <= u.ts GROUP BY u.event_id""",
    "stream_rate_limit": """SELECT event_id, CASE WHEN event_type = 'click' AND row_number() OVER (PARTITION BY event_type, user_id, date_trunc('day', ts) ORDER BY ts, event_id) > 1
        OR event_type = 'signup' AND row_number() OVER (PARTITION BY event_type, user_id, epoch_us(ts) // 7200000000 ORDER BY ts, event_id) > 2 THEN 429 ELSE 200 END AS code FROM events""",
}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream, with a time that watermarks take."""
    schema = v.table(spark, sf_dir, "events").schema
    # A pattern, as the file stream takes a table that is one file only so.
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _collected(spark: SparkSession, out: DataFrame, name: str, mode: str = "append") -> DataFrame:
    ship_package(spark)
    path = shared_folder(spark, name)
    jobs.run_available(out, jobs.to_folder(f"{path}/out"), f"{path}/checkpoint", mode)
    return spark.read.parquet(f"{path}/out").drop("batch_id")


def _staged(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """A batch view written as files and read as a stream.

    The file stream orders by the times of files, not by their rows, so all files that are there come as one batch.
    """
    path = shared_folder(spark, name)
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows
    timed.write.parquet(path)
    return spark.readStream.schema(timed.schema).parquet(path)


def stream_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "tasks")
    raw = _staged(spark, v.tasks_raw(spark, sf_dir), "tasks_raw")
    jobs.stream_tasks(raw, f"{path}/valid", f"{path}/quarantine", f"{path}/checkpoint", tasks.MODES)
    good, bad = spark.read.parquet(f"{path}/valid"), spark.read.parquet(f"{path}/quarantine")
    return good.unionByName(bad, allowMissingColumns=True).select("event_id", "file_id", "user_id", "mode", "reason")


def stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _staged(spark, v.status_log(spark, sf_dir), "status_log")
    ship_package(spark)
    path = shared_folder(spark, "status")
    jobs.run_available(jobs.stream_status(log), jobs.to_folder(f"{path}/out"), f"{path}/checkpoint", "update")
    rows = spark.read.parquet(f"{path}/out")
    return rows.groupBy("user_id", "filename").agg(F.max_by("status", "batch_id").alias("status"))


#: Of the streams whose rows arrive out of order: runs, the longest delay of a row, and a time after all rows.
RUNS, DELAY = 2, "2 days"
AFTER_ALL = "2100-01-01"


def _arriving(spark: SparkSession, rows: DataFrame, seq: str, make, name: str, delayed: bool = True, closing: DataFrame | None = None, no_data: bool = True) -> DataFrame:
    """What a stream gives whose rows arrive up to DELAY after their time, in RUNS runs that each go on from the checkpoint of the one before.

    closing: rows of a last run, which move the watermark past all others.
    """
    ship_package(spark)
    path = shared_folder(spark, name)
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    delay = F.pmod(F.xxhash64(seq), F.lit(2 * 86_400_000_000)) if delayed else F.lit(0)
    come = timed.withColumn("__at", F.unix_micros("ts") + delay)
    first, last = come.agg(F.min("__at"), F.max("__at")).first()
    run = F.least(F.floor((F.col("__at") - F.lit(first)) * RUNS / F.lit(last - first + 1 if last is not None else 1)), F.lit(RUNS - 1))
    parts = [come.filter(run == i).drop("__at") for i in range(RUNS)] + ([closing] if closing is not None else [])
    for i, part in enumerate(parts):
        part.write.mode("append").parquet(f"{path}/in")
        stream = make(spark.readStream.schema(timed.schema).parquet(f"{path}/in"))
        jobs.run_available(stream, jobs.to_folder(f"{path}/out"), f"{path}/checkpoint", no_data=no_data and i == len(parts) - 1)  # the last run takes what waits
    return spark.read.schema(stream.schema).parquet(f"{path}/out/batch_id=*")


def _end(rows: DataFrame, **values) -> DataFrame:
    """One row in the shape of rows at AFTER_ALL."""
    return rows.sparkSession.range(1).select(*[F.lit(values.get(f.name)).cast("timestamp" if f.name == "ts" else f.dataType).alias(f.name) for f in rows.schema.fields])


def stream_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = v.file_events(spark, sf_dir).select("event_id", "ts", "user_id", "filename", "kind")
    return _arriving(spark, events, "event_id", lambda rows: jobs.stream_admission(rows, DELAY), "admission", closing=_end(events, ts=AFTER_ALL, event_id=0))


def stream_rate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update mode: the last count of each window, also of those that stay open."""
    requests = _events(spark, sf_dir).select("ts", F.col("user_id").cast("string").alias("key"))
    path = shared_folder(spark, "rates")
    jobs.run_available(jobs.stream_rate_counts(requests), jobs.to_folder(f"{path}/out"), f"{path}/checkpoint", "update")
    rows = spark.read.parquet(f"{path}/out").groupBy("start", "key").agg(F.max_by("n", "batch_id").alias("n"))
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete mode: the last batch has the whole histogram."""
    schema = v.table(spark, sf_dir, "lineitem").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/lineitem.parque[t]").withColumn("elapsed_s", F.col("l_quantity"))
    path = shared_folder(spark, "histogram")
    jobs.run_available(jobs.stream_histogram(rows, "elapsed_s"), jobs.to_folder(f"{path}/out"), f"{path}/checkpoint", "complete")
    written = spark.read.parquet(f"{path}/out")
    last = written.agg(F.max("batch_id").alias("last"))
    return written.join(F.broadcast(last), F.col("batch_id") == F.col("last")).drop("batch_id", "last")  # one row


def stream_grant_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = F.when(F.get_json_object("props", "$.k").cast("int") < 7, "access").otherwise("password_reset")
    events = lambda kind: _events(spark, sf_dir).filter(F.col("event_type") == kind).select("event_id", "ts", F.col("user_id").cast("string").alias("subject"), scope.alias("scope"))
    given = events("signup").withColumn("issued_at", F.col("ts")).withColumn("expires_at", F.col("ts") + F.expr("interval 24 hours"))
    joined = jobs.stream_grant_join(events("click"), given)
    return _collected(spark, joined, "grants").withColumn("issued_at", F.col("issued_at").cast("timestamp_ntz"))


def stream_grant_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses and grants in one table of arrivals, read as two streams."""
    used = v.uses(spark, sf_dir).select("subject", "scope", "ts", "event_id", F.lit(None).cast("timestamp").alias("expires_at"))
    given = v.grants(spark, sf_dir).select("subject", "scope", F.col("issued_at").alias("ts"), F.lit(None).cast("long").alias("event_id"), F.col("expires_at").cast("timestamp").alias("expires_at"))
    line = used.unionByName(given)

    def outcomes(rows: DataFrame) -> DataFrame:
        uses = rows.filter("event_id is not null").select("event_id", "subject", "scope", "ts")
        return jobs.stream_grant_outcomes(uses, rows.filter("event_id is null").withColumnRenamed("ts", "issued_at"), DELAY)

    return _arriving(spark, line, "event_id", outcomes, "grant_outcomes", closing=_end(line, ts=AFTER_ALL, expires_at=AFTER_ALL))


def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of the batch query; requests arrive in order."""
    rules = spark.createDataFrame([("click", 1, 86400), ("signup", 2, 7200)], "endpoint string, max_requests int, window_s long")
    return _arriving(spark, v.requests(spark, sf_dir), "event_id", lambda rows: jobs.stream_rate_limit(rows, rules), "rate_limit", delayed=False, no_data=False)


def stream_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = v.status_log(spark, sf_dir)
    return _arriving(spark, log, "seq", lambda rows: jobs.stream_transitions(rows, DELAY), "transitions", closing=_end(log, ts=AFTER_ALL, seq=0))


def stream_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in RUNS runs, those of most documents spread over all of them."""
    ship_package(spark)
    path = shared_folder(spark, "conversion")
    pages = v.doc_pages(spark, sf_dir)
    for i in range(RUNS):
        pages.filter(F.pmod(F.xxhash64("doc_id", "page"), F.lit(RUNS)) == i).write.mode("append").parquet(f"{path}/in")
        jobs.stream_conversion(spark.readStream.schema(pages.schema).parquet(f"{path}/in"), path, f"{path}/checkpoint")
    return jobs.converted(spark, path)[0].select("doc_id", "seq", "page", "kind", "text")


def _task_conversion(spark: SparkSession, sf_dir: str) -> str:
    """Tasks of the event log; an uploaded file holds the pages of the conversation that has its user's number. Files are stored, and found by listing."""
    ship_package(spark)
    path = shared_folder(spark, "task_conversion")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    bodies = v.doc_pages(spark, sf_dir).groupBy(F.col("doc_id").cast("string").alias("user_id")).agg(F.array_join(ordered, "\f").alias("text"))
    stored = v.uploads(spark, sf_dir).select("user_id", "filename").distinct().join(bodies, "user_id")
    files.store_files(stored.select(F.col("user_id").alias("u"), F.col("filename").alias("f"), "text"), f"{path}/store", ("u", "f"))
    listed = files.list_paths(spark, f"{path}/store").filter(F.endswith("path", F.lit(".txt")))
    catalog = listed.select(F.regexp_extract("path", "/u=([^/]*)/", 1).alias("user_id"), F.regexp_extract("path", "/f=([^/]*)/", 1).alias("filename"), "path")
    jobs.stream_task_conversion(_staged(spark, v.tasks_raw(spark, sf_dir), "tasks_raw"), catalog, path, f"{path}/checkpoint", seq="event_id")
    return path


def stream_task_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.converted(spark, _task_conversion(spark, sf_dir), ("user_id", "filename"))[1].select("user_id", "filename", "status", "pages")


def stream_task_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows for the status log; place is their order by ts and seq, the log's own order, in each file."""
    log = spark.read.parquet(f"{_task_conversion(spark, sf_dir)}/status")
    place = F.row_number().over(Window.partitionBy("user_id", "filename").orderBy("ts", "seq"))
    return log.select("user_id", "filename", "status", "seq", place.alias("place"))


def stream_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _staged(spark, v.status_log(spark, sf_dir), "status_log")
    return _collected(spark, jobs.stream_timeouts(log), "timeouts")


def stream_histogram_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs.stream_histogram_windows(_events(spark, sf_dir).select("ts", "value"), "value")
    return _collected(spark, rows, "histogram_windows").withColumn("start", F.col("start").cast("timestamp_ntz"))


def dedup_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every upload is sent twice."""
    sent = v.uploads(spark, sf_dir)
    return _collected(spark, jobs.dedup_uploads(_staged(spark, sent.unionByName(sent), "uploads")), "dedup").select("user_id", "filename", "seq", "size")


def task_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid tasks published to the queue, and read from it as a stream."""
    path = shared_folder(spark, "queue")
    good, _ = tasks.split_tasks(tasks.validate_tasks(v.tasks_raw(spark, sf_dir), tasks.MODES))
    queue.publish(good, f"{path}/queue")
    jobs.stream_tasks(queue.task_stream(spark, f"{path}/queue", 1000), f"{path}/valid", f"{path}/quarantine", f"{path}/checkpoint", tasks.MODES)
    return spark.read.parquet(f"{path}/valid").select("file_id", "user_id", "mode")


def acknowledged_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tasks published as eight messages; one is taken in a first run, the others by a second one that goes on from there."""
    path = shared_folder(spark, "acknowledged")
    raw = v.tasks_raw(spark, sf_dir).select(F.to_json(F.struct("event_id", "value")).alias("value"))
    raw.repartition(8).write.text(f"{path}/queue")
    for run in (jobs.run_available, jobs.run_until_empty):
        sent = queue.acknowledged_task_stream(spark, f"{path}/queue").select(F.from_json("value", "event_id long, value string").alias("task"), "ts")
        jobs.stream_tasks(sent.select("task.*", "ts"), f"{path}/valid", f"{path}/quarantine", f"{path}/checkpoint", tasks.MODES, run)
    good, bad = spark.read.parquet(f"{path}/valid"), spark.read.parquet(f"{path}/quarantine")
    return good.unionByName(bad, allowMissingColumns=True).select("event_id", "file_id", "user_id", "mode", "reason")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (stream_task_conversion, stream_task_status, stream_grant_outcomes, stream_rate_limit, stream_timeouts, stream_histogram_windows, dedup_uploads, task_queue, acknowledged_queue, stream_tasks, stream_status, stream_admission, stream_rate_counts, stream_histogram, stream_grant_join, stream_transitions, stream_conversion)
    return {f.__name__: f for f in found}
