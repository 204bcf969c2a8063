"""Streaming forms of the operators. Each takes a streaming DataFrame and returns one, or starts a query with a sink.

Event times are TIMESTAMP with the session zone at UTC, as watermarks need.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioworks.operators import convert, layout, metrics, status, tasks
from folioworks.sources import files
from folioworks.streaming import state

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state(df: DataFrame) -> None:
    """Custom state needs the RocksDB provider; its Python driver process gets the processors by value, not by import."""
    cloudpickle.register_pickle_by_value(state)
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


def chunked(items: Iterable[str], size: int) -> Iterator[list[str]]:
    items = iter(items)
    while chunk := list(islice(items, size)):
        yield chunk


_NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


def run_available(out: DataFrame, sink, checkpoint: str, mode: str = "append", no_data: bool = True) -> None:
    """Run what is there in micro-batches, each given to sink(batch, batch_id), then stop.

    no_data: whether batches without data follow, as watermarks need; streams whose state has a time to live in processing time
    would never stop with them.
    """
    conf = out.sparkSession.conf
    before = conf.get(_NO_DATA)
    conf.set(_NO_DATA, str(no_data).lower())
    try:
        query = out.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    finally:
        conf.set(_NO_DATA, before)
    query.awaitTermination()


def run_until_empty(out: DataFrame, sink, checkpoint: str) -> None:
    """As run_available, for sources that hand out a part of what is there at a time: batch after batch until nothing new comes."""
    query = out.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def to_folder(path: str):
    """A sink that writes each batch to a folder named by it, so a batch that is run again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def stream_tasks(raw: DataFrame, valid_path: str, quarantine_path: str, checkpoint: str, modes: Sequence[str] | None = None, run=run_available) -> None:
    """Valid tasks to one folder and the others, with their reason, to another."""

    def write(batch: DataFrame, batch_id: int) -> None:
        checked = tasks.validate_tasks(batch, modes).persist()
        good, bad = tasks.split_tasks(checked)
        to_folder(valid_path)(good, batch_id)
        to_folder(quarantine_path)(bad, batch_id)
        checked.unpersist()

    run(raw, write, checkpoint)


def stream_status(log: DataFrame) -> DataFrame:
    """Current status of each file; for update or complete mode."""
    return log.groupBy(*status.KEY).agg(F.max_by("status", F.struct("ts", "seq")).alias("status"))


#: Buckets that keys are dealt to; a checkpoint holds for one number only.
BUCKETS = 4096


def _bucketed(rows: DataFrame, keys: Sequence[str], *also: str):
    """rows grouped by the bucket of these keys, and by other columns."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")).groupBy(*also, "bucket")


def _waiting(rows: DataFrame, seq: str, late: str, *fields) -> DataFrame:
    """What InOrder processors take, behind a watermark on ts."""
    marked = rows.withWatermark("ts", late)
    return marked.select("*", F.unix_micros("ts").alias("at"), F.lit(0).alias("turn"), F.col(seq).cast("long").alias("order"), *fields).drop("seq").withColumnRenamed("order", "seq")


def stream_admission(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """event_id, code of each conversion as conversion_admission gives, once the watermark (late behind the newest event) has passed it.

    Events of a file may come in any order and batch within that delay; later ones are dropped. Only files that are there have state.
    """
    use_state(events)
    keyed = _bucketed(_waiting(events, "event_id", late, F.col("kind").alias("what")), ["user_id"], "filename")
    return keyed.transformWithState(state.Admission(), "event_id long, code int", "Append", "EventTime")


def stream_rate_counts(requests: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Requests by key and window; rows behind the watermark are dropped."""
    slot = F.window("ts", window)
    return requests.withWatermark("ts", late).groupBy(slot, "key").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "key", "n")


def stream_histogram(rows: DataFrame, value: str, buckets: Sequence[float] = metrics.PAGE_BUCKETS) -> DataFrame:
    """The running histogram, for complete mode."""
    return metrics.duration_histogram(rows, value, buckets)


def stream_histogram_windows(rows: DataFrame, value: str, window: str = "1 day", late: str = "1 hour", buckets: Sequence[float] = metrics.PAGE_BUCKETS) -> DataFrame:
    """The histogram of each window of event time, for append mode: a window comes once, when the watermark has passed it."""
    at = F.col(value)
    each = [F.count_if(at <= b).alias(f"at{i}") for i, b in enumerate([*buckets, float("inf")])]
    counted = rows.withWatermark("ts", late).groupBy(F.window("ts", window).alias("slot")).agg(*each, F.count("*").alias("total_count"), F.round(F.sum(at), 2).alias("total_sum"))
    pairs = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"at{i}").alias("bucket_count")) for i, b in enumerate([*buckets, float("inf")])])
    return counted.select(F.col("slot.start").alias("start"), F.explode(pairs).alias("x"), "total_count", "total_sum").select("start", "x.*", "total_count", "total_sum")


def _newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of each key the rows of the last batch that wrote it."""
    last = rows.groupBy(*keys).agg(F.max("batch_id").alias("last"))
    return rows.join(last, list(keys)).filter("batch_id = last").drop("batch_id", "last")


def converted(spark: SparkSession, path: str, keys: Sequence[str] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """Paragraphs and outcomes that a conversion stream has written so far; a document that was written again has its last form."""
    outcome = spark.read.parquet(f"{path}/outcome")
    last = outcome.groupBy(*keys).agg(F.max("batch_id").alias("last"))
    paragraphs = spark.read.parquet(f"{path}/paragraphs").join(last, list(keys)).filter("batch_id = last").drop("batch_id", "last")
    return paragraphs, _newest(outcome, keys)


def _write_documents(results: DataFrame, outcome: DataFrame, path: str, batch_id: int, keys: Sequence[str]) -> None:
    to_folder(f"{path}/outcome")(outcome, batch_id)
    done = results.join(outcome.filter("status = 'done'").select(*keys), list(keys), "left_semi")
    to_folder(f"{path}/paragraphs")(layout.build_layout(done.select(*keys, "page", "text"), keys), batch_id)


def stream_conversion(pages: DataFrame, path: str, checkpoint: str, make=lambda: convert.clean_page, keys: Sequence[str] = ("doc_id",), forget_s: int | None = None) -> None:
    """Pages in, paragraphs and outcomes out. A batch run again replaces its output.

    The pages of a document may come in several batches: a document's converted pages are state, each batch writes the
    documents that it touches anew from all their pages so far, and converted() reads the last form of each. So a batch
    costs its own pages and the documents they belong to, whatever came before. A page that comes again replaces itself.
    forget_s: how long pages of a document are kept after they came; for ever if not given.
    """
    use_state(pages)
    made = convert.convert_pages(pages, make, keys)
    whole = made.groupBy(*keys).transformWithState(state.Pages(tuple(keys), forget_s), made.schema, "Append", "ProcessingTime" if forget_s else "None")

    def write(batch: DataFrame, batch_id: int) -> None:
        to_folder(f"{path}/results")(batch, batch_id)
        results = batch.sparkSession.read.schema(made.schema).parquet(f"{path}/results/batch_id={batch_id}")
        _write_documents(results, convert.job_outcome(results, keys), path, batch_id, keys)

    run_available(whole, write, checkpoint, no_data=not forget_s)


FILES_A_READ = 10_000


def stream_task_conversion(raw: DataFrame, catalog: DataFrame, path: str, checkpoint: str, splitter=lambda: convert.form_feeds, make=lambda: convert.clean_page, modes: Sequence[str] | None = None, clock=now, seq: str | None = None) -> None:
    """Tasks in; paragraphs, outcomes and rows for the status log out. catalog: user_id, filename, path of the stored files.

    A valid task sets its file to processing; the bytes are split into pages, the pages converted, and the file is done if
    every page was, else failed, as it is where the file is missing, can't be split or has no pages. A file asked for more
    than once in a batch is converted once. A batch that is run again replaces its output. Of the files only those that
    the batch asks for are opened: their paths are looked up first, and go through the driver FILES_A_READ at a time.

    Status rows have the times (of clock) at which the batch began its work and had written its results, the end at least
    a microsecond after the start. Their seq is that of the file's first task in the batch (column seq of raw, 0 without
    one), the number line of the event that asked, so the log orders them with the events of other writers.
    """
    key = list(status.KEY)
    order = F.col(seq).cast("long") if seq else F.lit(0).cast("long")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, began = batch.sparkSession, clock()
        own = lambda name: f"{path}/{name}/batch_id={batch_id}"
        good, _ = tasks.split_tasks(tasks.validate_tasks(batch, modes))
        wanted = good.groupBy(F.col("user_id"), F.col("file_id").alias("filename")).agg(F.min(F.struct("ts", order.alias("seq")))["seq"].alias("seq"))
        to_folder(f"{path}/wanted")(wanted, batch_id)
        wanted = spark.read.parquet(own("wanted"))
        there = catalog.select(*key, "path").join(wanted.select(*key), key, "left_semi").groupBy(*key).agg(F.min("path").alias("path"))
        to_folder(f"{path}/found")(there, batch_id)
        found = spark.read.parquet(own("found"))
        to_folder(f"{path}/pages")(convert.pdf_to_pages(found.limit(0).withColumn("content", F.lit(None).cast("binary")), splitter, key), batch_id)
        for paths in chunked((r["path"] for r in found.select("path").toLocalIterator()), FILES_A_READ):
            contents = files.load_contents(spark, paths).withColumnRenamed("path", "at")
            asked = contents.join(found, files.same_path(F.col("at"), F.col("path"))).select(*key, "content")
            convert.pdf_to_pages(asked, splitter, key).write.mode("append").parquet(own("pages"))
        pages = spark.read.parquet(own("pages"))
        broken = pages.filter("error is not null").select(*key, "page", "text", F.lit(0.0).alias("elapsed_s"), F.lit(False).alias("ok"), "error")
        to_folder(f"{path}/results")(convert.convert_pages(pages.filter("error is null"), make, key).unionByName(broken), batch_id)
        results = spark.read.parquet(own("results"))
        made = convert.job_outcome(results, key)
        outcome = wanted.select(*key).join(made, key, "left").withColumn("status", F.coalesce("status", F.lit("failed"))).fillna(0, ["attempts", "pages"])
        _write_documents(results, outcome, path, batch_id, key)
        ended = max(clock(), began + dt.timedelta(microseconds=1))
        started = wanted.select(*key, F.lit("processing").alias("status"), F.lit(began).alias("ts"), "seq")
        finished = wanted.join(spark.read.parquet(own("outcome")), key).select(*key, "status", F.lit(ended).alias("ts"), "seq")
        to_folder(f"{path}/status")(started.unionByName(finished), batch_id)

    run_available(raw, write, checkpoint)


def stream_grant_join(uses: DataFrame, grants: DataFrame, longest: str = "24 hours", late: str = "1 hour", how: str = "inner") -> DataFrame:
    """Uses under a grant of their subject and scope that is not expired, as a stream-stream interval join.

    With how = "left_outer" a use without one comes too, with nulls, when the watermark says that none can follow; the
    reason is what stream_grant_outcomes tells. longest bounds how long a grant is remembered: one that runs longer counts until then. Null scopes equal each other.
    """
    u = uses.select("event_id", F.col("subject").alias("use_subject"), F.col("scope").alias("use_scope"), F.col("ts").alias("used_at")).withWatermark("used_at", late)
    g = grants.select("subject", "scope", "issued_at", "expires_at").withWatermark("issued_at", late)
    near = f"use_subject = subject and use_scope <=> scope and issued_at <= used_at and used_at < expires_at and used_at <= issued_at + interval {longest}"
    return u.join(g, F.expr(near), how).select("event_id", F.col("use_subject").alias("subject"), F.col("use_scope").alias("scope"), "issued_at")


def stream_grant_outcomes(uses: DataFrame, grants: DataFrame, late: str = "1 hour") -> DataFrame:
    """event_id, outcome of each use as grant_validity_join gives, once the watermark has passed it: valid, expired, wrong_scope or none.

    Uses and grants are one time line by subject, so nothing is paired; the state of a subject is one time for each scope.
    """
    use_state(uses)
    nothing = F.lit(None)
    used = uses.select("subject", "ts", F.lit(1).alias("turn"), F.col("event_id").alias("seq"), "scope", nothing.cast("long").alias("until"))
    given = grants.select("subject", F.col("issued_at").alias("ts"), F.lit(0).alias("turn"), nothing.cast("long").alias("seq"), "scope", F.unix_micros("expires_at").alias("until"))
    line = used.unionByName(given).withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    filled = line.withColumn("seq", F.coalesce("seq", F.lit(0)))
    return _bucketed(filled, ["subject"]).transformWithState(state.Grants(), "event_id long, outcome string", "Append", "EventTime")


def stream_rate_limit(requests: DataFrame, rules: DataFrame, keep_s: int = 2 * 86_400) -> DataFrame:
    """event_id, code: 200 or 429 for each request in the batch that brings it; rules (a plain table): endpoint, max_requests, window_s.

    Equal to rate_limit where requests come in order of batches; within a batch they go by ts and event_id. A window's
    count is kept for keep_s of processing time after its last request. Endpoints without a rule pass.
    """
    use_state(requests)
    one = rules.groupBy("endpoint").agg(F.min(F.struct("max_requests", "window_s")).alias("rule")).select("endpoint", "rule.*")
    timed = requests.join(F.broadcast(one), "endpoint", "left").withColumn("at", F.unix_micros("ts"))  # a row an endpoint
    keyed = _bucketed(timed.select("endpoint", "key", "at", "event_id", "max_requests", "window_s"), ["endpoint", "key"])
    return keyed.transformWithState(state.RateLimit(keep_s), "event_id long, code int", "Append", "ProcessingTime")


def stream_transitions(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """user_id, filename, seq, status where processing ended, as status_transitions gives, once the watermark has passed it."""
    use_state(log)
    keyed = _bucketed(_waiting(log, "seq", late, F.col("status").alias("what")), status.KEY)
    return keyed.transformWithState(state.Transitions(), "user_id string, filename string, seq long, status string", "Append", "EventTime")


def stream_timeouts(log: DataFrame, limit_s: int = status.TIME_LIMIT_S, late: str = "1 minute") -> DataFrame:
    """user_id, filename, seq of processing that nothing ended within limit_s of event time."""
    use_state(log)
    keyed = _bucketed(_waiting(log, "seq", late, F.col("status").alias("what")), status.KEY)
    return keyed.transformWithState(state.Timeouts(limit_s), "user_id string, filename string, seq long", "Append", "EventTime")


def dedup_uploads(uploads: DataFrame, late: str = "1 hour") -> DataFrame:
    """Uploads without exact repeats of an event within the watermark; the latest one of a name then replaces the others."""
    return uploads.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "filename", "seq"])


def start(out: DataFrame, path: str, checkpoint: str, every: str = "3 seconds") -> StreamingQuery:
    """A continuing query that writes Parquet, for production use."""
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
