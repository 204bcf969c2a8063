"""Status of files: admission of conversions, latest status, transitions, running time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks.operators import slices

OPEN = ("processing", "pending")
KEY = ("user_id", "filename")
TIME_LIMIT_S = 600


def admit(events: DataFrame, slice_s: int = slices.DAY_S) -> DataFrame:
    """events: event_id, ts, user_id, filename, kind. Adds present, status (both before the event), code and sets.

    A conversion of a missing file is 404, of one in process 409, else 200 and sets processing; uploads and deletes set
    pending, done and failed set themselves, also where the file is gone. Two running windows share one sort. They run in
    slices of slice_s seconds, for both answers to whether the file was there when the slice began; a row for each slice
    then says which one holds.
    """
    rows, marks = slices.sliced(events, KEY, "ts", slice_s)
    before = slices.within(marks, "ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    kind = F.col("kind")
    life = F.when(kind.isin("upload", "delete"), kind)

    def would(present: Column) -> Column:
        return F.when(kind.isin("upload", "delete"), "pending").when((kind == "convert") & present, "processing").when(kind.isin("done", "failed"), kind)

    here = rows.withColumn("__life", F.last(life, ignorenulls=True).over(before))
    there = F.col("__life") == "upload"
    here = here.withColumns({"__with": would(F.coalesce(there, F.lit(True))), "__without": would(F.coalesce(there, F.lit(False)))})
    here = here.withColumns({f"__last{c}": F.last(c, ignorenulls=True).over(before) for c in ("__with", "__without")})

    order = ("ts", "event_id")
    sums = here.groupBy(*marks, slices.SLICE).agg(slices.last_of(life, *order).alias("__ends"), *[slices.last_of(F.col(c), *order).alias(f"__end{c}") for c in ("__with", "__without")])
    came = sums.withColumn("__came", F.coalesce(F.last("__ends", ignorenulls=True).over(slices.earlier(marks)) == "upload", F.lit(False)))
    ended = came.withColumn("__ended", F.when(F.col("__came"), F.col("__end__with")).otherwise(F.col("__end__without")))
    entry = ended.select(*marks, slices.SLICE, "__came", F.last("__ended", ignorenulls=True).over(slices.earlier(marks)).alias("__held"))

    both = here.join(entry, [*marks, slices.SLICE]).withColumn("present", F.coalesce(there, F.col("__came")))
    both = both.withColumn("status", F.coalesce(F.when(F.col("__came"), F.col("__last__with")).otherwise(F.col("__last__without")), F.col("__held"), F.lit("pending")))
    code = F.when(kind != "convert", F.lit(None)).when(~F.col("present"), 404).when(F.col("status") == "processing", 409).otherwise(200)
    coded = both.withColumn("code", code)
    sets = F.when((kind == "convert") & (F.col("code") != 200), F.lit(None)).otherwise(would(F.col("present")))
    return coded.select(*events.columns, "present", "status", "code", sets.alias("sets"))


def conversion_admission(events: DataFrame) -> DataFrame:
    return admit(events).filter("kind = 'convert'").select("event_id", "code")


def latest_status(log: DataFrame) -> DataFrame:
    """Last writer wins, by ts and seq; one row a file."""
    order = F.struct("ts", "seq")
    return log.groupBy(*KEY).agg(F.max_by("status", order).alias("status"), F.max("ts").alias("ts"))


def status_transitions(log: DataFrame) -> DataFrame:
    """Rows where a file went from processing to done or failed."""
    order = Window.partitionBy(*KEY).orderBy("ts", "seq")
    moved = log.withColumn("previous", F.lag("status").over(order))
    return moved.filter("previous = 'processing' and status in ('done', 'failed')").select(*KEY, "seq", "ts", "status")


def processing_elapsed(log: DataFrame, as_of: Column) -> DataFrame:
    """Whole seconds that each file has been in process at as_of; files in another state are left out."""
    order = F.struct("ts", "seq")
    latest = log.filter(F.col("ts") <= as_of).groupBy(*KEY).agg(F.max_by("status", order).alias("status"), F.max_by("ts", order).alias("started"))
    seconds = F.floor((as_of.cast("timestamp").cast("double") - F.col("started").cast("timestamp").cast("double"))).cast("long")
    return latest.filter("status = 'processing'").select(*KEY, seconds.alias("elapsed_s"))


def stale_jobs(log: DataFrame, as_of: Column, limit_s: int = TIME_LIMIT_S) -> DataFrame:
    """Starts of processing that no other status followed within limit_s, up to as_of; ran_s is in whole seconds, the limit is exact."""
    order = Window.partitionBy(*KEY).orderBy("ts", "seq")
    ended = F.least(F.coalesce(F.lead("ts").over(order), as_of), as_of)
    ran = F.unix_micros(ended.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    late = log.withColumn("ran", ran).filter(f"status = 'processing' and ran > {limit_s * 1_000_000}")
    return late.select(*KEY, "seq", F.floor(F.col("ran") / 1_000_000).cast("long").alias("ran_s"))


def write_status(changes: DataFrame, path: str) -> None:
    """Append to the log; nothing is overwritten."""
    changes.select(*KEY, "status", "ts", "seq").write.mode("append").parquet(path)


def save_options(options: DataFrame, files: DataFrame) -> DataFrame:
    """Latest options of each file with code 200, or 404 where the file does not exist."""
    order = F.struct("ts", "seq")
    latest = options.groupBy(*KEY).agg(F.max_by("options_json", order).alias("options_json"))
    known = files.select(*KEY).distinct()
    saved = latest.join(known, list(KEY), "left_semi").withColumn("code", F.lit(200))
    return saved.unionByName(latest.join(known, list(KEY), "left_anti").withColumn("code", F.lit(404)))
