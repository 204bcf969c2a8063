"""The file catalog: listing, search, scoping, matching of results, deletion, snapshots, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks.functions.text import output_stem
from folioworks.operators.status import KEY, OPEN

# Endings of files that stand beside a document, and limits of uploads.
SIDECARS = (".settings.json", ".status", ".docx")
PDF_TYPES = ("application/pdf",)
WORKER_TYPES = ("application/pdf", "application/octet-stream")
MOST_BYTES = 50 * 1024 * 1024
# Order of states in listings; any other state is 9.
STATUS_RANK = {"processing": 0, "pending": 1, "failed": 2, "done": 3}


def is_sidecar(filename: Column) -> Column:
    out = F.lit(False)
    for ending in SIDECARS:
        out = out | filename.endswith(ending)
    return out


def exclude_sidecars(files: DataFrame) -> DataFrame:
    return files.filter(~is_sidecar(F.col("filename")))


def search_filename(files: DataFrame, query: str) -> DataFrame:
    """Case-insensitive substring; an empty query matches all, and % and _ stand for themselves."""
    return files.filter(F.contains(F.lower("filename"), F.lower(F.lit(query))))


def scope_to_user(files: DataFrame, user_id: str) -> DataFrame:
    return files.filter(F.col("user_id") == user_id)


def upload_admission(uploads: DataFrame, types: Sequence[str] = PDF_TYPES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Adds reason: the first rule that fails (onlyPdf, tooLarge), or null. A null type is no PDF."""
    wrong = ~F.coalesce(F.col("content_type").isin(*types), F.lit(False))
    return uploads.withColumn("reason", F.when(wrong, "onlyPdf").when(F.col("size") > most_bytes, "tooLarge"))


def current_files(uploads: DataFrame) -> DataFrame:
    """Latest accepted version of each file: a new upload of a name replaces the old."""
    order = F.struct("ts", "seq")
    return uploads.groupBy(*KEY).agg(F.max_by("size", order).alias("size"), F.max("ts").alias("last_modified"), F.count("*").alias("versions"))


def live_files(uploads: DataFrame, deletes: DataFrame) -> DataFrame:
    """Files that are there after all uploads and deletes: the latest version of those uploaded after their last deletion."""
    last = deletes.groupBy(*KEY).agg(F.max(F.struct("ts", "seq")).alias("gone_at"))
    left = uploads.join(last, list(KEY), "left").filter(F.col("gone_at").isNull() | (F.struct("ts", "seq") > F.col("gone_at")))
    return current_files(left.drop("gone_at"))


def ingest_uploads(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Current files, and the pending rows that the uploads add to the status log."""
    accepted = upload_admission(uploads).filter("reason is null")
    return current_files(accepted), accepted.select(*KEY, F.lit("pending").alias("status"), "ts", "seq")


def list_documents(files: DataFrame, latest: DataFrame) -> DataFrame:
    """Files with their status, pending where the log has none. One join in place of a read for each file."""
    joined = exclude_sidecars(files).join(latest.select(*KEY, "status"), list(KEY), "left")
    return joined.withColumn("status", F.coalesce("status", F.lit("pending")))


def document_status(keys: DataFrame, latest: DataFrame) -> DataFrame:
    """Status of the given files, also of those that do not exist (pending)."""
    return keys.join(latest.select(*KEY, "status"), list(KEY), "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def files_exist(keys: DataFrame, files: DataFrame) -> DataFrame:
    known = files.select(*KEY).distinct().withColumn("present", F.lit(True))
    return keys.join(known, list(KEY), "left").withColumn("present", F.coalesce("present", F.lit(False)))


def convertible(files: DataFrame, selection: DataFrame) -> DataFrame:
    """Selected files that may be converted: pending or failed ones."""
    return files.join(selection.select(*KEY).distinct(), list(KEY), "left_semi").filter(F.col("status").isin("pending", "failed"))


def match_outputs(files: DataFrame, outputs: DataFrame) -> DataFrame:
    """Each file with its result, paired by stem; null where there is none. Of several results of a stem the smallest name counts, so files never multiply."""
    results = outputs.groupBy("user_id", output_stem(F.col("filename")).alias("stem")).agg(F.min("filename").alias("output"))
    return files.withColumn("stem", output_stem(F.col("filename"))).join(results, ["user_id", "stem"], "left")


def orphan_outputs(files: DataFrame, outputs: DataFrame, latest: DataFrame) -> DataFrame:
    """user_id, filename, reason: results without input, and done inputs without result."""
    inputs = files.select("user_id", output_stem(F.col("filename")).alias("stem")).distinct()
    results = outputs.withColumn("stem", output_stem(F.col("filename")))
    lost = results.join(inputs, ["user_id", "stem"], "left_anti").select(*KEY, F.lit("no_input").alias("reason"))
    done = files.join(latest.filter("status = 'done'").select(*KEY), list(KEY), "left_semi").withColumn("stem", output_stem(F.col("filename")))
    bare = done.join(results.select("user_id", "stem").distinct(), ["user_id", "stem"], "left_anti").select(*KEY, F.lit("no_output").alias("reason"))
    return lost.unionByName(bare)


def delete_documents(files: DataFrame, deletes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What stays of files (results and sidecars included), code 200 or 404 for each deleted name, and the rows of deletes
    that found their file with status pending: the state that a file without a status row is in, for the log.
    """
    wanted = deletes.select(*KEY).distinct()
    name = F.col("filename")
    derived = F.array(name, F.concat(output_stem(name), F.lit(".docx")), F.concat(name, F.lit(".status")), F.concat(name, F.lit(".settings.json")))
    found = wanted.join(files.select(*KEY).distinct(), list(KEY), "left_semi")
    gone = found.select("user_id", F.explode(derived).alias("filename")).distinct()
    code = files_exist(wanted, files).select(*KEY, F.when(F.col("present"), 200).otherwise(404).alias("code"))
    reset = deletes.join(found, list(KEY), "left_semi").withColumn("status", F.lit("pending"))
    return files.join(gone, list(KEY), "left_anti"), code, reset


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes between two listings: added, removed, completed, failed, or changed to another status."""
    before = old.select(*KEY, F.col("status").alias("was"))
    joined = before.join(new.select(*KEY, F.col("status").alias("now")), list(KEY), "full_outer")
    ended = F.col("was") == "processing"
    change = (
        F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed")
        .when(ended & (F.col("now") == "done"), "completed").when(ended & (F.col("now") == "failed"), "failed")
        .when(F.col("was") != F.col("now"), "changed")
    )
    return joined.withColumn("change", change).filter("change is not null")


def _counts() -> list[Column]:
    status = F.col("status")
    return [
        F.count("*").alias("total"),
        F.count_if(status.isin(*OPEN)).alias("converting"),
        F.count_if(status == "done").alias("converted"),
        F.count_if(status == "failed").alias("failed"),
    ]


def dashboard_stats(files: DataFrame) -> DataFrame:
    """Counts by user in one pass; an unknown status counts in total only."""
    return files.groupBy("user_id").agg(*_counts())


def file_count(files: DataFrame) -> DataFrame:
    """Documents of each user, and of all in a row with a null user."""
    return files.rollup("user_id").agg(F.count("*").alias("n_files"), F.grouping("user_id").cast("int").alias("is_total"))


def any_processing(files: DataFrame) -> DataFrame:
    return files.groupBy("user_id").agg(F.bool_or(F.col("status") == "processing").alias("busy"))


def recent_documents(files: DataFrame, most: int = 5) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy(F.desc("last_modified"), "filename")
    return files.withColumn("pos", F.row_number().over(order).cast("long")).filter(f"pos <= {most}")


def status_rank(status: Column) -> Column:
    ranked = F.create_map(*[F.lit(x) for pair in STATUS_RANK.items() for x in pair])
    return F.coalesce(F.try_element_at(ranked, status), F.lit(9))


def sort_documents(files: DataFrame, by: str = "date", descending: bool = True) -> DataFrame:
    """Adds pos: the place of each file in its user's listing, ordered by name, status or date; the name breaks ties."""
    key = {"name": F.lower("filename"), "status": status_rank(F.col("status")), "date": F.col("last_modified")}[by]
    order = Window.partitionBy("user_id").orderBy(key.desc() if descending else key.asc(), "filename")
    return files.withColumn("pos", F.row_number().over(order).cast("long"))
