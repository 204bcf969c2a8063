"""Conversion of pages by a pluggable page function, and what becomes of each document."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from folioworks.operators.layout import build_layout

PageFunction = Callable[[str], str]
Splitter = Callable[[bytes], list[str]]
PAGE_SPLIT = "\f"
# Pages a file may have by plan; null is no limit.
PLAN_PAGES = {"free": 5, "pro": None}
MONTH_PAGES = 50


def clean_page(text: str) -> str:
    """The shipped page function: every line without the white space at its ends."""
    return "\n".join(line.strip() for line in text.split("\n"))


def form_feeds(content: bytes) -> list[str]:
    """The shipped splitter: UTF-8 text with form feeds between pages; other bytes are an error of their file."""
    return content.decode().split(PAGE_SPLIT)


def convert_pages(pages: DataFrame, make: Callable[[], PageFunction] = lambda: clean_page, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keys, page, text, elapsed_s, ok, error. make gives the page function once a task; its errors are rows, not failures.

    Pages are dealt by document and page, so a long document spreads over the cluster. A null text is an empty page. Keys
    stay Arrow columns, so a null one leaves the others exact.
    """
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convert = make()
        for batch in batches:
            texts, seconds, errors = [], [], []
            for text in batch.column(n + 1).to_pylist():
                began = time.perf_counter()
                try:
                    out, error = convert(text or ""), None
                except Exception as problem:  # a page that fails fails its document, not the job
                    out, error = None, f"{type(problem).__name__}: {problem}"
                texts.append(out)
                seconds.append(time.perf_counter() - began)
                errors.append(error)
            made = [pa.array(texts, pa.string()), pa.array(seconds, pa.float64()), pa.array([e is None for e in errors], pa.bool_()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: n + 1], *made], names=[*keys, "page", "text", "elapsed_s", "ok", "error"])

    dealt = pages.select(*keys, F.col("page").cast("int").alias("page"), "text").repartition(*keys, "page")
    made = [("text", StringType()), ("elapsed_s", DoubleType()), ("ok", BooleanType()), ("error", StringType())]
    schema = StructType([*dealt.schema.fields[: n + 1], *(StructField(name, kind) for name, kind in made)])
    return dealt.mapInArrow(run, schema)


def split_pages(files: DataFrame, mark: str = PAGE_SPLIT) -> DataFrame:
    """files: doc_id, text (null counts as empty). One row per page, for files that are text already: no Python is needed."""
    parts = F.posexplode(F.split(F.coalesce("text", F.lit("")), F.lit(mark), -1)).alias("at", "text")
    return files.select("doc_id", parts).select("doc_id", (F.col("at") + 1).cast("int").alias("page"), "text")


def pdf_to_pages(files: DataFrame, make: Callable[[], Splitter] = lambda: form_feeds, keys: Sequence[str] = ("user_id", "filename")) -> DataFrame:
    """files: keys, content (bytes). One row per page: keys, page (from 1), text, error.

    make gives the splitter once a task. A file that it can't split is one row with a null page and its error; a null
    content is an error too, and a file without pages gives no rows.
    """
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = make()
        for batch in batches:
            for i in range(batch.num_rows):  # a file at a time: contents can be large
                try:
                    pages, error = split(batch.column(n)[i].as_py()), None
                except Exception as problem:
                    pages, error = [None], f"{type(problem).__name__}: {problem}"
                at = pa.array([i] * len(pages), pa.int64())
                numbers = pa.array([None if error else p + 1 for p in range(len(pages))], pa.int32())
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:n]), numbers, pa.array(pages, pa.string()), pa.array([error] * len(pages), pa.string())], names=[*keys, "page", "text", "error"])

    given = files.select(*keys, F.col("content").cast("binary").alias("content"))
    schema = StructType([*given.schema.fields[:n], StructField("page", IntegerType()), StructField("text", StringType()), StructField("error", StringType())])
    return given.mapInArrow(run, schema)


def job_summary(results: DataFrame) -> DataFrame:
    """doc_id, attempts, pages, characters, seconds. results has text, or characters where its length is known.

    Rows are dealt by document first: hardly any repeat a page, so sums before the shuffle would only fill a task's memory with
    a whole split of the table, which holds the more rows the larger the table is.
    """
    length = F.coalesce("characters", F.lit(0)) if "characters" in results.columns else F.length(F.coalesce("text", F.lit("")))
    needed = results.select("doc_id", "page", "elapsed_s", length.alias("characters"))
    tasks = int(results.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, so that they are not merged again by their small bytes
    return needed.repartition(tasks, F.col("doc_id")).groupBy("doc_id").agg(
        F.count("*").alias("attempts"),
        F.count_distinct("page").alias("pages"),
        F.sum("characters").alias("characters"),
        F.round(F.sum("elapsed_s"), 2).alias("seconds"),
    )


def job_outcome(attempts: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """A document is done only if every attempt was, else failed, from its first page that failed."""
    bad = ~F.col("ok")
    return attempts.groupBy(*keys).agg(
        F.count("*").alias("attempts"),
        F.count_distinct("page").alias("pages"),
        F.when(F.bool_and("ok"), "done").otherwise("failed").alias("status"),
        F.min(F.when(bad, F.col("page"))).alias("first_failed_page"),
    )


def run_conversion(pages: DataFrame, make: Callable[[], PageFunction] = lambda: clean_page) -> tuple[DataFrame, DataFrame]:
    """Paragraphs of the documents that are done, and the outcome of all."""
    results = convert_pages(pages, make)
    outcome = job_outcome(results)
    done = results.join(outcome.filter("status = 'done'").select("doc_id"), "doc_id", "left_semi")
    return build_layout(done.select("doc_id", "page", "text")), outcome


def page_quota(conversions: DataFrame, quota: int = MONTH_PAGES) -> DataFrame:
    """conversions: user_id, ts, seq, pages. Adds used (pages of the user's month so far) and over."""
    order = Window.partitionBy("user_id", F.date_trunc("month", "ts")).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return conversions.withColumn("used", F.sum("pages").over(order)).withColumn("over", F.col("used") > quota)


def page_caps(conversions: DataFrame, caps: dict[str, int | None] = PLAN_PAGES) -> DataFrame:
    """conversions: plan, pages, ... Adds over_cap: more pages than a file may have in its plan; an unknown plan has the smallest cap."""
    least = min(n for n in caps.values() if n is not None)
    cap = F.lit(least)
    for plan, n in caps.items():
        cap = F.when(F.col("plan") == plan, F.lit(n).cast("int")).otherwise(cap)
    return conversions.withColumn("over_cap", F.coalesce(F.col("pages") > cap, F.lit(False)))
