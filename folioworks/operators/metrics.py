"""Counters, histograms, gauges and averages over requests and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bucket bounds in seconds.
REQUEST_BUCKETS = (2.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0, 600.0)
PAGE_BUCKETS = (0.5, 1.0, 2.0, 3.0, 5.0, 10.0, 20.0, 40.0)


def request_counter(requests: DataFrame) -> DataFrame:
    return requests.groupBy("outcome").agg(F.count("*").alias("n"))


def duration_histogram(rows: DataFrame, value: str, buckets: Sequence[float] = PAGE_BUCKETS, by: Sequence[str] = ()) -> DataFrame:
    """Cumulative buckets, +Inf included, with the total count and sum: one pass, then one row a bound."""
    bounds = [*buckets, float("inf")]
    counts = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    once = rows.groupBy(*by).agg(*counts, F.count("*").alias("total_count"), F.round(F.sum(value), 2).alias("total_sum"))
    pairs = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("bucket_count")) for i, b in enumerate(bounds)])
    return once.select(*by, F.explode(pairs).alias("x"), "total_count", "total_sum").select(*by, "x.le", "x.bucket_count", "total_count", "total_sum")


def latest_gauge(samples: DataFrame, gauge: str, value: str) -> DataFrame:
    """Last value of each gauge, by ts and event_id."""
    return samples.groupBy(F.col(gauge).alias("gauge")).agg(F.max_by(value, F.struct("ts", "event_id")).alias("value"))


def ocr_stats(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """One row. Page seconds are over all pages; request seconds over successful requests; null where nothing was counted."""
    ok = F.col("outcome") == "success"
    of_requests = requests.agg(
        F.count("*").alias("requests_total"),
        F.count_if(ok).alias("requests_success"),
        F.count_if(~ok).alias("requests_error"),
        F.round(F.try_divide(F.sum(F.when(ok, F.col("elapsed_s"))), F.count_if(ok)), 2).alias("avg_request_seconds"),
    )
    of_pages = pages.agg(F.count("*").alias("pages_total"), F.round(F.try_divide(F.sum("elapsed_s"), F.count("*")), 2).alias("avg_page_seconds"))
    return of_requests.crossJoin(of_pages)  # one row each


def http_metrics(requests: DataFrame, buckets: Sequence[float] = REQUEST_BUCKETS) -> DataFrame:
    return duration_histogram(requests, "elapsed_s", buckets, ("endpoint", "outcome"))
