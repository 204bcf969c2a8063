"""Access: validity of grants, and rate limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioworks.operators import slices


def grant_validity_join(uses: DataFrame, grants: DataFrame, slice_s: int = slices.DAY_S) -> DataFrame:
    """event_id, outcome: valid, expired, wrong_scope or none.

    A use is valid under a grant of its subject and scope that was issued by then and has not expired. Uses and grants
    are laid out on one time line by subject and scope, so each use looks back at running maxima of expiry and nothing is
    paired. The line is cut into slices of slice_s seconds, so a subject with very many rows spreads over tasks.
    """
    line = uses.select("subject", "scope", "ts", "event_id", F.lit(1).alias("is_use"), F.lit(None).cast("timestamp_ntz").alias("until"))
    given = grants.select("subject", "scope", F.col("issued_at").alias("ts"), F.lit(None).cast("long").alias("event_id"), F.lit(0).alias("is_use"), F.col("expires_at").alias("until"))
    every, marks = slices.sliced(line.unionByName(given), ("subject", "scope"), "ts", slice_s)
    own = slices.within(marks, "ts", "is_use").rowsBetween(Window.unboundedPreceding, 0)
    here = every.withColumn("until_here", F.max("until").over(own)).filter("is_use = 1").select("event_id", "ts", "until_here", *marks, slices.SLICE)
    sums = every.groupBy(*marks, slices.SLICE).agg(F.max("until").alias("until"), F.min(F.when(F.col("is_use") == 0, F.col("ts"))).alias("issued"))
    of_subject = Window.partitionBy(marks[0])
    before = sums.withColumns({"until_before": F.max("until").over(slices.earlier(marks)), "first_issue": F.min("issued").over(of_subject)}).drop("until", "issued")
    until = F.greatest("until_here", "until_before")
    outcome = F.when(F.col("ts") < until, "valid").when(until.isNotNull(), "expired").when(F.col("first_issue") <= F.col("ts"), "wrong_scope").otherwise("none")
    return here.join(before, [*marks, slices.SLICE]).select("event_id", outcome.alias("outcome"))


def rate_limit(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds code: per endpoint, key and window the first max_requests pass, the rest get 429. rules: endpoint, max_requests, window_s.

    Windows are aligned to the epoch. Endpoints without a rule are not limited; of several rules of an endpoint the one with
    the smallest max_requests holds.
    """
    one = rules.groupBy("endpoint").agg(F.min(F.struct("max_requests", "window_s")).alias("rule")).select("endpoint", "rule.*")
    ruled = requests.join(one, "endpoint", "left")
    slot = F.floor(F.col("ts").cast("timestamp").cast("double") / F.col("window_s"))
    order = Window.partitionBy("endpoint", "key", slot).orderBy("ts", "event_id")
    return ruled.withColumn("code", F.when(F.row_number().over(order) > F.col("max_requests"), 429).otherwise(200)).drop("max_requests", "window_s")
