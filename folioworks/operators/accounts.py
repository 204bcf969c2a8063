"""Accounts: lookup, sign-up, sign-in, changes, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioworks.functions.text import normal_email

# Rules of a strong text and the names of its bands.
TEXT_RULES = (r"(?s).{8,}", r"[A-Z]", r"[0-9]", r"[^A-Za-z0-9]")
BANDS = ((25, "Weak"), (50, "Fair"), (75, "Good"), (100, "Strong"))


def find_users(users: DataFrame, keys: DataFrame, by: str = "email") -> DataFrame:
    """Users with one of the given keys, the smallest id where a key is not unique."""
    found = users.join(keys.select(by).distinct(), by, "left_semi")
    order = Window.partitionBy(by).orderBy("id")
    return found.withColumn("__nth", F.row_number().over(order)).filter("__nth = 1").drop("__nth")


def public_user(users: DataFrame) -> DataFrame:
    return users.select("id", "email", "name", F.coalesce("email_verified", F.lit(False)).alias("email_verified"))


def login_eligible(attempts: DataFrame, users: DataFrame) -> DataFrame:
    """Adds reason: no_user, no_password, or check where a password is there to be checked."""
    known = users.groupBy("email").agg(F.lit(True).alias("known"), F.bool_or(F.col("hashed_password").isNotNull()).alias("has_password"))
    reason = F.when(F.col("known").isNull(), "no_user").when(~F.col("has_password"), "no_password").otherwise("check")
    return attempts.join(known, "email", "left").withColumn("reason", reason).drop("known", "has_password")


def _first_requests(requests: DataFrame) -> DataFrame:
    order = Window.partitionBy("email").orderBy("ts", "seq")
    return requests.withColumn("nth", F.row_number().over(order))


def _with_ids(new: DataFrame, users: DataFrame) -> DataFrame:
    """Ids after the largest one, by e-mail: ranges are counted first, so no single task numbers all rows."""
    top = users.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    bucket = F.substring(F.md5("email"), 1, 3)
    numbered = new.withColumn("bucket", bucket)
    sizes = numbered.groupBy("bucket").agg(F.count("*").alias("n"))
    before = sizes.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    nth = F.row_number().over(Window.partitionBy("bucket").orderBy("email"))
    placed = numbered.join(F.broadcast(before), "bucket").withColumn("nth", nth)  # 4096 buckets at most
    return placed.crossJoin(F.broadcast(top)).withColumn("id", F.col("top") + F.col("base") + F.col("nth")).drop("bucket", "base", "nth", "top")


def find_or_create_users(users: DataFrame, sign_ins: DataFrame) -> DataFrame:
    """users with a verified row, without password, for each unknown e-mail; existing rows stay as they are."""
    first = _first_requests(sign_ins).filter("nth = 1").join(users.select("email"), "email", "left_anti")
    new = _with_ids(first.select("email", "name"), users)
    fresh = new.select("id", "email", F.lit(None).cast("string").alias("hashed_password"), "name", F.lit(True).alias("email_verified"))
    return users.select("id", "email", "hashed_password", "name", "email_verified").unionByName(fresh)


def register_users(users: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: seq, ts, email, ... Adds code: 400 if the e-mail exists or an earlier request of the batch has it, else 201."""
    known = users.select("email").distinct().withColumn("known", F.lit(True))
    taken = F.col("known").isNotNull() | (F.col("nth") > 1)
    return _first_requests(requests).join(known, "email", "left").withColumn("code", F.when(taken, 400).otherwise(201)).drop("known", "nth")


def update_profile(users: DataFrame, changes: DataFrame) -> DataFrame:
    """Latest name that is not null by e-mail; e-mail and id stay."""
    latest = changes.filter("name is not null").groupBy("email").agg(F.max_by("name", F.struct("ts", "seq")).alias("new_name"))
    return users.join(latest, "email", "left").withColumn("name", F.coalesce("new_name", "name")).drop("new_name")


def verify_emails(users: DataFrame, checked: DataFrame) -> DataFrame:
    """checked: event_id, email, outcome of its grant. Result: expired, none, not_found, already or verified."""
    known = users.groupBy("email").agg(F.bool_or(F.coalesce("email_verified", F.lit(False))).alias("was"))
    result = F.when(F.col("outcome") != "valid", F.col("outcome")).when(F.col("was").isNull(), "not_found").when(F.col("was"), "already").otherwise("verified")
    return checked.join(known, "email", "left").withColumn("result", result).drop("was")


def apply_user_changes(changes: DataFrame) -> DataFrame:
    """Current accounts from one change log, by e-mail: the latest name and password, verified once by link or sign-in."""
    order = F.struct("ts", "seq")
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c)
    return changes.groupBy("email").agg(
        F.min("seq").alias("first_seq"),
        last("name"),
        last("hashed_password"),
        F.bool_or(F.col("op").isin("verify", "oauth")).alias("email_verified"),
    )


ACCOUNT_BUCKETS = 64


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("email"), F.lit(buckets)).cast("int")


def write_accounts(changes: DataFrame, path: str, buckets: int = ACCOUNT_BUCKETS) -> None:
    """The accounts of a whole change log as a table of buckets by e-mail, with the time of each value, so that later changes can be laid on it."""
    _by_bucket(_account_state(changes), path, buckets)


def merge_accounts(spark: SparkSession, changes: DataFrame, path: str, buckets: int = ACCOUNT_BUCKETS) -> None:
    """Lay new changes on the table at path: only buckets with a changed e-mail are read and written anew.

    What comes out is what write_accounts makes of all changes, in whatever order and batches they come; changes that
    were merged before do no harm. The buckets of the batch (buckets at most) go through the driver. The merged rows are written
    beside the table first, as a bucket can't be read while it is overwritten.
    """
    new = _account_state(changes).withColumn("bucket", _bucket(buckets))
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
    if not touched:
        return
    stored = spark.read.parquet(path)
    old = stored.filter(F.col("bucket").isin(touched)).select(*new.columns)
    merged = old.unionByName(new).groupBy("email").agg(
        F.min("first_seq").alias("first_seq"),
        *[F.max(c).alias(c) for c in ("name_at", "password_at")],
        F.bool_or("email_verified").alias("email_verified"),
    )
    aside = f"{path.rstrip('/')}.merge"
    merged.write.mode("overwrite").parquet(aside)
    _by_bucket(spark.read.schema(merged.schema).parquet(aside), path, buckets)


def read_accounts(spark: SparkSession, path: str) -> DataFrame:
    """The table in the shape of apply_user_changes."""
    return spark.read.parquet(path).select("email", "first_seq", F.col("name_at.value").alias("name"), F.col("password_at.value").alias("hashed_password"), "email_verified")


def _account_state(changes: DataFrame) -> DataFrame:
    def last(column: str) -> Column:
        return F.max(F.when(F.col(column).isNotNull(), F.struct("ts", "seq", F.col(column).alias("value"))))

    return changes.groupBy("email").agg(
        F.min("seq").alias("first_seq"), last("name").alias("name_at"), last("hashed_password").alias("password_at"), F.bool_or(F.col("op").isin("verify", "oauth")).alias("email_verified")
    )


def _by_bucket(accounts: DataFrame, path: str, buckets: int) -> None:
    """Overwrites the buckets that accounts have, and no others."""
    dealt = accounts.withColumn("bucket", _bucket(buckets)).repartition("bucket")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def conform_schema(rows: DataFrame, target: StructType) -> DataFrame:
    """Columns of target in order and type: others are dropped, missing ones are null."""
    have = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.fields])


def identity_audit(users: DataFrame) -> DataFrame:
    """E-mails that several rows share if case and outer spaces do not count."""
    groups = users.groupBy(normal_email(F.col("email")).alias("normal_email")).agg(F.count("*").alias("n_rows"), F.count_distinct("email").alias("n_spellings"))
    return groups.filter("n_rows > 1")


def rule_score(rows: DataFrame, text: str, rules: Sequence[str] = TEXT_RULES) -> DataFrame:
    """Rows by band of the share of rules that the text keeps; a null text keeps none."""
    passed = sum((F.coalesce(F.col(text).rlike(r).cast("int"), F.lit(0)) for r in rules), F.lit(0))
    share = passed * 100 / len(rules)
    band: Column | None = None
    for most, name in BANDS:
        band = F.when(share <= most, name) if band is None else band.when(share <= most, name)
    return rows.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.count_if(passed == len(rules)).alias("n_all_rules"))
