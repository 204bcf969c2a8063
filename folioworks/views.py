"""Views of the driver tables in the shapes that the conversion operators take, with the same views in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.operators.status import admit

# Event types as steps of a file's life.
EVENT_KINDS = {"signup": "upload", "click": "convert", "purchase": "done", "error": "failed", "view": "delete"}
#: Interface texts by language and key.
LABELS = (
    ("en", "dashboard.title", "Dashboard"), ("en", "docs.count", "{{count}} documents by {{user}}"), ("en", "docs.empty", "No documents"),
    ("en", "status.done", "Done"), ("en", "status.failed", "Failed"), ("de", "dashboard.title", "Übersicht"),
    ("de", "docs.count", "{{count}} Dokumente"), ("de", "status.done", "Fertig"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _choose(column: Column, names: dict[str, str]) -> Column:
    out = None
    for key, value in names.items():
        out = F.when(column == key, value) if out is None else out.when(column == key, value)
    return out


def files_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, filename, size, last_modified, status: documents as files, their labels as status."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    status = F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 1, "done").when(F.col("quality") == 0, "processing")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return docs.join(labels, "doc_id", "left").select(
        F.col("source").alias("user_id"),
        F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".pdf")).alias("filename"),
        F.col("n_chars").alias("size"),
        (start + F.make_dt_interval(mins=F.col("doc_id").cast("int"))).alias("last_modified"),
        F.coalesce(status, F.lit("pending")).alias("status"),
    )


def files_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same shape from orders; many files a user, and equal dates."""
    failed = F.when(F.col("o_orderkey") % 10 == 0, "failed")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("user_id"),
        F.concat(F.lit("order_"), F.col("o_orderkey"), F.lit(".pdf")).alias("filename"),
        F.floor("o_totalprice").cast("long").alias("size"),
        F.col("o_orderdate").alias("last_modified"),
        failed.otherwise(_choose(F.col("o_orderstatus"), {"P": "processing", "F": "done", "O": "pending"})).alias("status"),
    )


def page_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, elapsed_s, ok: attempts, so a page may come more than once."""
    ok = F.col("l_returnflag") != "R"
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.col("l_quantity").alias("elapsed_s"), ok.alias("ok"))


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), "text")


def file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, user_id, filename, kind, value, props."""
    k = F.get_json_object("props", "$.k").cast("int") % 10
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.lit("file_"), k, F.lit(".pdf")).alias("filename"),
        _choose(F.col("event_type"), EVENT_KINDS).alias("kind"),
        "value",
        "props",
    )


def status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, filename, status, ts, seq: a row for each event that sets a status; a deleted file is pending, as its status goes with it."""
    admitted = admit(file_events(spark, sf_dir))
    return admitted.filter("sets is not null").select("user_id", "filename", F.col("sets").alias("status"), "ts", F.col("event_id").alias("seq"))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, filename, size, content_type, ts, seq."""
    kind = F.when(F.col("event_id") % 4 == 0, "text/plain").otherwise("application/pdf")
    size = F.floor(F.col("value") * 1024 * 1024).cast("long")
    return file_events(spark, sf_dir).filter("kind = 'upload'").select("user_id", "filename", size.alias("size"), kind.alias("content_type"), "ts", F.col("event_id").alias("seq"))


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, filename: results that were written; those of the quickest conversions are lost."""
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    return file_events(spark, sf_dir).filter("kind = 'done' and value >= 20").select("user_id", F.concat(stem, F.lit(".docx")).alias("filename")).distinct()


def deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_events(spark, sf_dir).filter("kind = 'delete'").select("user_id", "filename", "ts", F.col("event_id").alias("seq"))


def page_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, text, elapsed_s, ok: attempts with the text of their page, null where a page has none."""
    return page_timings(spark, sf_dir).join(doc_pages(spark, sf_dir), ["doc_id", "page"], "left")


def page_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_results with the number of characters in place of the text, so that no text is joined."""
    lengths = doc_pages(spark, sf_dir).select("doc_id", "page", F.length("text").alias("characters"))
    return page_timings(spark, sf_dir).join(lengths, ["doc_id", "page"], "left")


def options_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_events(spark, sf_dir).select("user_id", "filename", F.col("props").alias("options_json"), "ts", F.col("event_id").alias("seq"))


def tasks_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, value (JSON text, sometimes damaged), ts."""
    i = F.col("event_id")
    file_id = F.when(i % 11 != 0, F.col("filename"))
    user_id = F.when(i % 13 == 0, "").otherwise(F.col("user_id"))
    mode = F.when(i % 3 == 0, F.lit(None)).when(i % 5 == 0, "layout").when(i % 7 == 0, "trial").otherwise("ocr")
    text = F.to_json(F.struct(file_id.alias("file_id"), user_id.alias("user_id"), mode.alias("mode")))
    damaged = F.when(i % 17 == 0, F.substring(text, 1, 5)).otherwise(text)
    return file_events(spark, sf_dir).filter("kind = 'convert'").select("event_id", damaged.alias("value"), "ts")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, email, hashed_password, name, email_verified."""
    secret = F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("hash_"), F.col("c_custkey")))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com")).alias("email"),
        secret.alias("hashed_password"),
        F.col("c_name").alias("name"),
        (F.col("c_acctbal") >= 0).alias("email_verified"),
    )


def _scope() -> Column:
    return F.when(F.get_json_object("props", "$.k").cast("int") < 7, "access").otherwise("password_reset")


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, scope, issued_at, expires_at: each signup is valid for a day."""
    day = F.expr("interval 24 hours")
    return table(spark, sf_dir, "events").filter("event_type = 'signup'").select(
        F.col("user_id").cast("string").alias("subject"), _scope().alias("scope"), F.col("ts").alias("issued_at"), (F.col("ts") + day).alias("expires_at")
    )


def uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("event_type = 'click'").select("event_id", F.col("user_id").cast("string").alias("subject"), _scope().alias("scope"), "ts")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, key, endpoint, ts, outcome, elapsed_s."""
    outcome = F.when(F.col("event_type") == "error", "error").otherwise("success")
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("endpoint"), "ts", outcome.alias("outcome"), F.col("value").alias("elapsed_s"))


def user_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, ts, op, email, name, hashed_password: account changes by e-mail, those made by link in upper case."""
    email = F.concat(F.lit("customer."), F.lpad(F.col("user_id").cast("string"), 9, "0"), F.lit("@example.com"))
    op = _choose(F.col("event_type"), {"signup": "register", "view": "rename", "click": "verify", "purchase": "oauth"})
    return table(spark, sf_dir, "events").withColumn("op", op).filter("op is not null").select(
        F.col("event_id").alias("seq"),
        "ts",
        "op",
        F.when(F.get_json_object("props", "$.k") == "7", F.upper(email)).otherwise(email).alias("email"),
        F.when(F.col("op") == "rename", F.concat(F.lit("name_"), F.col("event_id"))).alias("name"),
        F.when(F.col("op") == "register", F.concat(F.lit("hash_"), F.col("event_id"))).alias("hashed_password"),
    )


def labels_i18n(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LABELS), "lang string, key string, value string")


_PAIRS = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in LABELS)
_SCOPE = "CASE WHEN json_extract(props, '$.k')::INT < 7 THEN 'access' ELSE 'password_reset' END"
_KEYED = "PARTITION BY user_id, filename ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
#: DuckDB bodies by view; a view may use those above it.
SQL = {
    "files_docs": """SELECT d.source AS user_id, 'doc_' || d.doc_id || '.pdf' AS filename, d.n_chars AS size,
        TIMESTAMP '2024-01-01' + d.doc_id * INTERVAL 1 MINUTE AS last_modified,
        coalesce(CASE WHEN l.toxic = 1 THEN 'failed' WHEN l.quality = 1 THEN 'done' WHEN l.quality = 0 THEN 'processing' END, 'pending') AS status
        FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "files_orders": """SELECT o_custkey::VARCHAR AS user_id, 'order_' || o_orderkey || '.pdf' AS filename, floor(o_totalprice)::BIGINT AS size,
        o_orderdate AS last_modified, CASE WHEN o_orderkey % 10 = 0 THEN 'failed' WHEN o_orderstatus = 'P' THEN 'processing'
        WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'pending' END AS status FROM orders""",
    "page_timings": "SELECT l_orderkey AS doc_id, l_linenumber AS page, l_quantity AS elapsed_s, l_returnflag <> 'R' AS ok FROM lineitem",
    "doc_pages": "SELECT conv_id AS doc_id, (turn + 1)::INT AS page, text FROM conversations",
    "file_events": """SELECT event_id, ts, user_id::VARCHAR AS user_id, 'file_' || (json_extract(props, '$.k')::INT % 10) || '.pdf' AS filename,
        CASE event_type WHEN 'signup' THEN 'upload' WHEN 'click' THEN 'convert' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed'
        WHEN 'view' THEN 'delete' END AS kind, value, props FROM events""",
    "existing": f"""SELECT *, coalesce(last_value(CASE WHEN kind IN ('upload', 'delete') THEN kind END IGNORE NULLS) OVER ({_KEYED}) = 'upload', false) AS present
        FROM file_events""",
    "setting": """SELECT *, CASE WHEN kind IN ('upload', 'delete') THEN 'pending' WHEN kind = 'convert' AND present THEN 'processing'
        WHEN kind IN ('done', 'failed') THEN kind END AS would FROM existing""",
    "admitted": f"""SELECT *, coalesce(last_value(would IGNORE NULLS) OVER ({_KEYED}), 'pending') AS status FROM setting""",
    "coded": """SELECT *, CASE WHEN kind <> 'convert' THEN NULL WHEN NOT present THEN 404 WHEN status = 'processing' THEN 409 ELSE 200 END AS code,
        CASE WHEN kind = 'convert' AND (NOT present OR status = 'processing') THEN NULL ELSE would END AS sets FROM admitted""",
    "status_log": "SELECT user_id, filename, sets AS status, ts, event_id AS seq FROM coded WHERE sets IS NOT NULL",
    "latest": "SELECT user_id, filename, arg_max(status, (ts, seq)) AS status, max(ts) AS ts FROM status_log GROUP BY ALL",
    "uploads": """SELECT user_id, filename, floor(value * 1024 * 1024)::BIGINT AS size,
        CASE WHEN event_id % 4 = 0 THEN 'text/plain' ELSE 'application/pdf' END AS content_type, ts, event_id AS seq FROM file_events WHERE kind = 'upload'""",
    "outputs": "SELECT DISTINCT user_id, regexp_replace(filename, '\\.[^.]*$', '') || '.docx' AS filename FROM file_events WHERE kind = 'done' AND value >= 20",
    "page_results": "SELECT t.*, p.text FROM page_timings t LEFT JOIN doc_pages p ON p.doc_id = t.doc_id AND p.page = t.page",
    "options_log": "SELECT user_id, filename, props AS options_json, ts, event_id AS seq FROM file_events",
    "tasks": """SELECT event_id, ts, CASE WHEN event_id % 11 <> 0 THEN filename END AS file_id, CASE WHEN event_id % 13 = 0 THEN '' ELSE user_id END AS user_id,
        CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'layout' WHEN event_id % 7 = 0 THEN 'trial' ELSE 'ocr' END AS mode,
        event_id % 17 = 0 AS damaged FROM file_events WHERE kind = 'convert'""",
    "users": """SELECT c_custkey AS id, lower(replace(c_name, '#', '.')) || '@example.com' AS email,
        CASE WHEN c_custkey % 5 <> 0 THEN 'hash_' || c_custkey END AS hashed_password, c_name AS name, c_acctbal >= 0 AS email_verified FROM customer""",
    "grants": f"SELECT user_id::VARCHAR AS subject, {_SCOPE} AS scope, ts AS issued_at, ts + INTERVAL 24 HOUR AS expires_at FROM events WHERE event_type = 'signup'",
    "uses": f"SELECT event_id, user_id::VARCHAR AS subject, {_SCOPE} AS scope, ts FROM events WHERE event_type = 'click'",
    "requests": """SELECT event_id, user_id::VARCHAR AS key, event_type AS endpoint, ts, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS outcome,
        value AS elapsed_s FROM events""",
    "user_changes": """SELECT event_id AS seq, ts, op, CASE WHEN json_extract(props, '$.k')::INT = 7 THEN upper(address) ELSE address END AS email,
        CASE WHEN op = 'rename' THEN 'name_' || event_id END AS name, CASE WHEN op = 'register' THEN 'hash_' || event_id END AS hashed_password
        FROM (SELECT *, 'customer.' || lpad(user_id::VARCHAR, 9, '0') || '@example.com' AS address,
              CASE event_type WHEN 'signup' THEN 'register' WHEN 'view' THEN 'rename' WHEN 'click' THEN 'verify' WHEN 'purchase' THEN 'oauth' END AS op FROM events)
        WHERE op IS NOT NULL""",
    "labels_i18n": f"SELECT * FROM (VALUES {_PAIRS}) AS v(lang, key, value)",
}


def with_views(*names: str) -> str:
    """A WITH clause with these views and what they use."""
    need, order = set(names), list(SQL)
    for name in reversed(order):
        if name in need:
            need |= {other for other in order if other != name and f" {other}" in SQL[name].replace("\n", " ").replace("(", " ").replace(")", " ") + " "}
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order if n in need) + "\n"
