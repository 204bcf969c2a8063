"""The registered queries of the document-conversion operators, with their DuckDB equivalents."""

from __future__ import annotations

import base64
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks import views as v
from folioworks.functions import text as fn
from folioworks.operators import access, accounts, catalog, convert, labels, layout, metrics, status, tasks
from folioworks.plans import streams
from folioworks.session import shared_folder, ship_package
from folioworks.sources import files, tables

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
AS_OF = "2024-01-20 00:00:00"


def _query(sql: str | None = None, views: tuple[str, ...] = ()):
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = (v.with_views(*views) if views else "") + sql
        return f

    return keep


def _at(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the event log: the latest version of each upload."""
    return catalog.current_files(v.uploads(spark, sf_dir))


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are there at the end of the event log."""
    return catalog.live_files(v.uploads(spark, sf_dir), v.deletes(spark, sf_dir))


_LIVE = """files AS (SELECT user_id, filename, arg_max(size, (ts, seq)) AS size, max(ts) AS last_modified, count(*) AS versions FROM uploads u
WHERE NOT EXISTS (SELECT 1 FROM file_events d WHERE d.kind = 'delete' AND d.user_id = u.user_id AND d.filename = u.filename AND (d.ts > u.ts OR d.ts = u.ts AND d.event_id > u.seq)) GROUP BY ALL)"""
_FILES = "files AS (SELECT user_id, filename, arg_max(size, (ts, seq)) AS size, max(ts) AS last_modified, count(*) AS versions FROM uploads GROUP BY ALL)"


# Catalog


@_query("SELECT user_id, count(*) AS total, count(*) FILTER (status IN ('processing', 'pending')) AS converting, "
        "count(*) FILTER (status = 'done') AS converted, count(*) FILTER (status = 'failed') AS failed FROM files_docs GROUP BY user_id", ("files_docs",))  # fmt: skip
def dashboard_stats(spark, sf_dir):
    return catalog.dashboard_stats(v.files_docs(spark, sf_dir))


@_query("SELECT user_id, count(*) AS n_files, grouping(user_id)::INT AS is_total FROM files_orders GROUP BY ROLLUP (user_id)", ("files_orders",))
def file_count(spark, sf_dir):
    return catalog.file_count(v.files_orders(spark, sf_dir))


@_query("SELECT user_id, bool_or(status = 'processing') AS busy FROM files_orders GROUP BY user_id", ("files_orders",))
def any_processing(spark, sf_dir):
    return catalog.any_processing(v.files_orders(spark, sf_dir))


@_query("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_modified DESC, filename) AS pos FROM files_orders) WHERE pos <= 5", ("files_orders",))
def recent_documents(spark, sf_dir):
    return catalog.recent_documents(v.files_orders(spark, sf_dir))


@_query("SELECT user_id, filename, row_number() OVER (PARTITION BY user_id ORDER BY CASE status WHEN 'processing' THEN 0 WHEN 'pending' THEN 1 WHEN 'failed' THEN 2 "
        "WHEN 'done' THEN 3 ELSE 9 END, filename) AS pos FROM files_orders", ("files_orders",))  # fmt: skip
def sort_documents_by_status(spark, sf_dir):
    return catalog.sort_documents(v.files_orders(spark, sf_dir), "status", descending=False).select("user_id", "filename", "pos")


@_query("SELECT user_id, filename, row_number() OVER (PARTITION BY user_id ORDER BY last_modified DESC, filename) AS pos FROM files_docs", ("files_docs",))
def sort_documents_by_date(spark, sf_dir):
    return catalog.sort_documents(v.files_docs(spark, sf_dir)).select("user_id", "filename", "pos")


@_query("SELECT user_id, filename, row_number() OVER (PARTITION BY user_id ORDER BY lower(filename) DESC, filename) AS pos FROM files_docs", ("files_docs",))
def sort_documents_by_name(spark, sf_dir):
    return catalog.sort_documents(v.files_docs(spark, sf_dir), "name").select("user_id", "filename", "pos")


@_query("SELECT user_id, filename FROM (SELECT user_id, filename FROM uploads UNION ALL SELECT user_id, filename FROM outputs) "
        "WHERE NOT (filename LIKE '%.settings.json' OR filename LIKE '%.status' OR filename LIKE '%.docx')", ("uploads", "outputs"))  # fmt: skip
def exclude_sidecars(spark, sf_dir):
    stored = v.uploads(spark, sf_dir).select("user_id", "filename").unionByName(v.outputs(spark, sf_dir))
    return catalog.exclude_sidecars(stored)


@_query("SELECT user_id, filename, size FROM files_orders WHERE contains(lower(filename), lower('R_12'))", ("files_orders",))
def search_filename(spark, sf_dir):
    return catalog.search_filename(v.files_orders(spark, sf_dir), "R_12").select("user_id", "filename", "size")


@_query("SELECT filename, size, status FROM files_docs WHERE user_id = 'src0'", ("files_docs",))
def scope_to_user(spark, sf_dir):
    return catalog.scope_to_user(v.files_docs(spark, sf_dir), "src0").select("filename", "size", "status")


@_query("SELECT user_id, filename, seq, CASE WHEN content_type <> 'application/pdf' THEN 'onlyPdf' WHEN size > 52428800 THEN 'tooLarge' END AS reason FROM uploads", ("uploads",))
def upload_admission(spark, sf_dir):
    return catalog.upload_admission(v.uploads(spark, sf_dir)).select("user_id", "filename", "seq", "reason")


@_query(", ok AS (SELECT * FROM uploads WHERE content_type = 'application/pdf' AND size <= 52428800) SELECT user_id, filename, arg_max(size, (ts, seq)) AS size, "
        "max(ts) AS last_modified, count(*) AS versions FROM ok GROUP BY ALL", ("uploads",))  # fmt: skip
def ingest_uploads(spark, sf_dir):
    return catalog.ingest_uploads(v.uploads(spark, sf_dir))[0]


@_query(f", {_LIVE} SELECT f.*, coalesce(l.status, 'pending') AS status FROM files f LEFT JOIN latest l USING (user_id, filename)", ("uploads", "latest", "file_events"))
def list_documents(spark, sf_dir):
    return catalog.list_documents(_live(spark, sf_dir), status.latest_status(v.status_log(spark, sf_dir)))


@_query(", keys AS (SELECT DISTINCT user_id, filename FROM file_events) SELECT k.*, coalesce(l.status, 'pending') AS status FROM keys k LEFT JOIN latest l USING (user_id, filename)", ("file_events", "latest"))
def document_status(spark, sf_dir):
    keys = v.file_events(spark, sf_dir).select("user_id", "filename").distinct()
    return catalog.document_status(keys, status.latest_status(v.status_log(spark, sf_dir)))


@_query("SELECT e.event_id, EXISTS (SELECT 1 FROM uploads u WHERE u.user_id = e.user_id AND u.filename = e.filename) AS present FROM file_events e WHERE kind = 'convert'", ("file_events", "uploads"))
def files_exist(spark, sf_dir):
    asked = v.file_events(spark, sf_dir).filter("kind = 'convert'").select("event_id", "user_id", "filename")
    return catalog.files_exist(asked, v.uploads(spark, sf_dir)).select("event_id", "present")


@_query("SELECT f.user_id, f.filename, f.status FROM files_docs f WHERE f.size >= 1000 AND f.status IN ('pending', 'failed')", ("files_docs",))
def convertible(spark, sf_dir):
    files = v.files_docs(spark, sf_dir)
    return catalog.convertible(files, files.filter("size >= 1000")).select("user_id", "filename", "status")


@_query(f", {_LIVE} SELECT f.user_id, f.filename, o.filename AS output FROM files f LEFT JOIN outputs o ON o.user_id = f.user_id "
        "AND regexp_replace(o.filename, '\\.[^.]*$', '') = regexp_replace(f.filename, '\\.[^.]*$', '')", ("uploads", "outputs", "file_events"))  # fmt: skip
def match_outputs(spark, sf_dir):
    return catalog.match_outputs(_live(spark, sf_dir), v.outputs(spark, sf_dir)).select("user_id", "filename", "output")


@_query(f""", {_LIVE}, ins AS (SELECT DISTINCT user_id, regexp_replace(filename, '\\.[^.]*$', '') AS stem FROM files),
outs AS (SELECT *, regexp_replace(filename, '\\.[^.]*$', '') AS stem FROM outputs)
SELECT user_id, filename, 'no_input' AS reason FROM outs o WHERE NOT EXISTS (SELECT 1 FROM ins i WHERE i.user_id = o.user_id AND i.stem = o.stem)
UNION ALL SELECT f.user_id, f.filename, 'no_output' FROM files f JOIN latest l ON l.user_id = f.user_id AND l.filename = f.filename AND l.status = 'done'
WHERE NOT EXISTS (SELECT 1 FROM outs o WHERE o.user_id = f.user_id AND o.stem = regexp_replace(f.filename, '\\.[^.]*$', ''))""", ("uploads", "outputs", "latest", "file_events"))
def orphan_outputs(spark, sf_dir):
    return catalog.orphan_outputs(_live(spark, sf_dir), v.outputs(spark, sf_dir), status.latest_status(v.status_log(spark, sf_dir)))


@_query(f""", {_FILES}, stored AS (SELECT user_id, filename FROM files UNION ALL SELECT user_id, filename FROM outputs),
wanted AS (SELECT DISTINCT user_id, filename FROM file_events WHERE kind = 'delete'),
found AS (SELECT w.* FROM wanted w WHERE EXISTS (SELECT 1 FROM stored s WHERE s.user_id = w.user_id AND s.filename = w.filename)),
gone AS (SELECT user_id, unnest([filename, regexp_replace(filename, '\\.[^.]*$', '') || '.docx']) AS filename FROM found)
SELECT s.user_id, s.filename FROM stored s WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.user_id = s.user_id AND g.filename = s.filename)""", ("uploads", "outputs", "file_events"))
def delete_documents(spark, sf_dir):
    stored = _files(spark, sf_dir).select("user_id", "filename").unionByName(v.outputs(spark, sf_dir))
    return catalog.delete_documents(stored, v.file_events(spark, sf_dir).filter("kind = 'delete'"))[0]


@_query(f""", {_FILES}, wanted AS (SELECT DISTINCT user_id, filename FROM file_events WHERE kind = 'delete')
SELECT w.*, CASE WHEN f.filename IS NULL THEN 404 ELSE 200 END AS code FROM wanted w LEFT JOIN files f USING (user_id, filename)""", ("uploads", "file_events"))
def delete_codes(spark, sf_dir):
    return catalog.delete_documents(_files(spark, sf_dir), v.file_events(spark, sf_dir).filter("kind = 'delete'"))[1].select("user_id", "filename", "code")


@_query(f""", {_FILES} SELECT d.user_id, d.filename, d.event_id AS seq, d.ts, 'pending' AS status FROM file_events d
WHERE d.kind = 'delete' AND EXISTS (SELECT 1 FROM files f WHERE f.user_id = d.user_id AND f.filename = d.filename)""", ("uploads", "file_events"))
def delete_status(spark, sf_dir):
    return catalog.delete_documents(_files(spark, sf_dir), v.deletes(spark, sf_dir))[2]


@_query("SELECT user_id, filename, 'pending' AS status, ts, seq FROM uploads WHERE content_type = 'application/pdf' AND size <= 52428800", ("uploads",))
def ingest_status(spark, sf_dir):
    return catalog.ingest_uploads(v.uploads(spark, sf_dir))[1]


@_query("SELECT user_id, filename, seq, CASE WHEN content_type NOT IN ('application/pdf', 'application/octet-stream') THEN 'onlyPdf' WHEN size > 52428800 THEN 'tooLarge' END AS reason FROM uploads", ("uploads",))
def worker_admission(spark, sf_dir):
    return catalog.upload_admission(v.uploads(spark, sf_dir), catalog.WORKER_TYPES).select("user_id", "filename", "seq", "reason")


_SNAP = "SELECT user_id, filename, arg_max(status, (ts, seq)) AS status FROM status_log WHERE ts < TIMESTAMP '{}' GROUP BY ALL"


@_query(f""", older AS ({_SNAP.format('2024-01-15')}), newer AS ({_SNAP.format('2024-01-16')}),
both_of AS (SELECT user_id, filename, o.status AS was, n.status AS now FROM older o FULL JOIN newer n USING (user_id, filename)),
changes AS (SELECT *, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' WHEN was = 'processing' AND now = 'done' THEN 'completed'
WHEN was = 'processing' AND now = 'failed' THEN 'failed' WHEN was <> now THEN 'changed' END AS change FROM both_of)
SELECT * FROM changes WHERE change IS NOT NULL""", ("status_log",))
def snapshot_diff(spark, sf_dir):
    log = v.status_log(spark, sf_dir)
    older, newer = (status.latest_status(log.filter(F.col("ts") < _at(day))) for day in ("2024-01-15 00:00:00", "2024-01-16 00:00:00"))
    return catalog.snapshot_diff(older, newer)


# Status


@_query("SELECT event_id, code FROM coded WHERE kind = 'convert'", ("coded",))
def conversion_admission(spark, sf_dir):
    return status.conversion_admission(v.file_events(spark, sf_dir))


@_query("SELECT * FROM latest", ("latest",))
def latest_status(spark, sf_dir):
    return status.latest_status(v.status_log(spark, sf_dir))


@_query("SELECT user_id, filename, seq, ts, status FROM (SELECT *, lag(status) OVER (PARTITION BY user_id, filename ORDER BY ts, seq) AS previous FROM status_log) "
        "WHERE previous = 'processing' AND status IN ('done', 'failed')", ("status_log",))  # fmt: skip
def status_transitions(spark, sf_dir):
    return status.status_transitions(v.status_log(spark, sf_dir))


@_query(f"""SELECT user_id, filename, floor(epoch_us(TIMESTAMP '{AS_OF}') / 1e6 - epoch_us(started) / 1e6)::BIGINT AS elapsed_s FROM (
SELECT user_id, filename, arg_max(status, (ts, seq)) AS status, arg_max(ts, (ts, seq)) AS started FROM status_log WHERE ts <= TIMESTAMP '{AS_OF}' GROUP BY ALL)
WHERE status = 'processing'""", ("status_log",))
def processing_elapsed(spark, sf_dir):
    return status.processing_elapsed(v.status_log(spark, sf_dir), _at(AS_OF))


_STALE = """(SELECT *, epoch_us(least(coalesce(lead(ts) OVER (PARTITION BY user_id, filename ORDER BY ts, seq), TIMESTAMP '2024-02-01'), TIMESTAMP '2024-02-01')) - epoch_us(ts) AS ran
FROM status_log) WHERE status = 'processing' AND ran > 600000000"""


@_query(f"SELECT user_id, filename, seq, ran // 1000000 AS ran_s FROM {_STALE}", ("status_log",))
def stale_jobs(spark, sf_dir):
    return status.stale_jobs(v.status_log(spark, sf_dir), _at("2024-02-01 00:00:00"))


@_query(f""", {_LIVE}, last_options AS (SELECT user_id, filename, arg_max(options_json, (ts, seq)) AS options_json FROM options_log GROUP BY ALL)
SELECT o.*, CASE WHEN f.filename IS NULL THEN 404 ELSE 200 END AS code FROM last_options o LEFT JOIN files f USING (user_id, filename)""", ("uploads", "options_log", "file_events"))
def save_options(spark, sf_dir):
    return status.save_options(v.options_log(spark, sf_dir), _live(spark, sf_dir))


# Tasks


_TASKS = """SELECT event_id, CASE WHEN damaged THEN NULL ELSE file_id END AS file_id, CASE WHEN damaged THEN NULL ELSE user_id END AS user_id,
CASE WHEN damaged THEN 'ocr' ELSE coalesce(mode, 'ocr') END AS mode, CASE WHEN damaged THEN 'damaged' WHEN coalesce(file_id, '') = '' THEN 'no_file'
WHEN coalesce(user_id, '') = '' THEN 'no_user'{} END AS reason FROM tasks"""


@_query(_TASKS.format(""), ("tasks",))
def validate_tasks(spark, sf_dir):
    return tasks.validate_tasks(v.tasks_raw(spark, sf_dir)).select("event_id", "file_id", "user_id", "mode", "reason")


@_query(_TASKS.format(" WHEN coalesce(mode, 'ocr') NOT IN ('ocr', 'layout') THEN 'bad_mode'"), ("tasks",))
def validate_mode(spark, sf_dir):
    return tasks.validate_tasks(v.tasks_raw(spark, sf_dir), tasks.MODES).select("event_id", "file_id", "user_id", "mode", "reason")


# Layout and conversion

_LAYOUT = r"""lines AS (SELECT doc_id, page, string_split(text, chr(10)) AS ls FROM doc_pages),
parts AS (SELECT doc_id, page, unnest(ls) AS raw, generate_subscripts(ls, 1) AS line_no FROM lines),
paragraphs AS (SELECT doc_id, page, line_no, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS text FROM parts
               UNION ALL SELECT doc_id, page, 0, '-- Page ' || page || ' --' FROM doc_pages WHERE page > 1),
laid AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, line_no) AS seq, page, line_no::INT AS line_no,
         CASE WHEN line_no = 0 THEN 'separator' WHEN text = '' THEN 'blank' ELSE 'text' END AS kind, text FROM paragraphs)"""


@_query(f", {_LAYOUT} SELECT * FROM laid", ("doc_pages",))
def build_layout(spark, sf_dir):
    return layout.build_layout(v.doc_pages(spark, sf_dir))


@_query(f"""{', ' + _LAYOUT} SELECT doc_id, seq, CASE kind WHEN 'text' THEN 'right' WHEN 'separator' THEN 'center' END AS align,
CASE kind WHEN 'text' THEN true WHEN 'separator' THEN false END AS rtl, CASE kind WHEN 'text' THEN 'Arial' END AS font,
CASE kind WHEN 'text' THEN 12 WHEN 'separator' THEN 9 END AS size_pt, CASE kind WHEN 'separator' THEN '999999' END AS color FROM laid""", ("doc_pages",))
def paragraph_style(spark, sf_dir):
    styled = layout.paragraph_style(layout.build_layout(v.doc_pages(spark, sf_dir)))
    return styled.select("doc_id", "seq", "align", "rtl", "font", "size_pt", "color")


@_query("SELECT conv_id AS doc_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS page FROM conversations")
def number_pages(spark, sf_dir):
    turns = v.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn")
    return layout.number_pages(turns, "doc_id", "turn")


@_query("SELECT doc_id, string_agg(coalesce(text, ''), chr(10) ORDER BY page) AS text FROM doc_pages GROUP BY doc_id", ("doc_pages",))
def assemble_text(spark, sf_dir):
    return layout.assemble_text(v.doc_pages(spark, sf_dir))


@_query(r"""SELECT doc_id, page, list_aggregate(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), 'string_agg', chr(10)) AS text,
true AS ok FROM doc_pages""", ("doc_pages",))
def convert_pages(spark, sf_dir):
    ship_package(spark)
    return convert.convert_pages(v.doc_pages(spark, sf_dir)).select("doc_id", "page", "text", "ok")


@_query(f", {_LAYOUT} SELECT doc_id, seq, page, kind, text FROM laid", ("doc_pages",))
def run_conversion(spark, sf_dir):
    ship_package(spark)
    return convert.run_conversion(v.doc_pages(spark, sf_dir))[0].select("doc_id", "seq", "page", "kind", "text")


@_query("SELECT doc_id, count(*) AS attempts, count(DISTINCT page) AS pages, coalesce(sum(length(text)), 0)::BIGINT AS characters, round(sum(elapsed_s), 2) AS seconds FROM page_results GROUP BY doc_id", ("page_results",))
def job_summary(spark, sf_dir):
    return convert.job_summary(v.page_lengths(spark, sf_dir))


@_query("SELECT doc_id, count(*) AS attempts, count(DISTINCT page) AS pages, CASE WHEN bool_and(ok) THEN 'done' ELSE 'failed' END AS status, "
        "min(CASE WHEN NOT ok THEN page END) AS first_failed_page FROM page_timings GROUP BY doc_id", ("page_timings",))  # fmt: skip
def job_outcome(spark, sf_dir):
    return convert.job_outcome(v.page_timings(spark, sf_dir))


@_query("""SELECT o.o_orderkey AS seq, (sum(p.pages) OVER w)::BIGINT AS used, sum(p.pages) OVER w > 5 AS over FROM orders o JOIN
(SELECT l_orderkey, count(*) AS pages FROM lineitem GROUP BY 1) p ON p.l_orderkey = o.o_orderkey
WINDOW w AS (PARTITION BY o_custkey, date_trunc('month', o_orderdate) ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def page_quota(spark, sf_dir):
    pages = v.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("pages"))
    orders = v.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"))
    return convert.page_quota(orders.join(pages, orders["seq"] == pages["l_orderkey"]), quota=5).select("seq", "used", "over")


@_query("""SELECT o_orderkey AS seq, CASE WHEN c_mktsegment = 'BUILDING' THEN false ELSE coalesce(n, 0) > 5 END AS over_cap
FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def page_caps(spark, sf_dir):
    pages = v.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("pages"))
    plan = F.when(F.col("c_mktsegment") == "BUILDING", "pro").when(F.col("c_mktsegment") == "MACHINERY", "trial").otherwise("free")
    users = v.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), plan.alias("plan"))
    files = v.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(users, "o_custkey").join(pages, "o_orderkey", "left")
    return convert.page_caps(files).select(F.col("o_orderkey").alias("seq"), "over_cap")


@_query("SELECT doc_id, count(DISTINCT page) AS pages, 'section' AS kind, true AS rtl FROM doc_pages GROUP BY doc_id", ("doc_pages",))
def section_style(spark, sf_dir):
    return layout.section_style(v.doc_pages(spark, sf_dir))


@_query("SELECT doc_id::VARCHAR AS filename, source AS user_id, generate_subscripts(parts, 1)::INT AS page, unnest(parts) AS text FROM (SELECT *, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)")
def pdf_to_pages(spark, sf_dir):
    """Documents as files of bytes, a line a page: the splitter is a parameter."""
    ship_package(spark)
    files = v.table(spark, sf_dir, "documents").select(F.col("source").alias("user_id"), F.col("doc_id").cast("string").alias("filename"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    return convert.pdf_to_pages(files, lambda: lambda content: content.decode().split("\n")).drop("error")


@_query(f", {_LAYOUT} SELECT doc_id, seq, text FROM laid", ("doc_pages",))
def write_paragraphs(spark, sf_dir):
    """Result documents written by buckets of users, and read back."""
    path = shared_folder(spark, "paragraphs")
    files.write_paragraphs(layout.build_layout(v.doc_pages(spark, sf_dir)).withColumn("user_id", F.col("doc_id").cast("string")), path)
    return spark.read.parquet(path).select("doc_id", "seq", "text")


@_query("SELECT 'source=' || source AS user_id, doc_id::VARCHAR AS doc, strlen(text) + 1 AS size FROM documents WHERE text IS NOT NULL AND source IS NOT NULL")
def scan_files(spark, sf_dir):
    """Documents stored as text files, a folder a user, and listed."""
    path = shared_folder(spark, "store")
    docs = v.table(spark, sf_dir, "documents").filter("text is not null and source is not null").select("source", "doc_id", "text")
    files.store_files(docs, path, ("source", "doc_id"))
    listed = files.scan_files(spark, path).filter(F.endswith("filename", F.lit(".txt")))
    return listed.select(files.plain_key(F.col("user_id")).alias("user_id"), F.regexp_extract("filename", "doc_id=([^/]*)/", 1).alias("doc"), "size")


@_query("SELECT user_id, filename, status FROM latest", ("latest",))
def write_status(spark, sf_dir):
    """The log written in three appends, and its latest status read back."""
    path, log = shared_folder(spark, "status_log"), v.status_log(spark, sf_dir)
    for i in range(3):
        status.write_status(log.filter(F.col("seq") % 3 == i), path)
    return status.latest_status(spark.read.parquet(path)).select("user_id", "filename", "status")


@_query("SELECT user_id, filename, status FROM latest", ("latest",))
def read_status(spark, sf_dir):
    """Status files beside documents, a folder a user, with white space around the text. Spark's writers end names in three letters, and make a folder for each file."""
    path, latest = shared_folder(spark, "sidecars"), status.latest_status(v.status_log(spark, sf_dir))
    text = F.concat(F.lit("  "), "status", F.lit(" "))
    files.store_files(latest.select("user_id", "filename", text.alias("text")), path, ("user_id", "filename"), "sta", beside=True)
    read = files.read_status(spark, path, ".sta")
    user, name = F.regexp_extract("user_id", "=(.*)", 1), F.regexp_extract("filename", "filename=([^/]*)", 1)
    return read.select(files.plain_key(user).alias("user_id"), files.plain_key(name).alias("filename"), "status")


@_query("SELECT doc_id, page, coalesce(text, '') AS text FROM doc_pages", ("doc_pages",))
def load_pdf_bytes(spark, sf_dir):
    """From files to bytes to pages: each conversation is a file with its pages in base64, which the splitter takes apart."""
    ship_package(spark)
    path = shared_folder(spark, "pdfs")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    body = F.base64(F.encode(F.array_join(ordered, "\f"), "UTF-8"))
    files.store_files(v.doc_pages(spark, sf_dir).groupBy("doc_id").agg(F.regexp_replace(body, r"\s", "").alias("text")), path, ("doc_id",), "pdf")
    pages = convert.pdf_to_pages(files.load_pdf_bytes(spark, path), lambda: lambda content: base64.b64decode(content).decode().split("\f"))
    return pages.select(F.regexp_extract("user_id", "=(.*)", 1).cast("long").alias("doc_id"), "page", "text")


@_query("""SELECT lang, 'sources.' || source || '.' || k AS key, CASE k WHEN 'count' THEN n::VARCHAR ELSE longest::VARCHAR END AS value
FROM (SELECT lang, source, count(*) AS n, max(n_chars) AS longest FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL), (VALUES ('count'), ('longest')) AS t(k)""")
def load_labels(spark, sf_dir):
    """A nested file for each language, made of its documents' sources; all are read in one scan."""
    path = shared_folder(spark, "locales")
    facts = v.table(spark, sf_dir, "documents").filter("lang is not null and source is not null").groupBy("lang", "source").agg(F.count("*").alias("count"), F.max("n_chars").alias("longest"))
    inner = F.map_from_entries(F.collect_list(F.struct("source", F.struct("count", "longest"))))
    facts.groupBy("lang").agg(F.to_json(F.struct(inner.alias("sources"))).alias("text")).write.partitionBy("lang").text(path)
    return tables.load_labels(spark, path, F.regexp_extract("path", "lang=([^/]*)/", 1))


@_query("""SELECT 'source=' || coalesce(source, '__HIVE_DEFAULT_PARTITION__') AS user_id, doc_id::VARCHAR AS doc, CASE WHEN lang = 'de' THEN 'added' ELSE 'changed' END AS change
FROM documents WHERE lang IN ('de', 'fr') AND doc_id IS NOT NULL UNION ALL SELECT 'source=' || source, 'gone', 'removed' FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)""")
def scan_changes(spark, sf_dir):
    """Documents in three languages stored a file each and listed; then one language is written anew, one is new, and a file of each source goes."""
    path, docs = shared_folder(spark, "listing"), v.table(spark, sf_dir, "documents").filter("doc_id is not null").select("source", F.col("doc_id").cast("string").alias("doc_id"), "lang", F.coalesce("text", F.lit("")).alias("text"))
    gone = docs.filter("source is not null").select("source", F.lit("gone").alias("doc_id"), F.lit("x").alias("lang"), F.lit("y").alias("text")).distinct()

    def store(rows):
        files.store_files(rows.drop("lang"), f"{path}/store", ("source", "doc_id"))

    store(docs.filter("lang in ('en', 'fr')").unionByName(gone))
    files.scan_changes(spark, f"{path}/store", f"{path}/manifest").count()
    store(docs.filter("lang in ('de', 'fr')"))
    store_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/store")
    system = store_of.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in system.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/store/source=*/doc_id=gone")):
        system.delete(folder.getPath(), True)
    # Files that Spark's writer writes anew get new names: what went and what came under one key is a change of it.
    found = files.scan_changes(spark, f"{path}/store", f"{path}/manifest").select(files.plain_key(F.col("user_id")).alias("user_id"), F.regexp_extract("filename", "doc_id=([^/]*)/", 1).alias("doc"), "change")
    return found.groupBy("user_id", "doc").agg(F.when(F.count_distinct("change") > 1, "changed").otherwise(F.min("change")).alias("change"))


# Metrics


@_query("SELECT outcome, count(*) AS n FROM requests GROUP BY outcome", ("requests",))
def request_counter(spark, sf_dir):
    return metrics.request_counter(v.requests(spark, sf_dir))


@_query("SELECT le, count(*) FILTER (elapsed_s <= le) AS bucket_count, count(*) AS total_count, round(sum(elapsed_s), 2) AS total_sum "
        "FROM page_timings, unnest([0.5, 1, 2, 3, 5, 10, 20, 40, 'infinity'::DOUBLE]) AS u(le) GROUP BY le", ("page_timings",))  # fmt: skip
def duration_histogram(spark, sf_dir):
    return metrics.duration_histogram(v.page_timings(spark, sf_dir), "elapsed_s")


@_query("SELECT endpoint AS gauge, arg_max(elapsed_s, (ts, event_id)) AS value FROM requests GROUP BY endpoint", ("requests",))
def latest_gauge(spark, sf_dir):
    return metrics.latest_gauge(v.requests(spark, sf_dir), "endpoint", "elapsed_s")


@_query(""", r AS (SELECT count(*) AS requests_total, count(*) FILTER (outcome = 'success') AS requests_success, count(*) FILTER (outcome = 'error') AS requests_error,
round(sum(elapsed_s) FILTER (outcome = 'success') / nullif(count(*) FILTER (outcome = 'success'), 0), 2) AS avg_request_seconds FROM requests),
p AS (SELECT count(*) AS pages_total, round(sum(elapsed_s) / nullif(count(*), 0), 2) AS avg_page_seconds FROM page_timings) SELECT * FROM r, p""", ("requests", "page_timings"))
def ocr_stats(spark, sf_dir):
    return metrics.ocr_stats(v.requests(spark, sf_dir), v.page_timings(spark, sf_dir))


@_query("SELECT endpoint, outcome, le, count(*) FILTER (elapsed_s <= le) AS bucket_count, count(*) AS total_count, round(sum(elapsed_s), 2) AS total_sum "
        "FROM requests, unnest([2, 5, 10, 30, 60, 120, 300, 600, 'infinity'::DOUBLE]) AS u(le) GROUP BY ALL", ("requests",))  # fmt: skip
def http_metrics(spark, sf_dir):
    return metrics.http_metrics(v.requests(spark, sf_dir))


# Accounts and access


@_query("SELECT * FROM users", ("users",))
def users_table(spark, sf_dir):
    """The users relation as stored Parquet."""
    path = shared_folder(spark, "users")
    v.users(spark, sf_dir).select(F.col("id").cast("int").alias("id"), "email", "hashed_password", "name", "email_verified").write.parquet(path)
    return tables.users_table(spark, path)


@_query("SELECT id, email, name, coalesce(email_verified, false) AS email_verified FROM users", ("users",))
def public_user(spark, sf_dir):
    return accounts.public_user(v.users(spark, sf_dir))


@_query("SELECT u.id, u.email FROM users u WHERE u.email IN (SELECT lower(email) FROM user_changes)", ("users", "user_changes"))
def find_user_by_email(spark, sf_dir):
    keys = v.user_changes(spark, sf_dir).select(fn.normal_email(F.col("email")).alias("email"))
    return accounts.find_users(v.users(spark, sf_dir), keys).select("id", "email")


@_query("SELECT c.seq, CASE WHEN u.email IS NULL THEN 'no_user' WHEN u.hashed_password IS NULL THEN 'no_password' ELSE 'check' END AS reason "
        "FROM user_changes c LEFT JOIN users u USING (email)", ("users", "user_changes"))  # fmt: skip
def login_eligible(spark, sf_dir):
    return accounts.login_eligible(v.user_changes(spark, sf_dir), v.users(spark, sf_dir)).select("seq", "reason")


_OLD = "old_users AS (SELECT * FROM users WHERE email_verified)"
_NEW = "first_of AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY ts, seq) AS nth FROM user_changes {}) WHERE nth = 1)"


@_query(f""", {_OLD}, {_NEW.format("WHERE op = 'oauth'")}, fresh AS (SELECT email, name FROM first_of WHERE email NOT IN (SELECT email FROM old_users))
SELECT id::BIGINT AS id, email, name, email_verified FROM old_users UNION ALL
SELECT (SELECT max(id) FROM old_users) + row_number() OVER (ORDER BY substr(md5(email), 1, 3), email), email, name, true FROM fresh""", ("users", "user_changes"))
def find_or_create_users(spark, sf_dir):
    old = v.users(spark, sf_dir).filter("email_verified")
    return accounts.find_or_create_users(old, v.user_changes(spark, sf_dir).filter("op = 'oauth'")).select("id", "email", "name", "email_verified")


@_query(f""", {_OLD} SELECT seq, CASE WHEN u.email IS NOT NULL OR row_number() OVER (PARTITION BY c.email ORDER BY ts, seq) > 1 THEN 400 ELSE 201 END AS code
FROM user_changes c LEFT JOIN old_users u ON u.email = c.email WHERE op = 'register'""", ("users", "user_changes"))
def register_users(spark, sf_dir):
    old = v.users(spark, sf_dir).filter("email_verified")
    return accounts.register_users(old, v.user_changes(spark, sf_dir).filter("op = 'register'")).select("seq", "code")


@_query(""", names AS (SELECT email, arg_max(name, (ts, seq)) AS new_name FROM user_changes WHERE name IS NOT NULL GROUP BY email)
SELECT u.id, u.email, coalesce(n.new_name, u.name) AS name FROM users u LEFT JOIN names n USING (email)""", ("users", "user_changes"))
def update_profile(spark, sf_dir):
    return accounts.update_profile(v.users(spark, sf_dir), v.user_changes(spark, sf_dir)).select("id", "email", "name")


_OUTCOMES = """outcomes AS (SELECT u.event_id, u.subject, CASE WHEN bool_or(g.scope = u.scope AND u.ts < g.expires_at) THEN 'valid' WHEN bool_or(g.scope = u.scope) THEN 'expired'
WHEN count(g.subject) > 0 THEN 'wrong_scope' ELSE 'none' END AS outcome FROM uses u LEFT JOIN grants g ON g.subject = u.subject AND g.issued_at <= u.ts GROUP BY u.event_id, u.subject)"""


@_query(f", {_OUTCOMES} SELECT event_id, outcome FROM outcomes", ("uses", "grants"))
def grant_validity_join(spark, sf_dir):
    return access.grant_validity_join(v.uses(spark, sf_dir), v.grants(spark, sf_dir))


@_query(f""", {_OUTCOMES} SELECT o.event_id, CASE WHEN outcome <> 'valid' THEN outcome WHEN u.email IS NULL THEN 'not_found' WHEN u.email_verified THEN 'already' ELSE 'verified' END AS result
FROM outcomes o LEFT JOIN users u ON u.email = 'customer.' || lpad(o.subject, 9, '0') || '@example.com'""", ("uses", "grants", "users"))
def verify_emails(spark, sf_dir):
    uses = v.uses(spark, sf_dir)
    outcomes = access.grant_validity_join(uses, v.grants(spark, sf_dir)).join(uses.select("event_id", "subject"), "event_id")
    email = F.concat(F.lit("customer."), F.lpad("subject", 9, "0"), F.lit("@example.com"))
    return accounts.verify_emails(v.users(spark, sf_dir), outcomes.withColumn("email", email)).select("event_id", "result")


@_query("""SELECT email, min(seq) AS first_seq, arg_max(name, (ts, seq)) FILTER (name IS NOT NULL) AS name,
arg_max(hashed_password, (ts, seq)) FILTER (hashed_password IS NOT NULL) AS hashed_password, bool_or(op IN ('verify', 'oauth')) AS email_verified
FROM user_changes GROUP BY email""", ("user_changes",))
def apply_user_changes(spark, sf_dir):
    return accounts.apply_user_changes(v.user_changes(spark, sf_dir))


@_query("""SELECT email, min(seq) AS first_seq, arg_max(name, (ts, seq)) FILTER (name IS NOT NULL) AS name,
arg_max(hashed_password, (ts, seq)) FILTER (hashed_password IS NOT NULL) AS hashed_password, bool_or(op IN ('verify', 'oauth')) AS email_verified
FROM user_changes GROUP BY email""", ("user_changes",))
def merge_accounts(spark, sf_dir):
    """A table of the changes until a day, then the others laid on it."""
    path, changes = shared_folder(spark, "accounts"), v.user_changes(spark, sf_dir)
    accounts.write_accounts(changes.filter(F.col("ts") < _at(AS_OF)), path)
    accounts.merge_accounts(spark, changes.filter(F.col("ts") >= _at(AS_OF)), path)
    return accounts.read_accounts(spark, path)


@_query("SELECT id::BIGINT AS id, email, NULL::VARCHAR AS phone, email_verified FROM users", ("users",))
def conform_schema(spark, sf_dir):
    from pyspark.sql.types import StructType

    return accounts.conform_schema(v.users(spark, sf_dir), StructType.fromDDL("id long, email string, phone string, email_verified boolean"))


@_query("SELECT lower(trim(email)) AS normal_email, count(*) AS n_rows, count(DISTINCT email) AS n_spellings FROM user_changes GROUP BY 1 HAVING count(*) > 1", ("user_changes",))
def identity_audit(spark, sf_dir):
    return accounts.identity_audit(v.user_changes(spark, sf_dir))


@_query(r"""SELECT CASE WHEN k <= 1 THEN 'Weak' WHEN k = 2 THEN 'Fair' WHEN k = 3 THEN 'Good' ELSE 'Strong' END AS band, count(*) AS n, count(*) FILTER (k = 4) AS n_all_rules
FROM (SELECT (length(text) >= 8)::INT + regexp_matches(text, '[A-Z]')::INT + regexp_matches(text, '[0-9]')::INT + regexp_matches(text, '[^A-Za-z0-9]')::INT AS k FROM documents) GROUP BY 1""")
def rule_score(spark, sf_dir):
    return accounts.rule_score(v.table(spark, sf_dir, "documents"), "text")


@_query("""SELECT event_id, CASE WHEN event_type = 'click' AND row_number() OVER (PARTITION BY event_type, user_id, date_trunc('day', ts) ORDER BY ts, event_id) > 1
OR event_type = 'signup' AND row_number() OVER (PARTITION BY event_type, user_id, epoch_us(ts) // 7200000000 ORDER BY ts, event_id) > 2 THEN 429 ELSE 200 END AS code FROM events""")
def rate_limit(spark, sf_dir):
    """Two endpoints with a rule; the others have none and pass."""
    rules = spark.createDataFrame([("click", 1, 86400), ("signup", 2, 7200)], "endpoint string, max_requests int, window_s long")
    return access.rate_limit(v.requests(spark, sf_dir), rules).select("event_id", "code")


# Labels and functions


@_query("""SELECT d.doc_id, coalesce(o.value, b.value, d.key) AS value FROM (SELECT doc_id, lang, CASE doc_id % 3 WHEN 0 THEN 'docs.count' WHEN 1 THEN 'docs.empty' ELSE 'docs.none' END AS key FROM documents) d
LEFT JOIN labels_i18n o ON o.lang = d.lang AND o.key = d.key LEFT JOIN labels_i18n b ON b.lang = 'en' AND b.key = d.key""", ("labels_i18n",))
def resolve_labels(spark, sf_dir):
    key = F.when(F.col("doc_id") % 3 == 0, "docs.count").when(F.col("doc_id") % 3 == 1, "docs.empty").otherwise("docs.none")
    wanted = v.table(spark, sf_dir, "documents").select("doc_id", "lang", key.alias("key"))
    return labels.resolve_labels(wanted, v.labels_i18n(spark)).select("doc_id", "value")


@_query("""SELECT l.lang, k.key, 'missing' AS problem FROM (SELECT DISTINCT lang FROM labels_i18n) l, (SELECT DISTINCT key FROM labels_i18n) k
WHERE NOT EXISTS (SELECT 1 FROM labels_i18n x WHERE x.lang = l.lang AND x.key = k.key)
UNION ALL SELECT DISTINCT NULL, 'status.' || f.status, 'missing_everywhere' FROM files_docs f WHERE 'status.' || f.status NOT IN (SELECT key FROM labels_i18n)
UNION ALL SELECT a.lang, a.key, 'placeholders' FROM labels_i18n a JOIN labels_i18n b ON b.key = a.key AND b.lang = 'en'
WHERE list_sort(regexp_extract_all(a.value, '\\{\\{(\\w+)\\}\\}', 1)) <> list_sort(regexp_extract_all(b.value, '\\{\\{(\\w+)\\}\\}', 1))""", ("labels_i18n", "files_docs"))
def label_coverage(spark, sf_dir):
    used = v.files_docs(spark, sf_dir).select(F.concat(F.lit("status."), "status").alias("key"))
    return labels.label_coverage(used, v.labels_i18n(spark))


@_query("""SELECT user_id, filename, regexp_replace(filename, '\\.[^.]*$', '') AS stem, format('{:.1f} KB', floor(size / 1024 * 10 + 0.5) / 10) AS size_label, printf('%d:%02d', size // 60, size % 60) AS elapsed,
last_modified::DATE AS day, user_id || '/' || filename AS key, filename AS name_of_key, round(size / 1e9, 2) AS gb, 'files_' || CASE WHEN size % 3 = 1 THEN 'one' ELSE 'other' END AS plural,
replace('{{name}} of {{who}}', '{{name}}', filename) AS filled FROM files_docs""", ("files_docs",))
def expr_files(spark, sf_dir):
    name, size = F.col("filename"), F.col("size")
    key = fn.join_key(F.col("user_id"), name)
    epoch = F.col("last_modified").cast("timestamp").cast("long")
    return v.files_docs(spark, sf_dir).select(
        "user_id", "filename", fn.output_stem(name).alias("stem"), fn.size_label(size).alias("size_label"), fn.elapsed_label(size).alias("elapsed"),
        fn.epoch_date(epoch).alias("day"), key.alias("key"), fn.key_filename(key).alias("name_of_key"), fn.gigabytes(size).alias("gb"),
        fn.plural_key(F.lit("files"), size % 3).alias("plural"),
        fn.fill_placeholders(F.lit("{{name}} of {{who}}"), F.create_map(F.lit("name"), name)).alias("filled"),
    )


@_query("""SELECT id, string_split(name, ' ')[1] AS first_name, coalesce(nullif(upper(substr(name, 1, 1)), ''), 'U') AS initial, lower(trim(email)) AS normal,
regexp_matches(email, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]{2,}$') AS is_email, 2::INT AS n_parts, CASE WHEN name LIKE '%1' THEN 'rtl' ELSE 'ltr' END AS direction, trim(name) AS stripped FROM users""", ("users",))
def expr_users_labels(spark, sf_dir):
    name, email = F.col("name"), F.col("email")
    padded = F.concat(F.lit("  "), name, F.lit("\t "))
    return v.users(spark, sf_dir).select(
        "id", fn.first_name(name).alias("first_name"), fn.initial(name).alias("initial"), fn.normal_email(email).alias("normal"), fn.is_email(email).alias("is_email"),
        F.size(fn.comma_list(F.concat(name, F.lit(", ,"), email))).alias("n_parts"), fn.text_direction(F.when(name.endswith("1"), "ar").otherwise("en")).alias("direction"), fn.full_strip(padded).alias("stripped"),
    )


def queries() -> dict[str, Query]:
    return _QUERIES | streams.queries()


def oracle_sql() -> dict[str, str]:
    return _SQL | streams.STREAM_SQL
