"""Files, status sidecars and results in any file system that Spark reads (local folders and object stores alike)."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from folioworks.functions.text import full_strip
from folioworks.session import ship_package

# Bytes of contents in a batch of rows.
_BATCH_BYTES = 8 << 20


def _on_disk(spark: SparkSession, path: str) -> bool:
    system = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.getUri().getScheme() == "file"


def _local(spark: SparkSession, root: str) -> str | None:
    """The path of a plain folder in the local file system, which tasks then list and open themselves; null for any other root.

    Hadoop's local file system starts a process for each file that it writes, and Spark's index of a root keeps all files in the
    driver and deals them to tasks a few at a time.
    """
    if not _on_disk(spark, root) or re.search(r"[\\\[\]{}*?]", root):
        return None
    ship_package(spark)
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath()


def _shown(name: str) -> bool:
    """Whether Spark's file sources take a file or folder of this name."""
    return not (name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name)


def _dealt(rows: DataFrame, name: str) -> DataFrame:
    """rows dealt out by a column over all cores. The number of tasks is given: names are few bytes, by which adaptive execution would leave all files to a few tasks."""
    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism * 2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(tasks, F.col(name))


def _entries(folders: Iterator[str], base: str, deep: bool) -> Iterator[tuple[str, bool, int, int]]:
    """key below base, whether it is a folder, size and time in microseconds of what the folders hold, with all that is below them if deep."""
    waiting = list(folders)
    while waiting:
        folder = waiting.pop()
        with os.scandir(f"{base}/{folder}" if folder else base) as found:
            for e in found:
                if not _shown(e.name):
                    continue
                key = f"{folder}/{e.name}" if folder else e.name
                if e.is_dir():
                    if deep:
                        waiting.append(key)
                    else:
                        yield key, True, 0, 0
                elif e.is_file():
                    facts = e.stat()
                    yield key, False, facts.st_size, facts.st_mtime_ns // 1_000_000 * 1000


_ENTRY = pa.schema([("key", pa.string()), ("folder", pa.bool_()), ("size", pa.int64()), ("at", pa.int64())])


def _walk(spark: SparkSession, base: str) -> DataFrame:
    """key, size, at of all files with bytes below base. A task lists base, others the folders in it: none of it goes through the driver."""

    def listing(deep: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = []
            for batch in batches:
                for row in _entries(iter(batch.column(0).to_pylist()), base, deep):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_pylist([dict(zip(_ENTRY.names, r, strict=True)) for r in rows], _ENTRY)
                        rows = []
            yield pa.RecordBatch.from_pylist([dict(zip(_ENTRY.names, r, strict=True)) for r in rows], _ENTRY)

        return run

    schema = "key string, folder boolean, size long, at long"
    # First the files and folders in base; both are dealt out by name.
    first = spark.range(0, 1, 1, 1).select(F.lit("").alias("key")).mapInArrow(listing(False), schema)

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pc.invert(batch.column(1)))
            yield from listing(True)(iter([batch.filter(batch.column(1)).select(["key"])]))

    return _dealt(first, "key").mapInArrow(below, schema).filter("size > 0").select("key", "size", "at")


def _keyed(spark: SparkSession, base: str) -> DataFrame:
    """user_id, filename, path, size, last_modified of all files with bytes below a local folder."""
    at = F.timestamp_micros("at")
    path = F.concat(F.lit(f"file:{base.rstrip('/')}/"), "key")
    return _walk(spark, base).select(F.substring_index("key", "/", 1).alias("user_id"), F.regexp_replace("key", "^[^/]*/", "").alias("filename"), path.alias("path"), "size", at.alias("last_modified"))


def _opened(rows: DataFrame, path: str = "path") -> DataFrame:
    """rows with the content of the local file at path."""
    names = rows.columns
    at = names.index(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, contents, held = 0, [], 0
            for i, name in enumerate(batch.column(at).to_pylist()):
                with open(re.sub("^file:/*", "/", name), "rb") as f:
                    contents.append(f.read())
                held += len(contents[-1])
                if held >= _BATCH_BYTES or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*batch.slice(start, len(contents)).columns, pa.array(contents, pa.binary())], names=[*names, "content"])
                    start, contents, held = i + 1, [], 0

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("content", BinaryType())]))


def key_text(value: Column) -> Column:
    """A value as it stands in the name of a folder; plain_key takes it back."""
    return F.replace(F.replace(value.cast("string"), F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F"))


def plain_key(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("%2F"), F.lit("/")), F.lit("%25"), F.lit("%"))


def store_files(rows: DataFrame, root: str, keys: Sequence[str], ending: str = "txt", beside: bool = False) -> None:
    """rows: keys, text. Each row becomes one file with a line break after its text, below root in a folder of the form key=value for each key.

    Tasks write the files themselves in a local file system, else Spark's partitioned writer does. A file of the same keys is
    replaced; a task that runs again replaces what it wrote. With beside, tasks give a file the last key as its name, beside the others of its
    folder: half of what a file system keeps for a file in a folder of its own. Spark's writer names no files, it makes the folder.
    """
    spark = rows.sparkSession
    base = _local(spark, root)
    if base is None:
        out = rows.select(*keys, "text").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys)
        whole = out.option("extension", ending).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        return out.text(root) if ending == "txt" else whole.csv(root)
    folder = F.concat_ws("/", *[F.concat(F.lit(f"{k}="), F.coalesce(key_text(F.col(k)), F.lit("__HIVE_DEFAULT_PARTITION__"))) for k in keys])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                target = f"{base}/{key.as_py()}" + (f".{ending}" if beside else f"/part.{ending}")
                place = os.path.dirname(target)
                os.makedirs(place, exist_ok=True)
                own = f"{place}/.{uuid.uuid4().hex}"
                with open(own, "wb") as f:
                    f.write(text.as_py())
                    f.write(b"\n")
                os.replace(own, target)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    named = rows.select(folder.alias("folder"), F.encode("text", "UTF-8").alias("text"))
    os.makedirs(base, exist_ok=True)
    _dealt(named, "folder").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def _named(rows: DataFrame, root: str) -> DataFrame:
    """user_id is the first folder below root, filename all that follows it."""
    inside = F.regexp_replace(F.expr("url_decode(replace(path, '+', '%2B'))"), "^[a-z0-9]+:/+", "/")
    key = F.ltrim(F.expr("substring_index(inside, root_name, -1)"), F.lit("/"))
    base = root.split("://")[-1].rstrip("/").rsplit("/", 1)[-1]
    return (
        rows.withColumn("inside", inside)
        .withColumn("root_name", F.lit(f"/{base}/"))
        .withColumn("key", key)
        .withColumn("user_id", F.substring_index("key", "/", 1))
        .withColumn("filename", F.regexp_replace("key", "^[^/]*/", ""))
        .drop("inside", "root_name", "key")
    )


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """user_id, filename, size, last_modified of all files below root that have bytes; their content is not read."""
    if (base := _local(spark, root)) is not None:
        return _keyed(spark, base).drop("path")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    listed = found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))
    return _named(listed, root).select("user_id", "filename", "size", "last_modified")


def list_paths(spark: SparkSession, root: str) -> DataFrame:
    """user_id, filename, path of all files below root; their content is not read."""
    if (base := _local(spark, root)) is not None:
        return _keyed(spark, base).select("user_id", "filename", "path")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("path").alias("own"))
    return _named(found, root).select("user_id", "filename", F.col("own").alias("path"))


_SEEN = "user_id string, filename string, path string, size long, last_modified timestamp"


def _versions(spark: SparkSession, manifest: str) -> list[int]:
    """Complete versions of a manifest, in order."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(manifest)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    marks = system.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{manifest}/version=*/_SUCCESS"))
    return sorted(int(m.getPath().getParent().getName().removeprefix("version=")) for m in marks)


def scan_changes(spark: SparkSession, root: str, manifest: str) -> DataFrame:
    """user_id, filename, path, size, last_modified, change: what differs between the files below root and the manifest's last version.

    change is added, changed (size or time) or removed; a removed file has the size and time that it had. Every key is
    listed, by Spark in parallel; contents are only read of what load_contents is given, so a scan after a scan opens new
    and changed files alone. The listing is written as the manifest's next version, which is the state that the result and the
    next scan compare with: a scan that fails before it is complete leaves the manifest as it was.
    """
    versions = _versions(spark, manifest)
    now = f"{manifest}/version={versions[-1] + 1 if versions else 0}"
    if (base := _local(spark, root)) is not None:
        listed = _keyed(spark, base)
    else:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        facts = found.select("path", F.col("path").alias("own"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))
        listed = _named(facts, root).select("user_id", "filename", F.col("own").alias("path"), "size", "last_modified")
    listed.write.mode("overwrite").parquet(now)
    new = spark.read.schema(_SEEN).parquet(now)
    old = spark.read.schema(_SEEN).parquet(f"{manifest}/version={versions[-1]}") if versions else new.limit(0)
    both = new.alias("n").join(old.alias("o"), F.col("n.path") == F.col("o.path"), "full_outer")
    same = (F.col("n.size") == F.col("o.size")) & (F.col("n.last_modified") == F.col("o.last_modified"))
    change = F.when(F.col("o.path").isNull(), "added").when(F.col("n.path").isNull(), "removed").when(~same, "changed")
    return both.select(*[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in new.columns], change.alias("change")).filter("change is not null")


def load_contents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, content of these files and no others; signs that mean a pattern stand for themselves."""
    if paths and all(re.match("file:|/", p) for p in paths) and _on_disk(spark, paths[0]):
        ship_package(spark)
        tasks = min(spark.sparkContext.defaultParallelism * 2, len(paths))
        return _opened(spark.createDataFrame(spark.sparkContext.parallelize([(p,) for p in paths], tasks), "path string"))
    exact = [re.sub(r"([\\\[\]{}*?])", r"\\\1", p) for p in paths]
    return spark.read.format("binaryFile").load(exact).select("path", "content")


def same_path(a: Column, b: Column) -> Column:
    """Whether two spellings of a file's path are one: with or without the slashes of an empty authority."""
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")
    return plain(a) == plain(b)


def read_status(spark: SparkSession, root: str, ending: str = ".status") -> DataFrame:
    """user_id, filename, status from the status files beside documents, without the white space around it. Spark sees no file without bytes: its status is none."""
    if (base := _local(spark, root)) is not None:
        listed = _keyed(spark, base).filter(F.endswith("filename", F.lit(ending)))
        rows = _opened(_dealt(listed.select("user_id", "filename", "path"), "path")).withColumn("value", F.col("content").cast("string"))
    else:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{ending}").load(root)
        rows = _named(found.select(F.col("_metadata.file_path").alias("path"), F.col("content").cast("string").alias("value")), root)
    bare = F.expr(f"left(filename, length(filename) - {len(ending)})")
    return rows.select("user_id", bare.alias("filename"), full_strip(F.col("value")).alias("status"))


def load_pdf_bytes(spark: SparkSession, root: str, most_bytes: int = 50 * 1024 * 1024) -> DataFrame:
    """user_id, filename, content of PDF files; larger ones are left out before their content is read."""
    if (base := _local(spark, root)) is not None:
        listed = _keyed(spark, base).filter(F.endswith("filename", F.lit(".pdf")) & (F.col("size") <= most_bytes))
        return _opened(_dealt(listed.select("user_id", "filename", "path"), "path")).drop("path")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(root)
    small = found.filter(F.col("length") <= most_bytes).select("path", "content")
    return _named(small, root).select("user_id", "filename", "content")


def write_paragraphs(paragraphs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Result documents as paragraphs, a folder for each bucket of users."""
    paragraphs.withColumn("user_bucket", F.pmod(F.xxhash64("user_id"), F.lit(64))).write.mode(mode).partitionBy("user_bucket").parquet(path)
