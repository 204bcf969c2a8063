"""Reading input tables, and intermediate tables as Parquet in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from folioworks.session import ship_package

ROWS_A_SLICE, BYTES_A_SLICE = 500, 4 << 20
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Held while a table is written: its query's shuffle files go when it ends, not when the driver happens to collect its
#: garbage, and Arrow batches of whole texts stay small on both sides of the pipe.
WHILE_WRITING = {_TIDY: "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def prepare(spark: SparkSession) -> None:
    """Give the workers this package. Settings of the session stay as they are."""
    ship_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = ROWS_A_SLICE, size: int = BYTES_A_SLICE) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of bounded rows and bytes (one row at least), so that a worker holds few texts as Python objects at once."""
    for batch in batches:
        each = max(1, min(rows, int(size * batch.num_rows / max(batch.nbytes, 1))))
        if not batch.num_rows:
            yield batch
        for first in range(0, batch.num_rows, each):
            yield batch.slice(first, each)


_ROOTS: dict[str, str] = {}
_OWNED: list[tuple[object, object]] = []  # Hadoop file system and path of folders that are still there
_NAMED: list[tuple[SparkSession, str]] = []  # tables that a catalog knows


def _root(spark: SparkSession) -> str:
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _ROOTS:
            _ROOTS[context.applicationId] = tempfile.mkdtemp(prefix="spark-scratch-")
        found = _ROOTS[context.applicationId]
    return found.rstrip("/")


def _path(spark: SparkSession, folder: str) -> tuple[object, object]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def discard() -> None:
    """Delete all intermediate tables of this application. Frames that operators returned before can't be read any more."""
    while _NAMED:
        spark, name = _NAMED.pop()
        with suppress(Exception):  # the driver's JVM may have ended
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    while _OWNED:
        files, path = _OWNED.pop()
        with suppress(Exception):
            files.delete(path, True)


atexit.register(discard)


class Scratch:
    """The intermediate tables of one operator, in a folder of their own.

    Each is written at once, which cuts lineage: a lost executor costs the step that runs, not those before. Tables are
    deleted as soon as a step says that no later one reads them; what the operator's result still reads goes with
    discard(), which also runs when the application ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.paths = spark, f"{_root(spark)}/folioworks-{uuid.uuid4().hex}", {}
        _OWNED.append(_path(spark, self.folder))

    @contextmanager
    def _held(self) -> Iterator[None]:
        """The caller's settings are as before afterwards."""
        before = {key: self.spark.conf.get(key, None) for key in WHILE_WRITING}
        for key, value in WHILE_WRITING.items():
            self.spark.conf.set(key, value)
        try:
            yield
        finally:
            for key, value in before.items():
                self.spark.conf.unset(key) if value is None else self.spark.conf.set(key, value)

    def keep(self, df: DataFrame) -> DataFrame:
        """Write df now, and return the stored rows."""
        folder = f"{self.folder}/{len(self.paths)}"
        with self._held():
            df.write.option("compression", "zstd").parquet(folder)
        stored = self.spark.read.schema(df.schema).parquet(folder)
        self.paths[id(stored)] = (folder, stored)
        return stored

    def keep_dealt(self, df: DataFrame, column: str, parts: int) -> DataFrame:
        """Write df dealt into parts by a hash of column, so that later steps on that column find its rows together without a shuffle."""
        folder, name = f"{self.folder}/{len(self.paths)}", f"folioworks_{uuid.uuid4().hex}"
        with self._held():
            df.write.format("parquet").option("compression", "zstd").option("path", folder).bucketBy(parts, column).saveAsTable(name)
        _NAMED.append((self.spark, name))
        stored = self.spark.table(name)
        self.paths[id(stored)] = (folder, stored)
        return stored

    def drop(self, *stored: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for df in stored:
            files, path = _path(self.spark, self.paths[id(df)][0])
            files.delete(path, True)


def stage_folder(spark: SparkSession) -> str:
    """A new folder for the tables that pipeline stages hand on; it goes with discard()."""
    return Scratch(spark).folder


def numbered(df: DataFrame, store: Scratch, file: str, row: str) -> DataFrame:
    """df with two more columns that tell its rows apart, alike each time that it is read: file and row number of a Parquet table.

    What is not the plain scan of one is written to the store first.
    """
    try:
        place = df.metadataColumn("_metadata")
        return df.select("*", place["file_path"].alias(file), place["row_index"].alias(row))
    except AnalysisException:
        return numbered(store.keep(df), store, file, row)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out
