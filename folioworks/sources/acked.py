"""A task queue in a folder as a streaming source of its own: messages in order of arrival, acknowledged when their batch is done.

Each file of the folder is a message with a task on each line. What is handed out is numbered in a journal beside the
messages (_delivery), and an offset is such a number, so a batch that is run again gets the same messages whatever has
arrived since. Spark commits an offset when the batch that ends there is in its log and the next one begins: then the
messages go, so those of the last batch stay until another comes. One stream at a time reads a queue.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

JOURNAL = "_delivery"
TAKEN, ACKED = "taken", "acked"
LINES_A_BATCH = 10_000


class Queue:
    """The folder and its journal: files number.taken that hold a message's name, and number.acked for all up to that number."""

    def __init__(self, path: str):
        self.files, self.root = fs.FileSystem.from_uri(re.sub("^file:/+", "/", path))
        self.journal = f"{self.root}/{JOURNAL}"

    def _listed(self, folder: str) -> list[fs.FileInfo]:
        return [x for x in self.files.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if x.is_file]

    def numbers(self, kind: str) -> list[int]:
        names = (x.base_name.split(".") for x in self._listed(self.journal))
        return sorted(int(x[0]) for x in names if len(x) == 2 and x[1] == kind)

    def _entry(self, number: int, kind: str) -> str:
        return f"{self.journal}/{number:012d}.{kind}"

    def _write(self, number: int, kind: str, text: str) -> None:
        """Written beside and moved, so that an entry is whole or not there."""
        self.files.create_dir(self.journal)
        with self.files.open_output_stream(f"{self._entry(number, kind)}.part") as out:
            out.write(text.encode())
        self.files.move(f"{self._entry(number, kind)}.part", self._entry(number, kind))

    def name(self, number: int) -> str:
        with self.files.open_input_stream(self._entry(number, TAKEN)) as entry:
            return entry.read().decode()

    def acknowledged(self) -> int:
        return max(self.numbers(ACKED), default=0)

    def take(self, most: int) -> int:
        """Number the next messages, the oldest first, most of them at most. Returns the last number given out so far."""
        done = self.acknowledged()
        self._forget(done)
        taken = self.numbers(TAKEN)
        last = max([done, *taken])
        known = {self.name(n) for n in taken}
        waiting = [x for x in self._listed(self.root) if not x.base_name.startswith(("_", ".")) and x.base_name not in known]
        for x in sorted(waiting, key=lambda x: (x.mtime_ns, x.base_name))[:most]:
            last += 1
            self._write(last, TAKEN, x.base_name)
        return last

    def acknowledge(self, end: int) -> None:
        """The mark comes first: whatever ends this half way, nothing up to end is handed out again, and the next call goes on."""
        if end > self.acknowledged():
            self._write(end, ACKED, "")
        self._forget(end)

    def _forget(self, end: int) -> None:
        for n in self.numbers(TAKEN):
            if n <= end:
                message = f"{self.root}/{self.name(n)}"
                if self.files.get_file_info(message).is_file:
                    self.files.delete_file(message)
                self.files.delete_file(self._entry(n, TAKEN))
        for n in self.numbers(ACKED):
            if n < end:
                self.files.delete_file(self._entry(n, ACKED))

    def tasks(self, name: str) -> Iterator[pa.RecordBatch]:
        """The lines of a message; ts is when it arrived, the same however often it is read."""
        at = self.files.get_file_info(f"{self.root}/{name}").mtime_ns
        with self.files.open_input_stream(f"{self.root}/{name}") as raw:
            lines = (x.removesuffix("\n") for x in io.TextIOWrapper(raw, encoding="utf-8", errors="replace", newline="\n"))
            while chunk := list(islice(lines, LINES_A_BATCH)):
                times = pa.array([at // 1000] * len(chunk), pa.timestamp("us", tz="UTC"))
                yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.string()), times, pa.array([name] * len(chunk), pa.string())], names=["value", "ts", "message"])


class Message(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)


class TaskReader(DataSourceStreamReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def initialOffset(self) -> dict:
        return {"number": Queue(self.path).acknowledged()}

    def latestOffset(self) -> dict:
        return {"number": Queue(self.path).take(self.most)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        queue = Queue(self.path)
        return [Message(queue.name(n)) for n in range(start["number"] + 1, end["number"] + 1)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return Queue(self.path).tasks(partition.value)

    def commit(self, end: dict) -> None:
        Queue(self.path).acknowledge(end["number"])


class TaskQueue(DataSource):
    """Format task_queue; options path and messages_a_batch (1)."""

    @classmethod
    def name(cls) -> str:
        return "task_queue"

    def schema(self) -> str:
        return "value string, ts timestamp, message string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return TaskReader(self.options["path"], int(self.options.get("messages_a_batch", "1")))
