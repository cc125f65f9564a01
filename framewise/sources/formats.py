"""Spark data sources: packet files with frame pushdown, and a journal sink with admission and commits."""

from __future__ import annotations

import json
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from .packets import SCHEMA, decode, frames

#: Rows of a stream that a task of a batch admits, if not told otherwise.
CAPACITY = 1024


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or local path, and the path in it."""
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class PacketFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class PacketReader(DataSourceReader):
    """One task a file. Filters on frame reach the reader: frames outside are neither inflated nor decoded."""

    def __init__(self, path: str):
        self.path, self.low, self.high = path, 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            bound = f.value if getattr(f, "attribute", None) == ("frame",) and isinstance(getattr(f, "value", None), int) else None
            if bound is None or not isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                yield f
                continue
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, bound + isinstance(f, GreaterThan))
            if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                end = bound + (not isinstance(f, LessThan))
                self.high = end if self.high is None else min(self.high, end)

    def partitions(self) -> list[InputPartition]:
        store, path = _store(self.path)
        found = store.get_file_info(path)
        files = store.get_file_info(fs.FileSelector(path, recursive=True)) if found.type == fs.FileType.Directory else [found]
        return [PacketFile(f.path) for f in sorted(files, key=lambda f: f.path) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]

    def read(self, partition: PacketFile) -> Iterator[tuple]:
        store, _ = _store(self.path)
        with store.open_input_stream(partition.path) as s:
            data = s.read()
        inside = range(self.low, 1 << 31 if self.high is None else self.high)
        try:
            parts = frames(data)
        except ValueError as e:
            if 0 in inside:
                yield (partition.path, 0, None, None, None, None, None, str(e))
            return
        for k, part in enumerate(parts):
            if k in inside:
                try:
                    rgb, depth, said = decode(part)
                    yield (partition.path, k, json.dumps(said), rgb.shape[0], rgb.shape[1], rgb.tobytes(), depth.astype("<u2").tobytes(), None)
                except (ValueError, zlib.error) as e:
                    yield (partition.path, k, None, None, None, None, None, str(e) or "broken")


class PacketSource(DataSource):
    """format("framewise_packets"): (path, frame, metadata, height, width, rgb, depth, error) of a packet file, or of all in a folder.

    A broken frame gives a row with its error, and so does a broken batch.
    """

    @classmethod
    def name(cls) -> str:
        return "framewise_packets"

    def schema(self) -> str:
        return f"path string, {SCHEMA}"

    def reader(self, schema) -> DataSourceReader:
        return PacketReader(self.options["path"])


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: its file, if it admitted rows, and rows admitted and dropped by stream."""

    file: str | None
    admitted: dict[str, int]
    dropped: dict[str, int]


class JournalWriter(DataSourceStreamWriter):
    """Each task admits rows of a stream up to a capacity and counts the others; a batch counts once its commit file stands."""

    def __init__(self, path: str, capacity: int):
        self.path, self.capacity = path.rstrip("/"), capacity

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, path = _store(self.path)
        admitted, dropped, lines = Counter(), Counter(), []
        name = f"{uuid.uuid4().hex}.jsonl"
        store.create_dir(f"{path}/rows", recursive=True)
        with store.open_output_stream(f"{path}/rows/{name}") as out:
            for row in iterator:
                said = row.asDict(recursive=True)
                stream = str(said.get("stream"))
                if admitted[stream] >= self.capacity:
                    dropped[stream] += 1
                    continue
                admitted[stream] += 1
                lines.append(json.dumps(said, default=str, separators=(",", ":")))
                if len(lines) >= CAPACITY:
                    out.write(("\n".join(lines) + "\n").encode())
                    lines.clear()
            if lines:
                out.write(("\n".join(lines) + "\n").encode())
        if not admitted:
            store.delete_file(f"{path}/rows/{name}")
        return Written(name if admitted else None, dict(admitted), dict(dropped))

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        store, path = _store(self.path)
        store.create_dir(f"{path}/commits", recursive=True)
        done = [m for m in messages if m is not None]
        said = [{"batch": batchId, "file": m.file, "stream": s, "admitted": m.admitted.get(s, 0), "dropped": m.dropped.get(s, 0)} for m in done for s in sorted({*m.admitted, *m.dropped})]
        with store.open_output_stream(f"{path}/commits/.{batchId}") as out:
            out.write("".join(json.dumps(x) + "\n" for x in said).encode())
        store.move(f"{path}/commits/.{batchId}", f"{path}/commits/{batchId}.json")

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        store, path = _store(self.path)
        for m in messages:
            if m is not None and m.file:
                store.delete_file(f"{path}/rows/{m.file}")


class JournalSink(DataSource):
    """format("framewise_journal") for writeStream: JSON lines of rows with a column stream, under path; option capacity."""

    @classmethod
    def name(cls) -> str:
        return "framewise_journal"

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return JournalWriter(self.options["path"], int(self.options.get("capacity", CAPACITY)))


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PacketSource)
    spark.dataSource.register(JournalSink)


def journal_counts(spark: SparkSession, path: str) -> DataFrame:
    """(stream, admitted, dropped) over the committed batches; a batch that was committed again counts once."""
    commits = spark.read.schema("batch long, file string, stream string, admitted long, dropped long").json(f"{path}/commits/*.json")
    return commits.groupBy("stream").agg(F.sum("admitted").alias("admitted"), F.sum("dropped").alias("dropped"))


def journal_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the files that a commit names, with their batch; files of batches that were never committed don't count."""
    commits = spark.read.schema("batch long, file string").json(f"{path}/commits/*.json").where("file is not null").select("batch", "file").distinct()
    rows = spark.read.schema(schema).json(f"{path}/rows").withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    return rows.join(commits, "file").drop("file")
