"""FASTA as a data source: `spark.read.format("fasta")`, `readStream` and `write`, once it is registered.

A read is planned as splits of files by bytes; a split has the records whose header begins in it, so one file of any size is read by many tasks. Records are known by file and byte offset, which are in the order of the files. A range
of these can be given as options, which leaves out whole splits; filters aren't pushed down, as Spark 4.1 keeps a pushed filter for later reads of the same frame. A stream takes files as they come, in the order of their times and names. A write gives each task's file its name only when all have ended.

Paths are those that pyarrow's file systems open (local ones, file://, s3://, gs://, hdfs:// ...).
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow.fs as fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

SCHEMA = "file string, offset long, name string, seq string, length int"
#: Bytes of a split, and bytes read at once.
SPLIT, READ = 32 << 20, 1 << 20


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    """The file system of a path and its files: itself, or all in the folder whose names don't begin with _ or a dot, in the order of names."""
    system, where = _system(path)
    info = system.get_file_info(where)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(where)) if f.type == fs.FileType.File and f.base_name[0] not in "_."]
    return system, sorted(found, key=lambda f: f.path)


def records(stream, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, record without its >) of all records of an open file whose > stands at a line's start in [start, end)."""
    at = max(0, start - 1)
    stream.seek(at)
    held, begin = b"", None  # the record that began at `begin`, as far as it was read
    if start == 0:
        held = b"\n"
        at = -1
    place = at
    while True:
        found = held.find(b"\n>", 0 if begin is None else 1)
        if found >= 0:
            if begin is not None:
                yield begin, held[2:found]
            begin = place + found + 1
            held, place = held[found:], place + found
            if begin >= end:
                return
            continue
        more = stream.read(READ)
        if not more:
            break
        if begin is None and len(held) > 1:  # nothing of it matters but whether a line ends there
            place += len(held) - 1
            held = held[-1:]
            if place + 1 >= end:
                return
        held += more
    if begin is not None:
        yield begin, held[2:]


def _row(path: str, offset: int, record: bytes) -> tuple:
    name, _, rest = record.decode("utf-8", "replace").partition("\n")
    seq = "".join(rest.split())
    return path, offset, name.rstrip("\r"), seq, len(seq)


class _Reads:
    path: str

    def read(self, partition: Split) -> Iterator[tuple]:
        with _system(self.path)[0].open_input_file(partition.path) as stream:
            for offset, record in records(stream, partition.start, partition.end):
                yield _row(partition.path, offset, record)

    def splits(self, files: Iterable[fs.FileInfo], size: int) -> list[Split]:
        return [Split(f.path, start, min(start + size, f.size)) for f in files for start in range(0, f.size, size)]


class FastaReader(_Reads, DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("split", SPLIT))
        self.file, self.low, self.high = options.get("file"), int(options.get("from", 0)), int(options["to"]) if "to" in options else None

    def partitions(self) -> Sequence[Split]:
        every = self.splits((f for f in _files(self.path)[1] if not self.file or posixpath.basename(f.path) == self.file), self.size)
        return [s for s in every if s.end > self.low and (self.high is None or s.start < self.high)] or [Split("", 0, 0)]

    def read(self, partition: Split) -> Iterator[tuple]:
        rows = super().read(partition) if partition.path else iter(())
        return (r for r in rows if r[1] >= self.low and (self.high is None or r[1] < self.high))


class FastaStream(_Reads, DataSourceStreamReader):
    """An offset is the time and the name of the last file taken."""

    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("split", SPLIT))

    def _known(self) -> list[tuple[list, fs.FileInfo]]:
        return sorted((([f.mtime_ns or 0, f.path], f) for f in _files(self.path)[1]), key=lambda x: x[0])

    def initialOffset(self) -> dict:
        return {"last": json.dumps([0, ""])}

    def latestOffset(self) -> dict:
        known = self._known()
        return {"last": json.dumps(known[-1][0])} if known else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> Sequence[Split]:
        low, high = json.loads(start["last"]), json.loads(end["last"])
        return self.splits((f for key, f in self._known() if low < key <= high), self.size)


class FastaWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool, columns: list[str]):
        self.path, self.width, self.overwrite, self.columns = options["path"], int(options.get("width", 60)), overwrite, columns

    def write(self, iterator: Iterator[Row]) -> Written:
        from pyspark import TaskContext

        system, where = _system(self.path)
        system.create_dir(where, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05}-{uuid.uuid4().hex}.fa"
        message = Written(posixpath.join(where, f"_{name}"), posixpath.join(where, name))
        with system.open_output_stream(message.temporary) as out:
            for row in iterator:
                seq = row["seq"] or ""
                if seq.startswith(">"):
                    raise ValueError("a sequence that begins with > can't be told from a header")
                wrapped = "\n".join(seq[i : i + self.width] for i in range(0, len(seq), self.width)).replace("\n>", ">")  # no line may begin like a header
                out.write((f">{row['name'] or ''}\n" + wrapped + "\n" * bool(seq)).encode())
        return message

    def commit(self, messages: list[Written | None]) -> None:
        system, where = _system(self.path)
        system.create_dir(where, recursive=True)
        if self.overwrite:
            for f in _files(self.path)[1]:
                system.delete_file(f.path)
        for m in filter(None, messages):
            system.move(m.temporary, m.final)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = _system(self.path)
        for m in filter(None, messages):
            system.delete_file(m.temporary)


class FastaSource(DataSource):
    """Columns file, offset (of the header, in bytes), name, seq, length; written are name and seq. Options: split (bytes), file (a name), from and to (offsets), width (letters of a line)."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FastaReader:
        return FastaReader(self.options)

    def streamReader(self, schema: StructType) -> FastaStream:
        return FastaStream(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> FastaWriter:
        if not {"name", "seq"} <= set(schema.names):
            raise ValueError("FASTA needs the columns name and seq")
        return FastaWriter(self.options, overwrite, schema.names)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(FastaSource)
