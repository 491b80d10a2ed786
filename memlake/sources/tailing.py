"""A data source that follows log files as they grow: new whole lines only, by byte."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes read at a time, and bytes of one task.
BLOCK, SPLIT = 1 << 20, 64 << 20
SCHEMA = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("line", pa.string())])


@dataclass
class Range(InputPartition):
    """Lines of a file that begin in [low, high); reading may go on to ``end``. ``first`` is where a line is known to begin."""

    path: str
    first: int
    low: int
    high: int
    end: int


class Files:
    """The files below a folder, on any file system that Arrow opens by its URI."""

    def __init__(self, root: str, pattern: str):
        self.fs, self.root = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)
        self.pattern = pattern

    def sizes(self) -> dict[str, int]:
        found = self.fs.get_file_info(pafs.FileSelector(self.root, recursive=True, allow_not_found=True))
        return {f.path: f.size for f in found if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, self.pattern)}

    def whole(self, path: str, low: int, size: int) -> int:
        """Where the last whole line of [low, size) ends; ``low`` if there is none. Looks back from the end, block by block."""
        with self.fs.open_input_file(path) as f:
            high = size
            while high > low:
                at = max(low, high - BLOCK)
                f.seek(at)
                cut = f.read(high - at).rfind(b"\n")
                if cut >= 0:
                    return at + cut + 1
                high = at
        return low

    def lines(self, part: Range) -> Iterator[tuple[int, bytes]]:
        """(offset, line) of a range, without line ends; a line over the border belongs to the range it begins in."""
        with self.fs.open_input_file(part.path) as f:
            at = part.low if part.low == part.first else part.low - 1
            f.seek(at)
            rest, skip = b"", part.low != part.first
            while at < part.end:
                data = f.read(min(BLOCK, part.end - at - len(rest)))
                if not data:
                    break
                pieces = (rest + data).split(b"\n")
                for piece in pieces[:-1]:
                    if not skip and at >= part.high:
                        return
                    if not skip:
                        yield at, piece
                    skip, at = False, at + len(piece) + 1
                rest = pieces[-1]
            if rest and not skip and at < part.high:
                yield at, rest


def ranges(path: str, low: int, high: int, split: int) -> list[Range]:
    return [Range(path, low, a, min(a + split, high), high) for a in range(low, high, split)]


def _read(files: Files, part: Range):
    rows = [[], [], []]
    held = 0
    for at, line in files.lines(part):
        if line.strip():
            text = line.decode("utf-8", "replace").removesuffix("\r")
            for column, value in zip(rows, (part.path, at, text)):
                column.append(value)
            held += len(line)
        if held > 4 * BLOCK:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, SCHEMA.types)], schema=SCHEMA)
            rows, held = [[], [], []], 0
    if rows[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, SCHEMA.types)], schema=SCHEMA)


class Batch(DataSourceReader):
    """All lines that are there, a last one without its line end too."""

    def __init__(self, options):
        self.files, self.split = Files(options["path"], options.get("pattern", "*")), int(options.get("split", SPLIT))

    def partitions(self):
        return [part for path, size in sorted(self.files.sizes().items()) for part in ranges(path, 0, size, self.split)] or [Range("", 0, 0, 0, 0)]

    def read(self, part):
        return iter(()) if not part.path else _read(self.files, part)


class Stream(DataSourceStreamReader):
    """Offsets are maps of file to the byte after its last whole line, so a line half written waits until it ends. Of a
    file only what is past the offset is read, in ranges that are tasks of their own. A file that is shorter than its
    offset was replaced and is read anew; one that is gone is forgotten."""

    def __init__(self, options):
        self.files, self.split = Files(options["path"], options.get("pattern", "*")), int(options.get("split", SPLIT))
        self.seen: dict[str, tuple[int, int]] = {}

    def initialOffset(self):
        return {}

    def latestOffset(self):
        now = {}
        for path, size in sorted(self.files.sizes().items()):
            before, whole = self.seen.get(path, (0, 0))
            if size < before:
                before, whole = 0, 0
            now[path] = (size, whole if size == before else self.files.whole(path, whole, size))
        self.seen = now
        return {path: whole for path, (_, whole) in now.items() if whole}

    def partitions(self, start, end):
        parts = []
        for path, high in sorted(end.items()):
            low = start.get(path, 0)
            parts += ranges(path, low if low <= high else 0, high, self.split)
        return parts or [Range("", 0, 0, 0, 0)]

    def read(self, part):
        return iter(()) if not part.path else _read(self.files, part)

    def commit(self, end):
        pass


class LogTail(DataSource):
    """Format ``log_tail``: (path, offset, line) of the files below option ``path`` whose names fit ``pattern``. Blank lines
    go; bytes that are not UTF-8 are replaced. ``split`` bounds the bytes of a task."""

    @classmethod
    def name(cls):
        return "log_tail"

    def schema(self):
        return "path string, offset long, line string"

    def reader(self, schema):
        return Batch(self.options)

    def streamReader(self, schema):
        return Stream(self.options)


def _options(folder: str, pattern: str, split: int) -> dict[str, str]:
    return {"path": folder, "pattern": pattern, "split": str(split)}


def read_logs(spark: SparkSession, folder: str, pattern: str = "*.jsonl", split: int = SPLIT) -> DataFrame:
    """(path, offset, line) of log files; a large file is read by many tasks."""
    spark.dataSource.register(LogTail)
    return spark.read.format("log_tail").options(**_options(folder, pattern, split)).load()


def follow_logs(spark: SparkSession, folder: str, pattern: str = "*.jsonl", split: int = SPLIT) -> DataFrame:
    """The same as a stream: each micro-batch has the lines that were finished since the one before."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").options(**_options(folder, pattern, split)).load()
