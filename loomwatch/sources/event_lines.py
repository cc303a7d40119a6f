"""A Spark data source of text lines with their byte offsets, for batches and streams.

``spark.read.format("event_lines").load(path)`` gives (file, offset, position,
line). ``offset`` is where a line begins in its file. ``position`` is where it
begins in all files of the folder tree put one behind the other in the order of
their paths, so it orders the lines of a capture without a window or an id that
depends on tasks. Files are cut into splits of ``split_bytes``, or of more where
these would be more than ``most_splits`` (for each file one at least), so that
small splits don't become tasks without number; a split reads the lines that
begin in it, whichever split they end in. Of a stream, which sees
files come and grow, ``position`` is null, and a line is read once its line feed
is there.

Paths are local ones or URIs that pyarrow's file systems know (file, hdfs, s3,
gs); files are plain text, one line feed after each line, a carriage return
before it is dropped. Bytes that aren't UTF-8 become replacement characters.
Empty files and empty folders give no rows. The driver lists files and sizes
only; a stream's offset has one number for each file.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, offset long, position long, line string"
_CHUNK = 4 << 20


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    if "://" not in path and not path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path)


def listed(path: str) -> list[tuple[str, int]]:
    """Files of a folder tree, or a single file, with their sizes in the order of their paths; hidden ones are left out."""
    fs, at = file_system(path)
    info = fs.get_file_info(at)
    if info.type == pyarrow.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pyarrow.fs.FileType.File:
        return [(at, info.size)]
    found = fs.get_file_info(pyarrow.fs.FileSelector(at, recursive=True))
    below = lambda f: f.path[len(at) :].lstrip("/").split("/")
    return sorted((f.path, f.size) for f in found if f.type == pyarrow.fs.FileType.File and not any(p.startswith(("_", ".")) for p in below(f)))


@dataclass
class Split(InputPartition):
    file: str
    start: int
    end: int
    base: int | None  # bytes of all files before this one


def splits(files: list[tuple[str, int, int]], size: int, with_base: bool) -> list[Split]:
    """Splits of (file, from, to) stretches."""
    out, base = [], 0
    for file, start, end in files:
        out += [Split(file, at, min(at + size, end), base if with_base else None) for at in range(start, end, size)]
        base += end
    return out


def lines_of(fs: pyarrow.fs.FileSystem, split: Split, end_of_file: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of the lines that begin in a split. With ``end_of_file`` the file counts as ending there."""
    with fs.open_input_file(split.file) as f:
        size = f.size() if end_of_file is None else end_of_file
        at = max(split.start - 1, 0)
        f.seek(at)
        held = b""
        if split.start:  # a line that began before belongs to the split before
            while True:
                chunk = f.read(min(_CHUNK, size - at))
                if not chunk:
                    return
                feed = chunk.find(b"\n")
                if feed >= 0:
                    held, at = chunk[feed + 1 :], at + feed + 1
                    break
                at += len(chunk)
        while at < split.end:  # ``held`` begins at ``at``
            read = at + len(held)
            chunk = f.read(max(0, min(_CHUNK, size - read)))
            held += chunk
            last = held.rfind(b"\n")
            if last < 0 and chunk:
                continue
            whole, rest = (held[:last], held[last + 1 :]) if last >= 0 else (held, b"")
            if not chunk and last >= 0 and rest:  # the last line has no line feed
                whole, rest = held, b""
            if whole or last >= 0:
                yield from _batch(split, at, whole)
            at += len(whole) + (last >= 0 and len(whole) == last)
            held = rest
            if not chunk and not held:
                return


def _batch(split: Split, at: int, whole: bytes) -> Iterator[pa.RecordBatch]:
    lines = whole.split(b"\n")
    starts = at + np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines])[:-1]]).astype(np.int64)
    n = int(np.searchsorted(starts, split.end))
    if n:
        text = [x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines[:n]]
        position = pa.nulls(n, pa.int64()) if split.base is None else pa.array(starts[:n] + split.base)
        yield pa.RecordBatch.from_arrays([pa.array([split.file] * n), pa.array(starts[:n]), position, pa.array(text, pa.string())], names=["file", "offset", "position", "line"])


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("split_bytes", 64 << 20))
        self.most = int(options.get("most_splits", 1 << 12))

    def partitions(self) -> list[Split]:
        files = listed(self.path)
        size = max(self.size, -(-sum(n for _, n in files) // self.most))
        return splits([(f, 0, n) for f, n in files], size, True) or [Split("", 0, 0, 0)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if split.end:
            yield from lines_of(file_system(self.path)[0], split)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("split_bytes", 64 << 20))
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def _whole_lines(self, fs: pyarrow.fs.FileSystem, file: str, size: int, known: int) -> int:
        """The end of the last line that has its line feed."""
        with fs.open_input_file(file) as f:
            hi = size
            while hi > known:
                lo = max(known, hi - (1 << 16))
                f.seek(lo)
                feed = f.read(hi - lo).rfind(b"\n")
                if feed >= 0:
                    return lo + feed + 1
                hi = lo
        return known

    def latestOffset(self) -> dict:
        fs = file_system(self.path)[0]
        for file, size in listed(self.path):
            known = self.seen.get(file, 0)
            self.seen[file] = self._whole_lines(fs, file, size, known) if size > known else known
        return {"files": json.dumps(self.seen, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        a, b = json.loads(start["files"]), json.loads(end["files"])
        return splits([(f, a.get(f, 0), n) for f, n in sorted(b.items()) if n > a.get(f, 0)], self.size, False)

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        # A stretch of whole lines begins right behind a line feed, so reading from its start is safe for later files too.
        yield from lines_of(file_system(self.path)[0], split)

    def commit(self, end: dict) -> None:
        self.seen = json.loads(end["files"]) | self.seen


class EventLines(DataSource):
    """``format("event_lines")``: options ``path``, ``split_bytes`` and, of batches, ``most_splits``."""

    @classmethod
    def name(cls) -> str:
        return "event_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self.options)


def read_lines(spark: SparkSession, path: str, split_bytes: int = 64 << 20, most_splits: int | None = None):
    """(file, offset, position, line) of a file or folder tree, in at most about eight splits for each core if ``most_splits`` isn't given."""
    spark.dataSource.register(EventLines)
    most = most_splits or 8 * max(8, spark.sparkContext.defaultParallelism)
    return spark.read.format("event_lines").option("split_bytes", split_bytes).option("most_splits", most).load(path)


def stream_lines(spark: SparkSession, path: str, split_bytes: int = 64 << 20):
    """The same of files as they come and grow."""
    spark.dataSource.register(EventLines)
    return spark.readStream.format("event_lines").option("split_bytes", split_bytes).load(path)
