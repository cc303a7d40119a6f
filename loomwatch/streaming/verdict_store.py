"""A committed store of verdicts: a Spark data source that writes batches once and reads what is committed.

``writeStream.format("verdict_store")`` and ``write.format("verdict_store")``
write Parquet files in tasks. A batch becomes visible by one small file that
names its parts, written under its batch number after all tasks are done. When
a micro-batch is run again after a crash, its number is there already and the
new parts are taken away: no row appears twice, and none is lost, since a
batch without its commit is run again by Spark. A batch write takes the number
of its ``batch`` option, so a job that is repeated writes once as well.

``read_store`` gives Spark the committed files; parts of tasks that failed are
never named. Paths are local ones or URIs that pyarrow's file systems know; a
commit is made by renaming a finished file, which such stores do at once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from loomwatch.sources.event_lines import file_system


@dataclass
class Part(WriterCommitMessage):
    file: str | None
    rows: int


def _commit_file(root: str, batch: str) -> str:
    return f"{root}/_commits/{batch}.json"


def _exists(fs: pyarrow.fs.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type == pyarrow.fs.FileType.File


class _Parts:
    """What batch and stream writers share."""

    def __init__(self, options: dict, schema: StructType):
        self.path = options["path"]
        self.batch = options.get("batch")
        self.schema = schema

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        fs, root = file_system(self.path)
        name, writer, rows = f"data/{uuid.uuid4().hex}.parquet", None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                fs.create_dir(f"{root}/data", recursive=True)
                writer = pq.ParquetWriter(f"{root}/{name}", batch.schema, filesystem=fs)
            writer.write_batch(batch)
            rows += batch.num_rows
        if writer is None:
            return Part(None, 0)
        writer.close()
        return Part(name, rows)

    def _commit(self, parts: list[Part | None], batch: str) -> None:
        fs, root = file_system(self.path)
        named = [p for p in parts if p and p.file]
        if _exists(fs, _commit_file(root, batch)):
            self._drop(named)
            return
        fs.create_dir(f"{root}/_commits", recursive=True)
        made = f"{root}/_commits/.{uuid.uuid4().hex}"
        with fs.open_output_stream(made) as f:
            f.write(json.dumps({"files": [p.file for p in named], "rows": sum(p.rows for p in named)}).encode())
        fs.move(made, _commit_file(root, batch))

    def _drop(self, parts: list[Part | None]) -> None:
        fs, root = file_system(self.path)
        for p in parts:
            if p and p.file and _exists(fs, f"{root}/{p.file}"):
                fs.delete_file(f"{root}/{p.file}")


class _BatchWriter(_Parts, DataSourceArrowWriter):
    def commit(self, messages: list[Part | None]) -> None:
        self._commit(messages, str(self.batch or uuid.uuid4().hex))

    def abort(self, messages: list[Part | None]) -> None:
        self._drop(messages)


class _StreamWriter(_Parts, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Part | None], batchId: int) -> None:
        self._commit(messages, f"{self.batch or 'stream'}-{batchId}")

    def abort(self, messages: list[Part | None], batchId: int) -> None:
        self._drop(messages)


class VerdictStore(DataSource):
    """``format("verdict_store")``: options ``path`` and ``batch`` (a batch's name, or a stream's)."""

    @classmethod
    def name(cls) -> str:
        return "verdict_store"

    def writer(self, schema: StructType, overwrite: bool) -> _BatchWriter:
        if overwrite:
            raise ValueError("a verdict store is only appended to")
        return _BatchWriter(self.options, schema)

    def streamWriter(self, schema: StructType, overwrite: bool) -> _StreamWriter:
        return _StreamWriter(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VerdictStore)


def append_batch(rows: DataFrame, path: str, batch: str) -> None:
    """Write ``rows`` as the batch of this name; if it is committed already, nothing changes."""
    register(rows.sparkSession)
    rows.write.format("verdict_store").option("batch", batch).mode("append").save(path)


def committed(path: str) -> dict[str, dict]:
    """Committed batches by name, with their files and rows."""
    fs, root = file_system(path)
    out = {}
    for f in fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/_commits", allow_not_found=True)):
        if f.base_name.endswith(".json"):
            with fs.open_input_file(f.path) as stream:
                out[f.base_name.removesuffix(".json")] = json.loads(stream.read())
    return out


def read_store(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The rows of all committed batches."""
    files = [f"{path.rstrip('/')}/{f}" for batch in committed(path).values() for f in batch["files"]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
