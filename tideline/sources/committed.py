"""Logs with commits: each job's rows are there once and whole, or not at all.

    spark.dataSource.register(CommittedLog)
    df.write.format("tideline_log").option("path", folder).option("job", "2024-06-01").mode("append").save()
    stream.writeStream.format("tideline_log").option("path", folder).option("job", "lines").option(...)

Tasks write Parquet files under names of their own and hand on the names. When all are done, the driver
publishes the job by one small file, ``commits/<job>.json``, that names the files; it is written whole under
another name first. A job that is published already is left as it is, and what was written for it again is
removed; so a job that is killed, fails or is repeated leaves its rows once. Jobs of a stream are its
micro-batches. Readers see files that commits name and no others: what a
killed job leaves behind is never read, and ``vacuum`` removes it.

Paths are those of ``pyarrow.fs``: local ones, HDFS and object stores.
"""

from __future__ import annotations

import contextlib
import json
import re
import sys
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

# the processes that Spark starts for data sources don't have the files of the session
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Written(WriterCommitMessage):
    """The file of a task, without one if it had no rows."""

    file: str | None
    rows: int


@dataclass
class LogFile(InputPartition):
    """A file that a commit names."""

    file: str


class Log:
    """A folder with ``data`` and ``commits``."""

    def __init__(self, path: str) -> None:
        self.uri = path
        whole = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
        self.files, self.folder = fs.FileSystem.from_uri(whole)

    def commits(self) -> list[dict]:
        """What has been published, in the order of the jobs' names."""
        found = self.files.get_file_info(fs.FileSelector(f"{self.folder}/commits", allow_not_found=True))
        read = []
        for x in sorted(found, key=lambda x: x.path):
            if x.path.endswith(".json"):
                with self.files.open_input_file(x.path) as file:
                    read.append(json.loads(file.read()))
        return read

    def published(self, job: str) -> bool:
        return self.files.get_file_info(self.place(job)).is_file

    def place(self, job: str) -> str:
        """The file of a job's commit; names that aren't safe in file names are told apart by a number."""
        safe = re.sub("[^A-Za-z0-9._-]", "-", job)
        return f"{self.folder}/commits/{safe if safe == job else f'{safe}-{uuid.uuid5(uuid.NAMESPACE_URL, job).hex[:8]}'}.json"

    def write(self, batches: Iterator[pa.RecordBatch], run: str = "alone") -> Written:
        """The rows of a task, in a file of its own in the folder of the run."""
        writer, rows = None, 0
        name = f"data/{run}/{uuid.uuid4().hex}.parquet"
        for batch in batches:
            if writer is None:
                self.files.create_dir(f"{self.folder}/data/{run}", recursive=True)
                writer = pq.ParquetWriter(f"{self.folder}/{name}", batch.schema, filesystem=self.files)
            writer.write_batch(batch)
            rows += batch.num_rows
        if writer is None:
            return Written(None, 0)
        writer.close()
        return Written(name, rows)

    def publish(self, job: str, schema: StructType, messages: list[Written | None]) -> bool:
        """Make a job's files readable, all at once; False if the job was published before."""
        if self.published(job):
            self.remove(messages)
            return False
        self.files.create_dir(f"{self.folder}/commits", recursive=True)
        told = {"job": job, "schema": schema.json(), "files": [m.file for m in messages if m and m.file], "rows": sum(m.rows for m in messages if m)}
        whole = f"{self.folder}/commits/.{uuid.uuid4().hex}"
        with self.files.open_output_stream(whole) as file:
            file.write(json.dumps(told).encode())
        self.files.move(whole, self.place(job))
        return True

    def remove(self, messages: list[Written | None]) -> None:
        """Take back what tasks have written."""
        for m in messages:
            if m and m.file:
                with contextlib.suppress(FileNotFoundError):
                    self.files.delete_file(f"{self.folder}/{m.file}")


    def remove_run(self, run: str) -> None:
        """Take back all that a run has written, what its killed tasks left half done too."""
        with contextlib.suppress(FileNotFoundError):
            self.files.delete_dir(f"{self.folder}/data/{run}")


class LogWriter(DataSourceArrowWriter):
    """A batch job's writer."""

    def __init__(self, path: str, job: str, schema: StructType) -> None:
        self.path, self.job, self.schema, self.run = path, job, schema, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return Log(self.path).write(iterator, self.run)

    def commit(self, messages: list[Written | None]) -> None:
        Log(self.path).publish(self.job, self.schema, messages)

    def abort(self, messages: list[Written | None]) -> None:
        Log(self.path).remove_run(self.run)


class LogStreamWriter(DataSourceStreamArrowWriter):
    """A stream's writer: each micro-batch is a job."""

    def __init__(self, path: str, job: str, schema: StructType) -> None:
        self.path, self.job, self.schema = path, job, schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return Log(self.path).write(iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        Log(self.path).publish(f"{self.job}-{batchId:012d}", self.schema, messages)

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        Log(self.path).remove(messages)


class LogReader(DataSourceReader):
    """The files of all commits, one a partition."""

    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.names = path, schema.names

    def partitions(self) -> list[LogFile]:
        return [LogFile(name) for told in Log(self.path).commits() for name in told["files"]]

    def read(self, partition: LogFile | None) -> Iterator[pa.RecordBatch]:
        if partition is not None and partition.file:
            log = Log(self.path)
            with log.files.open_input_file(f"{log.folder}/{partition.file}") as file:
                yield from pq.ParquetFile(file).iter_batches(columns=self.names)


class CommittedLog(DataSource):
    """Options: ``path``, and ``job`` to write."""

    @classmethod
    def name(cls) -> str:
        return "tideline_log"

    def schema(self) -> StructType:
        told = Log(self.options["path"]).commits()
        if not told:
            raise ValueError(f"{self.options['path']} has no commit")
        return StructType.fromJson(json.loads(told[-1]["schema"]))

    def reader(self, schema: StructType) -> LogReader:
        return LogReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> LogWriter:
        if overwrite:
            raise ValueError("a log is appended to; a job of another name replaces nothing")
        return LogWriter(self.options["path"], self.options["job"], schema)

    def streamWriter(self, schema: StructType, overwrite: bool) -> LogStreamWriter:  # noqa: N802
        return LogStreamWriter(self.options["path"], self.options["job"], schema)


def append(rows: DataFrame, path: str, job: str) -> None:
    """Add the rows of a job to a log; a job that is there already adds nothing."""
    rows.sparkSession.dataSource.register(CommittedLog)
    rows.write.format("tideline_log").option("path", path).option("job", job).mode("append").save()


def append_stream(rows: DataFrame, path: str, job: str, checkpoint: str):  # noqa: ANN201
    """Add all that a stream has to a log, once, whatever restarts it takes; returns the query."""
    rows.sparkSession.dataSource.register(CommittedLog)
    writer = rows.writeStream.format("tideline_log").option("path", path).option("job", job).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all published jobs."""
    spark.dataSource.register(CommittedLog)
    return spark.read.format("tideline_log").option("path", path).load()


def vacuum(path: str, older_than_s: float = 24 * 3600.0) -> int:
    """Remove files that no commit names and that are older than any job may run; returns how many."""
    log = Log(path)
    named = {name for told in log.commits() for name in told["files"]}
    found = log.files.get_file_info(fs.FileSelector(f"{log.folder}/data", allow_not_found=True, recursive=True))
    left = [x for x in found if x.is_file and x.path.removeprefix(f"{log.folder}/") not in named and (x.mtime_ns or 0) / 1e9 <= time.time() - older_than_s]
    for x in left:
        log.files.delete_file(x.path)
    return len(left)
