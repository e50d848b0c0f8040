"""Jobs that report progress and can be cancelled, and events for readers that may lag.

``Job`` runs work under a tag of its own: tasks done of all that are known tell how far it is, and cancelling the tag
stops it on the executors. With a sink that commits (``tideline.sources.committed``), a cancelled job leaves nothing.

``EventLog`` is a log that keeps the newest rows only. Each reader has a place in it of its own, by rows since the
start; one that falls behind what is kept goes on with the oldest there is, and is told exactly how many rows it missed.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from tideline.sources import committed


class Cancelled(Exception):
    """The job was cancelled before it was done."""


@dataclass
class Job:
    """``work`` in a thread of its own; see ``start``."""

    spark: SparkSession
    work: Callable[[], Any]
    tag: str = field(default_factory=lambda: f"tideline-{uuid.uuid4().hex}")
    cancelled: bool = False
    _value: Any = None
    _error: BaseException | None = None

    def start(self) -> Job:
        """Begin; the work's Spark jobs carry the tag."""

        def run() -> None:
            # a new thread has no active session, in which Spark looks for registered data sources
            self.spark._jvm.org.apache.spark.sql.classic.SparkSession.setActiveSession(self.spark._jsparkSession)
            self.spark.sparkContext.addJobTag(self.tag)
            try:
                self._value = self.work()
            except BaseException as error:  # noqa: BLE001  it is raised again by ``result``
                self._error = error
            finally:
                self.spark.sparkContext.removeJobTag(self.tag)

        self._thread = threading.Thread(target=run, daemon=True)
        self._thread.start()
        return self

    def progress(self) -> tuple[int, int]:
        """Tasks that are done, and all that are known so far."""
        tracker, done, total = self.spark.sparkContext.statusTracker(), 0, 0
        for job in self.spark.sparkContext._jsc.sc().statusTracker().getJobIdsForTag(self.tag):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                if told := tracker.getStageInfo(stage):
                    # stages whose result was there already have no tasks to do
                    done, total = done + told.numCompletedTasks, total + (told.numCompletedTasks if info.status == "SUCCEEDED" else told.numTasks)
        return done, total

    def cancel(self) -> None:
        """Stop the work's jobs wherever they run."""
        self.cancelled = True
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def done(self) -> bool:
        return not self._thread.is_alive()

    def result(self, timeout: float | None = None) -> Any:
        """What the work gave; ``Cancelled`` if it was stopped, and its own error if it failed."""
        self._thread.join(timeout)
        if self._thread.is_alive():
            raise TimeoutError(self.tag)
        if self._error is not None:
            if self.cancelled:
                raise Cancelled(self.tag) from self._error
            raise self._error
        return self._value


class Rows(StreamingQueryListener):
    """How many rows each stream has read, by its name or id, and which have ended."""

    def __init__(self) -> None:
        self.read: dict[str, int] = {}
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        self.read.setdefault(event.name or str(event.id), 0)

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        name = event.progress.name or str(event.progress.id)
        self.read[name] = self.read.get(name, 0) + event.progress.numInputRows

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        self.ended[str(event.id)] = event.exception


@dataclass
class Delivery:
    """What a reader gets: rows, how many it missed before them, and the place after them."""

    rows: DataFrame | None
    skipped: int
    upto: int


class EventLog:
    """A committed log of which about ``keep`` rows stay: whole jobs go, the oldest first, while the others have as many."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 256) -> None:
        self.spark, self.path, self.keep, self.log = spark, path, keep, committed.Log(path)

    def publish(self, rows: DataFrame, job: str) -> None:
        """Add the rows of a job, whose name sorts after those before; then let go what is too old."""
        committed.append(rows, self.path, job)
        self.trim()

    def _read(self, name: str) -> dict:
        path = f"{self.log.folder}/{name}"
        if self.log.files.get_file_info(path).type == fs.FileType.NotFound:
            return {}
        with self.log.files.open_input_file(path) as file:
            return json.loads(file.read())

    def _write(self, name: str, value: dict) -> None:
        """A small file, whole before it has its name."""
        folder, _, _ = f"{self.log.folder}/{name}".rpartition("/")
        self.log.files.create_dir(folder, recursive=True)
        whole = f"{folder}/.{uuid.uuid4().hex}"
        with self.log.files.open_output_stream(whole) as file:
            file.write(json.dumps(value).encode())
        self.log.files.move(whole, f"{self.log.folder}/{name}")

    def kept(self) -> tuple[int, list[dict]]:
        """How many rows have gone, and the jobs that are kept."""
        gone = self._read("gone.json")
        return gone.get("rows", 0), sorted((x for x in self.log.commits() if x["job"] > gone.get("job", "")), key=lambda x: x["job"])

    def trim(self) -> int:
        """Let old jobs go; returns how many. What has gone is said first, so that a stop in between counts nothing twice."""
        before, jobs = self.kept()
        total, old = sum(x["rows"] for x in jobs), []
        while len(old) < len(jobs) and total - jobs[len(old)]["rows"] >= self.keep:
            total -= jobs[len(old)]["rows"]
            old.append(jobs[len(old)])
        if old:
            self._write("gone.json", {"rows": before + sum(x["rows"] for x in old), "job": old[-1]["job"]})
        for x in self.log.commits():
            if x["job"] <= self._read("gone.json").get("job", ""):
                self.log.files.delete_file(self.log.place(x["job"]))
                self.log.remove([committed.Written(name, 0) for name in x["files"]])
        return len(old)

    def poll(self, reader: str) -> Delivery:
        """What a reader hasn't had yet; call ``done`` when it has been dealt with, or get it again."""
        place = self._read(f"readers/{reader}.json").get("place", 0)
        first, jobs = self.kept()
        skipped, at, files = max(0, first - place), first, []
        for x in jobs:
            if at >= place:
                files += x["files"]
            at += x["rows"]
        upto = max(place, at)
        paths = [f"{self.path}/{name}" for name in files]
        return Delivery(self.spark.read.parquet(*paths) if paths else None, skipped, upto)

    def done(self, reader: str, delivery: Delivery) -> None:
        """A reader's place is after a delivery now."""
        self._write(f"readers/{reader}.json", {"place": delivery.upto})
