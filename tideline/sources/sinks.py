"""Sinks: transcript files of sessions, written once and in order; compaction of logs."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
from datetime import datetime
from itertools import count
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import render
from tideline.operators.fold import fold_log
from tideline.sources import committed
from tideline.sources.readers import records, transcript_log

FORMATS = {"txt": render.txt, "srt": render.srt, "vtt": render.vtt, "jsonl": render.jsonl, "bilingual": render.bilingual}


def tag(name: str) -> str:
    """A name that is safe in file names."""
    return re.sub("[^A-Za-z0-9-]", "-", name) or "x"


def parse_output(name: str) -> str:
    """An output selector; the error names the valid ones."""
    if name not in ("en", "zh", "both"):
        raise ValueError(f"{name!r} is none of en, zh, both")
    return name


def session_files(lines: DataFrame, kind: str) -> DataFrame:
    """``session_id, content``: each session's whole file, rows in order, the header first."""
    rows = FORMATS[kind](lines)
    column = "row" if "row" in rows.columns else "block"
    end = "\n" if column == "row" else ""
    ordered = F.sort_array(F.collect_list(F.struct("line_id", F.col(column).alias("block"))))
    head = render.VTT_HEADER if kind == "vtt" else ""
    body = F.array_join(F.transform(ordered, lambda x: F.concat(x["block"], F.lit(end))), "")
    return rows.groupBy("session_id").agg(body.alias("content")).select("session_id", F.concat(F.lit(head), F.col("content")).alias("content"))


def write_sessions(lines: DataFrame, path: str, formats: list[str]) -> list[str]:
    """One folder for each format (named once), one file part for each session; returns the folders.

    Sessions that are written again replace what is there of them; others stay.
    """
    written = []
    for kind in dict.fromkeys(formats):
        folder = f"{path}/{kind}"
        # the text writer ends each row with the line feed that the content ends with
        whole = session_files(lines, kind).withColumn("content", F.regexp_replace("content", r"\n\z", ""))
        whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").text(folder)
        written.append(folder)
    return written


_LOGGED = {"session_id": "long", "line_id": "long", "seq": "long", "start_s": "double", "end_s": "double", "source": "string", "translation": "string", "lane": "string", "reason": "string"}


def _logged(rows: DataFrame, seq: int) -> DataFrame:
    given = rows.withColumn("seq", F.lit(seq))
    return given.select(*((F.col(c) if c in given.columns else F.lit(None)).cast(k).alias(c) for c, k in _LOGGED.items()))


def append_lines(lines: DataFrame, path: str, job: str) -> None:
    """Source rows of a committed log: a job that is killed or repeated leaves each row once."""
    committed.append(_logged(lines, 0), path, job)


def append_patches(patches: DataFrame, path: str, job: str, seq: int = 1) -> None:
    """``session_id, line_id`` and what is new of a line; of several values of a column that with the largest ``seq`` counts."""
    committed.append(_logged(patches, seq), path, job)


def logged_lines(spark: SparkSession, path: str) -> DataFrame:
    """A committed log folded to one row for each line."""
    return fold_log(committed.read(spark, path), ["session_id", "line_id"], "seq")


def compact(log: DataFrame, keys: list[str], seq: str, path: str) -> None:
    """A log's folded rows, written beside it: readers see the old files until the new ones are whole."""
    fold_log(log, keys, seq).write.mode("errorifexists").json(path)


def compact_in_place(spark: SparkSession, path: str) -> bool:
    """A folder of log files folded to one row for each file and line, and put in its own place; whether that was done.

    A log without patches stays as it is, and so does one with a row that is no record; any other
    error is one. The new files are whole before the old ones go: the folders change names.
    """
    names = ["line_id", "start", "end", "source", "translation", "lane", "reason"]
    state = records(spark, path).agg(F.coalesce(F.bool_or("bad"), F.lit(False)), F.count(F.lit(1)), F.count_distinct("path", "row.line_id")).first()
    if state[0] or state[1] == state[2]:
        return False
    fold_log(transcript_log(spark, path), ["path", "line_id"], "seq").orderBy("path", "line_id").select(*names).write.mode("overwrite").json(f"{path}.new")
    folders = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}{end}") for end in ("", ".new", ".old")]
    files = folders[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(folders[2], True)
    if not files.rename(folders[0], folders[2]) or not files.rename(folders[1], folders[0]):
        raise OSError(f"{path} could not be replaced; its rows are in {path}.old")
    return files.delete(folders[2], True)


def free_stem(folder: str, started: datetime, name: str = "") -> str:
    """``YYYY-mm-dd_HHMMSS`` of a session, with its tag and, if files of that stem are there, a number."""
    stem = started.strftime("%Y-%m-%d_%H%M%S") + (f"_{tag(name)}" if name else "")
    taken = {x.name.split(".")[0] for x in Path(folder).glob(f"{stem}*")}
    return next(x for x in (stem if n == 1 else f"{stem}-{n}" for n in count(1)) if x not in taken)


def claim_name(folder: str, stem: str, suffix: str, content: str) -> str:
    """Write a small file without overwriting: ``stem``, then ``stem-2``, ``stem-3``...

    The file is whole before it gets the name: it is written under another and linked.
    """
    handle, whole = tempfile.mkstemp(dir=folder, prefix=".claim-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as file:
            file.write(content)
        for number in range(1, 10_000):
            target = Path(folder) / f"{stem}{'' if number == 1 else f'-{number}'}{suffix}"
            with contextlib.suppress(FileExistsError):
                os.link(whole, target)
                return str(target)
        raise FileExistsError(stem)
    finally:
        os.unlink(whole)
