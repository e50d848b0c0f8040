"""Sources: text, mixed logs, transcripts, manifests, configuration, audio files."""

from __future__ import annotations

import io
import tomllib
import wave
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.operators.fold import fold_log
from tideline.session import ship_package

RECORD = "line_id long, start double, end double, source string, translation string, lane string, reason string"


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line``: lines that aren't blank, trimmed."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("line"))
    return rows.where("line <> ''")


def mixed_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line`` of files that mix plain text and JSON rows; quick-lane rows are left out."""
    parsed = F.from_json("line", RECORD)
    is_json = F.col("line").startswith("{")
    rows = text_lines(spark, path).withColumn("row", F.when(is_json, parsed))
    kept = rows.where(~is_json | F.coalesce(F.col("row.lane") != "fast", F.lit(True)))
    return kept.select("path", F.when(is_json, F.col("row.source")).otherwise(F.col("line")).alias("line")).where("line is not null")


def records(spark: SparkSession, path: str) -> DataFrame:
    """``path, block, place, value, row, bad``: rows of log files as they are, and whether they are no records."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value"
    ).where("trim(value) <> ''")
    read = raw.withColumn("row", F.from_json("value", f"{RECORD}, broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}))
    return read.withColumn("bad", F.col("row.broken").isNotNull() | F.col("row.line_id").isNull())


def transcript_log(spark: SparkSession, path: str) -> DataFrame:
    """``path, seq`` and a transcript log's columns; a row that is no JSON is an error that names its place."""
    raw = records(spark, path)
    # numbered within each block of a file, and by the rows of the blocks before
    sizes = raw.groupBy("path", "block").agg(F.count(F.lit(1)).alias("size"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("path", "block", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("path", "block").orderBy("place"))
    numbered = raw.withColumn("within", within).join(starts, ["path", "block"])
    parsed = numbered.withColumn("number", F.col("before") + F.col("within"))
    checked = parsed.withColumn("line_id", F.when(F.col("bad"), F.raise_error(F.concat("path", F.lit(":"), F.col("number").cast("string")))).otherwise(F.col("row.line_id")))
    return checked.select("path", F.col("number").alias("seq"), "line_id", *(f"row.{c}" for c in ("start", "end", "source", "translation", "lane", "reason")))


def transcript(spark: SparkSession, path: str) -> DataFrame:
    """The log folded to one row for each file and line: the last value that is there, by column."""
    return fold_log(transcript_log(spark, path), ["path", "line_id"], "seq")


def reference_path(path: Column) -> Column:
    """``x.wav`` to ``x.en.txt``."""
    return F.regexp_replace(path, r"\.[^./]+$", ".en.txt")


def read_config(path: str) -> dict:
    """A TOML file; a missing one is empty, a broken one an error."""
    file = Path(path)
    return tomllib.loads(file.read_text()) if file.exists() else {}


def missing_files(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """``model, path, size`` of ``wanted`` that ``present(path, size)`` doesn't have in the very size."""
    return wanted.join(present, ["path", "size"], "left_anti")


def first_present(candidates: list[str], present: set[str]) -> str | None:
    """The first candidate path that is there."""
    return next((c for c in candidates if c in present), None)


def decode_wave(raw: bytes, rate: int = 16_000) -> np.ndarray:
    """Mono samples of a WAV file at ``rate``; empty audio is an error."""
    from tideline.functions.audio import downmix, resample

    with wave.open(io.BytesIO(raw)) as file:
        channels, width, own, frames = file.getnchannels(), file.getsampwidth(), file.getframerate(), file.readframes(file.getnframes())
    if not frames:
        raise ValueError("the file has no audio")
    if width == 1:
        samples = np.frombuffer(frames, np.uint8).astype(np.float64) - 128
    elif width == 3:
        parts = np.frombuffer(frames, np.uint8).reshape(-1, 3).astype(np.int32)
        samples = ((parts[:, 0] | parts[:, 1] << 8 | parts[:, 2] << 16) << 8 >> 8).astype(np.float64)
    else:
        samples = np.frombuffer(frames, {2: "<i2", 4: "<i4"}[width]).astype(np.float64)
    samples /= float(1 << (8 * width - 1))
    return resample(downmix(samples, channels), own, rate)


def audio_frames(spark: SparkSession, path: str, size: int = 512) -> DataFrame:
    """``path, frame_no, pcm``: WAV files as frames of ``size`` samples; the last may be short."""
    ship_package(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"], strict=True):
                samples = decode_wave(bytes(raw)).astype(np.float32)
                rows = [(name, i // size, samples[i : i + size].tolist()) for i in range(0, len(samples), size)]
                yield pd.DataFrame(rows, columns=["path", "frame_no", "pcm"])

    return files.mapInPandas(run, "path string, frame_no long, pcm array<float>")


def replay_files(spark: SparkSession, path: str, schema: str, files_a_batch: int = 1) -> DataFrame:
    """A stream of JSON files, a few for each micro-batch: paced replay."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(path)
