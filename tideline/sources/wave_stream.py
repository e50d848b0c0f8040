"""WAV files replayed as a stream of frames: a data source with offsets.

    spark.dataSource.register(WaveReplay)
    spark.readStream.format("tideline_wave").option("path", folder).option("pace", 1.0).option("started", t).load()

All files of a folder are replayed side by side. The offset is a number of frames since their start: at most
that many of each file have come. With a ``pace`` frames come as they are due, counted from ``started`` (seconds since
1970), and after a stop what fell due in the meantime comes at once; a query that is restarted from its
checkpoint needs the same ``started`` (``replay_clock`` keeps it), and gets each frame once: rows follow from the
offsets alone. Without a pace all frames are due. The last frame of a file is there when it is whole.

Each micro-batch has a partition for each file and ``MOST_FRAMES`` frames, which reads the bytes of
its range only, and resamples from there. Integer samples of 8 to 32 bits and floats are
read. Paths are those of ``pyarrow.fs``: local ones, HDFS and object stores.
"""

from __future__ import annotations

import math
import struct
import sys
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tideline.functions import audio

FRAME_MS = 32
RATE = 16_000
MOST_FRAMES = 1024
# the processes that Spark starts for data sources don't have the files of the session
for _module in (sys.modules[__name__], audio):
    cloudpickle.register_pickle_by_value(_module)


@dataclass
class WaveInfo:
    """What the header of a WAV file says, and where its samples are."""

    path: str
    channels: int
    rate: int
    bits: int
    is_float: bool
    at: int
    samples: int  # of each channel

    def frames(self, rate: int, size: int) -> int:
        """How many whole frames there are at ``rate``."""
        if not self.samples:
            return 0
        return (math.floor((self.samples - 1) / (self.rate / rate) + 1e-9) + 1) // size


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def wave_info(files: fs.FileSystem, path: str) -> WaveInfo:
    """The header of a WAV file; anything else is an error that names it."""
    with files.open_input_file(path) as file:
        size = file.size()
        riff = file.read(12)
        if len(riff) < 12 or riff[:4] != b"RIFF" or riff[8:] != b"WAVE":
            raise ValueError(f"{path} is no WAV file")
        told, at = None, 12
        while at + 8 <= size:
            name, length = struct.unpack("<4sI", file.read_at(8, at))
            if name == b"fmt ":
                head = file.read_at(min(length, 40), at + 8)
                kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", head[:16])
                if kind == 0xFFFE and len(head) >= 26:  # the kind of an extensible header is the first of its GUID
                    kind = struct.unpack("<H", head[24:26])[0]
                told = kind, channels, rate, bits
            elif name == b"data":
                if told is None or told[0] not in (1, 3) or not told[1] or told[3] not in ((32, 64) if told[0] == 3 else (8, 16, 24, 32)):
                    raise ValueError(f"{path} has samples of an unknown kind: {told}")
                kind, channels, rate, bits = told
                there = min(length, size - at - 8) // (channels * bits // 8)
                return WaveInfo(path, channels, rate, bits, kind == 3, at + 8, there)
            at += 8 + length + length % 2
    raise ValueError(f"{path} has no samples")


def samples_of(files: fs.FileSystem, info: WaveInfo, first: int, last: int) -> np.ndarray:
    """Mono samples ``first`` to ``last`` of a file; zeros before its start."""
    low, high = max(0, first), min(last, info.samples)
    width = info.channels * info.bits // 8
    with files.open_input_file(info.path) as file:
        raw = file.read_at(max(0, high - low) * width, info.at + low * width)
    if info.is_float:
        values = np.frombuffer(raw, f"<f{info.bits // 8}").astype(np.float64)
    elif info.bits == 8:
        values = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif info.bits == 24:
        parts = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        values = ((parts[:, 0] | parts[:, 1] << 8 | parts[:, 2] << 16) << 8 >> 8) / float(1 << 23)
    else:
        values = np.frombuffer(raw, f"<i{info.bits // 8}") / float(1 << (info.bits - 1))
    return np.concatenate([np.zeros(low - first), audio.downmix(values, info.channels)])


def resampled_range(files: fs.FileSystem, info: WaveInfo, rate: int, first: int, last: int) -> np.ndarray:
    """Samples ``first`` to ``last`` of the file at ``rate``, as resampling the whole file gives them."""
    if info.rate == rate:
        return samples_of(files, info, first, last)
    step = info.rate / rate
    taps = audio.low_pass(info.rate, rate) if info.rate > rate else np.ones(1)
    low, high = math.floor(first * step), min(info.samples, math.floor((last - 1) * step) + 2)
    smooth = np.convolve(samples_of(files, info, low - len(taps) + 1, high), taps, "valid")
    return np.interp(np.arange(first, last) * step, low + np.arange(len(smooth)), smooth)


@dataclass
class FrameRange(InputPartition):
    """Frames ``first`` to ``last`` of a file."""

    info: WaveInfo
    first: int
    last: int


class _Frames:
    """What the batch and the streaming reader share."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.rate = int(options.get("rate", RATE))
        self.size = self.rate * int(options.get("frame_ms", FRAME_MS)) // 1000
        files, path = file_system(self.path)
        found = files.get_file_info(fs.FileSelector(path)) if files.get_file_info(path).type == fs.FileType.Directory else [files.get_file_info(path)]
        names = sorted(x.path for x in found if x.is_file and x.path.lower().endswith(".wav"))
        self.files = [wave_info(files, name) for name in names]
        self.longest = max((x.frames(self.rate, self.size) for x in self.files), default=0)

    def ranges(self, start: int, end: int) -> list[FrameRange]:
        """Parts of the frames ``start`` to ``end`` of all files."""
        found = []
        for info in self.files:
            last = min(end, info.frames(self.rate, self.size))
            found += [FrameRange(info, at, min(at + MOST_FRAMES, last)) for at in range(start, last, MOST_FRAMES)]
        return found

    def read(self, part: FrameRange) -> Iterator[pa.RecordBatch]:
        files, _ = file_system(self.path)
        pcm = resampled_range(files, part.info, self.rate, part.first * self.size, part.last * self.size).astype(np.float32)
        count = part.last - part.first
        numbers = np.arange(part.first, part.last)
        offsets = pa.array(np.arange(count + 1, dtype=np.int32) * self.size)
        columns = [pa.array([part.info.path] * count), pa.array(numbers, pa.int64()), pa.array(numbers * (self.size / self.rate)), pa.ListArray.from_arrays(offsets, pa.array(pcm))]
        yield pa.RecordBatch.from_arrays(columns, names=["path", "frame_no", "at", "pcm"])


class WaveBatch(_Frames, DataSourceReader):
    """All frames of all files."""

    def partitions(self) -> list[FrameRange]:
        return self.ranges(0, self.longest)


class WaveStream(_Frames, DataSourceStreamReader):
    """Frames as they fall due."""

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.pace = float(options.get("pace", 0))
        if self.pace > 0 and "started" not in options:
            raise ValueError("a paced replay needs the time at which it started")
        self.started = float(options.get("started", 0))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"frames": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        if self.pace <= 0:
            return {"frames": self.longest}
        due = math.floor((time.time() - self.started) * self.pace * self.rate / self.size)
        return {"frames": max(0, min(due, self.longest))}

    def partitions(self, start: dict, end: dict) -> list[FrameRange]:
        return self.ranges(start["frames"], end["frames"])


class WaveReplay(DataSource):
    """``path, frame_no, at, pcm``; options: ``path``, ``rate``, ``frame_ms``, ``pace``, ``started``."""

    @classmethod
    def name(cls) -> str:
        return "tideline_wave"

    def schema(self) -> str:
        return "path string, frame_no long, at double, pcm array<float>"

    def reader(self, schema) -> WaveBatch:  # noqa: ANN001
        return WaveBatch(self.options)

    def streamReader(self, schema) -> WaveStream:  # noqa: ANN001, N802
        return WaveStream(self.options)


def replay_clock(path: str) -> float:
    """When the replay that keeps its clock in the file ``path`` started: now, if the file isn't there yet."""
    files, name = file_system(path)
    if files.get_file_info(name).type == fs.FileType.NotFound:
        with files.open_output_stream(name) as file:
            file.write(repr(time.time()).encode())
    with files.open_input_file(name) as file:
        return float(file.read().decode())


def wave_frames(spark: SparkSession, path: str, **options: float) -> DataFrame:
    """All frames of the WAV files of a folder."""
    spark.dataSource.register(WaveReplay)
    return spark.read.format("tideline_wave").options(path=path, **options).load()


def wave_replay(spark: SparkSession, path: str, pace: float, clock: str, **options: float) -> DataFrame:
    """A stream of the frames as they fall due, ``pace`` times as fast as they were recorded."""
    spark.dataSource.register(WaveReplay)
    return spark.readStream.format("tideline_wave").options(path=path, pace=pace, started=replay_clock(clock), **options).load()
