"""Sources with offsets and sinks with commits: kills, failures and repeats lose and double nothing."""

import json
import struct
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.sources import committed, readers, sinks, wave_stream
from tideline.streaming import jobs


def wav(path, samples, rate=16_000, bits=16, channels=1, is_float=False, extensible=False):
    """A WAV file of samples in -1..1, written by hand: the standard library has no floats."""
    kind = 3 if is_float else 1
    if is_float:
        raw = np.asarray(samples).astype(f"<f{bits // 8}").tobytes()
    elif bits == 8:
        raw = (np.round(np.asarray(samples) * 127) + 128).astype(np.uint8).tobytes()
    elif bits == 24:
        raw = b"".join(int(x * (2**23 - 1)).to_bytes(3, "little", signed=True) for x in samples)
    else:
        raw = (np.asarray(samples) * (2 ** (bits - 1) - 1)).astype(f"<i{bits // 8}").tobytes()
    block = channels * bits // 8
    head = struct.pack("<HHIIHH", 0xFFFE if extensible else kind, channels, rate, rate * block, block, bits)
    if extensible:
        head += struct.pack("<HHIH", 22, bits, 0, kind) + b"\x00\x00\x00\x00\x10\x00\x80\x00\x00\xaa\x00\x38\x9b\x71"
    body = b"fmt " + struct.pack("<I", len(head)) + head + b"LIST" + struct.pack("<I", 3) + b"abc\x00" + b"data" + struct.pack("<I", len(raw)) + raw
    Path(path).write_bytes(b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body)


def tone(seconds, rate=16_000):
    return 0.7 * np.sin(np.arange(int(seconds * rate)) * (2 * np.pi * 300 / rate))


@pytest.mark.parametrize(("bits", "is_float"), [(8, False), (16, False), (24, False), (32, False), (32, True), (64, True)])
@pytest.mark.parametrize("extensible", [False, True])
def test_all_kinds_of_samples(tmp_path, bits, is_float, extensible):
    want = tone(0.5)
    wav(tmp_path / "a.wav", want, bits=bits, is_float=is_float, extensible=extensible)
    files, name = wave_stream.file_system(str(tmp_path / "a.wav"))
    info = wave_stream.wave_info(files, name)
    assert (info.samples, info.rate, info.channels, info.is_float) == (8000, 16_000, 1, is_float)
    assert np.abs(wave_stream.samples_of(files, info, 0, 8000) - want).max() < (0.02 if bits == 8 else 1e-4)
    assert (wave_stream.samples_of(files, info, -3, 2)[:3] == 0).all() and len(wave_stream.samples_of(files, info, 7990, 9000)) == 10


@pytest.mark.parametrize("rate", [8_000, 16_000, 22_050, 44_100])
def test_ranges_are_those_of_the_whole_file(tmp_path, rate):
    wav(tmp_path / "a.wav", tone(1.3, rate), rate=rate)
    whole = readers.decode_wave((tmp_path / "a.wav").read_bytes())
    files, name = wave_stream.file_system(str(tmp_path / "a.wav"))
    info = wave_stream.wave_info(files, name)
    assert info.frames(16_000, 512) == len(whole) // 512
    for first, last in ((0, 512), (512, 1024), (700, 5000), (len(whole) - 300, len(whole))):
        assert np.abs(wave_stream.resampled_range(files, info, 16_000, first, last) - whole[first:last]).max() < 1e-9


def test_broken_files_are_named(tmp_path):
    (tmp_path / "x.wav").write_bytes(b"RIFF....WAVX")
    (tmp_path / "y.wav").write_bytes(b"RIFF\x10\x00\x00\x00WAVE")
    wav(tmp_path / "z.wav", tone(0.1))
    raw = (tmp_path / "z.wav").read_bytes()
    (tmp_path / "z.wav").write_bytes(raw.replace(b"fmt \x10\x00\x00\x00\x01\x00", b"fmt \x10\x00\x00\x00\x07\x00"))
    for name in "xyz":
        files, path = wave_stream.file_system(str(tmp_path / f"{name}.wav"))
        with pytest.raises(ValueError, match=f"{name}.wav"):
            wave_stream.wave_info(files, path)


def test_all_frames_of_a_folder(spark, tmp_path, monkeypatch):
    wav(tmp_path / "a.wav", tone(1.0))
    wav(tmp_path / "b.wav", np.repeat(tone(2.0), 2), channels=2, bits=32, is_float=True)
    (tmp_path / "c.txt").write_text("x")
    rows = wave_stream.wave_frames(spark, str(tmp_path)).collect()
    by = {Path(p).name: sorted(r["frame_no"] for r in rows if r["path"] == p) for p in {r["path"] for r in rows}}
    assert by == {"a.wav": list(range(31)), "b.wav": list(range(62))}  # the rest of less than a frame isn't there
    assert all(len(r["pcm"]) == 512 and r["at"] == r["frame_no"] * 0.032 for r in rows)
    one = np.concatenate([r["pcm"] for r in sorted(rows, key=lambda r: r["frame_no"]) if r["path"].endswith("b.wav")])
    assert np.abs(one - tone(2.0)[: len(one)]).max() < 1e-6
    many = wave_stream.wave_frames(spark, str(tmp_path), frame_ms=1)
    assert many.rdd.getNumPartitions() == 1 + 2 and many.count() == 3000


def frames_of(spark, path):
    return sorted((Path(r["path"]).name, r["frame_no"], round(sum(r["pcm"]), 3)) for r in committed.read(spark, path).collect())


def test_a_paced_replay_that_restarts_has_each_frame_once(spark, tmp_path):
    audio_, log, state, clock = (str(tmp_path / x) for x in ("audio", "log", "state", "clock"))
    Path(audio_).mkdir()
    wav(f"{audio_}/a.wav", tone(20.0))
    wav(f"{audio_}/b.wav", tone(9.0) ** 2)
    want = sorted((Path(r["path"]).name, r["frame_no"], round(sum(r["pcm"]), 3)) for r in wave_stream.wave_frames(spark, audio_).collect())
    seen = []
    for pause in (0.4, 0.4, 6.0):  # of twenty seconds, five times as fast
        query = committed.append_stream(wave_stream.wave_replay(spark, audio_, 5.0, clock), log, "replay", state)
        query.awaitTermination()
        seen.append(len(frames_of(spark, log)) if committed.Log(log).commits() else 0)
        time.sleep(pause)
    # what fell due while nothing ran comes at once
    committed.append_stream(wave_stream.wave_replay(spark, audio_, 5.0, clock), log, "replay", state).awaitTermination()
    assert frames_of(spark, log) == want and seen == sorted(seen) and seen[0] < len(want)
    # killed after its rows were published and before the checkpoint knew it: the last batch runs again
    last = max(Path(state, "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    committed.append_stream(wave_stream.wave_replay(spark, audio_, 5.0, clock), log, "replay", state).awaitTermination()
    assert frames_of(spark, log) == want
    with pytest.raises(Exception, match="started"):
        wave_stream.WaveStream({"path": audio_, "pace": "1"})


def test_a_repeated_job_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.range(100).withColumn("text", F.concat(F.lit("t"), "id")).repartition(4)
    for _ in range(2):
        committed.append(rows, path, "monday")
    committed.append(rows.where("id < 10"), path, "tuesday")
    committed.append(rows.where("id < 0"), path, "a/b c")
    found = committed.read(spark, path)
    assert found.count() == 110 and found.select("id").distinct().count() == 100 and dict(found.dtypes) == {"id": "bigint", "text": "string"}
    named = {name for told in committed.Log(path).commits() for name in told["files"]}
    assert {str(p.relative_to(tmp_path / "log")) for p in (tmp_path / "log" / "data").rglob("*.parquet")} == named
    with pytest.raises(Exception, match="appended"):
        rows.write.format("tideline_log").option("path", path).option("job", "x").mode("overwrite").save()


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    committed.append(spark.range(5), path, "first")
    bad = spark.range(1000).repartition(4).select(F.when(F.col("id") == 999, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        committed.append(bad, path, "second")
    assert committed.read(spark, path).count() == 5 and not committed.Log(path).published("second")
    committed.append(spark.range(7), path, "second")  # the name is still free
    assert committed.read(spark, path).count() == 12


def test_a_killed_job_is_never_read(spark, tmp_path):
    path = str(tmp_path / "log")
    committed.append(spark.range(5), path, "first")
    log = committed.Log(path)
    batch = spark.range(3).toArrow().to_batches()
    half = log.write(iter(batch))  # its task was done, its job never
    (tmp_path / "log" / "commits" / ".half").write_text('{"job":')
    assert half.rows == 3 and committed.read(spark, path).count() == 5
    assert committed.vacuum(path) == 0 and committed.vacuum(path, older_than_s=-1) == 1 and committed.read(spark, path).count() == 5
    writer = committed.LogWriter(path, "third", spark.range(1).schema)
    message = writer.write(iter(batch))
    writer.abort([message, None])
    assert len(list((tmp_path / "log" / "data").rglob("*.parquet"))) == len(log.commits()[0]["files"])
    assert json.loads((tmp_path / "log" / "commits" / "first.json").read_text())["rows"] == 5
    with pytest.raises(Exception, match="no commit"):
        committed.read(spark, str(tmp_path / "none")).count()


def test_transcript_rows_are_logged_once(spark, tmp_path):
    path = str(tmp_path / "log")
    lines = spark.createDataFrame([(1, 1, 3.0, 5.0, "first"), (1, 2, 6.0, 8.0, "second")], "session_id long, line_id long, start_s double, end_s double, source string")
    patches = spark.createDataFrame([(1, 2, "zwei")], "session_id long, line_id long, translation string")
    for _ in range(2):
        sinks.append_lines(lines, path, "lines")
        sinks.append_patches(patches, path, "patches")
    folded = {r["line_id"]: (r["source"], r["translation"]) for r in sinks.logged_lines(spark, path).collect()}
    assert folded == {1: ("first", None), 2: ("second", "zwei")} and committed.read(spark, path).count() == 3


# jobs and readers


def slow(spark, seconds, rows=40):
    """Rows that take their time, over eight tasks."""

    def wait(batches):
        for batch in batches:
            time.sleep(seconds)
            yield batch

    return spark.range(rows).repartition(8).mapInPandas(wait, "id long")


def test_a_cancelled_job_leaves_no_file(spark, tmp_path):
    path = str(tmp_path / "log")
    committed.append(spark.range(3), path, "before")
    job = jobs.Job(spark, lambda: committed.append(slow(spark, 20), path, "slow")).start()
    deadline = time.time() + 30
    while job.progress()[1] == 0 and time.time() < deadline:
        time.sleep(0.2)
    done, total = job.progress()
    assert 0 <= done < total and not job.done()
    start = time.time()
    job.cancel()
    with pytest.raises(jobs.Cancelled):
        job.result(15)
    assert time.time() - start < 15 and committed.read(spark, path).count() == 3 and not committed.Log(path).published("slow")
    assert len(list((tmp_path / "log" / "data").rglob("*.parquet"))) == len(committed.Log(path).commits()[0]["files"])
    other = jobs.Job(spark, lambda: committed.append(slow(spark, 0.01), path, "slow")).start()
    other.result(60)
    assert committed.read(spark, path).count() == 43 and other.progress()[0] == other.progress()[1] > 0
    with pytest.raises(ZeroDivisionError):
        jobs.Job(spark, lambda: 1 // 0).start().result(10)


def test_a_slow_reader_learns_what_it_missed(spark, tmp_path):
    log = jobs.EventLog(spark, str(tmp_path / "events"), keep=25)
    got = {"quick": [], "slow": []}
    missed = {"quick": 0, "slow": 0}

    def poll(reader, acknowledge=True):
        found = log.poll(reader)
        missed[reader] += found.skipped
        got[reader] += sorted(r["id"] for r in found.rows.collect()) if found.rows is not None else []
        if acknowledge:
            log.done(reader, found)

    for batch in range(12):
        log.publish(spark.range(batch * 10, batch * 10 + 10), f"b{batch:06d}")
        poll("quick")
        if batch in (1, 9):
            poll("slow")
    poll("slow")
    assert got["quick"] == list(range(120)) and missed["quick"] == 0
    # twenty rows, then those of the last thirty when ten batches were there, then the last two batches
    assert got["slow"] == [*range(20), *range(70, 100), *range(100, 120)] and missed["slow"] == 50
    assert len(got["slow"]) + missed["slow"] == 120
    poll("slow")
    assert missed["slow"] == 50 and len(got["slow"]) == 70
    log.publish(spark.range(5), "b000100")
    again = [log.poll("slow") for _ in range(2)]  # not acknowledged: the same again
    assert [d.rows.count() for d in again] == [5, 5] and again[0].upto == 125
    log.publish(spark.range(5), "b000100")  # a repeated job
    assert log.poll("slow").rows.count() == 5 and log.kept()[0] + sum(x["rows"] for x in log.kept()[1]) == 125


def test_rows_of_streams_are_counted(spark, tmp_path):
    rows = jobs.Rows()
    spark.streams.addListener(rows)
    try:
        spark.range(30).write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        committed.append_stream(stream, str(tmp_path / "log"), "s", str(tmp_path / "state")).awaitTermination()
        deadline = time.time() + 10
        while not rows.ended and time.time() < deadline:
            time.sleep(0.1)
        assert sum(rows.read.values()) == 30 and list(rows.ended.values()) == [None]
    finally:
        spark.streams.removeListener(rows)
