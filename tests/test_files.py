"""Sources and sinks: round trips, errors, restarts."""

import time
import wave
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import fold, render
from tideline.sources import readers, sinks
from tideline.streaming import queries as st


def lines_of(spark):
    rows = [(1, 1, 3.0, 5.0, "first, <b>"), (1, 2, 6.0, 8.0, " \n "), (1, 3, 9.0, 9.1, "third & last")]
    return spark.createDataFrame(rows, "session_id long, line_id long, start_s double, end_s double, source string")


def test_srt_numbers_only_lines_that_show(spark):
    content = sinks.session_files(lines_of(spark), "srt").first()["content"]
    assert content == "1\n00:00:03,000 --> 00:00:05,000\nfirst, <b>\n\n2\n00:00:09,000 --> 00:00:09,500\nthird & last\n\n"


def test_vtt_has_its_header(spark):
    content = sinks.session_files(lines_of(spark), "vtt").first()["content"]
    assert content.startswith("WEBVTT\n\n") and "first, &lt;b&gt;" in content


def test_formats_are_written_once(spark, tmp_path):
    found = sinks.write_sessions(lines_of(spark), str(tmp_path), ["txt", "srt", "txt"])
    assert len(found) == 2
    text = spark.read.text(found[0], wholetext=True).first()["value"]
    assert text == "first, <b>\nthird & last\n"


def test_log_round_trip_and_fold(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = lines_of(spark).where("line_id <> 2")
    render.jsonl(rows).select("session_id", F.col("row").alias("value")).write.partitionBy("session_id").text(path)
    patches = rows.select("session_id", "line_id", F.upper("source").alias("translation"))
    render.jsonl_patch(patches).select("session_id", F.col("row").alias("value")).coalesce(1).write.mode("append").partitionBy("session_id").text(path)
    log = readers.transcript_log(spark, path)
    folded = {r["line_id"]: r for r in readers.fold_log(log.drop("path"), ["line_id"], "seq").collect()}
    assert folded[1]["source"] == "first, <b>" and folded[3]["translation"] == "THIRD & LAST"


def test_a_broken_row_names_its_place(spark, tmp_path):
    file = tmp_path / "x.jsonl"
    file.write_text('{"line_id":1,"source":"a"}\n{"line_id":\n')
    with pytest.raises(Exception, match="x.jsonl:2"):
        readers.transcript_log(spark, str(file)).collect()


def test_text_and_mixed_sources(spark, tmp_path):
    file = tmp_path / "m.txt"
    file.write_text(' plain \n\n{"line_id":1,"source":"kept","lane":"accurate"}\n{"line_id":2,"source":"gone","lane":"fast"}\n{"line_id":3,"source":"also"}\n')
    assert [r["line"] for r in readers.mixed_lines(spark, str(file)).collect()] == ["plain", "kept", "also"]
    assert readers.text_lines(spark, str(file)).count() == 4


def test_wave_files(spark, tmp_path):
    path = str(tmp_path / "a.wav")
    with wave.open(path, "wb") as out:
        out.setnchannels(2)
        out.setsampwidth(2)
        out.setframerate(16000)
        out.writeframes((np.sin(np.arange(2000) / 9) * 20000).astype("<i2").tobytes())
    rows = readers.audio_frames(spark, path).orderBy("frame_no").collect()
    assert [len(r["pcm"]) for r in rows] == [512, 488]
    with pytest.raises(Exception):
        readers.decode_wave(b"RIFF")


def test_configuration(tmp_path):
    assert readers.read_config(str(tmp_path / "none.toml")) == {}
    bad = tmp_path / "bad.toml"
    bad.write_text("x = = 1")
    with pytest.raises(Exception):
        readers.read_config(str(bad))


def test_names(tmp_path):
    first, second = (sinks.claim_name(str(tmp_path), "s", ".txt", x) for x in ("a", "b"))
    assert first.endswith("s.txt") and second.endswith("s-2.txt")
    assert sinks.tag("a b/c") == "a-b-c" and sinks.tag("") == "x"
    with pytest.raises(ValueError):
        sinks.parse_output("fr")


def test_logs_are_compacted_in_place(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    file = folder / "a.jsonl"
    rows = ['{"line_id":1,"start":0.0,"end":1.0,"source":"a"}', '{"line_id":2,"start":1.0,"end":2.0,"source":"b"}']
    file.write_text("\n".join(rows) + "\n")
    assert not sinks.compact_in_place(spark, str(folder)) and file.exists()
    file.write_text("\n".join([*rows, '{"line_id":1,"translation":"x"}', "no record"]) + "\n")
    assert not sinks.compact_in_place(spark, str(folder)) and file.exists()
    file.write_text("\n".join([*rows, '{"line_id":1,"translation":"x"}']) + "\n")
    assert sinks.compact_in_place(spark, str(folder))
    found = spark.read.json(str(folder)).orderBy("line_id").collect()
    assert [(r["source"], r["translation"]) for r in found] == [("a", "x"), ("b", None)]
    assert sorted(x.name for x in tmp_path.iterdir()) == ["log"]


def test_stems_of_sessions(tmp_path):
    started = datetime(2024, 1, 2, 3, 4, 5)
    assert sinks.free_stem(str(tmp_path), started) == "2024-01-02_030405"
    (tmp_path / "2024-01-02_030405.srt").write_text("x")
    (tmp_path / "2024-01-02_030405-2.txt").write_text("x")
    assert sinks.free_stem(str(tmp_path), started) == "2024-01-02_030405-3"
    assert sinks.free_stem(str(tmp_path), started, "a b") == "2024-01-02_030405_a-b"


def test_sessions_written_again_replace_themselves(spark, tmp_path):
    def lines(session):
        return spark.createDataFrame([(session, 1, 0.0, 1.0, "a", None)], "session_id long, line_id long, start_s double, end_s double, source string, translation string")

    for session in (1, 2, 1):
        folders = sinks.write_sessions(lines(session), str(tmp_path / "out"), ["txt"])
    assert spark.read.text(folders[0]).count() == 2


def test_upsert_of_an_empty_batch(spark):
    current = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    changes = spark.createDataFrame([(2, 5, "c"), (3, 6, "d")], "k long, seq long, v string")
    assert sorted(map(tuple, fold.upsert(current, changes.limit(0), ["k"], "seq").collect())) == [(1, "a"), (2, "b")]
    assert sorted(map(tuple, fold.upsert(current, changes, ["k"], "seq").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_a_restarted_stream_adds_nothing(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = spark.createDataFrame([(1, 0, "a")], "line_id long, seq long, source string")
    rows.write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(source)
        st.upsert_files(stream, target, state, ["line_id"], "seq").awaitTermination()
    assert spark.read.parquet(target).count() == 1


def test_late_rows_are_dropped(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "session_id long, ts timestamp"
    # a batch between the newest row and the late one: the watermark moves after each batch
    parts = (["2024-01-01 00:00:00", "2024-01-01 05:00:00"], ["2024-01-01 05:00:10"], ["2024-01-01 00:00:30"], ["2024-01-02 00:00:00"], ["2024-01-02 00:00:10"])
    for number, part in enumerate(parts):
        rows = spark.createDataFrame([(1, t) for t in part], "session_id long, t string").select("session_id", F.col("t").cast("timestamp").alias("ts"))
        rows.coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1 if number + 1 < len(parts) else 0)

    def counts(delay):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        found = st.run_to_end(st.late_dropped(stream, delay, "1 hour"), f"late_rows_{delay[3:]}", str(tmp_path / f"state_{delay[3:]}"))
        return sorted((str(r["window"]["start"]), r["n"]) for r in found.collect())

    # the row that is five hours late is dropped, or counted, by the delay that is allowed
    assert counts("10 minutes") == [("2024-01-01 00:00:00", 1), ("2024-01-01 05:00:00", 2)]
    assert counts("10 hours") == [("2024-01-01 00:00:00", 2), ("2024-01-01 05:00:00", 2)]
