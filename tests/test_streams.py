"""Streams with state of their own: the same rows in one micro-batch or in many, and bounded state."""

import random
import time
import uuid

import numpy as np
import pytest

from tideline.operators.gate import settled_after
from tideline.operators.joins import cut_ranges
from tideline.session import shared_folder
from tideline.streaming import stateful


def in_files(spark, rows, schema, count):
    """A stream that gives ``rows`` in the order of ``count`` files, one a micro-batch."""
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    step = -(-len(rows) // count)
    for at in range(0, len(rows), step):
        spark.createDataFrame(rows[at : at + step], schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, stream):
    """The rows of a stream, and its progress."""
    path = f"{shared_folder(spark)}/out-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(map(tuple, spark.read.schema(stream.schema).parquet(f"{path}/rows").collect()), key=repr), query.recentProgress


FRAMES = "session_id long, at double, seq long"
SPANS = "session_id long, span_id long, start double, end double, asked double"


def frames_and_spans(seconds, late):
    """Two sessions with a frame every half second, spans of which one in three is asked for ``late`` seconds after its end."""
    frames = sorted(((s, k * 0.5, k) for s in (1, 2) for k in range(2 * seconds)), key=lambda x: x[1])
    spans = [(s, k, k * 7.0, k * 7.0 + 3.25, k * 7.0 + 4 + (late if k % 3 == 0 else 0)) for s in (1, 2) for k in range(seconds // 7)]
    return frames, sorted(spans, key=lambda x: x[4])


def test_held_cuts_are_padded_spans_of_what_is_held(spark):
    frames, spans = frames_and_spans(200, 29.0)
    found = set(map(tuple, stateful.held_cuts(spark.createDataFrame(frames, FRAMES), spark.createDataFrame(spans, SPANS)).select("session_id", "seq", "span_id").collect()))
    want = {
        (s, seq, span)
        for s, at, seq in frames
        for x, span, start, end, asked in spans
        if s == x and start - 0.3 <= at < end + 0.3 and asked - 30 < at <= asked
    }
    assert found == want
    # the part that has aged out is missing from late spans, and nothing of the others
    whole = set(map(tuple, cut_ranges(spark.createDataFrame(frames, FRAMES), spark.createDataFrame(spans, SPANS), 0.3, 5.0).select("session_id", "seq", "span_id").collect()))
    assert found < whole and {x for x in whole - found if x[2] % 3} == set() and any(x[2] % 3 == 0 for x in found)


@pytest.mark.parametrize("files", [1, 20])
def test_held_cuts_of_streams(spark, files):
    frames, spans = frames_and_spans(300, 29.0)
    want = sorted(map(tuple, stateful.held_cuts(spark.createDataFrame(frames, FRAMES), spark.createDataFrame(spans, SPANS)).collect()), key=repr)
    stream = stateful.held_cuts_stream(in_files(spark, frames, FRAMES, files), in_files(spark, spans, SPANS, files), delay="2 seconds")
    found, progress = run(spark, stream.select("session_id", "at", "seq", "span_id"))
    assert found == want
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    if files > 1:  # what may still be asked for: 30 s, a file of 15 s, the delay and a batch's lag of the watermark, twice two frames a second
        assert max(held) < 2 * 2 * (30 + 3 * 15 + 2) + 40 < len(frames)


@pytest.mark.parametrize("ttl_s", [None, 3600.0])
@pytest.mark.parametrize("files", [1, 7])
def test_scores_in_any_batches(spark, files, ttl_s):
    rng = random.Random(files)
    rows = []
    for session in range(3):
        offset = 0
        while offset < 400:
            samples = [float(rng.randint(-99, 99)) for _ in range(rng.randint(1, 60))]
            rows.append((session, offset, samples))
            offset += len(samples)
    rows += rows[:4]  # frames that come twice
    rng.shuffle(rows)
    schema = "session_id long, offset long, samples array<double>"
    scorer = stateful.LinearScorer(4)
    want = sorted(map(tuple, stateful.scores(spark.createDataFrame(rows, schema), scorer, 16, 4).collect()), key=repr)
    plain = []
    for session in range(3):
        line = np.concatenate([x[2] for x in sorted(dict.fromkeys((s, o, tuple(v)) for s, o, v in rows)) if x[0] == session])
        hidden, before = 0.0, 0.0
        for k in range(len(line) // 16):
            window = line[16 * k : 16 * k + 16]
            hidden = hidden / 2 + window.mean()
            plain.append((session, k, hidden + before / 2))
            before = window[-4:].mean()
    assert want == sorted(plain, key=repr)
    with stateful.in_rocksdb(spark, wait_for_watermark=False):
        found, progress = run(spark, stateful.scored_stream(in_files(spark, rows, schema, files), scorer, 16, 4, ttl_s))
    assert found == want and len(progress) <= files + 1


def test_a_gap_holds_scores_back(spark):
    schema = "session_id long, offset long, samples array<double>"
    rows = [(1, 0, [1.0] * 10), (1, 12, [1.0] * 10), (1, 0, None), (None, 0, [1.0] * 20)]
    scorer = stateful.LinearScorer(0)
    assert [r["window"] for r in stateful.scores(spark.createDataFrame(rows, schema), scorer, 4, 0).collect()] == [0, 1]
    with stateful.in_rocksdb(spark, wait_for_watermark=False):
        found, _ = run(spark, stateful.scored_stream(in_files(spark, [*rows, (1, 10, [1.0] * 2)], schema, 2), scorer, 4, 0, None))
    assert [x[1] for x in found] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("files", [1, 3, 60])
def test_quiescence_by_timers(spark, files):
    rng = random.Random(files)
    rows = []
    for session in range(4):
        at = 0.0
        for seq in range(60):
            at += rng.choice([0.5, 1, 3, 8, 8, 20.0])
            rows.append((session, at, seq, rng.choice("ab") if rng.random() > 0.1 else None))
    schema = "session_id long, at double, seq long, value string"
    want = sorted(map(tuple, settled_after(spark.createDataFrame(rows, schema), "value", 8.0).select("session_id", "at", "seq", "value").collect()), key=repr)
    rows = [*sorted(rows, key=lambda r: r[1] + 5 * rng.random()), (-1, 1e5, 0, "clock")]  # a little out of order
    with stateful.in_rocksdb(spark):
        found, progress = run(spark, stateful.quiescent_stream(in_files(spark, rows, schema, files), 8.0, "30 seconds"))
    assert [x for x in found if x[0] >= 0] == want
    # at the end nothing waits but the clock: the last change of each session, and no row
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 2 * 5 + 2


def test_a_quiet_session_wakes_without_rows_of_its_own(spark):
    schema = "session_id long, at double, seq long, value string"
    rows = [(1, 10.0, 0, "a"), (2, 11.0, 0, "x"), (2, 12.0, 1, "y"), (2, 500.0, 2, "y"), (2, 501.0, 3, "z")]
    with stateful.in_rocksdb(spark):
        found, _ = run(spark, stateful.quiescent_stream(in_files(spark, rows, schema, 5), 60.0, "1 second"))
    assert found == [(1, 10.0, 0, "a"), (2, 12.0, 1, "y")]  # of z nothing is known yet


def plain_utterances(rows, min_silence, pause, longest):
    """As the rules say it, with the whole history at hand."""
    found, start, speaking = [], None, False
    for k, (at, p) in enumerate(rows):
        loud = [a for a, q in rows[: k + 1] if q >= 0.35]
        silence = at - (loud[-1] if loud else rows[0][0])
        before = speaking
        if p >= 0.5:
            speaking = True
        elif silence >= min_silence:
            speaking = False
        if speaking and not before and start is None:
            start = at - silence
        if before and not speaking and silence >= pause:
            found, start = found + [(start, at, False)], None
        elif start is not None and at - start >= longest:
            found, start = found + [(start, at, True)], at
    return [x for x in found if x[0] is not None]


@pytest.mark.parametrize("files", [1, 5])
def test_utterances_carry_their_rest_over_batches(spark, files):
    rng = random.Random(files)
    rows, want = [], []
    for session in range(5):
        at, line = 0.0, []
        for seq in range(150):
            at += rng.choice([0.25, 0.5, 1.0])
            line.append((at, rng.choice([0.1, 0.4, 0.9, 0.9]) if rng.random() < 0.8 else 0.1))
            rows.append((session, at, seq, line[-1][1]))
        want += [(session, *x) for x in plain_utterances(line, 1.0, 1.5, 8.0)]
    schema = "session_id long, at double, seq long, p double"
    found = sorted(map(tuple, stateful.utterances(spark.createDataFrame(rows, schema), 1.0, 1.5, 8.0).collect()))
    assert found == sorted(want) and {x[3] for x in found} == {True, False}
    rows = [*sorted(rows, key=lambda r: r[1] + 4 * rng.random()), (-1, 1e5, 0, 0.0)]
    with stateful.in_rocksdb(spark):
        streamed, _ = run(spark, stateful.utterance_stream(in_files(spark, rows, schema, files), 1.0, 1.5, 8.0, "30 seconds"))
    assert sorted(streamed) == sorted(want)


def test_sessions_of_utterances_share_rows_of_state(spark):
    rng = random.Random(7)
    rows = [(session, k + 1.0, k, rng.choice([0.1, 0.4, 0.9])) for session in range(5) for k in range(80)]
    schema = "session_id long, at double, seq long, p double"
    want = sorted(map(tuple, stateful.utterances(spark.createDataFrame(rows, schema), 1.0, 1.5, 8.0).collect()))
    with stateful.in_rocksdb(spark):
        stream = in_files(spark, [*sorted(rows, key=lambda r: r[1]), (-1, 1e5, 0, 0.0)], schema, 3)
        found, progress = run(spark, stateful.utterance_stream(stream, 1.0, 1.5, 8.0, "30 seconds"))
    assert sorted(found) == want
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]) <= 6
