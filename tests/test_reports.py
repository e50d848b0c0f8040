"""Loads, stages, gates, and what lines are on display."""

import random

import pytest
from pyspark.sql import functions as F

from tideline.functions import tokens
from tideline.operators import load, segment
from tideline.plans import reports


def test_loads_over_the_last_passes(spark):
    rng = random.Random(5)
    rows = [(s, float(k), k, float(rng.choice([0, 1, 4])), float(rng.choice([0, 1, 2]))) for s in (1, 2) for k in range(80)]
    found = {(r["session_id"], r["seq"]): r for r in load.work_load(spark.createDataFrame(rows, "session_id long, at double, seq long, window_s double, cost_s double")).collect()}
    for s, _, k, _, _ in rows:
        part = [(w, c) for x, _, j, w, c in rows if x == s and k - 31 <= j <= k]
        heard, cost = sum(w for w, _ in part), sum(c for _, c in part)
        r = found[s, k]
        assert (r["n"], r["mean_window"]) == (len(part), heard / len(part)) and r["factor"] == (cost / heard if heard else 0.0)
        assert r["keeping_up"] == (r["factor"] < 1)


def test_thirty_two_slow_passes_are_forgotten(spark):
    rows = [(1, float(k), k, 4.0, 6.0 if k < 32 else 0.4) for k in range(64)]
    found = {r["seq"]: r for r in load.work_load(spark.createDataFrame(rows, "session_id long, at double, seq long, window_s double, cost_s double")).collect()}
    assert not found[31]["keeping_up"] and found[63]["factor"] == pytest.approx(0.1) and found[63]["keeping_up"]


def test_stages_count_from_the_end_of_speech(spark):
    emitted = [(1, 1, "quick", 5.0), (1, 1, "quick", 4.5), (1, 1, "partial", 2.0), (1, 2, "quick", 9.0), (1, 3, "quick", 9.0)]
    ends = [(1, 1, 4.0), (1, 2, 7.0)]
    frame = spark.createDataFrame(emitted, "session_id long, line_id long, stage string, at double")
    found = load.stage_latencies(frame, spark.createDataFrame(ends, "session_id long, line_id long, end_at double"))
    assert sorted(map(tuple, found.collect())) == [(1, 1, "partial", 0.0), (1, 1, "quick", 0.5), (1, 2, "quick", 2.0)]
    assert {r["stage"]: (r["n"], r["p50"], r["longest"]) for r in load.stage_table(found).collect()} == {"partial": (1, 0.0, 0.0), "quick": (2, 2.0, 2.0)}


def test_content_gates(spark):
    rows = reports.content_gates(spark, "/root/testdata/sf0.001").collect()
    assert rows and all((r["g2a"] == "pass") == (r["content_wer"] <= 15) and (r["g2b"] == "pass") == (r["drop_rate"] <= 2) for r in rows)
    assert {r["g2b"] for r in rows} >= {"fail"}


@pytest.mark.parametrize("keep", [0, 1, 2, 5])
def test_lines_on_display(spark, keep):
    rng = random.Random(keep)
    rows = [(s, k, rng.randrange(12)) for s in range(20) for k in range(15)]
    found = {r["session_id"]: r["shown"] for r in segment.keep_newest(spark.createDataFrame(rows, "session_id long, seq long, line_id long"), keep).collect()}
    for s in range(20):
        shown = []
        for _, _, line in (r for r in rows if r[0] == s):
            shown = segment.place_row(shown, line, keep)
        assert found[s] == shown and 1 <= len(shown) <= max(keep, 1)


def test_rows_without_pieces_never_reach_a_model(spark):
    rows = spark.createDataFrame([(1, ["a", None, "b"]), (2, []), (3, None)], "k long, pieces array<string>")
    asked = []

    def model(frame):
        asked.extend(tuple(r) for r in frame.select("k", "piece").collect())
        return frame.withColumn("answer", F.concat(F.coalesce("piece", F.lit("none")), F.lit("!")))

    found = {r["k"]: r["pieces"] for r in tokens.scatter_gather(rows, ["k"], "pieces", lambda p: p.isNull() | (p == "a"), model).collect()}
    assert sorted(asked, key=repr) == sorted([(1, "a"), (1, None)], key=repr) and found == {1: ["a!", "none!", "b"], 2: [], 3: []}
