"""Cases of the merge decision, gates, segments, folds, queues, scores and words."""

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideline.functions import stats
from tideline.functions.audio import GainControl, Resampler, resample, rms
from tideline.functions.models import EchoTranslator, fill_missing
from tideline.operators import confirm, fold, gate, joins, lines, merge, scoring, segment, waiting, words
from tideline.plans import registry
from tideline.streaming.queries import GateState

ELEVEN = "one two three four five six seven eight nine ten eleven"


@pytest.mark.parametrize(
    ("quick", "accurate", "late", "want"),
    [
        (ELEVEN, "one two three four", False, ("fast", "accurate_truncated")),
        ("NO NO", "No, no, no, no.", False, ("accurate", None)),
        ("um yeah", "", False, ("accurate", None)),
        ("a menu", "", False, ("fast", "accurate_truncated")),
        ("one two three four", " ".join(["alpha beta gamma delta"] * 3), False, ("fast", "accurate_looped")),
        ("one two", None, True, ("fast", "accurate_timeout")),
        ("one two", None, False, None),
        (None, "x", False, ("accurate", None)),
        (None, None, True, None),
    ],
)
def test_decision_in_both_forms(spark, quick, accurate, late, want):
    row = spark.createDataFrame([(quick, accurate, late)], "q string, a string, t boolean")
    found = row.select(merge.decide(F.col("q"), F.col("a"), F.col("t")).alias("d")).first()["d"]
    assert (found and (found["lane"], found["reason"])) == want
    plain = lines.decide_text(quick, accurate, late)
    assert (plain and (plain[1], plain[2])) == want


def test_lane_mode():
    assert merge.lane_mode(True, False) == "quick_only"
    with pytest.raises(ValueError):
        merge.lane_mode(False, False)


def series_of(spark, values, step=0.032):
    return spark.createDataFrame([(1, i * step, i, float(p)) for i, p in enumerate(values)], "session_id long, at double, seq long, p double")


def test_gate_cases(spark):
    found = gate.gate_events(series_of(spark, [0, 0.1, 0.9] + [0.0] * 8)).orderBy("seq").collect()
    assert [(r["event"], r["seq"]) for r in found] == [("start", 2), ("end", 9)]
    assert gate.gate_events(series_of(spark, [0, 0.1, 0.9] + [0.0] * 5)).count() == 1
    assert gate.gate_events(series_of(spark, [0.4] * 5)).count() == 0


def test_gate_matches_a_loop(spark):
    rng = random.Random(3)
    values = [rng.choice([0.0, 0.2, 0.4, 0.6, 0.9]) for _ in range(400)]
    state, want = GateState(), []
    for i, p in enumerate(values):
        event = state.push(i * 0.032, p, 0.2)
        if event:
            want.append((i, event))
    found = gate.gate_events(series_of(spark, values)).orderBy("seq").collect()
    assert [(r["seq"], r["event"]) for r in found] == want


def cut(runs, pause=18, longest=375, look_back=93):
    cutter = segment.PieceCutter(pause, longest, look_back)
    for p, n in runs:
        for _ in range(n):
            cutter.push(p)
    return cutter.finish()


@pytest.mark.parametrize(
    ("runs", "want"),
    [
        ([(0, 10), (0.9, 50), (0, 22), (0.9, 30), (0, 10)], [(4, 66), (76, 118)]),
        ([(0, 10), (0.9, 50), (0, 10), (0.9, 30), (0, 10)], [(4, 106)]),
        ([(0.9, 469)], [(0, 282), (282, 469)]),
        ([(0.9, 300), (0.4, 6), (0.9, 163)], [(0, 300), (300, 469)]),
        ([(0, 20), (0.9, 358), (0.2, 10), (0.1, 40)], [(14, 394)]),
        ([(0.1, 300)], []),
        ([(0, 20), (0.9, 40)], [(14, 60)]),
    ],
)
def test_pieces(runs, want):
    assert cut(runs) == want


def test_gaps_and_changes(spark):
    rows = spark.createDataFrame([(1, 0.0, 1, "a"), (1, 0.1, 2, "a"), (1, 1.1, 3, "b"), (1, 9.1, 4, "a")], "session_id long, at double, seq long, kind string")
    filled = [r["filled"] for r in gate.missing_silence(rows).orderBy("seq").collect()]
    assert filled == pytest.approx([0.0, 0.0, 1.0, 2.0])
    assert [r["seq"] for r in gate.changed_only(rows, "kind").orderBy("seq").collect()] == [1, 3, 4]
    assert [r["seq"] for r in gate.settled_after(rows, "kind", 2.0).orderBy("seq").collect()] == [3, 4]
    assert gate.sessions(rows.withColumn("p", F.lit(0.0)), 1.0).count() == 3


def test_fold_keeps_the_last_value(spark):
    log = spark.createDataFrame([(1, 0, "a", None), (2, 1, "b", None), (1, 2, None, "x"), (2, 3, None, "y"), (2, 4, None, None)], "line_id long, seq long, source string, translation string")
    found = fold.fold_log(log, ["line_id"], "seq").orderBy("line_id").collect()
    assert [(r["source"], r["translation"]) for r in found] == [("a", "x"), ("b", "y")]


def test_overtaken_lines(spark):
    rows = spark.createDataFrame([(1, i) for i in (1, 2, 3, 4)], "session_id long, line_id long")
    done = spark.createDataFrame([(1, 1, "x"), (1, 3, "z")], "session_id long, line_id long, translation string")
    found = waiting.in_order(rows, done).orderBy("line_id").collect()
    assert [r["state"] for r in found] == ["translated", "overtaken", "translated", "flushed"]


def test_superseded_work(spark):
    queue = spark.createDataFrame([(1, 1, 1, 2), (1, 2, 2, 0), (1, 3, 2, 1), (1, 4, 2, 1), (2, 5, 7, 1), (2, 6, 9, 2)], "session_id long, job_id long, line_id long, rank int")
    kept = waiting.prune_superseded(queue).orderBy("job_id").collect()
    assert [r["job_id"] for r in kept] == [1, 4, 6]


def test_admission_counts_admitted_work(spark):
    offers = spark.createDataFrame([(1, i, float(i), float(d)) for i, d in ((1, 9), (2, 9), (3, 4), (4, 5), (9, 20))], "session_id long, seq long, at double, done_at double")
    assert [r["admitted"] for r in segment.admit(offers, 2).orderBy("seq").collect()] == [True, True, False, False, True]


def test_rows_kept():
    assert segment.place_row([4, 5], 6, 2) == [5, 6]
    assert segment.place_row([4, 6], 5, 2) == [4, 6]
    assert segment.place_row([4, 6], 4, 2) == [4, 6]


def test_alignment_and_scores(spark):
    ops = scoring.align_words("a b c d".split(), "a x c".split())
    assert [o for o, _ in ops] == ["E", "S", "E", "D"]
    pairs = spark.createDataFrame([(1, ELEVEN, "one two three four"), (2, "", ""), (3, "", "x y"), (4, "alpha beta", "alpha beta")], "k long, ref string, hyp string")
    found = {r["k"]: r for r in scoring.measure(pairs, ["k"]).collect()}
    assert found[1]["drops"] == ["five six seven eight nine ten eleven"] and found[1]["drop_rate"] == pytest.approx(700 / 11)
    assert (found[2]["wer"], found[3]["wer"], found[4]["wer"]) == (0.0, 100.0, 0.0)


def test_alignment_costs_match_a_plain_table():
    rng = random.Random(5)
    for _ in range(50):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 9))]
        b = [rng.choice("abc") for _ in range(rng.randint(0, 9))]
        d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j - 1] + (a[i - 1] != b[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
        assert sum(o != "E" for o, _ in scoring.align_words(a, b)) == d[-1][-1]


def test_chrf(spark):
    pairs = spark.createDataFrame([(1, "abcdef", "abcdef"), (2, "abc", "xyz"), (3, "", "x")], "k long, ref string, hyp string")
    found = {r["k"]: r["chrf"] for r in scoring.chrf(pairs, ["k"]).collect()}
    assert found[1] == pytest.approx(100.0) and found[2] == 0.0 and found[3] == 0.0


def test_boundary_scores(spark):
    assert scoring.match_boundaries([3, 4, 20], [4, 9], [4, 9]) == (1, 2, 2)
    pairs = spark.createDataFrame([(1, [], [])], "k long, predicted array<int>, real array<int>")
    row = scoring.boundary_scores(pairs, ["k"]).first()
    assert math.isnan(row["precision"]) and math.isnan(row["recall"])


def test_percentiles(spark):
    rows = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "v double")
    got = rows.agg(stats.nearest_rank(F.col("v"), 0.5), stats.floor_rank(F.col("v"), 0.5), stats.upper_median(F.col("v"))).first()
    assert list(got) == [3.0, 3.0, 3.0]
    ten = spark.createDataFrame([(float(x),) for x in range(10)], "v double")
    assert list(ten.agg(stats.nearest_rank(F.col("v"), 0.9), stats.floor_rank(F.col("v"), 0.9)).first()) == [8.0, 9.0]
    empty = rows.where("v > 9").agg(stats.nearest_rank(F.col("v"), 0.5), stats.upper_median(F.col("v"))).first()
    assert math.isnan(empty[0]) and empty[1] == 0.0


def hypotheses_of(spark, texts, at):
    rows = [(1, 1, i + 1, float(t), x) for i, (x, t) in enumerate(zip(texts, at))]
    return spark.createDataFrame(rows, "session_id long, line_id long, hyp_no int, at double, text string")


def test_boundary_policy(spark):
    def cuts(texts, at):
        return [(r["hyp_no"], r["word_no"]) for r in confirm.boundaries(hypotheses_of(spark, texts, at)).orderBy("hyp_no").collect()]

    grown = ["we went to the shop.", "we went to the shop. then", "we went to the shop. then it was late."]
    assert cuts(grown, [2.0, 2.5, 3.0]) == [(2, 4)]
    assert cuts(["a b c d. e", "a b c d e", "a b c d. e"], [5.0, 5.0, 5.0]) == []


def test_early_prefix_only_grows(spark):
    texts = [
        "one two. three",
        "one two. three four",
        "one two. three four five, six seven",
        "one two. three four five, six seven eight nine. ten",
        "one two. three four five, six seven eight nine. ten eleven",
    ]
    found = confirm.early_prefixes(hypotheses_of(spark, texts, [1.0] * 5)).orderBy("hyp_no").collect()
    assert [(r["hyp_no"], r["prefix"]) for r in found] == [(2, "one two."), (5, "one two. three four five, six seven eight nine.")]


def test_words_of_pieces(spark):
    rows = [(1, 0, "▁IN", 0.0, 2.0), (1, 1, "▁", 0.5, 2.0), (1, 2, "NURS", 0.6, 2.0), (1, 3, "ING", 0.7, 2.0), (1, 4, "▁", 1.5, 2.0)]
    found = words.merge_pieces(spark.createDataFrame(rows, "session_id long, piece_no long, piece string, start_s double, t_end double")).orderBy("word_no").collect()
    assert [(r["word"], r["start_s"], r["end_s"]) for r in found] == [("IN", 0.0, 0.5), ("NURSING", 0.5, 2.0)]
    assert words.decode_tokens([("é".encode()[:1], 1.0), ("é".encode()[1:] + b"a", 2.0), (b"\xff ok", 3.0)]) == [("éa", 1.0), ("� ok", 3.0)]


def merged_plainly(rows):
    """``(session, number, word, start, end)`` of ``(session, piece, start, t_end)`` in order."""
    found = []
    for session in dict.fromkeys(r[0] for r in rows):
        groups = []
        for _, piece, start, t_end in (r for r in rows if r[0] == session):
            if not groups or piece[:1] in ("▁", " "):
                groups.append(["", start, t_end])
            groups[-1][0] += piece[1:] if piece[:1] in ("▁", " ") else piece
            groups[-1][2] = max(groups[-1][2], t_end)
        full = [g for g in groups if g[0]]
        ends = [g[1] for g in full[1:]] + [max(g[1:]) for g in full[-1:]]
        found += [(session, i, g[0], g[1], end) for i, (g, end) in enumerate(zip(full, ends, strict=True))]
    return found


def test_words_of_runs_wherever_batches_end():
    draw = random.Random(5)
    for _ in range(300):
        rows = [
            (session, "".join(draw.choices(["▁", " ", "", "é", "b▁"], [3, 1, 2, 4, 1], k=draw.randrange(3))), round(i * 0.1, 6), draw.random() * 3)
            for session in draw.sample([None, 1, 2, 3], draw.randrange(1, 4))
            for i in range(draw.randrange(9))
        ]
        runs, batches = [], []
        for session, piece, start, t_end in rows:
            if not runs or runs[-1]["session_id"] != session or draw.random() < 0.5:
                runs += [{"session_id": session, "pieces": [], "t_end": t_end}] * (draw.random() < 0.2)
                runs.append({"session_id": session, "pieces": [], "t_end": t_end})
            runs[-1]["pieces"].append({"piece": piece, "start_s": start})
        kind = pa.schema([("session_id", pa.int64()), ("pieces", pa.list_(pa.struct([("piece", pa.string()), ("start_s", pa.float64())]))), ("t_end", pa.float64())])
        flat = [(r["session_id"], p["piece"], p["start_s"], r["t_end"]) for r in runs for p in r["pieces"]]
        while runs:
            size = draw.randrange(1, 4)
            batches.append(pa.RecordBatch.from_pylist(runs[:size], kind))
            runs = runs[size:]
        found = [tuple(r.values()) for batch in words.merged_words(iter(batches)) for r in batch.to_pylist()]
        assert found == merged_plainly(flat)


def test_words_are_merged_without_sorting_pieces(spark, tmp_path):
    rows = [
        (1, 0, "ab cd▁ef gh▁i"), (1, 1, "one"), (1, 1, "one two▁"), (1, None, "last"), (2, 0, ""), (2, 3, "ab▁▁ ▁ x"),
        (3, 1, None), (None, 0, "no name"),
    ]
    spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = registry.queries()["subword_words"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()["subword_words"]).fetchall()
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
    # lines are sorted, with their texts; pieces and words are never shuffled, sorted or grouped
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 2 and "Aggregate" not in plan
    assert "Sort" not in plan[: plan.index("MapInArrow")] and plan.index("MapInArrow") < plan.index("transform(") < plan.index("Sort [")


def test_restore_marks(spark):
    rows = spark.createDataFrame([(["a", "b"], ["A,", "b."]), (["a", "b"], ["a", "c"])], "w array<string>, m array<string>")
    assert [r[0] for r in rows.select(words.restore_marks(F.col("w"), F.col("m"))).collect()] == [["A,", "b."], ["a", "b"]]


def test_asof_and_ranges(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, 4.0), (1, 9.0)], "session_id long, at double")
    points = spark.createDataFrame([(1, 2.0), (1, 4.0)], "session_id long, at double")
    assert [r["n"] for r in joins.next_at(rows, points, "n").orderBy("at").collect()] == [2.0, 4.0, None]
    anchors = spark.createDataFrame([(1, 2.0, 102.5), (1, 4.0, 105.0)], "session_id long, at double, wall double")
    assert [r["wall"] for r in joins.wall_clock(rows, anchors).orderBy("at").collect()] == [101.5, 105.0, 110.0]
    spans = spark.createDataFrame([(1, 7, 3.0, 8.8)], "session_id long, span_id long, start double, end double")
    assert [r["at"] for r in joins.cut_ranges(rows, spans, 0.3, 2.0).orderBy("at").collect()] == [4.0, 9.0]


def test_resampling_ignores_chunk_sizes():
    rng = np.random.default_rng(1)
    samples = rng.normal(size=4410)
    whole = resample(samples, 44100, 16000)
    machine, parts, at = Resampler(44100, 16000), [], 0
    for size in (1, 7, 500, 3, 2000, 10_000):
        parts.append(machine.push(samples[at : at + size]))
        at += size
    assert np.allclose(np.concatenate(parts), whole) and abs(len(whole) - 1600) <= 1


def test_gain_holds_on_silence():
    control = GainControl()
    loud = control.process(np.full(512, 0.01))
    level = control.level
    control.process(np.zeros(512))
    assert control.level == level and rms(loud) == pytest.approx(0.067)


def test_second_translator_fills_holes():
    assert fill_missing(["x", " ", ""], ["a b", "c d", "e f"], EchoTranslator()) == ["x", "d c", "f e"]


def test_alignment_in_bounded_memory(spark, monkeypatch):
    """Long texts: the table's rows are kept as far as a bound goes, with the same steps; steps reach Spark as numbers."""
    import tracemalloc

    rng = random.Random(4)
    said = [str(rng.randrange(400)) for _ in range(5000)]
    heard = [w for w in said if rng.random() < 0.7]
    whole = scoring.align_words(said, heard)
    monkeypatch.setattr(scoring, "TABLE_BYTES", 1 << 18)
    tracemalloc.start()
    ops, places = scoring._steps(said, heard)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(scoring.STEPS[op], at) for op, at in zip(ops.tolist(), places.tolist(), strict=True)] == whole
    assert peak < 8 * scoring.TABLE_BYTES
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 40))] for _ in range(2))
        few = scoring.align_words(a, b)
        with monkeypatch.context() as patch:
            patch.setattr(scoring, "TABLE_BYTES", 1)
            assert scoring.align_words(a, b) == few
    rows = spark.createDataFrame([(said, heard), (["a"], []), ([], ["b"]), ([], [])], "r array<string>, h array<string>")
    found = [[(x["op"], x["ref_no"]) for x in r["ops"]] for r in rows.select(scoring.alignment("r", "h").alias("ops")).collect()]
    assert found == [whole, [("D", 0)], [("I", 0)], []]


def test_flags_of_words_are_bytes_in_the_shuffle(spark):
    hyps = hypotheses_of(spark, ["Well. yes", "Well. yes it is."], [1.0, 2.0])
    assert dict(confirm.agreed(hyps, 2).dtypes)["spoken"] == "array<tinyint>"
