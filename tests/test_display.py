"""Wire rows, wrapping, boundary timings."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tideline.functions import wire
from tideline.operators import earliness


def test_events_survive_the_wire(spark):
    rows = spark.createDataFrame([(1, "a", "fast", None), (2, "b", "fast", 3.0)], "line_id long, text string, lane string, closed double")
    coded = rows.select(wire.encode(wire.partial(F.col("line_id"), F.col("text"), F.col("lane"), F.col("closed"))).alias("j"))
    assert coded.first()["j"] == '{"kind":"partial","line_id":1,"text":"a","lane":"fast","settled":false}'
    back = coded.select(wire.decode(F.col("j")).alias("e")).select("e.*").orderBy("line_id").collect()
    assert [(r["kind"], r["settled"], r["reason"]) for r in back] == [("partial", False, None), ("partial", True, None)]


@pytest.mark.parametrize(
    ("text", "columns", "want"),
    [("one two three", 8, ["one two", "three"]), ("abcdefghij", 4, ["abcd", "efgh", "ij"]), ("你好世界", 4, ["你好", "世界"]), ("", 4, [""]), ("a b", 10, ["a b"])],
)
def test_wrap(text, columns, want):
    assert wire.wrap_text(text, columns) == want


def test_array_helpers(one):
    assert one([1, 2, 9, 1], lambda x: wire.take_while(x, lambda v: v < 5), "array<int>") == [1, 2]
    assert one([1, 2], lambda x: wire.take_while(x, lambda v: v < 5), "array<int>") == [1, 2]
    assert len(one(["t"] * 300, wire.truncate_tokens, "array<string>")) == 200
    assert one(9.0, lambda x: wire.clamp(x, F.lit(4.0)), "double") == 4.0


def test_flaps_and_stability(spark):
    texts = ["a b.", "a b. c", "a b c", "a b. c d", "a b. c d e"]
    hyps = spark.createDataFrame([(1, 1, i + 1, float(i + 1), t) for i, t in enumerate(texts)], "session_id long, line_id long, hyp_no int, at double, text string")
    closed = spark.createDataFrame([(1, 1, "a b. c d e", 7.0, 0.5, 0.0)], "session_id long, line_id long, text string, close_at double, pace double, start_s double")
    row = earliness.boundary_timings(hyps, closed).first()
    assert (row["word_no"], row["saved"], row["saved_raw"], row["lag"], row["flaps"]) == (1, 5.0, 6.0, 1.0, 1)
    found = earliness.earliness_table(earliness.boundary_timings(hyps, closed)).first()
    assert (found["n"], found["never_seen"], found["saved_p50"], found["passed"]) == (1, 0, 5.0, True)


HYPS = "session_id long, line_id long, hyp_no int, at double, text string"
CLOSED = "session_id long, line_id long, text string, close_at double, pace double, start_s double"


def below(plan, node):
    """The lines of a plan's tree that are below the first ``node``."""
    lines = plan.splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    first = next(i for i, x in enumerate(lines) if x.lstrip(" :+-").startswith(node))
    return list(itertools.takewhile(lambda i: depth[i] > depth[first], range(first + 1, len(lines)))), lines


@pytest.mark.parametrize("runs", [1, 2, 3])
def test_boundaries_against_plain_counts(spark, runs):
    rng = random.Random(runs)
    hyps, closed, want = [], [], []
    for line in range(12):
        said = [[rng.choice(["a", "b.", "c!"]) for _ in range(rng.randint(0, 2 * k))] for k in range(1, 9)]
        hyps += [(1, line, k, float(rng.randint(1, 20)) if line % 2 else float(k), " ".join(w) if w or rng.random() < 0.5 else None) for k, w in enumerate(said, 1)]
        final = [rng.choice(["a", "b."]) for _ in range(9)]
        closed.append((1, line, " ".join(final), 30.0, 0.5, 1.0))
        at = {h[2]: h[3] for h in hyps if h[1] == line}
        last = max((k for k, w in enumerate(said, 1) if len(w) >= 2), default=None)
        for place, word in enumerate(final[:-1]):
            if not word.endswith("."):
                continue
            seen = [k for k, w in enumerate(said, 1) if len(w) >= 2 and len(w) > place and w[place] != "a"]
            firm = [at[k] for k in seen if all(k - i in seen for i in range(runs)) and place + 1 < len(said[k - 1])]
            flaps = sum(k - 1 not in seen for k in seen) - 1 + (seen[-1] < last) if seen else 0
            saved_raw = 30.0 - min(at[k] for k in seen) if seen else None
            want.append((1, line, place, 30.0 - min(firm) if firm else None, saved_raw, min(firm) - (1.0 + 0.5 * (place + 1)) if firm else None, flaps))
    found = earliness.boundary_timings(spark.createDataFrame(hyps, HYPS), spark.createDataFrame(closed, CLOSED), runs)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


def test_hypotheses_are_sorted_before_they_become_rows_of_places(spark):
    found = earliness.boundary_timings(spark.createDataFrame([], HYPS), spark.range(1).select(F.lit(1).alias("session_id"), F.lit(1).alias("line_id"), F.lit("a. b").alias("text"), *(F.lit(1.0).alias(x) for x in ("close_at", "pace", "start_s"))).limit(1))
    inside, lines = below(found._jdf.queryExecution().analyzed().toString(), "Window")
    assert inside and not any("Generate" in lines[i] for i in inside)


def test_timings_are_worked_out_once(spark):
    times = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            times.add(len(batch))
            yield batch

    rows = spark.createDataFrame([(float(i), float(i), 1.0, i % 3) for i in range(50)], "saved double, saved_raw double, lag double, flaps long")
    found = earliness.earliness_table(rows.mapInPandas(counted, rows.schema)).first()
    assert (found["n"], found["saved_max"], found["flaps_p50"]) == (50, 49.0, 1.0)
    assert times.value == 50


def test_queries_are_listed_with_their_columns(spark):
    import duckdb

    from tideline.plans import registry

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    made = registry.queries()
    for name, sql in registry.oracle_sql().items():
        if name.startswith("stream_"):
            continue
        frame = made[name](spark, "/root/testdata/sf0.001")
        result = con.execute(sql)
        assert sorted(frame.columns) == sorted(d[0] for d in result.description), name
        assert frame.count() == len(result.fetchall()), name
