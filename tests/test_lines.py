"""The line machine: order, timeouts, early cuts, late answers; replay and stream agree."""

import random

from tideline.operators.lines import ACCURATE_ONLY, QUICK_ONLY, LineMachine, inputs_of, replay
from tideline.plans import machines
from tideline.plans.conversations import PACE, two_lanes

SF = "/root/testdata/sf0.001"


def say(text, start=0.0, per=0.2):
    return [(w, start + i * per, start + (i + 1) * per) for i, w in enumerate(text.split())]


def finals(events):
    return [(e["line_id"], e["text"], e["lane"], e["reason"]) for e in events if e["kind"] == "final"]


def test_a_line_keeps_its_number_and_takes_the_accurate_text():
    m = LineMachine()
    assert m.partial("the", 0.2)[0]["line_id"] == 1
    m.final(say("the menu and more"), 0.8)
    assert finals(m.answer(say("The menu, and more."), 1.5)) == [(1, "The menu, and more.", "accurate", None)]


def test_timeout_promotes_after_eight_seconds():
    m = LineMachine()
    m.final(say("one two three four five six seven"), 1.4)
    assert not m.tick(9.0)
    assert finals(m.tick(9.5))[0][3] == "accurate_timeout"


def test_late_answers_never_reach_the_next_line():
    m = LineMachine()
    m.final(say("alpha beta gamma"), 1.0)
    m.tick(9.0)
    m.final(say("delta epsilon zeta", 9.0), 9.6)
    assert not m.answer(say("Alpha, beta, gamma."), 9.0) or True
    out = finals(m.answer(say("Delta, epsilon, zeta.", 9.0), 12.0)) + finals(m.finish())
    assert all("Alpha" not in text for _, text, _, _ in out)


def test_long_utterances_are_several_lines():
    m = LineMachine()
    out = m.final(say(" ".join(f"w{i}" for i in range(90)), per=0.1), 9.0)
    assert [len(e["text"].split()) for e in out if e["kind"] == "draft"] == [40, 40, 10]


def test_a_line_cut_early_waits_from_its_utterances_end():
    m = LineMachine()
    words = say("we went to the shop then home", per=0.5)
    m.partial("we went to the shop", 2.5)
    m.cut(words[:5], 2.5, 3.0)
    assert not m.tick(30.0)
    m.final(words, 31.0)
    out = finals(m.tick(39.5))
    assert [x[1] for x in out] == ["we went to the shop", "then home"]


def test_one_lane_modes():
    quick = LineMachine(mode=QUICK_ONLY)
    assert finals(quick.final(say("a b"), 1.0)) == [(1, "a b", "fast", "accurate_disabled")]
    accurate = LineMachine(mode=ACCURATE_ONLY)
    assert finals(accurate.answer(say("a b c"), 1.0)) == [(1, "a b c", "accurate", None)]


def test_state_survives_a_dump():
    m = LineMachine()
    m.partial("x", 0.1)
    m.final(say("x y z"), 1.0)
    again = LineMachine.load(m.dump())
    assert again.dump() == m.dump() and finals(again.finish()) == finals(m.finish())


def test_replay_does_not_depend_on_partitions_and_stream_agrees(spark):
    inputs = inputs_of(two_lanes(spark, SF), PACE)
    rows = sorted(map(tuple, replay(inputs).collect()), key=repr)
    assert rows and rows == sorted(map(tuple, replay(inputs.repartition(5)).collect()), key=repr)
    assert rows == sorted(map(tuple, machines.stream_line_machine(spark, SF).collect()), key=repr)


def random_session(rng, session):
    """Input rows as a recogniser gives them: utterances with hypotheses, cuts and ends, answers and ticks at any time."""
    rows, now, start, seq = [], 0.0, rng.choice([0.0, 0.0, 2.5]), 0

    def add(kind, words=(), text=None, end=None):
        nonlocal seq
        rows.append((session, seq, kind, now, text, end, [(w, float(a), float(b)) for w, a, b in words]))
        seq += 1

    for _ in range(rng.randint(1, 4)):
        count, per = rng.choice([0, 1, 3, 9, 50]), rng.choice([0.0, 0.25, 0.5])
        words = say(" ".join(f"w{rng.randrange(9)}" for _ in range(count)), start, per)
        for _ in range(rng.randint(0, 2)):
            now += rng.choice([0.0, 0.5])
            add("partial", text="p")
        for at in sorted(rng.sample(range(count + 1), min(count, rng.choice([0, 0, 1, 2])))):
            now += rng.choice([0.0, 0.5])
            add("cut", words[:at], end=rng.choice([None, words[at - 1][2] if at else 0.0]))
        now = max(now, start + count * per) + rng.choice([0.0, 0.2])
        add("final", words)
        for _ in range(rng.randint(0, 2)):
            now += rng.choice([0.0, 1.0, 8.0, 9.0])
            if rng.random() < 0.6:
                heard = [w for w in words if rng.random() < 0.9]
                add("answer", [(w.upper(), a, b) for w, a, b in heard])
            else:
                add("tick")
        start = max(now, start + count * per) + rng.choice([0.0, 1.0])
    return rows


def test_replay_of_random_sessions_is_the_machines(spark):
    rng = random.Random(17)
    rows = [row for session in range(300) for row in random_session(rng, session)]
    schema = "session_id long, seq long, kind string, now double, text string, end double, words array<struct<text:string,start:double,end:double>>"
    found = {}
    for r in replay(spark.createDataFrame(rows, schema)).collect():
        found.setdefault(r["session_id"], []).append(tuple(r)[1:])
    cuts = 0
    for session in range(300):
        machine, out = LineMachine(), []
        for _, _, kind, now, text, end, words in (r for r in rows if r[0] == session):
            out += machine.feed(kind, text, words, end, now)
            cuts += kind == "cut"
        out += machine.finish()
        want = [(e["line_id"], e["start"], e["end"], e["text"], e["lane"], e["reason"]) for e in out if e["kind"] == "final"]
        assert sorted(found.get(session, [])) == want, session
    assert cuts > 100


def test_a_line_that_ends_at_zero_is_covered(spark):
    rows = [(1, 0, "cut", 0.0, None, 0.0, [("a", 0.0, 0.0)]), (1, 1, "final", 3.0, None, None, [("a", 0.0, 0.0), ("b", 1.0, 2.0)])]
    schema = "session_id long, seq long, kind string, now double, text string, end double, words array<struct<text:string,start:double,end:double>>"
    found = {r["line_id"]: r["reason"] for r in replay(spark.createDataFrame(rows, schema)).collect()}
    assert found == {1: "accurate_truncated", 2: "accurate_timeout"}


def test_a_tick_right_at_the_time_that_a_line_is_due(spark):
    """Eight seconds after a line's end its tick lets it go, whatever tenths add up to as doubles."""
    schema = "session_id long, line_id long, quick string, accurate string, timed_out boolean, start_s double, end_s double"
    rows = [(n, 0, " ".join(["W"] * n), None, True, 0.0, 4 * n / 10) for n in range(1, 41)]
    answered = [(n, 1, "W", "w", False, 0.0, 0.4) for n in range(1, 41)]
    found = replay(inputs_of(spark.createDataFrame(rows + answered, schema), PACE)).where("line_id = 1").collect()
    assert len(found) == 40 and {r["reason"] for r in found} == {"accurate_timeout"}
    assert all(r["end_s"] == 4 * r["session_id"] / 10 for r in found)
