"""Recognisers and restorers as table functions."""

import pytest

from tideline.functions import recognition as rec


def pieces_of(spark, rows):
    return spark.createDataFrame(rows, "session_id long, piece_no long, start_s double, pcm array<float>")


class Prompted(rec.LevelEngine):
    """Says what it was prompted with; fails on a negative sample; tells no times of a single sample."""

    def feed(self, pcm, origin):
        if pcm[0] < 0:
            raise RuntimeError("lost")
        return [rec.Heard(f" {int(pcm[0])}  after  [{self.prompt.strip()}] ", [] if len(pcm) == 1 else [("x", origin + 0.5, origin + 1.0)])] if pcm[0] else []


def test_pieces_are_heard_in_order_with_prompts(spark):
    rows = [(1, 3, 9.0, [3.0]), (1, 1, 0.0, [1.0, 1.0]), (1, 2, 5.0, [-1.0]), (2, 1, 0.0, [7.0]), (1, 4, 12.0, [0.0]), (1, 5, 20.0, []), (1, 6, 21.0, None), (None, 1, 0.0, [5.0])]
    found = {(r["session_id"], r["piece_no"]): r for r in rec.recognised(pieces_of(spark, rows).repartition(4), Prompted, "prompted", rate=2, prompt_chars=12).collect()}
    assert set(found) == {(1, 1), (1, 2), (1, 3), (2, 1)}
    first, failed, third, other = (found[k] for k in ((1, 1), (1, 2), (1, 3), (2, 1)))
    assert (first["text"], first["start_s"], first["end_s"]) == ("1 after []", 0.5, 1.0)
    assert (failed["text"], failed["error"]) == (None, "RuntimeError: lost")  # costs its own row only
    assert (third["text"], third["start_s"], third["end_s"]) == ("3 after [1 after []]", 9.0, 9.5)  # the piece's own bounds
    assert other["text"] == "7 after []" and other["error"] is None
    counts = {r["session_id"]: (r["n"], r["failed"]) for r in rec.failures(rec.recognised(pieces_of(spark, rows), Prompted, "prompted", rate=2)).collect()}
    assert counts == {1: (3, 1), 2: (1, 0)}


def test_the_stand_in_keeps_the_whole_contract():
    engine = rec.LevelEngine(least=2.0, most=9.0, rate=10)
    assert engine.capabilities()["streaming"] and engine.backend()["device"] == "cpu" and engine.finalize() is None
    (heard,) = engine.feed([1.0, 3.5, 0.0, 4.0], 2.0)
    assert heard.text == "3 4" and heard.words == [("3", 2.1, 2.2), ("4", 2.3, 2.4)] and not heard.final
    assert engine.open_words() == heard.words and engine.finalize().final and engine.open_words() == []
    with pytest.raises(ValueError, match="overdriven"):
        engine.feed([9.0], 0.0)


class Marks:
    def restore(self, text):
        if text == "fail":
            raise RuntimeError("gone")
        return "Something else." if text == "change me" else text.capitalize() + "."


def test_marks_are_restored_where_words_stay(spark):
    rows = [(1, 1, "hello there"), (1, 2, "change me"), (1, 3, "fail"), (1, 4, None), (1, 5, ""), (2, 1, "so")]
    lines = spark.createDataFrame(rows, "session_id long, line_id long, text string")
    found = {(r["session_id"], r["line_id"]): (r["text"], r["marked"], r["error"]) for r in rec.restored(lines, Marks, "marks").collect()}
    assert found == {
        (1, 1): ("Hello there.", True, None), (1, 2): ("change me", False, None), (1, 3): ("fail", False, "RuntimeError: gone"),
        (1, 4): (None, False, None), (1, 5): ("", False, None), (2, 1): ("So.", True, None),
    }
    assert {r["text"] for r in rec.restored(lines, None).collect()} == {t for _, _, t in rows}
    assert {r["failed"] for r in rec.failures(rec.restored(lines, Marks, "marks")).collect()} == {0, 1}
