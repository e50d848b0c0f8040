"""Literal cases of the text and time functions."""

import pytest
from pyspark.sql import functions as F

from tideline.functions import chunks, fullwidth, interjections
from tideline.functions import text as tx
from tideline.functions import times as tm


@pytest.mark.parametrize(
    ("build", "value", "want"),
    [
        (tx.normalize, "MENU,", "menu"),
        (tx.normalize, '"Don\'t"', "don't"),
        (tx.content_words, "um so yeah the menu", ["so", "the", "menu"]),
        (lambda x: tx.metric_tokens(x, True), "25 items", ["twenty", "five", "items"]),
        (lambda x: tx.metric_tokens(x, True), "1500", ["one", "thousand", "five", "hundred"]),
        (lambda x: tx.metric_tokens(x, False), "0 colour 100", ["zero", "color", "one", "hundred"]),
        (lambda x: tx.metric_tokens(x, True), "um I_D x a i Centre", ["a", "i", "center"]),
        (lambda x: tx.metric_tokens(x, False), "999999 12000 1234567", "nine hundred ninety nine thousand nine hundred ninety nine twelve thousand 1234567".split()),
        (tx.collapse_spaced_ellipsis, "Oh . . . well", "Oh... well"),
        (tx.collapse_spaced_ellipsis, "One. Two.", "One. Two."),
        (tx.trim_final_stop, "Hello everybody. ", "Hello everybody"),
        (tx.trim_final_stop, "Or we can...", "Or we can..."),
        (tx.trim_final_stop, ".", "."),
        (tx.sentences, "3.5 seconds. Or we can... Then . . . go!", ["3.5 seconds.", "Or we can...", "Then . . .", "go!"]),
        (tx.ends_sentence, 'done."', True),
        (tx.ends_sentence, "done,", False),
        (tx.one_line, " a\n\tb  c ", "a b c"),
        (tx.escape_vtt, "a < b & c > d", "a &lt; b &amp; c &gt; d"),
        (tx.strip_upper, "The menu, don't - go!", "THE MENU DON'T GO"),
        (lambda x: tx.prompt_tail_on_word(x, 8), "alpha beta gamma", "gamma"),
        (lambda x: tx.tail_words(x, 1), "a b c", "b c"),
        (tx.readable, "I THINK I AM", "I think I am"),
        (lambda x: tx.width_cut(x, 12), " ".join(f"w{i}" for i in range(14)), [" ".join(f"w{i}" for i in range(7)), " ".join(f"w{i}" for i in range(7, 14))]),
        (tx.annotation, "[applause]", True),
        (tx.annotation, "[one) two", False),
        (tx.only_marks, ". . .", True),
        (tx.usable_translation, "好", True),
        (tx.usable_translation, "", False),
    ],
)
def test_text(one, build, value, want):
    assert one(value, build) == want


@pytest.mark.parametrize(("count", "sizes"), [(14, [7, 7]), (25, [9, 8, 8]), (29, [10, 10, 9]), (12, [12]), (0, [])])
def test_width_cut_is_even(one, count, sizes):
    found = one(" ".join("w" for _ in range(count)), lambda x: tx.width_cut(x, 12))
    assert [len(p.split()) for p in found] == sizes


def test_chunks_of_forty(one):
    found = one([str(i) for i in range(90)], lambda x: tx.chunk_words(x, 40), "array<string>")
    assert [len(p) for p in found] == [40, 40, 10]


def test_repeated_run(one):
    assert one("a b c d a b c d".split(), lambda x: tx.has_repeated_run(x, 4), "array<string>") is True
    assert one("a b c d a b c".split(), lambda x: tx.has_repeated_run(x, 4), "array<string>") is False
    assert one([], lambda x: tx.has_repeated_run(x, 4), "array<string>") is False


@pytest.mark.parametrize(
    ("text", "most", "run", "heard", "want"),
    [
        ("Uh . . . Oh, we also talked about it in the other room today.", 6, 0, False, 2),
        ("one two three, four five six seven, eight nine.", 6, 6, True, 2),
        (" ".join("w" for _ in range(14)), 6, 12, False, 2),
        ("  ", 6, 6, False, 0),
        ("all of it. And more.", 0, 6, False, 1),
    ],
)
def test_chunks(one, text, most, run, heard, want):
    assert len(one(text, lambda x: chunks.split(x, most, run, heard))) == want


@pytest.mark.parametrize(
    ("piece", "want"),
    [("Mm-hmm.", "嗯."), ("Oh, yeah.", "喔,對."), ("Ummm", "呃"), ("uh-uh", "不"), ("on", None), ("ere", None), ("Right?", "對?"), ("o.k.", "好."), ("42", None), ("- ...", None), ("wow so", None)],
)
def test_interjections(one, piece, want):
    assert one(piece, interjections.render) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("你好, 世界.", "你好，世界。"), ("3.5 GHz 很快!", "3.5 GHz 很快！"), ("好 ...", "好……"), ("你 好", "你好"), ("等等,", "等等"), ("a,b", "a,b")],
)
def test_full_width(one, text, want):
    assert one(text, fullwidth.punctuate) == want


def test_finish_and_close_up(one):
    assert one(["软件 好,", "", "对"], lambda x: fullwidth.finish(x), "array<string>") == "軟體 好，对".replace(" ", "")
    assert one("a  b 你 好", fullwidth.close_up) == "a b你好"


@pytest.mark.parametrize(("seconds", "want"), [(3723.456, "01:02:03,456"), (float("nan"), "00:00:00,000"), (-1.0, "00:00:00,000"), (360000.0, "100:00:00,000")])
def test_stamp(one, seconds, want):
    assert one(seconds, lambda x: tm.stamp(x, ","), "double") == want


def test_spans(one):
    assert one(12.0, lambda x: tm.cue_end(x, x), "double") == 12.5
    assert one(3725.9, tm.clock, "double") == "1:02:05"
    assert one(65.0, tm.clock, "double") == "1:05"
    assert one(1.2345, tm.round_ms, "double") == pytest.approx(1.235)
    assert one(5 << 20, lambda x: tm.human_bytes(x), "long") == "5 MB"
    assert one(3 << 30, lambda x: tm.human_bytes(x), "long") == "3.00 GB"


def test_nulls(one):
    assert one(None, tx.normalize) is None
    assert one(None, lambda x: F.size(tx.content_words(F.coalesce(x, F.lit(""))))) == 0


def test_parts_are_trimmed_and_joined(spark):
    rows = spark.createDataFrame([(["a", " b ", "  ", "", " c"],), ([],)], "x array<string>")
    assert [r[0] for r in rows.select(tx.join_words(F.col("x"))).collect()] == ["a b c", ""]


def test_boundaries_are_on_the_last_token_of_a_word(spark):
    rows = spark.createDataFrame([("We are twenty-five. -- So it is 1500! ...",), ("no end",), ("",), ("... !",)], "x string")
    found = [r[0] for r in rows.select(tx.boundaries(F.col("x"))).collect()]
    assert found[0]["tokens"] == ["we", "are", "twenty", "five", "so", "it", "is", "one", "thousand", "five", "hundred"]
    assert (found[0]["ends"], found[0]["last_word"]) == ([3, 10], 7) and (found[1]["ends"], found[1]["last_word"]) == ([], 1)
    assert all(r["tokens"] == [] and r["ends"] == [] and r["last_word"] == 0 for r in found[2:])


def test_upper_case_character_by_character(one):
    assert one("groß ﬁ ᾳ ŉ Éa😀", tx.upper_each) == "GROẞ ﬁ ᾼ ŉ ÉA😀" and one("plain é", tx.upper_each) == "PLAIN É"
    assert one("groß, ﬁn!", tx.strip_upper) == "GROSS ﬁN"
    assert one(None, tx.upper_each) is None
