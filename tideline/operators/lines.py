"""Ordered lines out of two lanes: hypotheses and utterances of the quick one, late answers of the accurate one.

What comes out follows from four facts, which the batch form works out by windows and the
streaming form keeps as state:

* numbers: whatever shows a line first takes the next number, a hypothesis for the line it
  grows into, and lines leave in the order of their numbers;
* spans: a line's start and end are those of its quick words; an utterance of more words
  than a line holds is several lines, and words cut out early aren't said again;
* shares: the running maxima of line ends part the time axis, and an accurate word is of the
  line in whose part its middle lies; once that line is out, the word is too late;
* release: a line is ready when the accurate lane has covered its end or its time is up,
  whatever comes first, and is out when all lines before it are ready too.

A session's rows are ordered by windows; state in streams is bounded by what a session has
open, goes when it stops, and has a timer for the time that a line waits.
"""

from __future__ import annotations

import json
import re
from decimal import Decimal
from itertools import takewhile

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.text import FILLERS
from tideline.operators.merge import MergeConfig, decide
from tideline.session import written

CUT_WORDS = 8
BOTH, QUICK_ONLY, ACCURATE_ONLY = "both", "quick_only", "accurate_only"
MAX_WORDS = 40
PROMOTE_AFTER = 8.0
WORDS = "array<struct<text:string,start:double,end:double>>"
INPUT = f"session_id long, seq long, kind string, now double, text string, end double, words {WORDS}"
OUTPUT = "session_id long, line_id long, start_s double, end_s double, source string, lane string, reason string"
COLUMNS = ["session_id", "line_id", "start_s", "end_s", "source", "lane", "reason"]

Word = tuple[str, float, float]


# the batch form


def _middle(word: Column) -> Column:
    return word["start"] + F.greatest(word["end"] - word["start"], F.lit(0.0)) / 2


def _text(words: Column) -> Column:
    trimmed = F.transform(words, lambda w: F.regexp_replace(w["text"], r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(trimmed, lambda t: t != ""), " ")


def _cut(words: Column, size: int) -> Column:
    """The words in arrays of ``size``, without those that have no text."""
    count = F.ceil(F.size(words) / size).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.slice(words, i * size + 1, size))
    return F.filter(parts, lambda part: _text(part) != "")


def first_reaching(events: DataFrame, levels: DataFrame) -> DataFrame:
    """``levels(session_id, line_id, level)`` with ``at``: the first ``seq`` whose ``value`` reaches the level.

    ``events(session_id, seq, value)`` have values that don't fall. Events and levels are put
    in one order of values, so that no pairs are formed.
    """
    both = events.select("session_id", "seq", "value", F.lit(None).cast("long").alias("line_id"), F.lit(0).alias("asks")).unionByName(
        levels.select("session_id", F.lit(None).cast("long").alias("seq"), F.col("level").alias("value"), "line_id", F.lit(1).alias("asks"))
    )
    over = Window.partitionBy("session_id").orderBy(F.desc("value"), "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("at", F.min("seq").over(over)).where("asks = 1").select("session_id", "line_id", F.col("value").alias("level"), "at")


def quick_lines(inputs: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """``session_id, line_id, seq, start_s, end_s, quick, due_from``: lines as the quick lane closes them.

    ``inputs`` have a ``clock`` that doesn't fall. A line cut out of an open utterance is due
    from the end of that utterance on, others from their own.
    """
    before = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    spoken = inputs.where(F.col("kind").isin("partial", "cut", "final"))
    spoken = spoken.withColumn("utterance", F.coalesce(F.sum((F.col("kind") == "final").cast("int")).over(before), F.lit(0)))
    early = F.when((F.col("kind") == "cut") & (_text(F.col("words")) != ""), F.greatest(F.coalesce("end", "now"), F.get("words", F.lit(0))["start"]))
    said = Window.partitionBy("session_id", "utterance").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    spoken = spoken.withColumn("until", early).withColumn("said", F.coalesce(F.last("until", ignorenulls=True).over(said), F.lit(0.0)))
    new = F.array_position(F.transform("words", lambda w: _middle(w) >= F.col("said")), F.lit(True)).cast("int")
    rest = F.when(new > 0, F.slice("words", F.greatest(new, F.lit(1)), F.size("words"))).otherwise(F.slice("words", 1, 0))
    parts = F.when(F.col("kind") == "final", _cut(rest, max_words)).when(F.col("until").isNotNull(), F.array("words")).otherwise(F.array().cast(f"array<{WORDS}>"))
    spoken = spoken.withColumn("parts", parts)
    # hypotheses between two closings are of one line, which has the number that the first of them took
    shown = spoken.where((F.col("kind") != "cut") | (F.size("parts") > 0))
    order = Window.partitionBy("session_id").orderBy("seq")
    opened = F.coalesce(F.lag("kind").over(order) == "partial", F.lit(False)).cast("int")
    takes = F.when(F.col("kind") == "partial", 1 - F.col("opened")).otherwise(F.greatest(F.size("parts") - F.col("opened"), F.lit(0)))
    shown = shown.withColumn("opened", opened).withColumn("takes", takes)
    shown = shown.withColumn("taken", F.coalesce(F.sum("takes").over(before), F.lit(0)))
    ended = Window.partitionBy("session_id", "utterance")
    shown = shown.withColumn("ended", F.max(F.when(F.col("kind") == "final", F.col("clock"))).over(ended))
    each = shown.select("session_id", "seq", "kind", "until", "ended", "taken", "opened", F.posexplode("parts").alias("place", "part"))
    start, stop = F.get("part", F.lit(0))["start"], F.coalesce("until", F.greatest(F.element_at("part", -1)["end"], F.get("part", F.lit(0))["start"]))
    return each.select(
        "session_id",
        (F.col("taken") + 1 + F.col("place") - F.col("opened")).cast("long").alias("line_id"),
        "seq",
        start.alias("start_s"),
        stop.alias("end_s"),
        _text(F.col("part")).alias("quick"),
        F.when(F.col("kind") == "final", stop).otherwise(F.col("ended")).alias("due_from"),
    )


def accurate_lines(inputs: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """Lines of the accurate lane alone: each answer's words, but for those before the end of an earlier answer."""
    before = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    answers = inputs.where("kind = 'answer'").withColumn("reach", F.array_max(F.transform("words", lambda w: w["end"])))
    fresh = answers.withColumn("edge", F.coalesce(F.max("reach").over(before), F.lit(0.0)))
    parts = fresh.withColumn("parts", _cut(F.filter("words", lambda w: _middle(w) >= F.col("edge")), max_words))
    taken = F.coalesce(F.sum(F.size("parts")).over(before), F.lit(0))
    each = parts.withColumn("taken", taken).select("session_id", "taken", F.posexplode("parts").alias("place", "part"))
    start = F.get("part", F.lit(0))["start"]
    return each.select(
        "session_id",
        (F.col("taken") + 1 + F.col("place")).cast("long").alias("line_id"),
        start.alias("start_s"),
        F.greatest(F.element_at("part", -1)["end"], start).alias("end_s"),
        _text(F.col("part")).alias("source"),
        F.lit("accurate").alias("lane"),
        F.lit(None).cast("string").alias("reason"),
    )


def released(inputs: DataFrame, lines: DataFrame, promote_after: float = PROMOTE_AFTER) -> DataFrame:
    """``lines`` with ``out``, the ``seq`` of the input that lets them go, and ``covered``: whether the accurate lane has heard their end by then."""
    by_seq = Window.partitionBy("session_id").orderBy("seq")
    heard = F.when(F.col("kind") == "answer", F.greatest("clock", F.array_max(F.transform("words", lambda w: w["end"]))))
    # before any answer, what is heard is the start of time itself
    events = inputs.select("session_id", "seq", "clock", F.coalesce(F.max(heard).over(by_seq), F.lit(0.0)).alias("covers"))
    ends = inputs.groupBy("session_id").agg((F.max("seq") + 1).alias("last"))
    covered = first_reaching(events.select("session_id", "seq", F.col("covers").alias("value")), lines.select("session_id", "line_id", F.col("end_s").alias("level")))
    due = lines.where("due_from is not null").select("session_id", "line_id", (F.col("due_from") + promote_after).alias("level"))
    late = first_reaching(events.select("session_id", "seq", F.col("clock").alias("value")), due)
    key = ["session_id", "line_id"]
    timed = lines.join(covered.select(*key, F.col("at").alias("cover_at")), key, "left").join(late.select(*key, F.col("at").alias("late_at")), key, "left").join(ends, "session_id")
    ready = F.greatest("seq", F.least(F.coalesce("cover_at", "last"), F.coalesce("late_at", "last")))
    in_order = Window.partitionBy("session_id").orderBy("line_id")
    timed = timed.withColumn("out", F.max(ready).over(in_order))
    return timed.withColumn("covered", F.coalesce(F.col("cover_at") <= F.col("out"), F.lit(False))).drop("cover_at", "late_at", "last")


def replay(inputs: DataFrame, mode: str = BOTH, max_words: int = MAX_WORDS, promote_after: float = PROMOTE_AFTER) -> DataFrame:
    """Final lines of whole sessions of input rows (see ``INPUT``); the session's end lets all lines go."""
    clock = F.max("now").over(Window.partitionBy("session_id").orderBy("seq"))
    # written once: each of the branches below would work the inputs out again
    inputs = written(inputs.withColumn("clock", F.greatest(clock, F.lit(0.0))), "line-inputs")
    if mode == ACCURATE_ONLY:
        return accurate_lines(inputs, max_words).select(*COLUMNS)
    lines = written(quick_lines(inputs, max_words), "quick-lines")
    if mode == QUICK_ONLY:
        return lines.select("session_id", "line_id", "start_s", "end_s", F.col("quick").alias("source"), F.lit("fast").alias("lane"), F.lit("accurate_disabled").alias("reason"))
    out = released(inputs, lines, promote_after)
    shared = attributed(inputs, out)
    heard = F.when(F.col("covered"), F.coalesce("accurate", F.lit("")))
    decided = out.join(shared, ["session_id", "line_id"], "left").withColumn("decision", decide(F.col("quick"), heard, ~F.col("covered")))
    return decided.select("session_id", "line_id", "start_s", "end_s", F.col("decision.text").alias("source"), F.col("decision.lane").alias("lane"), F.col("decision.reason").alias("reason"))


def attributed(inputs: DataFrame, lines: DataFrame) -> DataFrame:
    """``session_id, line_id, accurate``: the accurate words of each line that came by the time that it was out."""
    each = inputs.where("kind = 'answer'").select("session_id", "seq", F.posexplode("words").alias("place", "word"))
    words = each.select("session_id", _middle(F.col("word")).alias("at"), F.lit(1).alias("asks"), "seq", "place", F.col("word.text").alias("text"))
    order = Window.partitionBy("session_id").orderBy("line_id").rowsBetween(Window.unboundedPreceding, -1)
    edges = lines.withColumn("edge", F.coalesce(F.max("end_s").over(order), F.lit(0.0))).where(F.col("end_s") > F.col("edge"))
    marks = edges.select("session_id", F.col("end_s").alias("at"), F.lit(0).alias("asks"), F.struct("line_id", "out").alias("of"))
    ahead = Window.partitionBy("session_id").orderBy("at", "asks").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # a word right at a line's end is of the next line: ends come first and words look ahead
    met = words.unionByName(marks, allowMissingColumns=True).withColumn("of", F.first("of", ignorenulls=True).over(ahead))
    own = met.where((F.col("asks") == 1) & (F.col("seq") <= F.col("of.out")))
    said = F.sort_array(F.collect_list(F.struct("seq", "place", "text")))
    return own.groupBy("session_id", F.col("of.line_id").alias("line_id")).agg(_text(said).alias("accurate"))


# the streaming form

_EDGES = re.compile(r"^[^\w']+|[^\w']+$|^_+|_+$")


def _bare(text: str) -> list[str]:
    """Normalised words without fillers, as the column function gives them."""
    found = (_EDGES.sub("", w).lower() for w in text.split())
    return [w for w in found if w and w not in FILLERS]


def distrust(quick: str, accurate: str, config: MergeConfig = MergeConfig()) -> str | None:
    """Why an accurate text isn't trusted, as ``merge.suspicion`` has it."""
    said, heard = _bare(quick), _bare(accurate)
    gap, run = len(said) - len(heard), config.repetition_run
    runs = {tuple(heard[i : i + run]) for i in range(len(heard) - run + 1)}
    reasons = {
        "accurate_truncated": not heard or (gap >= config.min_drop_words and len(heard) < config.truncation_guard * len(said)),
        "accurate_looped": -gap >= config.min_extra_words and len(heard) > config.repetition_guard * len(said) and len(heard) >= 2 * run and len(runs) <= len(heard) - run,
    }
    return next((reason for reason, holds in reasons.items() if said and holds), None)


def decide_text(quick: str | None, accurate: str | None, late: bool) -> tuple[str, str, str | None] | None:
    """``(text, lane, reason)`` as ``merge.decide`` gives it, or None while a line has to wait."""
    if accurate is None:
        return (quick, "fast", "accurate_timeout") if late and quick is not None else None
    reason = None if quick is None else distrust(quick, accurate)
    return (accurate, "accurate", None) if reason is None else (quick, "fast", reason)


class LineMachine:
    """A session's state between micro-batches, as plain data.

    ``lines`` are closed and not yet out: number, start, end, quick text, accurate text (of
    the accurate lane alone) and the time that they are due from. ``heard`` are accurate
    words that no line that is out has had, by their middle.
    """

    def __init__(self, mode: str = BOTH, max_words: int = MAX_WORDS, promote_after: float = PROMOTE_AFTER, **state) -> None:  # noqa: ANN003
        self.mode, self.max_words, self.promote_after = mode, max_words, promote_after
        self.facts = {"clock": 0.0, "covers": 0.0, "edge": 0.0, "said": 0.0, "numbers": 0, "shown": 0, "lines": [], "heard": [], **state}

    def dump(self) -> str:
        return json.dumps({"mode": self.mode, "max_words": self.max_words, "promote_after": self.promote_after, **self.facts})

    @classmethod
    def load(cls, state: str) -> LineMachine:
        return cls(**json.loads(state))

    # one input of each kind

    def partial(self, text: str, now: float) -> list[dict]:
        return self.feed("partial", text, [], None, now)

    def final(self, words: list[Word], now: float) -> list[dict]:
        return self.feed("final", None, words, None, now)

    def cut(self, words: list[Word], end: float, now: float) -> list[dict]:
        return self.feed("cut", None, words, end, now)

    def answer(self, words: list[Word], now: float) -> list[dict]:
        return self.feed("answer", None, words, None, now)

    def tick(self, now: float) -> list[dict]:
        return self.feed("tick", None, [], None, now)

    def finish(self) -> list[dict]:
        return self.feed("stop", None, [], None, self.facts["clock"])

    def feed(self, kind: str, text: str | None, words: list[Word], end: float | None, now: float) -> list[dict]:
        """What an input row shows and lets go."""
        facts = self.facts
        facts["clock"] = max(facts["clock"], now)
        events: list[dict] = []
        if kind == "partial":
            facts["shown"] = facts["shown"] or self._next_number()
            events = [{"kind": "partial", "line_id": facts["shown"], "text": text}]
        elif kind in ("cut", "final"):
            events = self._close(kind == "cut", words, now if end is None else end)
        elif kind == "answer":
            self._hear(words)
        return events + self._release(kind == "stop")

    def due_at(self) -> float | None:
        """When time alone lets the next line go."""
        first = next(iter(self.facts["lines"]), None)
        return None if first is None or first["due_from"] is None else first["due_from"] + self.promote_after

    def _next_number(self) -> int:
        self.facts["numbers"] += 1
        return self.facts["numbers"]

    def _add(self, words: list[Word], end: float, due_from: float | None, **texts: str) -> dict:
        number, self.facts["shown"] = self.facts["shown"] or self._next_number(), 0
        line = {"line_id": number, "start": words[0][1], "end": max(end, words[0][1]), "quick": None, "accurate": None, "due_from": due_from, **texts}
        self.facts["lines"].append(line)
        return line

    def _close(self, early: bool, words: list[Word], end: float) -> list[dict]:
        facts = self.facts
        if early:
            parts = [words]
        else:
            fresh = [i for i, w in enumerate(words) if w[1] + max(w[2] - w[1], 0.0) / 2 >= facts["said"]]
            parts = pieces(words[fresh[0] :], self.max_words) if fresh else []
            facts["said"] = 0.0
            facts["lines"] = [{**x, "due_from": facts["clock"] if x["due_from"] is None else x["due_from"]} for x in facts["lines"]]
        new = []
        for part in parts:
            if text := joined(part):
                stop = end if early else part[-1][2]
                new.append(self._add(part, stop, None if early else max(stop, part[0][1]), quick=text))
        if early and new:
            facts["said"] = new[0]["end"]
        facts["shown"] = facts["shown"] if early else 0
        return [] if self.mode == QUICK_ONLY else [{"kind": "draft", "line_id": x["line_id"], "text": x["quick"], "end": x["end"]} for x in new]

    def _hear(self, words: list[Word]) -> None:
        facts = self.facts
        timed = [(w[1] + max(w[2] - w[1], 0.0) / 2, w) for w in words]
        kept = [(at, w) for at, w in timed if at >= facts["edge"]]
        facts["covers"] = max([facts["covers"], facts["clock"], *(w[2] for w in words)])
        if self.mode == ACCURATE_ONLY:
            for part in pieces([w for _, w in kept], self.max_words):
                if text := joined(part):
                    self._add(part, part[-1][2], part[-1][2], accurate=text)
        else:
            facts["heard"] += [[at, w[0]] for at, w in kept]

    def _verdict(self, line: dict, ending: bool) -> dict | None:
        """The line as it leaves, or None while it waits; lines before it are out."""
        facts = self.facts
        event = {"kind": "final", "line_id": line["line_id"], "start": line["start"], "end": line["end"]}
        heard = line["accurate"]
        if heard is None and facts["covers"] >= line["end"]:
            heard = joined([(word,) for at, word in facts["heard"] if facts["edge"] <= at < line["end"]])
        late = ending or (line["due_from"] is not None and facts["clock"] >= line["due_from"] + self.promote_after)
        verdict = (line["quick"], "fast", "accurate_disabled") if self.mode == QUICK_ONLY else decide_text(line["quick"], heard, late)
        return None if verdict is None else event | dict(zip(("text", "lane", "reason"), verdict, strict=True))

    def _release(self, ending: bool) -> list[dict]:
        facts, out = self.facts, []
        for line, event in takewhile(lambda x: x[1] is not None, ((x, self._verdict(x, ending)) for x in facts["lines"])):
            facts["edge"] = max(facts["edge"], line["end"])
            out.append(event)
        facts["lines"] = facts["lines"][len(out) :]
        facts["heard"] = [x for x in facts["heard"] if x[0] >= facts["edge"]]
        return out


def joined(words: list[tuple]) -> str:
    return " ".join(t for w in words if (t := w[0].strip()))


def pieces(words: list[Word], size: int) -> list[list[Word]]:
    return [words[at : at + size] for at in range(0, len(words), size)]


def rows_of(session: int, events: list[dict]) -> list[tuple]:
    """Final lines as output rows."""
    return [(session, e["line_id"], e["start"], e["end"], e["text"], e["lane"], e["reason"]) for e in events if e["kind"] == "final"]


def frame_of(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=COLUMNS)


def feed_frame(machine: LineMachine, frame: pd.DataFrame) -> list[dict]:
    """Feed a session's input rows, in order."""
    out: list[dict] = []
    for row in frame.sort_values("seq").itertuples():
        words = [(w["text"], w["start"], w["end"]) for w in row.words] if row.words is not None else []
        end = None if row.end is None or row.end != row.end else float(row.end)
        out += machine.feed(row.kind, row.text, words, end, float(row.now))
    return out


def inputs_of(lanes: DataFrame, pace: float, cuts: Column | None = None) -> DataFrame:
    """Input rows out of lines with both lanes' texts: partial, final, answer and tick for each.

    ``lanes(session_id, line_id, quick, accurate, timed_out, start_s, end_s)``. Where ``cuts`` is true (every third
    line, if it isn't told), a line of ``CUT_WORDS`` words or more is cut in its middle while it is spoken.
    """

    step = F.lit(Decimal(str(pace)))

    def at(count: Column) -> Column:
        """The start of the word after ``count`` of them: the pace is multiplied as a decimal, so that words end where their line does."""
        return F.col("start_s") + (step * count).cast("double")

    def timed(text: str):  # noqa: ANN202
        w = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+", -1), "")
        return F.transform(
            w, lambda x, i: F.struct(x.alias("text"), at(i).alias("start"), at(i + 1).alias("end"))
        )

    none = F.array().cast(WORDS)

    def row(kind: str, place: int, now, text, words, end=F.lit(None)):  # noqa: B008  # noqa: ANN001, ANN202
        return F.struct(
            (F.col("line_id") * 5 + place).alias("seq"), F.lit(kind).alias("kind"), now.alias("now"), text.alias("text"), end.cast("double").alias("end"), words.alias("words")
        )

    nothing, spoken = F.lit(None).cast("string"), timed("quick")
    half = F.floor(F.size(spoken) / 2).cast("int")
    cut_at = at(half)
    cuts = F.col("line_id") % 3 == 1 if cuts is None else cuts
    cut = F.coalesce(cuts & (F.size(spoken) >= CUT_WORDS), F.lit(False))
    rows = F.array(
        row("partial", 0, F.col("start_s"), F.col("quick"), none),
        F.when(cut, row("cut", 1, cut_at + 0.1, nothing, F.slice(spoken, F.lit(1), half), cut_at)),
        row("final", 2, F.col("end_s"), nothing, spoken),
        F.when(F.col("accurate").isNotNull(), row("answer", 3, F.col("end_s") + 1.0, nothing, timed("accurate"))),
        F.when(F.col("timed_out"), row("tick", 4, F.col("end_s") + 8.0, nothing, none)),
    )
    return lanes.select("session_id", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("session_id", "r.*")
