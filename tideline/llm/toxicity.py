"""Toxicity by maximum-scoring segments of token log-odds.

A token's score is the log-odds of its document frequencies in toxic and in other labelled
documents, with an informative Dirichlet prior (``PRIOR_DOCS`` documents with the token, toxic
or not as the labels are; near copies count as one document), times a
weight that goes from 0 to 1 around ``FIRM_Z`` standard errors; it is that of the strongest
of the token and its beginnings. A linear-time scan finds every maximal-scoring segment of
a text, in which tokens of ``LEAST_MARK`` or less cost ``COST``; a text with no others has
its strongest token as its best segment, and one without any marks has none.

Calibration: under ordinary text the best score of n tokens grows with ``log(n) / lambda``,
where ``lambda`` solves ``sum p exp(lambda s) = 1`` over the distribution of the scores of
ordinary tokens; without that, best scores of all lengths are comparable (a text shorter than
half of the ordinary ones counts as being as long as those: its best score can't be under 0). Their distribution
over ordinary documents is taken as it is (documents without a segment are a mass of
their own below all scores), and beyond ``TAIL`` of them by the exponential
tail that extreme values have. It turns scores into E-values: an ordinary document has a
segment with an E-value under c with the probability ``1 - exp(-c)``. All is taken
out of fold: a document's tokens are scored by the odds of the other folds, as those of a
new text will be. Segments with an E-value under ``SIGNIFICANT`` are toxic passages. A
document's probability is a logistic function of the surprise of the best segment, of the second best
and of all segments together, fitted out of fold too.

The model is fitted on the driver, on at most ``SAMPLE_DOCS`` labelled texts, and of
a longer one on a span of ``SAMPLE_CHARS`` characters, whatever the size of the corpus; it has at most
``LEXICON`` tokens.

Defined results: null and empty texts are scored as texts without tokens; without toxic
labels every score is that of the share of toxic labels, 0 without any; equal rows get
equal results; null labels don't count; other columns pass through ``with_toxicity``, but
for those of the names that it adds, which it replaces.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.session import ship_package
from tideline.llm.shingles import splitmix, text_sets
from tideline.llm.store import hashed_sample, hashed_span, small_batches

SAMPLE_DOCS = 8000
SAMPLE_CHARS = 20_000
LEXICON = 20_000
PRIOR_DOCS = 10.0
LEAST_DOCS = 2
OWN_DOCS = 5
FIRM_Z = 3.5
LEAST_MARK = 0.5
COST = 0.1
FOLDS = 10
TAIL = 0.01
QUANTILES = 1000
STEM = (4, 8)
CACHE_TOKENS = 300_000
SIGNIFICANT = 1e-2
SLICE_BYTES = 4 << 20
PASSAGES = "array<struct<first:int,last:int,score:double,e_value:double>>"
_MULTIPLIERS = splitmix(83, 4) | np.uint64(1)
_TOKEN = re.compile(r"[^\W\d_]+")


def maximal_segments(items: list[tuple[int, float]], between: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments ``(first, last, score)``, from left to right, in linear time.

    ``items`` are the places and scores of the positive tokens, in order; each other
    token scores ``between``, which is negative.
    """
    found: list[list] = []  # first, last, total before, total after, earlier segment with less before
    total, at = 0.0, 0
    for place, score in items:
        total += between * (place - at)
        at = place + 1
        first, before, after = place, total, total + score
        total = after
        while True:
            back = len(found) - 1
            while back >= 0 and found[back][2] >= before:
                back = found[back][4]
            if back < 0 or found[back][3] >= after:
                found.append([first, place, before, after, back])
                break
            first, before = found[back][0], found[back][2]
            del found[back:]
    return [(a, b, after - before) for a, b, before, after, _ in found]


def segments_of(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """Maximal-scoring segments of tokens of these scores; those of ``LEAST_MARK`` or less cost ``COST``.

    Without any other, the strongest token is one, if it has a score at all.
    """
    places = np.flatnonzero(scores > LEAST_MARK)
    if len(places):
        return maximal_segments(list(zip(places.tolist(), scores[places].tolist(), strict=True)), -COST)
    best = int(scores.argmax()) if len(scores) else 0
    return [(best, best, float(scores[best]))] if len(scores) and scores[best] > 0 else []


class Scores(dict):
    """Token -> score, by the best of the marks that the token is or begins with; 0 without."""

    def __init__(self, marks: dict[str, float]) -> None:
        super().__init__()
        self.marks = marks

    def __missing__(self, token: str) -> float:
        if len(self) > CACHE_TOKENS:
            self.clear()
        self[token] = value = max((self.marks[x] for x in stems(token) if x in self.marks), default=0.0)
        return value


def stems(token: str) -> list[str]:
    """The token, and its beginnings with a mark that they are not the whole of it."""
    return [token, *(token[:k] + "-" for k in range(STEM[0], min(STEM[1], len(token) - 1) + 1))]


@dataclass
class Law:
    """How often ordinary documents reach a length-free best score, and beyond."""

    values: np.ndarray  # ascending
    shares: np.ndarray  # of documents that reach them
    tail: float  # the rate of the exponential tail

    @classmethod
    def of(cls, values: np.ndarray, documents: int, rate: float) -> Law:
        """The law of ``documents`` of which some have ``values``, at most ``QUANTILES`` points of it; the others have no segment.

        The tail falls no faster than ``rate``, by which scores of chance fall: few or equal values don't make
        what lies above them certain.
        """
        n = len(values)
        if n < 2:
            return cls(np.array([values.max(initial=0.0)]), np.array([1 / (documents + 1)]), rate)
        ordered = np.sort(values)
        top = max(1, min(n - 1, max(10, round(TAIL * documents))))
        excess = float((ordered[n - top :] - ordered[n - top - 1]).mean())
        places = np.unique(np.linspace(0, n - top - 1, QUANTILES).round().astype(int))
        return cls(ordered[places], (n - places) / (documents + 1), min(1 / max(excess, 1e-9), rate))

    def e_value(self, value: float) -> float:
        """The expected number of segments that score as much in an ordinary document."""
        if value > self.values[-1]:
            share = self.shares[-1] * math.exp(-min(700.0, self.tail * (value - self.values[-1])))
        else:
            share = float(np.interp(value, self.values, self.shares))
        return -math.log1p(-min(share, 1 - 1e-9))


_FLAT = Law(np.zeros(1), np.full(1, 0.5), 1.0)


@dataclass
class Detector:
    """A fitted model."""

    marks: dict[str, float]
    rate: float
    law: Law
    weights: tuple[float, float, float, float]
    least: float = 1.0  # the length, in tokens, that shorter texts count as having

    def __post_init__(self) -> None:
        self.scores = Scores(self.marks)

    def segments(self, text: str | None) -> tuple[list[tuple[int, int, float, float]], list[str]]:
        """Segments ``(first token, last token, score, E-value)`` and the tokens; a text without marks has no segment."""
        tokens = _TOKEN.findall(text.lower()) if text else []
        found = segments_of(np.array([self.scores[t] for t in tokens]))
        return [(a, b, s, self.law.e_value(s - self.shift(len(tokens)))) for a, b, s in found], tokens

    def shift(self, count: int) -> float:
        """How much more the best segment of so many tokens scores by chance."""
        return math.log(max(self.least, count)) / self.rate

    def facts(self, e_values: list[float], names: list[str]) -> tuple[float, float, float]:
        """The surprise of the best segment and of the second best, and that of all segments that are rarer than one a document, together.

        Of segments that start with the same token the best counts: repeating it says nothing more.
        """
        surprises: dict[str, float] = {}
        for e, name in zip(e_values, names, strict=True):
            if e < 1:
                surprises[name] = max(surprises.get(name, 0.0), min(30.0, -math.log(max(e, 1e-300))))
        first, second = sorted([*surprises.values(), 0.0, 0.0], reverse=True)[:2]
        return first / 10, second / 10, math.log1p(sum(surprises.values()))

    def judge(self, text: str | None) -> tuple[float, list[tuple[int, int, float, float]]]:
        """Probability of the toxic label, and the significant passages."""
        found, tokens = self.segments(text)
        facts = self.facts([e for *_, e in found], [tokens[a] for a, *_ in found])
        level = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], facts, strict=True))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, level)))), [s for s in found if s[3] < SIGNIFICANT]


def in_groups(rows: list[tuple[str, int]]) -> list[tuple[int, str, int]]:
    """``(group, text, label)``, sorted: texts that share one of a few MinHash values of five words, and chains of such, are a group.

    With fewer toxic groups than folds there is nothing to leave out: then each text is one.
    """
    sets = list(text_sets(pa.array([text for text, _ in rows], pa.string())))
    roots = list(range(len(rows)))

    def root(i: int) -> int:
        while roots[i] != i:
            roots[i] = i = roots[roots[i]]
        return i

    seen: dict[tuple[int, int], int] = {}
    for i, elements in enumerate(sets):
        for k, multiplier in enumerate(_MULTIPLIERS if len(elements) else ()):
            other = root(seen.setdefault((k, int((elements * multiplier).min())), i))
            roots[max(other, root(i))] = min(other, root(i))
    names = [int(sets[root(i)][0]) if len(sets[i]) else 0 for i in range(len(rows))]
    if len({name for name, (_, y) in zip(names, rows, strict=True) if y}) < FOLDS:
        return [(i, text, y) for i, (text, y) in enumerate(sorted(rows))]
    return sorted((name, text, y) for name, (text, y) in zip(names, rows, strict=True))


class Vocabulary:
    """The tokens of the texts that a model is fitted on, as numbers; each text is taken apart once."""

    def __init__(self) -> None:
        self.tokens: list[str] = []
        self._known: dict[str, int] = {}

    def numbers(self, text: str) -> np.ndarray:
        """The number of each token of a text."""
        known, found = self._known, []
        for token in _TOKEN.findall(text.lower()):
            number = known.get(token)
            if number is None:
                number = known[token] = len(self.tokens)
                self.tokens.append(token)
            found.append(number)
        return np.array(found, np.int32)


@dataclass
class Counts:
    """In how many groups of copies each mark is, by fold and label, and what tokens have which marks."""

    marks: list[str]
    groups: np.ndarray  # fold, label, mark
    sizes: list[list[int]]  # fold, label
    owned: np.ndarray  # marks of all tokens, one token's after the other's
    starts: np.ndarray  # where those of each token start

    def scores(self, left_out: int | None) -> np.ndarray:
        """The score of each mark, by all folds but one."""
        folds = [k for k in range(FOLDS) if k != left_out]
        n_other, n_toxic = (sum(self.sizes[k][y] for k in folds) for y in (0, 1))
        if not n_toxic or not n_other or not self.marks:
            return np.zeros(len(self.marks))
        other, toxic = self.groups[folds].sum(axis=0)
        share = n_toxic / (n_toxic + n_other)
        a, b = toxic + PRIOR_DOCS * share, other + PRIOR_DOCS * (1 - share)
        odds = np.log(a / (n_toxic + PRIOR_DOCS + 1 - a)) - np.log(b / (n_other + PRIOR_DOCS + 1 - b))
        z = odds / np.sqrt(1 / a + 1 / b)
        found = np.where((toxic >= LEAST_DOCS) & (odds > 0), odds / (1 + np.exp(-3 * (z - FIRM_Z))), 0.0)
        if np.count_nonzero(found) > LEXICON:
            ranked = sorted(np.flatnonzero(found).tolist(), key=lambda k: (-z[k], self.marks[k]))
            found[ranked[LEXICON:]] = 0.0
        return found

    def token_scores(self, left_out: int | None) -> np.ndarray:
        """The score of each token: that of the best of its marks."""
        return np.maximum.reduceat(np.concatenate([self.scores(left_out), [0.0]])[self.owned], self.starts)


def document_counts(rows: list[tuple[int, str, int]]) -> tuple[Counts, list[list[int]]]:
    """For each fold, in how many other and toxic groups of copies a token or beginning is, and how many there are."""
    words = Vocabulary()
    counts = count_marks(rows, [words.numbers(text) for _, text, _ in rows], words)
    return counts, counts.sizes


def count_marks(rows: list[tuple[int, str, int]], numbers: list[np.ndarray], words: Vocabulary) -> Counts:
    """Counts of tokens and beginnings over the groups of copies of ``rows``, whose tokens are ``numbers``.

    Only what ``LEAST_DOCS`` toxic groups have is counted. A beginning that groups have in
    tokens that are not known by themselves (to ``OWN_DOCS`` toxic groups) counts by those:
    it says nothing that the known token doesn't.
    """
    sizes = [[0, 0] for _ in range(FOLDS)]

    def groups(label: int) -> Iterator[tuple[int, np.ndarray]]:
        chosen = (k for k, row in enumerate(rows) if row[2] == label)
        for group, copies in groupby(chosen, key=lambda k: rows[k][0]):
            yield group % FOLDS, np.unique(np.concatenate([numbers[k] for k in copies]))

    toxic = list(groups(1))
    whole = np.zeros(len(words.tokens), np.int64)
    for _, tokens in toxic:
        whole[tokens] += 1
    in_groups_: Counter = Counter()
    by_fold = [Counter() for _ in range(FOLDS)]
    beside = [Counter() for _ in range(FOLDS)]
    for fold, tokens in toxic:
        names = [words.tokens[t] for t in tokens]
        mine = {x for t in names for x in stems(t)}
        in_groups_.update(mine)
        by_fold[fold].update(mine)
        beside[fold].update({x for t, n in zip(names, whole[tokens], strict=True) if n < OWN_DOCS for x in stems(t)[1:]})
        sizes[fold][1] += 1
    marks = sorted(x for x, n in in_groups_.items() if n >= LEAST_DOCS)
    place = {x: k for k, x in enumerate(marks)}
    owned, starts = [], []
    for token in words.tokens:
        starts.append(len(owned))
        owned.extend([place[x] for x in stems(token) if x in place] or [len(marks)])
    owned, starts = np.array(owned, np.int64), np.array(starts, np.int64)
    lengths = np.diff([*starts, len(owned)])
    counted = np.zeros((FOLDS, 2, len(marks) + 1), np.int64)
    for fold, tokens in groups(0):
        first, wide = starts[tokens], lengths[tokens]
        at = np.repeat(first - np.cumsum(wide) + wide, wide) + np.arange(int(wide.sum()))
        counted[fold, 0, np.unique(owned[at])] += 1
        sizes[fold][0] += 1
    counted = counted[:, :, :-1]
    for fold in range(FOLDS):
        counted[fold, 1] = [by_fold[fold][x] for x in marks]
    others, unknown = counted[:, 0].sum(axis=0), np.array([[b[x] for x in marks] for b in beside], np.int64).reshape(FOLDS, -1)
    shared = np.array([x.endswith("-") for x in marks], bool) & (others + unknown.sum(axis=0) >= OWN_DOCS)
    counted[:, 1, shared] = unknown[:, shared]
    return Counts(marks, counted, sizes, owned, starts)


def growth_rate(scores: Counter) -> float:
    """The positive ``lambda`` of ``sum p exp(lambda s) = 1``, over counted scores with a negative mean."""
    values, counts = np.array(list(scores)), np.array(list(scores.values()), float)
    low, high = 0.0, 1.0

    def total(rate: float) -> float:
        return float((counts * np.exp(np.minimum(rate * values, 700))).sum() / counts.sum())

    while total(high) < 1 and high < 100:
        high *= 2
    for _ in range(100):
        rate = (low + high) / 2
        low, high = (rate, high) if total(rate) < 1 else (low, rate)
    return (low + high) / 2


def fit(rows: list[tuple[str, int]]) -> Detector:
    """A detector fitted to ``(text, toxic)`` rows."""
    n_toxic = sum(y for _, y in rows)
    share = n_toxic / len(rows) if rows else 0.0
    flat = (math.log(share / (1 - share)) if 0 < share < 1 else (30.0 if share else -30.0), 0.0, 0.0, 0.0)
    if not 0 < share < 1:
        return Detector({}, 1.0, _FLAT, flat)
    grouped, words = in_groups(rows), Vocabulary()
    numbers = [words.numbers(text) for _, text, _ in grouped]
    counts = count_marks(grouped, numbers, words)
    marks = {x: float(s) for x, s in zip(counts.marks, counts.scores(None), strict=True) if s > 0}
    if not marks:
        return Detector({}, 1.0, _FLAT, flat)
    by_fold = [counts.token_scores(k) for k in range(FOLDS)]
    scores: Counter = Counter({-COST: 1})
    held: list[tuple[int, int, list[float], list[str]]] = []
    for (group, _, y), tokens in zip(grouped, numbers, strict=True):
        values = by_fold[group % FOLDS][tokens]
        found = segments_of(values)
        held.append((y, len(tokens), [s for *_, s in found], [words.tokens[tokens[a]] for a, *_ in found]))
        if not y:
            marked = values[values > LEAST_MARK]
            scores.update(marked.round(2).tolist())
            scores[-COST] += len(values) - len(marked)
    detector = Detector(marks, growth_rate(scores), _FLAT, flat, max(1.0, float(np.median([n for y, n, *_ in held if not y]))))
    best = np.array([max(s) - detector.shift(n) for y, n, s, _ in held if not y and s])
    detector.law = Law.of(best, sum(not y for y, *_ in held), detector.rate)
    facts = np.array([(1.0, *detector.facts([detector.law.e_value(s - detector.shift(n)) for s in found], names)) for _, n, found, names in held])
    labels = np.array([float(y) for y, *_ in held])
    w = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-facts @ w))
        gradient = facts.T @ (labels - p) - 0.05 * w
        curve = (facts * (p * (1 - p))[:, None]).T @ facts + 0.05 * np.eye(4)
        w = w + np.linalg.solve(curve, gradient)
    detector.weights = tuple(float(x) for x in w)
    return detector


def learnable(id_col: str = "doc_id") -> Column:
    """Rows that a model may learn from: those that the held-out quarter leaves."""
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2) | F.col(id_col).isNull()


def sample(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "toxic") -> list[tuple[str, int]]:
    """At most ``SAMPLE_DOCS`` labelled texts, by hash of their id: ids first, then their texts."""
    marked = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).where(usable & F.col("label").isin(0, 1))
    ids = hashed_sample(marked, SAMPLE_DOCS, extra="label")
    # at most SAMPLE_DOCS rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where("text is not null")
    some = rows.orderBy(F.xxhash64("doc_id", "text", "label"), "doc_id", "text", "label").limit(SAMPLE_DOCS)  # ids may repeat
    return sorted((r[0], r[1]) for r in some.select(hashed_span("text", SAMPLE_CHARS), "label").collect())


def with_toxicity(docs: DataFrame, model: Detector, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``passages``, by token places."""
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    docs = docs.drop("score", "passages")
    place = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast((model.marks, model.rate, model.law, model.weights, model.least))  # at most LEXICON tokens
    added = T.StructType.fromDDL(f"score double, passages {PASSAGES}").fields
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = Detector(*shared.value)
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy())
            cuts = np.flatnonzero(np.diff(sizes // SLICE_BYTES)) + 1
            scores, passages = [], []
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)], strict=True):
                for text in batch.column(place).slice(low, high - low).to_pylist():
                    score, found = detector.judge(text)
                    scores.append(score)
                    passages.append([{"first": a, "last": b, "score": s, "e_value": e} for a, b, s, e in found])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(passages, kind)], names=[*batch.schema.names, "score", "passages"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))
