"""Language identification of words by a linear-chain conditional random field.

Every word of a text gets a label. A word's features are its affixes, its character
n-grams and whether it is in the lexicon of frequent words, hashed into a table of
weights; learned transitions tie neighbours. Forward-backward gives each word's
posterior, exactly, over the whole text; a text's language is the one with the largest
sum, and its score is that sum's share.

The model is fitted on the driver, on a sample of labelled rows of at most
``SAMPLE_DOCS`` texts, shared out to the languages (each has one at least), and of a longer
text on a span of ``SAMPLE_CHARS`` characters, whatever the size of the corpus. Its training sequences are spliced from
runs of texts in different languages, so that transitions are learned from code-switched
text. It has a weight for each of ``BUCKETS`` hashed features and language.

Defined results: a null text or one without any letter is ``und`` with score 0; without
labelled rows every text is ``und``; equal rows get equal results; other columns pass through
``with_language`` untouched, but for those of the names that it adds, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.session import ship_package
from tideline.llm.shingles import _powers, mix, splitmix
from tideline.llm.store import give_back, hashed_sample_by, hashed_span, small_batches

SAMPLE_DOCS = 1500
SAMPLE_CHARS = 12_000
SAMPLE_WORDS = 400_000
BUCKETS = 1 << 16
LEXICON = 2_000
SPAN = 40
LONGEST = 64
EPOCHS = 25
CACHE_WORDS = 200_000
SLICE_BYTES = 2 << 20
UNKNOWN = "und"
_PLACES = splitmix(171, 8) | np.uint64(1)
_LETTERS = np.array([chr(c).isalpha() for c in range(1 << 16)])


def letters(codes: np.ndarray) -> np.ndarray:
    """Which code points are letters."""
    found = _LETTERS[np.minimum(codes, 65535)]
    high = np.flatnonzero(codes > 65535)
    if len(high):
        single, of = np.unique(codes[high], return_inverse=True)
        found[high] = np.array([chr(c).isalpha() for c in single.tolist()])[of]
    return found


class Words:
    """The words of several texts, as spans of one array of code points.

    Words are runs of letters, lower-cased; a run of more than ``LONGEST`` letters, as scripts
    without spaces have them, is cut into consecutive words of that many, and the rest.
    """

    def __init__(self, texts: list[str | None]) -> None:
        lowered = [t.lower() if t else "" for t in texts]
        self.codes = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = letters(self.codes)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        starts, ends = edges[0::2], edges[1::2]
        parts = -(-(ends - starts) // LONGEST)
        part = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        self.starts = np.repeat(starts, parts) + LONGEST * part
        self.ends = np.minimum(self.starts + LONGEST, np.repeat(ends, parts))
        stops = np.cumsum([len(t) + 1 for t in lowered])
        self.counts = np.diff(np.searchsorted(self.starts, np.concatenate([[0], stops])))
        if len(self.starts):
            sizes = self.ends - self.starts
            kept = self.codes[inside].astype(np.uint64) + np.uint64(1)
            first = np.cumsum(sizes) - sizes
            place = np.arange(len(kept)) - np.repeat(first, sizes)
            self.hashes = mix(np.add.reduceat(kept * _powers(int(sizes.max()) + 1)[place], first))
        else:
            self.hashes = np.zeros(0, np.uint64)

    def features(self, which: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashed features of the words ``which`` and the places in ``which`` that they are of, in order.

        Character n-grams of the word between marks, longer affixes, and the word itself
        if the lexicon (sorted hashes) has it.
        """
        starts = self.starts[which]
        sizes = self.ends[which] - starts
        padded = sizes + 2
        first = np.cumsum(padded) - padded
        owner = np.repeat(np.arange(len(which)), padded)
        place = np.arange(int(padded.sum())) - first[owner]
        codes = self.codes[np.clip(starts[owner] + place - 1, 0, len(self.codes) - 1)].astype(np.uint64)
        codes[first] = 2
        codes[first + padded - 1] = 3
        left = padded[owner] - place
        flats, owners = [], []
        for n in (2, 3, 4, 5, 6):
            at = np.flatnonzero((left >= n) if n < 5 else (left >= n) & ((place == 0) | (left == n)))
            h = codes[at] * _PLACES[0]
            for k in range(1, n):
                h = h + codes[at + k] * _PLACES[k]
            flats.append((mix(h + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64))
            owners.append(owner[at])
        if len(lexicon):
            hashes = self.hashes[which]
            near = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
            at = np.flatnonzero(lexicon[near] == hashes)
            flats.append((mix(hashes[at] + np.uint64(1)) % np.uint64(BUCKETS)).astype(np.int64))
            owners.append(at)
        flat, owner = np.concatenate(flats), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return flat[order], owner[order]


@dataclass
class Field:
    """A fitted model: languages, weights of features, transitions, lexicon."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: np.ndarray
    known: dict[int, int] = field(default_factory=dict)
    scores: np.ndarray | None = None

    def emissions(self, words: Words) -> np.ndarray:
        """Rows of ``self.scores`` for the words; new words are scored, in one go.

        The cache of scored words is emptied between calls, when it has grown too large.
        """
        if len(self.known) > CACHE_WORDS:
            self.known, self.scores = {}, None
        single, first, of = np.unique(words.hashes, return_index=True, return_inverse=True)
        keys = single.tolist()
        found = list(map(self.known.get, keys))
        if fresh := [i for i, at in enumerate(found) if at is None]:
            flat, owner = words.features(first[fresh], self.lexicon)
            sizes = np.bincount(owner, minlength=len(fresh))
            starts = np.cumsum(sizes) - sizes
            rows = (np.add.reduceat(self.weights[flat], starts, axis=0) / np.sqrt(sizes)[:, None]).astype(np.float32)
            self.known.update(zip((keys[i] for i in fresh), range(len(self.known), len(self.known) + len(fresh)), strict=True))
            self.scores = rows if self.scores is None else np.concatenate([self.scores, rows])
            found = list(map(self.known.get, keys))
        return np.array(found, np.int64)[of]

    def label(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        found: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        words = Words(texts)
        if not len(words.hashes) or not self.languages:
            return found
        index = self.emissions(words)
        order = np.argsort(-words.counts, kind="stable")
        order = order[words.counts[order] > 0]
        sizes = words.counts[order]
        low = (np.cumsum(words.counts) - words.counts)[order]
        by_size = np.arange(int(sizes.sum())) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)
        sums = posterior_sums(self.scores[index[by_size]], sizes, self.transitions)
        best = sums.argmax(1)
        for row, i in enumerate(order.tolist()):
            found[i] = (self.languages[best[row]], float(min(1.0, sums[row, best[row]] / sizes[row])))
        return found


def _packed(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places that put the words of texts, longest first, by position; their starts; the texts."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(int(sizes[0])), side="right")
    starts = np.concatenate([[0], np.cumsum(active)])
    return starts[at] + text, starts, text


def posteriors(scores: np.ndarray, sizes: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors in packed order, and what they were made of: forward, backward and local factors."""
    place, starts, _ = _packed(sizes)
    local = np.empty_like(scores)
    local[place] = np.exp(scores - scores.max(1, keepdims=True))
    step = np.exp(transitions).astype(scores.dtype)
    back_step = np.ascontiguousarray(step.T)
    forward, backward = np.empty_like(local), np.ones_like(local)
    last = None
    bounds = starts.tolist()
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        now = local[low:high] if last is None else (last[: high - low] @ step) * local[low:high]
        now = now / now.sum(1, keepdims=True)
        forward[low:high] = last = now
    for t in range(len(bounds) - 3, -1, -1):
        low, high, top = bounds[t], bounds[t + 1], bounds[t + 2]
        now = (local[high:top] * backward[high:top]) @ back_step
        backward[low : low + top - high] = now / now.sum(1, keepdims=True)
    both = forward * backward
    both /= both.sum(1, keepdims=True)
    return both, forward, backward, local


def posterior_sums(scores: np.ndarray, sizes: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Sum of word posteriors for each text; ``sizes`` from the longest down."""
    both, *_ = posteriors(scores, sizes, transitions)
    place, _, text = _packed(sizes)
    return np.stack([np.bincount(text, both[place, k], len(sizes)) for k in range(scores.shape[1])], axis=1)


def fit(rows: list[tuple[str, str]], seed: int = 5) -> Field:
    """A field fitted to ``(text, language)`` rows by gradient ascent on spliced sequences."""
    rng = np.random.default_rng(seed)
    languages = sorted({y for _, y in rows})
    if not languages:
        return Field([], np.zeros((1, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0, np.uint64))
    words = Words([text for text, _ in rows])
    of_row = np.repeat(np.array([languages.index(y) for _, y in rows]), words.counts)
    by_language = [np.flatnonzero(of_row == j) for j in range(len(languages))]
    frequent = []
    for own in by_language:
        hashes, counts = np.unique(words.hashes[own], return_counts=True)
        frequent.append(hashes[np.lexsort((hashes, -counts))][:LEXICON][np.sort(-counts)[:LEXICON] < -2])
    lexicon = np.unique(np.concatenate(frequent))
    quota = SAMPLE_WORDS // len(languages)
    sequence, label = [], []
    spent = [0] * len(languages)
    while able := [j for j, own in enumerate(by_language) if spent[j] < min(quota, len(own))]:
        j = able[int(rng.integers(len(able)))]
        run = by_language[j][spent[j] : spent[j] + 3 + int(rng.geometric(1 / 25))]
        spent[j] += len(run)
        sequence.append(run)
        label.extend([j] * len(run))
    if not label:
        raise ValueError(f"none of {len(rows)} labelled texts has a word to learn from")
    n_seq = len(label) // SPAN
    sizes = np.full(n_seq, SPAN) if n_seq else np.array([len(label)])
    sequence, label = np.concatenate(sequence)[: int(sizes.sum())], np.array(label[: int(sizes.sum())])
    _, first, types = np.unique(words.hashes[sequence], return_index=True, return_inverse=True)
    flat, owner = words.features(sequence[first], lexicon)
    scale = (1 / np.sqrt(np.bincount(owner)))[owner]
    lists = first
    k = len(languages)
    weights, transitions = np.zeros((BUCKETS, k)), np.zeros((k, k))
    squares, trans_squares = np.full((BUCKETS, k), 1e-6), np.full((k, k), 1e-6)
    place, starts, _ = _packed(sizes)
    truth = np.zeros((len(label), k))
    truth[place, label] = 1
    bounds = starts.tolist()
    for _ in range(EPOCHS):
        by_type = np.stack([np.bincount(owner, weights[flat, j] * scale, len(lists)) for j in range(k)], axis=1)
        both, forward, backward, local = posteriors(by_type[types], sizes, transitions)
        gap = truth - both
        pull = np.stack([np.bincount(types, gap[place, j], len(lists)) for j in range(k)], axis=1)
        grad = np.stack([np.bincount(flat, pull[owner, j] * scale, BUCKETS) for j in range(k)], axis=1) - 0.5 * weights
        step, tgrad = np.exp(transitions), -0.1 * transitions
        for low, high, top in zip(bounds[:-2], bounds[1:-1], bounds[2:], strict=True):
            m = top - high
            joint = forward[low : low + m, :, None] * step[None] * (local[high:top] * backward[high:top])[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            tgrad += truth[low : low + m].T @ truth[high:top] - joint.sum(0)
        squares += grad**2
        trans_squares += tgrad**2
        weights += 0.5 * grad / np.sqrt(squares)
        transitions += 0.3 * tgrad / np.sqrt(trans_squares)
    return Field(languages, weights.astype(np.float32), transitions.astype(np.float32), lexicon)


def sample(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> list[tuple[str, str]]:
    """About ``SAMPLE_DOCS`` labelled rows with a letter, equally of each language, by hash of their ids."""
    labelled = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(label_col).alias("label")).where(
        usable & F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    chosen = hashed_sample_by(labelled, SAMPLE_DOCS, "label")
    return sorted((r[0], r[1]) for r in chosen.select(hashed_span("text", SAMPLE_CHARS), "label").collect())


def learnable(id_col: str = "doc_id") -> Column:
    """Rows that a model may learn from: those that the held-out third leaves."""
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1) | F.col(id_col).isNull()


def with_language(docs: DataFrame, model: Field, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """``docs`` with each row's predicted language and score."""
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    docs = docs.drop(lang_name, score_name)
    place = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.transitions, model.lexicon))  # BUCKETS rows
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_name, T.StringType()), T.StructField(score_name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Field(*shared.value)
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy())
            cuts = np.flatnonzero(np.diff(sizes // SLICE_BYTES)) + 1
            labels = []
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)], strict=True):
                labels += fitted.label(batch.column(place).slice(low, high - low).to_pylist())
            columns = [*batch.columns, pa.array([x for x, _ in labels], pa.string()), pa.array([y for _, y in labels], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, lang_name, score_name])
        del fitted
        give_back()

    return docs.mapInArrow(run, schema)
