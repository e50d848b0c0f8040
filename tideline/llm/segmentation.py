"""SentencePiece segmentations sampled without replacement, by perturbed best-first search.

A text's lattice has the vocabulary's pieces as edges; characters that no piece has are
spelled in byte pieces. A segmentation's probability is proportional to the product of
its pieces' weights, ``1 / (rank + 2)`` to the power ``SHARPNESS`` (a Zipf law over the
model's merge ranks). Where no piece of the vocabulary spans two neighbouring characters
the lattice is one node wide, so it is a chain of independent units, each worked out once.

Gumbel top-k: every segmentation's log-probability is perturbed by a Gumbel variable of
its own, and the ``k`` largest are a sample without replacement. Best-first search finds
them without listing any others: the queue holds regions of the lattice (a prefix of
units that is fixed, and a unit for which some segmentations are excluded) with the
largest perturbed value inside each, which the region's exact log-mass gives. The best
region's maximum is located by sampling, emitted, and what is left of the region is
split by the first unit that differs. The value that the queue then holds next is the
threshold of the inclusion scores ``log P(perturbed value above it)``.

Random numbers are hashes of the row's key, the sample, the unit and the step, so that
rows give the same samples wherever and however often they are worked out.

Defined results: a null text has no samples; an empty text has one, empty; a text with
fewer segmentations than ``k`` has all of them, the last threshold being minus infinity
(inclusion 0, certain); equal rows get equal samples; a null key counts as a key; white space, control
characters and the mark U+2581 itself survive decoding; other columns pass through, and one
of the name of the samples is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.session import ship_package
from tideline.llm.shingles import _powers, mix, splitmix
from tideline.llm.store import fresh_name, give_back, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
SHARPNESS = 0.6
SLICE_BYTES = 3 << 19
CACHE_UNITS = 120_000
SPACE = "▁"
#: Stands for a U+2581 of the text while it is segmented: no valid text has a lone surrogate.
MARK = "\udc81"
_SALT = splitmix(131, 8)
_PAIR_BITS = 20
_TABLE_BITS = 21
_CHAR_BASE = splitmix(151, 1)[0] | np.uint64(1)


class Vocabulary:
    """Pieces of a SentencePiece model with their weights."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = processor.get_piece_size()
        self.pieces = [processor.id_to_piece(i) for i in range(self.size)]
        self.byte_ids = {}
        self.ids: dict[str, int] = {}
        self.log_weight = np.zeros(self.size)
        for i, piece in enumerate(self.pieces):
            if processor.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (processor.is_control(i) or processor.is_unknown(i)):
                self.ids[piece] = i
                self.log_weight[i] = -SHARPNESS * math.log(max(0.0, -processor.get_score(i)) + 2.0)
        self.longest = max(map(len, self.ids))
        beginnings = sorted({p[:k] for p in self.ids for k in range(1, len(p) + 1)})
        hashes = np.zeros(len(beginnings), np.uint64)
        for place, text in enumerate(beginnings):
            h = 0
            for char in text:
                h = (h * int(_CHAR_BASE) + ord(char) + 1) & (2**64 - 1)
            hashes[place] = h
        order = np.argsort(hashes)
        self._hashes = hashes[order]
        self._of_hash = np.array([self.ids.get(beginnings[i], -1) for i in order], np.int64)
        self._maybe = np.zeros(1 << _TABLE_BITS, bool)
        self._maybe[self._slot(self._hashes)] = True
        self.joined = np.zeros(1 << _PAIR_BITS, bool)
        pairs = sorted({p[i : i + 2] for p in self.ids for i in range(len(p) - 1)})
        codes = np.frombuffer("".join(pairs).encode("utf-32-le"), np.uint32).reshape(-1, 2)
        self.joined[self._pair(codes[:, 0], codes[:, 1])] = True
        self.surface = [bytes([int(p[3:5], 16)]) if i in set(self.byte_ids.values()) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return ((hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE_BITS)

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are of beginnings of pieces, and for those the whole piece's id or -1."""
        live = self._maybe[self._slot(hashes)]
        some = np.flatnonzero(live)
        place = np.minimum(np.searchsorted(self._hashes, hashes[some]), len(self._hashes) - 1)
        same = self._hashes[place] == hashes[some]
        live[some] = same
        return live, self._of_hash[place[same]]

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a.astype(np.uint64) * np.uint64(0x9E3779B1) + b.astype(np.uint64)) * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(64 - _PAIR_BITS)

    def units(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """The texts' independent units, in order: one string, where they start, their hashes, how many of each text.

        The units of a text together are the text with its dummy space.
        """
        marked = [SPACE + t.replace(SPACE, MARK).replace(" ", SPACE) for t in texts]
        joined = "".join(marked)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        opens = np.ones(len(codes), bool)
        opens[1:] = ~self.joined[self._pair(codes[:-1], codes[1:])]
        ends = np.cumsum([len(t) for t in marked])
        opens[ends[:-1]] = True
        starts = np.flatnonzero(opens)
        sizes = np.diff(np.append(starts, len(codes)))
        place = np.arange(len(codes)) - np.repeat(starts, sizes)
        hashes = mix(np.add.reduceat((codes.astype(np.uint64) + np.uint64(1)) * _powers(int(sizes.max()) + 1)[place], starts))
        return joined, np.append(starts, len(codes)), hashes, np.diff(np.searchsorted(starts, np.concatenate([[0], ends])))

    def decode(self, ids: list[int]) -> str:
        """The text that the pieces spell, without the dummy space."""
        return b"".join([self.surface[i] for i in ids]).decode("utf-8", "replace")[1:]


class Grown:
    """An array that grows at its end."""

    def __init__(self, dtype: type) -> None:
        self._room = np.empty(1024, dtype)
        self.size = 0

    def extend(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self._room):
            room = np.empty(2 * need, self._room.dtype)
            room[: self.size] = self._room[: self.size]
            self._room = room
        self._room[self.size : need] = values
        self.size = need

    @property
    def view(self) -> np.ndarray:
        return self._room[: self.size]


class Lattices:
    """Lattices of units, as arrays of edges by node; nodes and units are numbered as they come.

    Edge ``e`` of node ``v`` is among ``start[v]`` to ``start[v + 1]``; ``above[e]`` is ``v``
    plus the share of the edges up to it, so that one search finds an edge by a random number.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.reset()

    def reset(self) -> None:
        self.known: dict[int, int] = {}  # hash of a unit -> number
        self._first, self._start = Grown(np.int64), Grown(np.int64)
        self._above, self._log, self._local = Grown(np.float64), Grown(np.float64), Grown(np.float64)
        self._next, self._piece = Grown(np.int64), Grown(np.int32)
        self._start.extend(np.zeros(1, np.int64))

    def add(self, units: list[str], hashes: list[int]) -> None:
        """Work out the lattices of new units, all together."""
        base = self._start.size - 1
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = len(codes)
        ends = np.cumsum(sizes)
        self.known.update(zip(hashes, range(self._first.size, self._first.size + len(units)), strict=True))
        end = np.repeat(ends, sizes)
        # edges by length: the positions at which some piece may still go on shrink from step to step
        sources, lengths, pieces = [], [], []
        at, hashes, single = np.arange(n), np.zeros(n, np.uint64), np.zeros(n, bool)
        for length in range(1, self.vocabulary.longest + 1):
            inside = at + length <= end[at]
            at, hashes = at[inside], hashes[inside]
            if not len(at):
                break
            hashes = hashes * _CHAR_BASE + codes[at + length - 1] + np.uint64(1)
            live, piece = self.vocabulary.look_up(hashes)
            at, hashes = at[live], hashes[live]
            real = piece >= 0
            sources.append(at[real])
            lengths.append(np.full(int(real.sum()), length))
            pieces.append(piece[real])
            if length == 1:
                single[at[real]] = True
        odd = np.flatnonzero(~single)  # spelled in bytes, with the weight of a rare piece
        source = np.concatenate([*sources, odd])
        target = np.concatenate([*(x + k for x, k in zip(sources, lengths, strict=True)), odd + 1])
        piece = np.concatenate([*pieces, np.full(len(odd), -1)]).astype(np.int64)
        order = np.lexsort((target, source))
        source, target, piece = source[order], target[order], piece[order]
        weight = np.where(piece >= 0, self.vocabulary.log_weight[piece], -20.0)
        start = np.searchsorted(source, np.arange(n + 1))
        # masses from the right, one position of all units at a time
        mass = np.zeros(n + 1)
        tail = end - np.arange(n)
        by_tail = np.argsort(tail, kind="stable")
        bounds = np.searchsorted(tail[by_tail], np.arange(1, int(sizes.max()) + 2))
        inner = target < end[source]
        share = np.empty(len(source))
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            nodes = by_tail[low:high]
            counts = start[nodes + 1] - start[nodes]
            first = np.cumsum(counts) - counts
            edges = np.arange(int(counts.sum())) + np.repeat(start[nodes] - first, counts)
            total = weight[edges] + np.where(inner[edges], mass[target[edges]], 0.0)
            most = np.maximum.reduceat(total, first)
            mass[nodes] = most + np.log(np.add.reduceat(np.exp(total - np.repeat(most, counts)), first))
            share[edges] = total - np.repeat(mass[nodes], counts)
        # shares summed up within each node, one edge of all nodes at a time: other units don't touch the sums
        running = np.exp(share)
        degree = np.diff(start)
        for k in range(1, int(degree.max())):
            at = start[:-1][degree > k] + k
            running[at] += running[at - 1]
        running = np.minimum(running, 1.0)
        running[start[1:] - 1] = 1.0
        following = np.where(inner, target + base, -1)
        spelled, extra_piece, extra_next = n, [], []
        for e in np.flatnonzero(piece < 0).tolist():
            char = chr(int(codes[source[e]]))
            ids = [self.vocabulary.byte_ids[x] for x in (SPACE if char == MARK else char).encode()]
            piece[e] = ids[0]
            if len(ids) > 1:
                to, following[e] = int(following[e]), base + spelled
                for k, x in enumerate(ids[1:]):
                    spelled += 1
                    extra_piece.append(x)
                    extra_next.append(base + spelled if k + 2 < len(ids) else to)
        more = len(extra_piece)
        self._first.extend(base + ends - sizes)
        self._start.extend(np.concatenate([start[1:], len(source) + 1 + np.arange(more)]) + self._piece.size)
        self._above.extend(np.concatenate([source + running, n + np.arange(more) + 1.0]) + base)
        self._local.extend(np.concatenate([running, np.ones(more)]))
        self._log.extend(np.concatenate([share, np.zeros(more)]))
        self._next.extend(np.concatenate([following, np.array(extra_next, np.int64)]))
        self._piece.extend(np.concatenate([piece, np.array(extra_piece, np.int64)]))

    def numbers(self, joined: str, starts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The units' numbers; the cache is emptied between calls, when it has grown too large."""
        if len(self.known) > CACHE_UNITS:
            self.reset()
        single, first, of = np.unique(hashes, return_index=True, return_inverse=True)
        keys = single.tolist()
        found = list(map(self.known.get, keys))
        if fresh := [i for i, at in enumerate(found) if at is None]:
            low, high = starts[first[fresh]].tolist(), starts[first[fresh] + 1].tolist()
            self.add([joined[a:b] for a, b in zip(low, high, strict=True)], [keys[i] for i in fresh])
            found = list(map(self.known.get, keys))
        return np.array(found, np.int64)[of]

    def freeze(self) -> None:
        """Make the arrays of the lattices so far readable."""
        self.first, self.start = self._first.view, self._start.view
        self.above, self.log, self.local = self._above.view, self._log.view, self._local.view
        self.next, self.piece = self._next.view, self._piece.view

    def other(self, unit: int, excluded: list[tuple[int, ...]], draw) -> tuple[tuple[int, ...], float]:  # noqa: ANN001
        """A path of edges of the unit that is none of ``excluded``, and its log-probability."""
        node, path, log = int(self.first[unit]), [], 0.0
        # the excluded paths that go the way gone so far, with their probabilities
        along = [(x, math.exp(float(self.log[list(x)].sum()))) for x in excluded]
        while node >= 0:
            step = len(path)
            edges = range(int(self.start[node]), int(self.start[node + 1]))
            left = []
            for e in edges:
                held = [m for x, m in along if x[step] == e]
                taken, whole = sum(held), math.exp(log + float(self.log[e]))
                alone = int(self.next[e]) < 0 and taken > 0
                left.append(0.0 if alone or (taken > 0 and whole - taken < 1e-14 * whole and self._at_most(e, len(held))) else max(whole - taken, 1e-300))
            aim = draw(step) * sum(left)
            chosen = max(k for k, m in enumerate(left) if m > 0)
            for k, m in enumerate(left):
                if m > 0 and aim < m:
                    chosen = k
                    break
                aim -= m
            e = edges[chosen]
            along = [(x, m) for x, m in along if x[step] == e]
            path.append(e)
            log, node = log + float(self.log[e]), int(self.next[e])
        return tuple(path), log

    def _at_most(self, edge: int, limit: int) -> bool:
        """Whether no more than ``limit`` paths go on from ``edge``."""
        count, front = 0, [int(self.next[edge])]
        while front and count <= limit:
            node = front.pop()
            if node < 0:
                count += 1
                continue
            front.extend(int(self.next[e]) for e in range(int(self.start[node]), int(self.start[node + 1])))
        return count <= limit and not front

    def paths_at_most(self, unit: int, limit: int) -> int:
        """The number of the unit's segmentations, counted up to ``limit``."""
        count, front = 0, [int(self.first[unit])]
        while front and count < limit:
            node = front.pop()
            if node < 0:
                count += 1
                continue
            front.extend(int(self.next[e]) for e in range(int(self.start[node]), int(self.start[node + 1])))
        return count


def uniform(keys: np.ndarray, sample: int, unit: np.ndarray, step: int) -> np.ndarray:
    """Numbers in (0, 1) that follow from a row's key and the place of use."""
    h = keys ^ (unit.astype(np.uint64) * _SALT[0] + np.uint64((sample * int(_SALT[1]) + step * int(_SALT[2])) & (2**64 - 1)))
    return (mix(h) >> np.uint64(12)) * 2.0**-52 + 2.0**-53


class Paths:
    """One segmentation of each text of a slice: log-probability and pieces by unit."""

    def __init__(self, log: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.log = log
        self.steps = steps


def draw_paths(lattices: Lattices, numbers: np.ndarray, keys: np.ndarray, unit: np.ndarray, sample: int) -> Paths:
    """A segmentation of every unit, by its lattice's probabilities; arrays are sorted by unit number."""
    log = np.zeros(len(numbers))
    node, active, steps = lattices.first[numbers], np.arange(len(numbers)), []
    step = 0
    while len(active):
        edge = lattices.start[node]
        open_ = np.flatnonzero(lattices.start[node + 1] - edge > 1)  # the others have one way on
        here, at = node[open_], active[open_]
        u = uniform(keys[at], sample, unit[at], step)
        found = np.minimum(np.searchsorted(lattices.above, here + u, side="right"), lattices.start[here + 1] - 1)
        # the sum of node and share is rounded: the shares themselves decide at the borders
        found += (lattices.local[found] <= u) & (found + 1 < lattices.start[here + 1])
        before = np.maximum(found - 1, 0)
        found -= (found > lattices.start[here]) & (lattices.local[before] > u)
        edge[open_] = found
        log[at] += lattices.log[found]
        steps.append((active, edge))
        node = lattices.next[edge]
        on = node >= 0
        active, node = active[on], node[on]
        step += 1
    return Paths(log, steps)


def sample_slice(lattices: Lattices, texts: list[str], keys: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to ``k`` samples ``(ids, log-probability, perturbed value, log inclusion)``."""
    joined, starts, hashes, counts = lattices.vocabulary.units(texts)
    row = np.repeat(np.arange(len(texts)), counts)
    low = np.cumsum(counts) - counts
    at = np.arange(len(row)) - low[row]
    numbers = lattices.numbers(joined, starts, hashes)
    lattices.freeze()
    order = np.argsort(numbers, kind="stable")
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    row_key, sorted_numbers, sorted_at = keys[row][order], numbers[order], at[order]

    rows = np.arange(len(texts))
    zero = np.zeros(len(texts), np.int64)
    top = -np.log(-np.log(uniform(keys, 0, zero, 1 << 20)))
    queue: list[np.ndarray] = []  # for each sample, the perturbed value of the region that differs first at each unit
    drawn: list[tuple[Paths, np.ndarray, list]] = []
    found: list[list] = [[] for _ in texts]
    paths_of: list[dict[tuple[int, int], list[tuple[int, ...]]]] = [{} for _ in texts]
    logs: list[np.ndarray] = []
    chosen: list[list[tuple[int, int, tuple[int, ...]] | None]] = []
    alive = np.ones(len(texts), bool)
    parents = np.full((k, len(texts)), -1)
    splits = np.zeros((k, len(texts)), np.int64)
    for s in range(k):
        paths = draw_paths(lattices, sorted_numbers, row_key, sorted_at, s)
        log = paths.log[back]
        special: list[tuple[int, ...] | None] = [None] * len(texts)
        if s:
            values = np.stack([np.maximum.reduceat(q, low) for q in queue])
            parents[s] = values.argmax(0)
            top = values[parents[s], rows]
            alive &= top > -np.inf
            inherited = np.choose(parents[s][row], logs)
            for r in np.flatnonzero(alive).tolist():
                p = int(parents[s, r])
                part = queue[p][low[r] : low[r] + counts[r]]
                v = int(part.argmax())
                splits[s, r] = v
                place = int(low[r]) + v
                excluded = [*paths_of[r].get((p, v), ()), _path(drawn, parents, splits, chosen, r, v, p, back[place])]
                if (same := [x for x in excluded]) and len(set(same)) != len(same):
                    excluded = list(dict.fromkeys(excluded))
                key, where = keys[r : r + 1], np.array([v])
                path, value = lattices.other(int(numbers[place]), excluded, lambda step, key=key, where=where: float(uniform(key, s + 1000, where, step)[0]))
                special[r] = path
                paths_of[r][(s, v)] = excluded
                log[place] = value
                part[v] = -np.inf
            log = np.where(at < splits[s][row], inherited, log)
        logs.append(log)
        chosen.append(special)
        drawn.append((paths, back, special))
        # summed text by text, so that the sums don't depend on a text's neighbours
        sums = np.concatenate([np.cumsum(log[a : a + n]) for a, n in zip(low.tolist(), counts.tolist(), strict=True)])
        whole, before = sums[low + counts - 1], sums - log
        rest = -np.expm1(log)
        for r in np.flatnonzero(alive).tolist() if s else ():
            taken = sum(math.exp(float(lattices.log[list(x)].sum())) for x in paths_of[r][(s, int(splits[s, r]))])
            place = int(low[r] + splits[s, r])
            more = lattices.paths_at_most(int(numbers[place]), len(paths_of[r][(s, int(splits[s, r]))]) + 2)
            rest[place] = max(rest[place] - taken, 1e-300) if more > len(paths_of[r][(s, int(splits[s, r]))]) + 1 else 0.0
        with np.errstate(divide="ignore"):
            region = np.where((rest > 1e-13) | (log < -1e-12), before + np.log(rest), -np.inf)
        noise = np.log(-np.log(uniform(keys[row], s, at, 1 << 21)))
        value = -np.logaddexp(-top[row], noise - region)
        queue.append(np.where((at >= splits[s][row]) & alive[row] & (region > -np.inf), value, -np.inf))
        for r in np.flatnonzero(alive).tolist():
            found[r].append([None, float(whole[r]), float(top[r]), 0.0])
    threshold = np.max(np.stack([np.maximum.reduceat(q, low) for q in queue]), axis=0)
    flat = [_ids(lattices, drawn[s], len(row)) for s in range(k)]
    for s in range(k):
        ids, ends = flat[s]
        for r, samples in enumerate(found):
            if s >= len(samples):
                continue
            a, b = int(low[r]), int(low[r] + counts[r])
            own = ids[ends[a] : ends[b]]
            if s:
                p, v = int(parents[s, r]), int(splits[s, r])
                head = samples[p][0][: _length(samples[p], v)]
                middle = lattices.piece[list(chosen[s][r])]
                own = np.concatenate([head, middle, ids[ends[a + v + 1] : ends[b]]])
                samples[s].append(np.concatenate([samples[p][4][: v + 1], len(head) + len(middle) + (ends[a + v + 1 : b + 1] - ends[a + v + 1])]))
            else:
                samples[s].append(ends[a : b + 1] - ends[a])
            samples[s][0] = own
            gap = samples[s][1] - threshold[r]
            samples[s][3] = 0.0 if gap > 30 else (gap if gap < -30 else math.log(-math.expm1(-math.exp(gap))))
    return [[(x[0], x[1], x[2], x[3]) for x in samples] for samples in found]


def _length(sample: list, unit: int) -> int:
    """The number of pieces before a unit."""
    return int(sample[4][unit])


def _path(drawn, parents, splits, chosen, r: int, v: int, s: int, place: int) -> tuple[int, ...]:  # noqa: ANN001
    """The edges of unit ``v`` of row ``r`` in its sample ``s``."""
    while s > 0:
        if v == splits[s, r]:
            return chosen[s][r]
        if v > splits[s, r]:
            break
        s = int(parents[s, r])
    path = []
    for active, edge in drawn[s][0].steps:
        k = int(np.searchsorted(active, place))
        if k == len(active) or active[k] != place:
            break
        path.append(int(edge[k]))
    return tuple(path)


def _ids(lattices: Lattices, drawn: tuple, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All pieces in the order of the texts, and the ``n + 1`` places where units begin."""
    paths, back, _ = drawn
    lengths = np.zeros(n, np.int64)
    for active, _ in paths.steps:
        lengths[active] += 1
    order = np.empty(n, np.int64)
    order[back] = np.arange(n)
    ends = np.zeros(n + 1, np.int64)
    np.cumsum(lengths[back], out=ends[1:])
    ids = np.empty(int(ends[-1]), np.int32)
    begin = ends[:-1][order]
    for step, (active, edge) in enumerate(paths.steps):
        ids[begin[active] + step] = lattices.piece[edge]
    return ids, ends


SAMPLE = "struct<ids:array<int>,log_prob:double,perturbed:double,log_inclusion:double,round_trip:boolean>"


def sample_segmentations(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", k: int = SAMPLES, model: str = MODEL, name: str = "samples") -> DataFrame:
    """``docs`` with up to ``k`` distinct sampled segmentations of each text."""
    spark = docs.sparkSession
    ship_package(spark)
    small_batches(spark)
    shared = spark.sparkContext.broadcast(Path(model).read_bytes())  # one tokenizer file
    key = F.xxhash64(key_col)
    docs = docs.withColumn(fresh_name(docs, "sample_key"), key).drop(name)
    place = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields[:-1], *T.StructType.fromDDL(f"`{name}` array<{SAMPLE}>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value)
        lattices = Lattices(vocabulary)
        for batch in batches:
            texts = batch.column(place)
            keys = batch.column(batch.num_columns - 1).to_numpy().view(np.uint64)
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
            cuts = np.flatnonzero(np.diff(sizes // SLICE_BYTES)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)], strict=True):
                part = texts.slice(low, high - low).to_pylist()
                full = [i for i, t in enumerate(part) if t is not None]
                found: list[list] = [[] for _ in part]
                if full:
                    sampled = sample_slice(lattices, [part[i] for i in full], keys[low:high][full], k)
                    for i, samples in zip(full, sampled, strict=True):
                        found[i] = samples
                yield pa.RecordBatch.from_arrays([*(c.slice(low, high - low) for c in batch.columns[:-1]), _arrow(vocabulary, part, found)], names=[*batch.schema.names[:-1], name])
        del lattices, vocabulary
        give_back()

    return docs.mapInArrow(run, schema)


def _arrow(vocabulary: Vocabulary, texts: list[str | None], found: list[list]) -> pa.Array:
    flat = [x for samples in found for x in samples]
    owner = [t for t, samples in zip(texts, found, strict=True) for _ in samples]
    ids = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum([len(x[0]) for x in flat])]).astype(np.int32), pa.int32()),
        pa.array(np.concatenate([x[0] for x in flat]) if flat else np.zeros(0, np.int32), pa.int32()),
    )
    trips = pa.array([vocabulary.decode(x[0].tolist()) == t for x, t in zip(flat, owner, strict=True)], pa.bool_())
    numbers = [pa.array([x[i] for x in flat], pa.float64()) for i in (1, 2, 3)]
    inner = pa.StructArray.from_arrays([ids, *numbers, trips], names=["ids", "log_prob", "perturbed", "log_inclusion", "round_trip"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32), pa.int32()), inner)


def sampled_rows(sampled: DataFrame) -> DataFrame:
    """One row for each sample of a document, with digests of its pieces."""
    each = sampled.select("doc_id", F.posexplode("samples").alias("sample", "s"))
    return each.select(
        "doc_id",
        "sample",
        F.size("s.ids").cast("long").alias("n_pieces"),
        F.xxhash64("s.ids").alias("ids_hash"),
        F.col("s.log_prob").alias("log_prob"),
        F.col("s.log_inclusion").alias("log_inclusion"),
        F.col("s.round_trip").alias("round_trip"),
    )
