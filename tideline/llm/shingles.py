"""Word shingles as 64-bit hashes, by whole Arrow columns of texts.

Words are runs of bytes other than space and \\x09-\\x0D, with A-Z lower-cased. A text's
set holds the hashes of its distinct runs of ``width`` words; a text with fewer words has
one element for the whole sequence; a text without words, or null, has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 19
_MASK = (1 << 64) - 1


def splitmix(seed: int, count: int) -> np.ndarray:
    """``count`` pseudo-random 64-bit integers that follow from ``seed``."""
    found = []
    for i in range(1, count + 1):
        z = (seed + i * 0x9E3779B97F4A7C15) & _MASK
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        found.append(z ^ (z >> 31))
    return np.array(found, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits; works in place."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = int(splitmix(11, 1)[0]) | 1
_PLACES = splitmix(23, 64) | np.uint64(1)


def _factors(count: int) -> np.ndarray:
    """A pseudo-random factor for each place in a word: with powers of one number, regular long words would share a hash."""
    known = getattr(_factors, "known", None)
    if known is None or len(known) < count:
        known = mix(np.arange(1, max(64, 2 * count) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(_BASE))
        _factors.known = known
    return known


def _powers(count: int) -> np.ndarray:
    known = getattr(_powers, "known", None)
    if known is None or len(known) < count:
        size = max(64, 2 * count)
        known = np.ones(size, np.uint64)
        known[1:] = np.uint64(_BASE)
        known = np.multiply.accumulate(known)
        _powers.known = known
    return known


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its ``n + 1`` offsets; nulls are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    values = column.buffers()[2]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data, offsets


def pieces(offsets: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``size`` bytes; a longer text is a run of its own."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, to
        at = to


def word_hashes(data: np.ndarray, bounds: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end byte of each word, and the number of words before each text.

    ``bounds`` are the texts' offsets in ``data``; a word never crosses them.
    """
    low, high = int(bounds[0]), int(bounds[-1])
    part = data[low:high]
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    if not len(part):
        return none
    part = _LOWER[part] if lower else part
    inside = ~_SPACE[part]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    edges = bounds[1:-1] - low
    edges = edges[edges < len(part)]
    opens[edges] = inside[edges]
    starts = np.flatnonzero(opens)
    if not len(starts):
        return none
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    closes[edges[edges > 0] - 1] = inside[edges[edges > 0] - 1]
    ends = np.flatnonzero(closes) + 1
    lengths = ends - starts
    kept = part[inside].astype(np.uint64)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(kept)) - np.repeat(first, lengths)
    kept += np.uint64(1)
    kept *= _factors(int(lengths.max()) + 1)[place]
    return mix(np.add.reduceat(kept, first)), starts + low, ends + low, np.searchsorted(starts + low, bounds)


def shingle_hashes(words: np.ndarray, before: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the run of ``width`` words from each word; and whether it stays in its text."""
    n = len(words)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    runs = words[: n - width + 1] * _PLACES[0]
    for k in range(1, width):
        runs = runs + words[k : n - width + 1 + k] * _PLACES[k]
    whole = np.ones(n - width + 1, bool)
    for stop in before[1:-1]:
        whole[max(0, stop - width + 1) : stop] = False
    return mix(runs), whole


def _short(words: np.ndarray) -> np.ndarray:
    total = sum(int(w) * int(p) for w, p in zip(words, _PLACES[41:], strict=False)) + len(words) * int(_PLACES[40])
    return mix(np.array([total & _MASK], np.uint64))


def text_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text of an Arrow string column."""
    data, offsets = text_bytes(column)
    for at, to in pieces(offsets):
        words, _, _, before = word_hashes(data, offsets[at : to + 1])
        runs, _ = shingle_hashes(words, before, width)
        for a, b in zip(before[:-1], before[1:], strict=True):
            if b - a >= width:
                yield np.unique(runs[a : b - width + 1])
            elif b > a:
                yield _short(words[a:b])
            else:
                yield np.zeros(0, np.uint64)
