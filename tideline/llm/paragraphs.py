"""Substring dedup by banded MinHash of paragraphs.

Paragraphs are of two kinds. A text is cut, across its line ends, where the hash of two
words is smaller than those around it, so that a passage is cut alike wherever it stands
and however its lines are wrapped; these pieces repeat where their words are equal. Each
line of ``LEAST_LINE`` words or more is a paragraph as a whole, and repeats by similarity:
its five-word shingles get MinHash values, bands of ``BAND_ROWS`` values, as many as the
wanted recall at the threshold takes, bring lines together, and colliding ones are
confirmed by exact Jaccard similarity, block by block, and joined into components.

Neighbouring repeated paragraphs form runs. The words beside a run are compared with those
beside the same paragraph in other texts, up to ``BESIDE`` of them, so that a run reaches
to the ends of what is shared, and not only to the last cut inside it. A run of ``LEAST_PASSAGE`` words or more, those beside it included, is a repeated
passage. Of each component the first paragraph (by id and place) stays, the others are
removals; words beside a run go where a smaller id has them beside the same paragraph.

Defined results: null, blank and short texts have no paragraphs; repeats inside one
document alone don't count; equal rows are one document; a row with a null id takes no
part; ids may be of any type that has an order; empty input gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.session import ship_package
from tideline.llm.graph import components
from tideline.llm.neardup import confirmed_links, parts_of
from tideline.llm.shingles import _powers, mix, pieces, shingle_hashes, splitmix, text_bytes, word_hashes
from tideline.llm.store import drop, fresh_name, give_back, only_ids, small_batches, written

REACH = 5
LEAST_UNIT = 6
MOST_UNIT = 32
LEAST_LINE = 8
LEAST_CORE = 12
LEAST_PASSAGE = 50
BESIDE = 40  # more than the longest unit has
GAP_BYTES = 64
WIDTH = 5
BAND_ROWS = 2
RECALL = 0.97
THRESHOLD = 0.8


def bands_for(recall: float, threshold: float, rows: int) -> int:
    """The least number of bands for which a pair at the threshold meets with the recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


BANDS = bands_for(RECALL, THRESHOLD, BAND_ROWS)
KEYS = [f"key{k}" for k in range(BANDS)]
_MULTIPLIERS = splitmix(61, BANDS * BAND_ROWS) | np.uint64(1)
_SECOND = splitmix(67, 1)[0]


def cut_places(words: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Places of the words that open a piece; ``opens`` marks those that open a text.

    The cuts are at words whose hash is the smallest of all within ``REACH`` words of the
    text on either side, and where a word ends that more than ``REACH`` of its kind precede:
    what is cut depends on the words around it alone. Where that leaves a piece long, it is
    cut every ``MOST_UNIT`` words.
    """
    n = len(words)
    text = np.cumsum(opens)
    starts = np.flatnonzero(opens)
    sizes = np.diff(np.append(starts, n))
    ranks = words * np.uint64(3)
    ranks[1:] += np.where(opens[1:], np.uint64(0), words[:-1])
    ranks = mix(ranks)
    least = np.ones(n, bool)
    for d in range(1, min(REACH, n - 1) + 1):
        other = text[d:] != text[:-d]
        least[d:] &= other | (ranks[d:] < ranks[:-d])
        least[:-d] &= other | (ranks[:-d] <= ranks[d:])
    into = np.arange(n) - np.repeat(starts, sizes)
    fresh = opens.copy()
    fresh[1:] |= words[1:] != words[:-1]
    kinds = np.flatnonzero(fresh)
    after = kinds[1:][np.diff(kinds) > REACH]
    least[after] = True
    least &= (into >= LEAST_UNIT) & (np.repeat(sizes, sizes) - into >= LEAST_UNIT)
    places = np.flatnonzero(opens | least)
    gaps = np.diff(np.append(places, n))
    long = np.flatnonzero(gaps > MOST_UNIT + LEAST_UNIT)
    if not len(long):
        return places
    more = [np.arange(places[i] + MOST_UNIT, places[i] + gaps[i] - LEAST_UNIT, MOST_UNIT) for i in long.tolist()]
    return np.sort(np.concatenate([places, *more]))


def _classes(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes for the word sequence of each span; spans follow one another without gaps."""
    low, high = int(starts[0]), int(starts[-1] + sizes[-1])
    place = np.arange(low, high) - np.repeat(starts, sizes)
    power = _powers(int(sizes.max()) + 1)[place]
    found = []
    for part in (words[low:high], mix(words[low:high] ^ _SECOND)):
        found.append(mix(np.add.reduceat(part * power, starts - low) + sizes.astype(np.uint64)).view(np.int64))
    return found[0], found[1]


class Units:
    """The paragraphs of a run of texts, as arrays: pieces first, then lines.

    ``row`` is the text's place in the run, ``begin`` and ``length`` are bytes in the text,
    ``word`` and ``size`` words in the text, ``first`` and ``second`` the hashes of the words;
    ``keys`` has the bands of the lines, which are the paragraphs from ``lines`` on.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray) -> None:
        words, starts, ends, before = word_hashes(data, bounds)
        self.count = self.lines = 0
        if not len(words):
            return
        low = int(bounds[0])
        newlines = np.flatnonzero(data[low : int(bounds[-1])] == 10) + low
        line = np.searchsorted(newlines, starts)
        opens_text = np.zeros(len(words), bool)
        opens_text[before[:-1][before[:-1] < before[1:]]] = True
        opens_line = opens_text.copy()
        opens_line[1:] |= line[1:] != line[:-1]
        found = []
        for places, least in ((cut_places(words, opens_text), LEAST_UNIT), (np.flatnonzero(opens_line), LEAST_LINE)):
            sizes = np.diff(np.append(places, len(words)))
            first, second = _classes(words, places, sizes)
            keep = sizes >= least
            found.append((places[keep], sizes[keep], first[keep], second[keep]))
        at, self.size, self.first, self.second = (np.concatenate(x) for x in zip(*found, strict=True))
        self.count, self.lines = len(at), len(found[0][0])
        if not self.count:
            return
        self.row = np.searchsorted(before, at, side="right") - 1
        self.begin = starts[at] - bounds[self.row]
        self.length = ends[at + self.size - 1] - starts[at]
        self.word = at - before[self.row]
        self.keys = _band_keys(words, before, at[self.lines :], self.size[self.lines :])


def _band_keys(words: np.ndarray, before: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each line, of the MinHash values of its shingles."""
    keys = np.zeros((len(places), BANDS), np.uint64)
    if not len(places):
        return keys.view(np.int64)
    runs, _ = shingle_hashes(words, before, WIDTH)
    runs = np.append(runs, np.uint64(0))  # so that a span may end with the last shingle
    spans = np.empty(2 * len(places), np.int64)
    spans[0::2] = places
    spans[1::2] = places + sizes - WIDTH + 1
    for k in range(BANDS * BAND_ROWS):
        least = np.minimum.reduceat(runs * _MULTIPLIERS[k], spans)[0::2]
        keys[:, k // BAND_ROWS] = mix((keys[:, k // BAND_ROWS] ^ least) + np.uint64(k + 1))
    return keys.view(np.int64)


def text_units(column: pa.Array) -> Iterator[tuple[int, Units]]:
    """The paragraphs of an Arrow string column, with the row that each run starts at."""
    data, offsets = text_bytes(column)
    for at, to in pieces(offsets):
        units = Units(data, offsets[at : to + 1])
        if units.count:
            yield at, units


def _chosen(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    held = F.col(id_col).cast("bigint") if kind in ("tinyint", "smallint", "int") else F.col(id_col)
    return docs.select(held.alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")


def describe(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each paragraph of each document.

    ``place`` packs the start byte and the length in bytes (32 bits each), ``words`` the
    place of the first word in the text and the number of words. Keys are those of lines.
    """
    chosen = _chosen(docs, id_col, text_col)
    names = ["doc_id", "place", "words", "first", "second", *KEYS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, units in text_units(batch.column(1)):
                columns = [(units.begin << 32) | units.length, (units.word << 32) | units.size, units.first, units.second]
                arrays = [batch.column(0).take(pa.array(at + units.row)), *(pa.array(c, pa.int64()) for c in columns)]
                for k in range(BANDS):
                    keys = np.zeros(units.count, np.int64)
                    keys[units.lines :] = units.keys[:, k]
                    arrays.append(pa.array(keys, mask=np.arange(units.count) < units.lines))
                yield pa.RecordBatch.from_arrays(arrays, names=names)
        give_back()

    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} bigint" for n in names[1:]))


def _name(first: Column, second: Column) -> Column:
    return F.unhex(F.concat(F.lpad(F.hex(first), 16, "0"), F.lpad(F.hex(second), 16, "0")))


def _same_class(texts: pa.Array, names: list[bytes]) -> list[bool]:
    """Whether each text is one paragraph of the class that its name tells."""
    found = []
    data, offsets = text_bytes(texts)
    for row, name in enumerate(names):
        words, *_ = word_hashes(data, offsets[row : row + 2])
        if not len(words):
            found.append(False)
            continue
        first, second = _classes(words, np.zeros(1, np.int64), np.array([len(words)]))
        found.append(first.astype(">i8").tobytes() + second.astype(">i8").tobytes() == name)
    return found


def _bytes_of(text: Column, start: Column, length: Column) -> Column:
    return F.substr(text.cast("binary"), (start + 1).cast("int"), length.cast("int")).cast("string")


def similar_lines(units: DataFrame, texts: DataFrame) -> DataFrame:
    """``first, second, cluster``: the component of each line class that is similar to another, where two documents have it.

    Classes are put together before they are dealt by band; of each, one text is read.
    """
    low = F.shiftleft(F.lit(1).cast("bigint"), 32) - 1
    lines = written(
        units.where(F.col(KEYS[0]).isNotNull())
        .groupBy("first", "second", *KEYS)
        .agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"), F.min_by("place", "doc_id").alias("place"), F.min("words").bitwiseAND(low).alias("n_words")),
        "lines",
        release=True,
    )
    banded = lines.select("first", "second", "n_words", F.explode(F.array(*KEYS)).alias("key"))
    several = written(banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "several-keys")
    pairs = written(
        banded.join(several.hint("shuffle_hash"), "key").select(
            F.unhex(F.lpad(F.hex("key"), 16, "0")).alias("group_id"), _name(F.col("first"), F.col("second")).alias("set_id"), F.col("n_words").alias("n_shingles")
        ),
        "pairs",
        release=True,
    )
    wanted = parts_of(pairs).groupBy("set_id").agg(F.array_distinct(F.flatten(F.collect_list("parts"))).alias("parts"))
    named = lines.select(_name(F.col("first"), F.col("second")).alias("set_id"), "first", "second", "d0", "d1", "place")
    wanted = written(named.join(wanted, "set_id"), "wanted", release=True)
    found = only_ids(texts, wanted.select(F.col("d0").alias("doc_id"))).join(wanted.withColumn("doc_id", F.col("d0")).hint("shuffle_hash"), "doc_id")
    found = found.select("set_id", "parts", _bytes_of(F.col("text"), F.shiftright("place", 32), F.col("place").bitwiseAND(low)).alias("text"))
    links = confirmed_links(found, int(THRESHOLD * 100), 100, fits=_same_class)
    roots = components(links).select(F.col("node").alias("set_id"), F.col("root").alias("cluster"))
    joined = written(wanted.join(roots, "set_id").select("first", "second", "d0", "d1", "cluster"), "similar")
    spread = joined.groupBy("cluster").agg(F.min("d0").alias("c0"), F.max("d1").alias("c1")).where("c0 <> c1").select("cluster")
    found = written(joined.join(written(spread, "spread"), "cluster").select("first", "second", "cluster"), "clusters")
    drop(lines, several, pairs)
    return found


def words_beside(texts: DataFrame, places: DataFrame) -> DataFrame:
    """``doc_id, side, at, first, beside, reach``: the words before or after paragraphs, from the nearest on.

    ``places(doc_id, side, at, first)`` has paragraphs' classes and their first word, or for
    side 1 the word after them. ``beside`` packs a hash of 32 bits for each of up to ``BESIDE``
    words, and ``reach`` the byte up to which that many words reach.
    """
    listed = places.groupBy("doc_id").agg(F.collect_list(F.struct("side", "at", "first")).alias("places"))
    listed = written(listed, "places", release=True)
    held = only_ids(texts, listed).join(listed.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "places")
    names = ["doc_id", "side", "at", "first", "beside", "reach"]
    steps = np.arange(1, BESIDE + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            counts = pc.list_value_length(batch.column(2)).to_numpy()
            flat = batch.column(2).flatten()
            bounds = np.concatenate([[0], np.cumsum(counts)])
            for low, high in pieces(offsets):
                words, starts, ends, before = word_hashes(data, offsets[low : high + 1])
                own = flat.slice(int(bounds[low]), int(bounds[high] - bounds[low]))
                row = np.repeat(np.arange(high - low), counts[low:high])
                side, at, first = (own.field(k).to_numpy().astype(np.int64) for k in range(3))
                place = (before[row] + at)[:, None] + np.where(side == 0, -1, 1)[:, None] * steps[None, :] - side[:, None]
                inside = (place >= before[row][:, None]) & (place < before[row + 1][:, None])
                place = np.clip(place, 0, len(words) - 1)
                hashes = (words[place] >> np.uint64(32)).astype(">u4")
                byte = (np.where(side[:, None] == 0, starts[place], ends[place]) - offsets[low + row][:, None]).astype(">u4")
                some = np.flatnonzero(inside[:, 0])
                many = inside.sum(1)
                packed = [[x[i, : many[i]].tobytes() for i in some.tolist()] for x in (hashes, byte)]
                columns = [batch.column(0).take(pa.array(low + row[some])), *(pa.array(x[some], pa.int64()) for x in (side, at, first))]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.binary()) for x in packed)], names=names)
        give_back()

    kind = held.schema["doc_id"].dataType.simpleString()
    return held.mapInArrow(run, f"doc_id {kind}, side bigint, at bigint, first bigint, beside binary, reach binary")


def common_lengths(a: list[bytes], b: list[bytes | None]) -> np.ndarray:
    """How many leading words of 32 bits the byte strings have in common; none with null."""
    if not a:
        return np.zeros(0, np.int64)
    wide = 4 * BESIDE
    left = np.frombuffer(b"".join(x.ljust(wide, b"\0") for x in a), "<u4").reshape(len(a), -1)
    right = np.frombuffer(b"".join((x or b"").ljust(wide, b"\0") for x in b), "<u4").reshape(len(a), -1)
    differ = np.concatenate([left != right, np.ones((len(a), 1), bool)], axis=1)
    sizes = np.array([min(len(x), len(y or b"")) // 4 for x, y in zip(a, b, strict=True)])
    return np.minimum(differ.argmax(axis=1), sizes)


def shared_beside(beside: DataFrame) -> DataFrame:
    """``first, side, beside, d0, steps, gone``: how many of the words another text has beside the same paragraph.

    Equal words are put together with their smallest id ``d0``; sorted, each has its
    closest likeness beside it. ``steps`` are shared by any two texts, ``gone`` those that
    ``d0`` shares with a smaller id. Groups have the paragraph and one word in common.
    """
    single = beside.groupBy("first", "side", "beside").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"))
    order = Window.partitionBy("first", "side", F.substring("beside", 1, 4)).orderBy("beside")
    near = [f(F.col(c)).over(order).alias(f"{n}_{c}") for n, f in (("before", F.lag), ("after", F.lead)) for c in ("beside", "d0", "d1")]
    rows = written(single, "beside-single", release=True).select("first", "side", "beside", "d0", "d1", *near)
    names = ["first", "side", "beside", "d0", "steps", "gone"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, d0, d1 = (batch.column(k).to_pylist() for k in (2, 3, 4))
            steps = np.array([len(x) // 4 if a != b else 0 for x, a, b in zip(words, d0, d1, strict=True)])
            gone = np.zeros(len(words), np.int64)
            for k in (5, 8):
                beside, n0, n1 = (batch.column(k + j).to_pylist() for j in range(3))
                common = common_lengths(words, beside)
                other = np.array([a is not None and not a == b == c == d for a, b, c, d in zip(n0, n1, d0, d1, strict=True)])
                less = np.array([a is not None and a < c for a, c in zip(n0, d0, strict=True)])
                steps, gone = np.maximum(steps, np.where(other, common, 0)), np.maximum(gone, np.where(less, common, 0))
            columns = [*batch.columns[:4], pa.array(steps, pa.int64()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = single.schema["d0"].dataType.simpleString()
    return rows.mapInArrow(run, f"first bigint, side bigint, beside binary, d0 {kind}, steps bigint, gone bigint")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, start, stop, cluster, removed``: each paragraph of a repeated passage.

    ``start`` and ``stop`` are byte places in the UTF-8 text; ``cluster`` names the
    component; ``removed`` is false for the one that stays. The words beside a run are a
    paragraph of their own.
    """
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    texts = _chosen(docs, id_col, text_col)
    units = written(describe(docs, id_col, text_col), "units")

    # classes that two documents have; a hot class is one row for each task
    ends = units.groupBy("first", "second").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"))
    shared = written(ends.where("d0 <> d1").select("first", "second", F.lit(None).cast("binary").alias("cluster")), "shared", release=True)
    clusters = similar_lines(units, texts)
    repeated = written(shared.unionByName(clusters).groupBy("first", "second").agg(F.max("cluster").alias("cluster")), "repeated")
    low = F.shiftleft(F.lit(1).cast("bigint"), 32) - 1
    begin, word = F.shiftright("place", 32), F.shiftright("words", 32)
    hits = (
        units.drop(*KEYS)
        .join(repeated.hint("shuffle_hash"), ["first", "second"])
        .select(
            "doc_id", begin.alias("start"), (begin + F.col("place").bitwiseAND(low)).alias("stop"), word.alias("word"),
            (word + F.col("words").bitwiseAND(low)).alias("stop_word"), "first", "second", "cluster",
        )
        .distinct()
    )

    # paragraphs overlap: gaps and words count from the furthest end so far
    by_place = Window.partitionBy("doc_id").orderBy("start", "stop")
    so_far = by_place.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce(F.col("start") - F.max("stop").over(so_far) > GAP_BYTES, F.lit(True))
    fresh = F.greatest(F.lit(0), F.col("stop_word") - F.greatest(F.col("word"), F.coalesce(F.max("stop_word").over(so_far), F.lit(0))))
    marked = hits.withColumn("opens", opens).withColumn("fresh", fresh)
    marked = marked.withColumn("run", F.last(F.when(F.col("opens"), F.col("word")), ignorenulls=True).over(by_place))
    marked = written(marked, "marked", release=True)
    drop(units, shared, clusters, repeated)
    grouped = marked.groupBy("doc_id", "run").agg(
        F.sum("fresh").alias("core"),
        F.max("stop_word").alias("stop_word"),
        F.min_by("first", F.struct("start", "stop", "first")).alias("left"),
        F.max_by("first", F.struct("stop", "start", "first")).alias("right"),
    )
    runs = written(grouped.where(F.col("core") >= LEAST_CORE), "runs", release=True)
    sided = [runs.select("doc_id", "run", F.lit(k).cast("bigint").alias("side"), F.col(at).alias("at"), F.col(c).alias("first")) for k, at, c in ((0, "run", "left"), (1, "stop_word", "right"))]
    ends = written(sided[0].unionByName(sided[1]), "ends")
    at = F.when(F.col("side") == 0, F.col("word")).otherwise(F.col("stop_word")).alias("at")
    places = marked.join(written(ends.select("side", "first").distinct(), "end-classes").hint("shuffle_hash"), "first").select("doc_id", "side", at, "first").distinct()
    beside = written(words_beside(texts, places), "beside", release=True)
    alike = written(shared_beside(beside), "alike", release=True)
    gone = F.when(F.col("doc_id") != F.col("d0"), F.length("beside") / 4).otherwise(F.col("gone")).cast("int")
    far = beside.join(ends, ["doc_id", "side", "at", "first"]).join(alike.hint("shuffle_hash"), ["first", "side", "beside"]).withColumn("gone", gone)
    far = written(far.where("steps > 0").select("doc_id", "run", "side", "first", "beside", "reach", "steps", "gone"), "far", release=True)
    more = far.groupBy("doc_id", "run").agg(F.sum("steps").alias("more"))
    enough = runs.join(more, ["doc_id", "run"], "left").where(F.col("core") + F.coalesce("more", F.lit(0)) >= LEAST_PASSAGE)
    enough = written(enough.select("doc_id", "run"), "enough")

    name = F.coalesce("cluster", _name(F.col("first"), F.col("second")))
    spans = marked.join(enough, ["doc_id", "run"]).select("doc_id", (F.col("stop_word") - F.col("word")).alias("n_words"), "start", "stop", name.alias("cluster"))
    passages = written(spans, "passages", release=True)
    edges = marked.groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    sides = written(far.join(enough, ["doc_id", "run"]).join(edges, ["doc_id", "run"]), "sides", release=True)
    drop(marked, runs, ends, beside, alike, far, enough)

    first = passages.groupBy("cluster").agg(F.min(F.struct("doc_id", "start", "stop")).alias("head"), F.max("doc_id").alias("last"))
    first = written(first.where(F.col("head.doc_id") != F.col("last")).select("cluster", "head"), "first")
    cluster = F.lower(F.hex("cluster")).alias("cluster")
    inner = passages.join(first, "cluster").select(
        "doc_id", "n_words", "start", "stop", cluster,
        # what overlaps the first paragraph in its own text is not another one
        ((F.col("doc_id") != F.col("head.doc_id")) | (F.col("start") >= F.col("head.stop"))).alias("removed"),
    )
    # what is shared is listed once: as a removal as far as it is one, or else as what stays
    listed = F.when(F.col("gone") > 0, F.col("gone")).otherwise(F.col("steps")).cast("int")
    far_byte = F.conv(F.hex(F.expr("substring(reach, 4 * n_words - 3, 4)")), 16, 10).cast("int")
    name = F.hex(F.xxhash64("first", "side", F.expr("substring(beside, 1, 4 * n_words)")))
    outer = sides.withColumn("n_words", listed).withColumn("far", far_byte).select(
        "doc_id",
        "n_words",
        F.when(F.col("side") == 0, F.col("far")).otherwise(F.col("stop")).alias("start"),
        F.when(F.col("side") == 0, F.col("start")).otherwise(F.col("far")).alias("stop"),
        F.lower(name).alias("cluster"),
        (F.col("gone") > 0).alias("removed"),
    )
    return inner.unionByName(outer).select("doc_id", *(F.col(c).cast("int").alias(c) for c in ("n_words", "start", "stop")), "cluster", "removed")


_BLANK = r"[\x20\x09-\x0D]"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with the removals cut out of their texts; a text that nothing is left of goes.

    What is left is as it was, but that of the white space on the two sides of a cut one
    stays: that with more line ends, or a space. ``length_col``, if given and there, is set
    to the number of characters of a changed text.
    """
    found = repeated_passages(docs, id_col, text_col).where("removed")
    key, cuts = fresh_name(docs, "cut_of"), fresh_name(docs, "cut_spans")
    # overlapping spans become one
    by_start = Window.partitionBy("doc_id").orderBy("start", "stop")
    apart = F.coalesce((F.col("start") > F.max("stop").over(by_start.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))
    parted = found.select("doc_id", "start", "stop", apart.alias("apart")).withColumn("span", F.sum("apart").over(by_start))
    merged = parted.groupBy("doc_id", "span").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    spans = merged.groupBy(F.col("doc_id").alias(key)).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias(cuts))
    raw = F.col(text_col).cast("binary")
    count = F.size(cuts)

    def piece(i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(F.get(F.col(cuts), i - 1)["stop"])
        stop = F.when(i == count, F.octet_length(text_col)).otherwise(F.get(F.col(cuts), i)["start"])
        part = F.substr(raw, start + 1, stop - start).cast("string")
        head, tail = F.regexp_extract(part, f"^{_BLANK}*", 0), F.regexp_extract(part, f"{_BLANK}*$", 0)
        return F.struct(i.alias("i"), head.alias("head"), tail.alias("tail"), F.regexp_replace(part, f"^{_BLANK}+|{_BLANK}+$", "").alias("body"))

    parts = F.filter(F.transform(F.sequence(F.lit(0), count), piece), lambda x: x["body"] != "")

    def lines(blank: Column) -> Column:
        return F.length(F.translate(blank, " \t\r\x0b\x0c", ""))

    def glued(all_parts: Column) -> Column:
        def one(x: Column, j: Column) -> Column:
            before = F.get(all_parts, j - 1)["tail"]
            seam = F.when(lines(x["head"]) + lines(before) == 0, " ").when(lines(x["head"]) >= lines(before), x["head"]).otherwise(before)
            lead = F.when(j > 0, seam).when(x["i"] == 0, x["head"]).otherwise("")
            trail = F.when((j == F.size(all_parts) - 1) & (x["i"] == count), x["tail"]).otherwise("")
            return F.concat(lead, x["body"], trail)

        return F.array_join(F.transform(all_parts, one), "")

    parted_col = fresh_name(docs, "cut_parts")
    joined = docs.join(spans, F.col(id_col) == F.col(key), "left").withColumn(parted_col, F.when(F.col(cuts).isNotNull(), parts))
    changed = F.col(cuts).isNotNull()
    out = joined.where(~changed | (F.size(parted_col) > 0)).withColumn(text_col, F.when(changed, glued(F.col(parted_col))).otherwise(F.col(text_col)))
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.when(changed, F.length(text_col).cast(kind)).otherwise(F.col(length_col)))
    return out.select(*docs.columns)
