"""Scores of a hypothesis against a reference: word errors, drops, chrF, boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions import stats
from tideline.functions.text import metric_tokens
from tideline.session import ship_package, small_batches

OPS = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("ref_no", T.IntegerType())]))
STEPS = ["E", "S", "D", "I"]
TABLE_BYTES = 16 << 20


def _next_row(above: np.ndarray, word: int, others: np.ndarray) -> np.ndarray:
    """Costs of one more reference word: the best of pairing and dropping, then added words as a running minimum."""
    ramp = np.arange(len(above), dtype=np.int32)
    row = np.empty_like(above)
    row[0] = above[0] + 1
    row[1:] = np.minimum(above[:-1] + (others != word), above[1:] + 1)
    return np.minimum.accumulate(row - ramp) + ramp


def _steps(reference: list[str], hypothesis: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``align_words`` as two arrays: which of ``STEPS`` a step is, and its place in the reference.

    Rows of the table are kept as far as ``TABLE_BYTES`` go, at equal distances, and those between two of them
    are worked out again on the way back, in the same manner: memory is a few times
    ``TABLE_BYTES``, however long the texts are. What is right of the way back is never needed again.
    """
    codes = {w: i for i, w in enumerate({*reference, *hypothesis})}
    r = np.array([codes[w] for w in reference], np.int32)
    h = np.array([codes[w] for w in hypothesis], np.int32)
    least = min(len(r), len(h))
    other = np.flatnonzero(r[len(r) - least :][::-1] != h[len(h) - least :][::-1])
    tail = int(other[0]) if len(other) else least  # equal ends are pairs in any case
    m, n = len(r) - tail, len(h) - tail
    ops, places = np.zeros(m + n + tail, np.int8), np.zeros(m + n + tail, np.int32)
    places[:tail] = np.arange(len(r) - 1, m - 1, -1)
    i, j, at = m, n, tail
    waiting = [(0, m, np.arange(n + 1, dtype=np.int32))]  # rows from, to, and the first of them
    while waiting:
        low, high, row = waiting.pop()
        row = row[: j + 1]
        every = -(-(high - low) // max(4, TABLE_BYTES // row.nbytes)) or 1
        block = [row]
        for k in range(low + 1, high + 1):
            row = _next_row(row, r[k - 1], h[:j])
            if (k - low) % every == 0:
                block.append(row)
        if every > 1:
            waiting += [(x, min(x + every, high), first) for x, first in zip(range(low, high, every), block)]
            continue
        while i > low or (low == 0 and j):
            cost, above = block[i - low], block[i - low - 1] if i else None
            if i and j and cost[j] == above[j - 1] + (r[i - 1] != h[j - 1]):
                i, j = i - 1, j - 1
                ops[at], places[at] = r[i] != h[j], i
            elif i and cost[j] == above[j] + 1:
                i -= 1
                ops[at], places[at] = 2, i
            else:
                j -= 1
                ops[at], places[at] = 3, i
            at += 1
    return ops[:at][::-1], places[:at][::-1]


def align_words(reference: list[str], hypothesis: list[str]) -> list[tuple[str, int]]:
    """Steps of a cheapest alignment: ``E`` equal, ``S`` other word, ``D`` dropped, ``I`` added.

    Of several cheapest ones, the one that, read from the end, prefers a pair of words,
    then a drop. Each step has its place in the reference.
    """
    ops, places = _steps(reference, hypothesis)
    return [(STEPS[op], at) for op, at in zip(ops.tolist(), places.tolist(), strict=True)]


@F.arrow_udf(OPS)
def alignment(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
    """``align_words`` over two columns of token arrays. Steps are held as numbers, and one row's words at a time as objects."""
    found = [_steps(a.as_py() or [], b.as_py() or []) for a, b in zip(reference, hypothesis, strict=True)]
    offsets = pa.array(np.cumsum([0, *(len(ops) for ops, _ in found)]), pa.int32())
    ops = np.concatenate([ops for ops, _ in found] or [np.zeros(0, np.int8)])
    places = np.concatenate([at for _, at in found] or [np.zeros(0, np.int32)])
    names = pa.DictionaryArray.from_arrays(pa.array(ops), pa.array(STEPS)).cast(pa.string())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([names, pa.array(places)], ["op", "ref_no"]))


def _error_rate(ops: Column, tokens: Column, hypothesis: Column) -> Column:
    wrong = F.size(F.filter(ops, lambda x: x["op"] != "E"))
    return F.when(F.size(tokens) == 0, F.when(F.size(hypothesis) == 0, 0.0).otherwise(100.0)).otherwise(100.0 * wrong / F.size(tokens))


def measure(pairs: DataFrame, keys: list[str], least_run: int = 5) -> DataFrame:
    """Scores of ``pairs(keys..., ref, hyp)``: word error rates, drop rate, dropped passages."""
    ship_package(pairs.sparkSession)
    small_batches(pairs.sparkSession)
    tokens = pairs.select(
        *keys,
        metric_tokens(F.col("ref"), False).alias("r"),
        metric_tokens(F.col("hyp"), False).alias("h"),
        metric_tokens(F.col("ref"), True).alias("rc"),
        metric_tokens(F.col("hyp"), True).alias("hc"),
    )
    aligned = tokens.withColumn("all_ops", alignment("r", "h")).withColumn("ops", alignment("rc", "hc"))
    # runs of drops: the array is folded into maximal runs of neighbouring reference places
    runs = F.aggregate(
        "ops",
        F.struct(F.array().cast("array<int>").alias("open"), F.array().cast("array<array<int>>").alias("done")),
        lambda acc, x: F.when(x["op"] == "D", F.struct(F.concat(acc["open"], F.array(x["ref_no"])).alias("open"), acc["done"].alias("done"))).otherwise(
            F.struct(
                F.array().cast("array<int>").alias("open"),
                F.when(F.size(acc["open"]) >= least_run, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
            )
        ),
        lambda acc: F.when(F.size(acc["open"]) >= least_run, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]),
    )
    with_runs = aligned.withColumn("runs", runs)
    dropped = F.aggregate("runs", F.lit(0), lambda acc, x: acc + F.size(x))
    return with_runs.select(
        *keys,
        _error_rate(F.col("all_ops"), F.col("r"), F.col("h")).alias("wer"),
        _error_rate(F.col("ops"), F.col("rc"), F.col("hc")).alias("content_wer"),
        F.when(F.size("rc") == 0, 0.0).otherwise(100.0 * dropped / F.size("rc")).alias("drop_rate"),
        F.transform("runs", lambda run: F.array_join(F.transform(run, lambda i: F.get(F.col("rc"), i)), " ")).alias("drops"),
        F.size("rc").cast("bigint").alias("ref_words"),
    )


def _gram_counts(text: str, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length up to ``order`` the distinct character n-grams, as hashes, and their counts."""
    codes = np.frombuffer(re.sub(r"\s+", "", text).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    found, runs = [], np.zeros(len(codes), np.uint64)
    for n in range(1, order + 1):
        if len(codes) < n:
            break
        runs = runs[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
        found.append(np.unique(runs, return_counts=True))
    return found


def chrf_score(reference: str | None, hypothesis: str | None, order: int = 6, beta: float = 2.0) -> float:
    """Character n-gram F-score, in percent; 0 where a side is missing."""
    precision, recall = [], []
    for (a, n), (b, k) in zip(_gram_counts(reference or "", order), _gram_counts(hypothesis or "", order)):
        _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        both = int(np.minimum(n[i], k[j]).sum())
        precision.append(both / int(k.sum()))
        recall.append(both / int(n.sum()))
    p, q = (sum(x) / len(x) if x else 0.0 for x in (precision, recall))
    return 100.0 * (1 + beta * beta) * p * q / (beta * beta * p + q) if p + q else 0.0


def chrf(pairs: DataFrame, keys: list[str], order: int = 6, beta: float = 2.0) -> DataFrame:
    """``keys..., chrf`` of ``pairs(keys..., ref, hyp)``: a row's score depends on it alone, so nothing is shuffled."""
    ship_package(pairs.sparkSession)

    @F.pandas_udf("double")
    def score(references: pd.Series, hypotheses: pd.Series) -> pd.Series:
        return pd.Series([chrf_score(a, b, order, beta) for a, b in zip(references, hypotheses, strict=True)], dtype="float64")

    return pairs.select(*keys, score("ref", "hyp").alias("chrf"))


def match_boundaries(predicted: list[int], real: list[int], wanted: list[int], slack: int = 1) -> tuple[int, int, int]:
    """Hits, predictions and truths; each truth is taken once, by the first prediction near it.

    ``wanted`` are the truths of one class: a prediction that only matches another class
    isn't held against this one. Both sides go in order, so that one pass does.
    """
    truths, guesses = np.sort(np.array(wanted, np.int64)), np.sort(np.array(predicted, np.int64))
    taken = hits = 0
    loose = []
    for guess in guesses.tolist():
        taken = max(taken, int(np.searchsorted(truths, guess - slack)))
        if taken < len(truths) and truths[taken] <= guess + slack:
            taken, hits = taken + 1, hits + 1
        else:
            loose.append(guess)
    every = np.sort(np.array(real, np.int64))
    near = np.searchsorted(every, np.array(loose, np.int64) + slack, "right") - np.searchsorted(every, np.array(loose, np.int64) - slack)
    return hits, hits + int((near == 0).sum()), len(truths)


def boundary_scores(pairs: DataFrame, keys: list[str], slack: int = 1) -> DataFrame:
    """Precision and recall of ``pairs(keys..., predicted, real)``, arrays of word places."""
    ship_package(pairs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [match_boundaries(list(p), list(r), list(r), slack) for p, r in zip(frame["predicted"], frame["real"], strict=True)]
            out = frame[keys].copy()
            out[["hits", "predicted", "truth"]] = pd.DataFrame(found, columns=["hits", "predicted", "truth"], index=frame.index)
            yield out

    kinds = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys)
    counted = pairs.select(*keys, "predicted", "real").mapInPandas(run, f"{kinds}, hits long, predicted long, truth long")
    return counted.withColumn("precision", stats.ratio(F.col("hits"), F.col("predicted"))).withColumn("recall", stats.ratio(F.col("hits"), F.col("truth")))
