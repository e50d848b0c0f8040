"""Ranks of groups of any size, against sorting."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tideline.functions import stats

PICKS = {"p10": stats.near_rank(0.1), "p50": stats.near_rank(0.5), "p99": stats.near_rank(0.99), "low": stats.low_rank(0.9), "first": lambda n: F.lit(0).cast("long")}


def plain(values):
    v = sorted(values)
    n = len(v)
    near = {q: math.floor(q * (n - 1) + 0.5) for q in (0.1, 0.5, 0.99)}
    return (n, v[-1], v[near[0.1]], v[near[0.5]], v[near[0.99]], v[min(math.floor(n * 0.9), n - 1)], v[0])


def groups():
    rng = random.Random(7)
    yield "one", [3.5]
    yield "equal", [2.0] * 50
    yield "whole", [float(rng.randint(-5, 5)) for _ in range(500)]
    yield "normal", [rng.gauss(0, 1) for _ in range(3000)]
    yield "outlier", [rng.random() for _ in range(2000)] + [1e12, -1e15]
    yield "wide", [10.0 ** rng.randint(-300, 300) * rng.choice((-1, 1)) for _ in range(400)]
    yield "late", [1.7e9 + rng.randint(0, 10**6) / 1e6 for _ in range(1000)]
    yield "endless", [math.inf, -math.inf, *(rng.random() for _ in range(100))]


@pytest.mark.parametrize("cells", [2, 7, 4096])
def test_ranks_of_groups(spark, monkeypatch, cells):
    monkeypatch.setattr(stats, "CELLS", cells)
    rows = [(name, v) for name, values in groups() for v in values] + [("equal", None), ("none", None)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "k string, v double").repartition(5)
    found = {r["k"]: tuple(r)[1:] for r in stats.at_ranks(frame, ["k"], "v", PICKS).collect()}
    assert found == {name: plain(values) for name, values in groups()}


def test_ranks_without_keys_and_of_nothing(spark):
    values = list(range(1000))
    frame = spark.createDataFrame([(v,) for v in values], "v long")
    assert tuple(stats.at_ranks(frame, [], "v", PICKS).first()) == plain(values)
    assert stats.at_ranks(frame.limit(0), [], "v", PICKS).count() == 0


def test_no_window_orders_a_whole_group(spark):
    rows = spark.range(200_000).select(F.lit("hot").alias("k"), (F.xxhash64("id") / 1e12).alias("v"))
    found = stats.at_ranks(rows, ["k"], "v", {"p50": stats.near_rank(0.5)})
    row = found.first()
    assert row["n"] == 200_000 and row["p50"] == sorted(r["v"] for r in rows.collect())[100_000]
    # what the last window orders: the values of a part of a part
    celled = stats._in_cells(rows.groupBy("k", "v").agg(F.count(F.lit(1)).alias("times")), ["k"], "v")
    assert celled.groupBy("cell").count().agg(F.max("count")).first()[0] < 200
