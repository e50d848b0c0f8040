"""The pipeline, stage by stage, against plain Python on the same input."""

import re
from itertools import combinations

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import SMALL, odd_documents, parts, word_set
from tideline.llm.store import written
from tideline.session import table


def test_stages_against_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    known = written(stages["language_id"](spark, docs, SMALL), "t1")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"] for r in known.collect()} == {i for i, t in texts.items() if t and re.search(r"[^\W\d_]", t)} and known.columns == columns

    single = written(stages["near_dedup"](spark, known, SMALL), "t2")
    sets = {r["doc_id"]: word_set(r["text"]) for r in known.collect()}
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert {r["doc_id"] for r in single.collect()} == set(parts(sets, links).values()) and single.columns == columns

    cut = written(stages["substring_dedup"](spark, single, SMALL), "t3")
    before, seen = {r["doc_id"]: r["text"] for r in single.collect()}, {}
    after = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert cut.columns == columns and all(set(after[i].split()) <= set(before[i].split()) for i in after)
    for i, t in after.items():
        w = t.lower().split()
        for k in range(len(w) - 59):
            assert seen.setdefault(tuple(w[k : k + 60]), i) == i

    clean = written(stages["decontamination"](spark, cut, SMALL), "t4")
    items = [word_set(r["text"]) for r in table(spark, SMALL, "benchmark").collect()]
    leaks = {i for i, t in after.items() if any(5 * len(s & word_set(t)) >= 4 * len(s) for s in items)}
    assert {r["doc_id"] for r in clean.collect()} == set(after) - leaks

    last = stages["sentencepiece"](spark, clean, SMALL).collect()
    assert {r["doc_id"] for r in last} == set(after) - leaks and all(r["round_trip"] for r in last)


def test_run_is_the_stages_in_order(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert rows and {r["sample"] for r in rows} == {0, 1}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "decontamination", "sentencepiece"]


def test_odd_documents_pass_all_stages(spark):
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SMALL), f"odd-{name}")
    assert {r["doc_id"] for r in docs.collect()} == {1, 7, 8, None}


def test_empty_documents_pass_all_stages(spark):
    docs = table(spark, SMALL, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SMALL), f"none-{name}")
    assert docs.count() == 0


def test_documents_without_a_labelled_language_stay(spark):
    docs = table(spark, SMALL, "documents").withColumn("lang", F.lit(None).cast("string"))
    left = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["language_id"](spark, docs, SMALL).collect()}
    assert left == {r["doc_id"] for r in docs.collect() if r["text"] and re.search(r"[^\W\d_]", r["text"])}
