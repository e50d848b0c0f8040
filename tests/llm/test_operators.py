"""The training-data operators against brute force, round trips and held-out labels."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideline.llm import chat, countjoin, decontam, fim, graph, html, langid, neardup, paragraphs, quality, queries, segmentation, sharding, shingles, toxicity, whitening
from tideline.session import table

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORDS = "ba be bi bo bu da de di do du ga ge gi go gu ka ke ki ko ku la le li lo lu ma me mi mo mu na ne ni no nu".split()


def prose(rng, count):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(count))


def odd_documents(spark):
    """Nulls, blanks, repeats, a long word, other columns with clashing names."""
    rng = random.Random(9)
    text = prose(rng, 80)
    rows = [
        (1, text, "en", "s", 1, "a"),
        (1, text, "en", "s", 1, "a"),
        (2, text, None, None, None, None),
        (3, None, "en", "s", None, "x"),
        (4, "", "en", "s", 0, "x"),
        (5, " \n\t ", "en", "s", 4, "x"),
        (6, "42 !!", "de", "s", 5, "x"),
        (7, "x" * 60_000, "de", "s", 60_000, "x"),
        (None, text + " more", "de", "s", 5, "x"),
        (8, "two words", "de", "s", 9, "x"),
        (9, "two words", "de", "s", 9, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, matches string")


def word_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def parts(nodes, links):
    least = {n: n for n in nodes}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        least[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


# chat formatting


@pytest.mark.parametrize("text", ["", "plain", "\\### Assistant: </turn> ok", "\\l <\\g> \\\\", "a\n</turn>\n<turn user>x", "<<>>\\"])
def test_chat_round_trip(spark, text):
    rows = spark.createDataFrame([(1, 0, "us>er\\", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    records = rows.select("conv_id", F.to_variant_object(F.struct("conv_id", "turn", "role", "text")).alias("record"))
    made = chat.format_chats(chat.to_turns(records, keep=("conv_id",)), "conv_id")
    back = made.select(chat.read_back(F.col("formatted")).alias("t"), chat.loss_text(F.col("segments")).alias("l")).first()
    assert [(t["role"], t["text"]) for t in back["t"]] == [("us>er\\", text), ("assistant", text)] and back["l"] == text


@pytest.mark.parametrize(
    ("record", "layout", "turns"),
    [
        ('{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}', "messages", [("user", "a"), ("assistant", "b")]),
        ('{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}', "from_value", [("user", "a"), ("assistant", "b")]),
        ('{"prompt":"a","response":"b"}', "prompt_response", [("user", "a"), ("assistant", "b")]),
        ('{"instruction":"a","input":"c","output":"b"}', "instruction", [("user", "a\n\nc"), ("assistant", "b")]),
        ('{"output":"b","instruction":"a"}', "instruction", [("user", "a"), ("assistant", "b")]),
        ('{"question":null,"answer":"b"}', "question_answer", [("user", None), ("assistant", "b")]),
        ('{"unknown":1}', None, None),
        ('{"prompt":"a","response":"b","meta":{"x":1}}', "prompt_response", [("user", "a"), ("assistant", "b")]),
        ('{"system":"s","messages":[{"role":"user","content":"a","name":"n"}],"n":2}', "messages", [("system", "s"), ("user", "a")]),
        ('{"messages":[]}', None, None),
    ],
)
def test_layouts_by_fingerprint(spark, record, layout, turns):
    row = chat.to_turns(spark.createDataFrame([(record,)], "r string").select(F.parse_json("r").alias("record"))).first()
    assert row["layout"] == layout
    assert (row["turns"] and [(t["role"], t["text"]) for t in row["turns"]]) == turns


def test_chats_of_odd_rows(spark):
    rows = [(1, 1, "user", "b"), (1, 0, None, None), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (None, 0, "user", "x"), (2, None, "user", None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("t"))
    records = frame.select("conv_id", F.to_variant_object(F.struct("conv_id", "turn", "role", "text")).alias("record"), "turns", F.lit(1).alias("layout"))
    made = chat.format_chats(chat.to_turns(records, keep=("conv_id",)), "conv_id")
    found = {r["conv_id"]: [(t["role"], t["text"]) for t in r["t"]] for r in made.select("conv_id", chat.read_back(F.col("formatted")).alias("t")).collect()}
    assert found == {1: [("", ""), ("assistant", "a"), ("assistant", "a"), ("user", "b")], None: [("user", "x")], 2: [("user", "")]}
    assert chat.digests(chat.format_chats(chat.to_turns(records.limit(0), keep=("conv_id",)), "conv_id"), "conv_id").count() == 0
    odd = spark.createDataFrame([(5, '{"unknown":1}')], "conv_id long, r string").select("conv_id", F.parse_json("r").alias("record"))
    assert [r["formatted"] for r in chat.format_chats(chat.to_turns(odd, keep=("conv_id",)), "conv_id").collect()] == [None]


# quality


def plain_repeats(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = Counter(zip(w, w[1:], w[2:]))
    return len({i + k for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for k in range(3)})


def test_repeat_words_match_brute_force(spark):
    rng = random.Random(4)
    texts = ["", "a", "a a", "a a a", "a a a a", "a b c a b c", "a b c d a b c", "x  y\nz x y z"] + [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    rows = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["n_repeat_words"] for r in quality.measure(rows).collect()}
    assert found == {i: plain_repeats(t) for i, t in enumerate(texts)}


def test_binomial_tail(spark):
    def tail(k, n, p):
        return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))

    cases = [(0, 10, 0.1), (3, 100, 0.05), (5, 1000, 0.02), (0, 0, 0.1)]
    rows = spark.createDataFrame([(k, n) for k, n, _ in cases], "k long, n long")
    for (k, n, p), row in zip(cases, rows.collect(), strict=True):
        got = rows.where((F.col("k") == k) & (F.col("n") == n)).select(quality.binomial_tail(F.col("k"), F.col("n"), p)).first()[0]
        assert got == pytest.approx(tail(k, n, p), rel=1e-9)


def test_certified_steps_match_sql(spark):
    rng = random.Random(41)
    docs, labels = [], []
    for i in range(2400):
        lang = ["de", "en", "fr", None, "es"][i % 5]
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(55, 80))]
        good = rng.random() < 0.8
        if not good and rng.random() < 0.8:
            kind = rng.randrange(3)
            if kind == 0:
                words = [w + rng.choice(["%%%", "$", "##"]) for w in words]
            elif kind == 1:
                words = [*words[:10], "\n", *words[:10], "\n", *words]
            else:
                words = words + words[:20]
        elif rng.random() < (0.02 if lang == "es" else 0.002):
            words = [w + "&" for w in words]
        docs.append((i, " ".join(words), lang))
        labels.append((i, int(good) if i % 11 else None))
    frames = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    steps = {r["cut_stratum"]: r["step"] for r in quality.certified_steps(quality.measure(frames[0]), frames[1]).collect()}
    assert len(steps) >= 3 and len(set(steps.values())) > 1
    con = duckdb.connect()
    con.register("documents", frames[0].toPandas())
    con.register("labels", frames[1].toPandas())
    want = sorted(con.sql(queries.OP2_SQL).fetchall())
    found = quality.judge(*frames).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert sorted(map(tuple, found.collect())) == want
    assert sum(not r[6] and not r[7] for r in want) > 100


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (99, 1)], "doc_id long, quality int")
    docs = odd_documents(spark).withColumn("stratum", F.lit("x")).withColumn("step", F.lit(1)).withColumn("first", F.lit(1))
    found = quality.judge(docs, labels).collect()
    assert len(found) == 11 and {r["base_failed"] for r in found if r["doc_id"] in (3, 4, 5, 6, 7, 8, 9)} == {True}
    assert all(r["kept"] for r in found if r["doc_id"] in (1, 2)) and [r["n_words"] for r in found if r["doc_id"] == 3] == [0]
    assert quality.judge(docs.limit(0), labels).count() == 0 and quality.judge(docs, labels.limit(0)).where("kept").count() == 4


def test_cutoffs_need_enough_labels(spark):
    def docs(n):
        words = " ".join(f"w{i}" for i in range(60))
        junk = " ".join(f"w{i}%%%" for i in range(60))
        rows = [(i, words if i % 10 else junk, "en") for i in range(n)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(n)], "doc_id long, quality int")

    few, many = quality.judge(*docs(100)), quality.judge(*docs(2000))
    assert few.where("not kept").count() == 0
    assert many.where("not kept").count() == 200 and many.where("not kept and doc_id % 10 <> 0").count() == 0


# near-duplicates


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(2)
    a, b = (shingles.mix(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (900, 1100))
    union = np.unique(np.concatenate([a, b]))
    assert (neardup.merge(neardup.sketch(a), neardup.sketch(b)) == neardup.sketch(union)).all()
    for share in (0.3, 0.6, 0.9):
        both = union[: int(2000 * share)]
        x, y = np.concatenate([both, shingles.mix(np.arange(1, 200, dtype=np.uint64))]), np.concatenate([both, shingles.mix(np.arange(1000, 1200, dtype=np.uint64))])
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        p, q = neardup.sketch(x), neardup.sketch(y)
        guess = neardup.most_likely(int((p > q).sum()), int((p < q).sum()), len(x), len(y))
        assert abs(guess - true) < 0.2


def test_shingle_sets_match_plain_sets():
    rng = random.Random(1)
    texts = [prose(rng, n) for n in (0, 1, 4, 5, 6, 30)] + [None, " \n", "A b\x0bC d E f", "ä ö ü é x y", "same same same same same same same"]
    texts += ["word " * 300_000]
    sizes = [len(s) for s in shingles.text_sets(pa.array(texts, pa.string()))]
    assert sizes == [len(word_set(t)) for t in texts]


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2100)]
    found = dict(map(tuple, graph.components(spark.createDataFrame(links, "a long, b long")).collect()))
    want = parts({x for p in links for x in p}, links)
    assert found == {n: want[n] for n in found} and set(found) == {x for a, b in links if a != b for x in (a, b)}


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(6)
    texts = {}
    for base in range(12):
        words = prose(rng, 120).split()
        for copy in range(rng.choice((1, 2, 30))):
            changed = list(words)
            for _ in range(rng.randint(0, 5)):
                changed[rng.randrange(len(changed))] = prose(rng, 1)
            texts[base * 100 + copy] = " ".join(changed)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(rows).collect()}
    sets = {i: word_set(t) for i, t in texts.items()}
    links = [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert found == parts(texts, links)


def test_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SET_BLOCK", 4)
    monkeypatch.setattr(neardup, "BUCKET_BLOCK", 4)
    rng = random.Random(2)
    words = prose(rng, 200).split()
    rows = []
    for i in range(25):
        words[i * 7] = prose(rng, 1)  # a chain: neighbours are alike, the ends are not
        rows.append((i, " ".join(words)))
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in found} == {0}


def test_near_duplicates_of_odd_rows(spark):
    found = neardup.near_duplicates(odd_documents(spark)).collect()
    assert len(found) == 11
    by = {r["doc_id"]: r for r in found}
    assert (by[2]["component_id"], by[9]["component_id"], by[3]["n_shingles"], by[5]["kept"]) == (1, 8, 0, True)
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert neardup.near_duplicates(odd_documents(spark).limit(0)).count() == 0


# substring dedup


def test_long_shared_runs_are_found_and_others_left(spark):
    rng = random.Random(12)
    shared = [prose(rng, n) for n in (52, 60, 90, 150)]
    texts = {i: prose(rng, 120) for i in range(60)}
    planted = {}
    for i in range(24):
        w = texts[i].split()
        at = rng.randrange(len(w))
        texts[i] = " ".join(w[:at] + [shared[i % 4]] + w[at:])
        planted[i] = i % 4
    texts[40] += "\n" + "a common short line of few words"
    texts[41] += "\n" + "a common short line of few words"
    found = {r["doc_id"] for r in paragraphs.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert found == set(planted)


def test_repeats_are_cut_once(spark):
    rng = random.Random(13)
    passage = prose(rng, 60)
    own = [prose(rng, 40) for _ in range(4)]
    rows = [(i, f"{own[i]}\n{passage}\n{own[3 - i]} ü", "en", "s", 0) for i in range(3)] + [(9, passage, "en", "s", 0), (10, None, "en", "s", 0)]
    out = paragraphs.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert passage in texts[0] and 9 not in texts and texts[10] is None
    assert texts[1] == f"{own[1]}\n{own[2]} ü" and out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["n_chars"] for r in out.where("doc_id = 1").collect()} == {len(texts[1])}


def test_paragraph_units_tile_the_text():
    rng = random.Random(3)
    text = "\n".join(prose(rng, n) for n in (3, 8, 70, 200)) + "\n"
    raw = text.encode()
    units = [u for _, u in paragraphs.text_units(pa.array([text]))]
    spans = [(int(a), int(n), int(k)) for u in units for a, n, k in zip(u.begin, u.length, u.size)]
    pieces = [int(k) for u in units for k in u.size[: u.lines]]
    assert all(len(raw[a : a + size].split()) == n for a, size, n in spans)
    assert sum(pieces) == 281 and max(pieces) <= paragraphs.MOST_UNIT + paragraphs.LEAST_UNIT
    assert [int(k) for u in units for k in u.size[u.lines :]] == [8, 70, 200]


@pytest.mark.parametrize("widths", [(5, 5), (4, 5), (12, 200), (5, 200)])
def test_passages_of_short_and_rewrapped_lines_go(spark, widths):
    rng = random.Random(21)
    passage = prose(rng, 120).split()
    wrapped = ["\n".join(" ".join(passage[i : i + n]) for i in range(0, len(passage), n)) for n in widths]
    own = [prose(rng, 60) for _ in range(4)]
    rows = [(i, f"{own[2 * i]}\n{wrapped[i]}\n{own[2 * i + 1]}") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {r["doc_id"]: r["text"] for r in paragraphs.remove_repeats(docs, length_col=None).collect()}
    # both own parts stay, and less than a cut's reach of the passage at either end
    assert texts[0] == rows[0][1] and len(texts[1].split()) - 120 <= 40
    assert texts[1].startswith(own[2]) and texts[1].endswith(own[3])


def test_near_copies_of_long_lines_are_whole_paragraphs(spark):
    rng = random.Random(22)
    rows = []
    for i in range(40):
        w = prose(rng, 60).split()
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:29] + ["changed"] + w[30:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r["doc_id"] for r in paragraphs.remove_repeats(docs, length_col=None).collect()}
    assert left >= set(range(0, 80, 2)) and len(left) <= 46


def test_every_word_is_in_a_paragraph():
    rng = random.Random(23)
    text = "\n".join(prose(rng, n) for n in (3, 2, 8, 5, 70, 1, 4, 4, 200, 2))
    covered = set()
    for _, u in paragraphs.text_units(pa.array([text])):
        for word, size in zip(u.word.tolist(), u.size.tolist()):
            covered.update(range(word, word + size))
    assert covered == set(range(len(text.split())))


def windows_of(text, size=50):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def test_passages_match_brute_force(spark):
    rng = random.Random(51)
    texts = {i: prose(rng, rng.randint(60, 160)).split() for i in range(60)}
    for size in (30, 40, 49, 50, 51, 60, 75, 90, 120):
        passage = prose(rng, size).split()
        for i in rng.sample(range(60), 3):
            at = rng.randrange(len(texts[i]))
            texts[i][at:at] = passage
    docs = {i: " ".join(w) for i, w in texts.items()}
    seen = Counter(x for t in docs.values() for x in windows_of(t))
    want = {i for i, t in docs.items() if any(seen[x] > 1 for x in windows_of(t))}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    rows = paragraphs.repeated_passages(frame).collect()
    assert {r["doc_id"] for r in rows} == want and 8 < len(want) < 30
    raw = {i: t.encode() for i, t in docs.items()}
    by = {}
    for r in rows:
        words = tuple(raw[r["doc_id"]][r["start"] : r["stop"]].decode().split())
        assert len(words) == r["n_words"]
        by.setdefault(r["cluster"], []).append((r["doc_id"], r["removed"], words))
    # without near copies, paragraphs of a cluster have the same words, and somebody keeps them
    assert all(len({w for *_, w in x}) == 1 for x in by.values())
    left = {r["doc_id"]: r["text"] for r in paragraphs.remove_repeats(frame, length_col=None).collect()}
    again = Counter(x for t in left.values() for x in windows_of(t))
    assert not any(n > 1 for n in again.values())
    assert all(left[i] == docs[i] for i in docs if i not in want)
    kept = {x for t in left.values() for x in windows_of(t, 5)}
    assert all(x in kept for r in by.values() for x in windows_of(" ".join(r[0][2]), 5))


def test_shared_runs_reach_their_ends(spark):
    rng = random.Random(77)
    rows, shared = [], {}
    for k in range(60):
        run = [prose(rng, 1) + str(rng.randrange(10**6)) for _ in range(rng.randint(60, 140))]
        for side in (0, 1):
            words = [[f"x{rng.randrange(10**9)}" for _ in range(rng.randint(0, 90))] for _ in range(2)]
            rows.append((2 * k + side, " ".join([*words[0], *run, *words[1]])))
            shared[2 * k + side] = set(run)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {i: t.encode() for i, t in rows}
    found = {}
    for r in paragraphs.repeated_passages(frame).collect():
        found.setdefault(r["doc_id"], set()).update(texts[r["doc_id"]][r["start"] : r["stop"]].decode().split())
    assert set(found) == set(texts) and all(shared[i] <= found[i] for i in found)
    assert paragraphs.BESIDE >= paragraphs.MOST_UNIT + paragraphs.LEAST_UNIT


def test_similar_lines_match_brute_force(spark):
    rng = random.Random(52)
    rows, place = [], 0
    for _ in range(12):
        w = prose(rng, 70).split()
        for copy in range(4):
            v = list(w)
            for at in rng.sample(range(70), copy):
                v[at] = "changed" + str(rng.randrange(1000))
            rows.append((place, " ".join(v)))
            place += 1
    sets = {i: word_set(t) for i, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    roots = parts(dict(rows), links)
    found = [r for r in paragraphs.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["n_words"] == 70]
    clusters = {}
    for r in found:
        clusters.setdefault(r["cluster"], set()).add(r["doc_id"])
    want = {}
    for i, root in roots.items():
        want.setdefault(root, set()).add(i)
    assert sorted(map(sorted, clusters.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)
    assert {r["doc_id"] for r in found if r["removed"]} == {i for i, root in roots.items() if i != root}


def test_blank_lines_and_columns_stay(spark):
    rng = random.Random(53)
    passage, own = prose(rng, 70), [prose(rng, 30) for _ in range(4)]
    text = f"{own[0]}\n\n    {own[1]}\n\n\n{own[2]}\n{passage}\n\n{own[3]}"
    rows = [("a", passage, 1, "x", "y"), ("b", text, 2, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, cut_spans int, span_doc string, Cut_of string")
    found = {r["doc_id"]: r for r in paragraphs.remove_repeats(docs).collect()}
    assert found["a"]["text"] == passage
    assert found["b"]["text"] == f"{own[0]}\n\n    {own[1]}\n\n\n{own[2]}\n\n{own[3]}" and found["b"]["cut_spans"] == 2


def test_long_words_have_paragraphs():
    text = "x" * (17 << 20) + " " + " ".join(f"w{i}" for i in range(20))
    assert sum(u.count for _, u in paragraphs.text_units(pa.array([text]))) >= 2


def test_repeated_passages_of_odd_rows(spark):
    found = paragraphs.repeated_passages(odd_documents(spark)).collect()
    assert {r["doc_id"] for r in found} == {1, 2}
    assert paragraphs.repeated_passages(odd_documents(spark).limit(0)).count() == 0
    assert paragraphs.remove_repeats(odd_documents(spark)).where("doc_id in (4, 5, 6)").count() == 3


# sharding


def best_capacity(sizes, runs):
    best = [[math.inf] * (len(sizes) + 1) for _ in range(runs + 1)]
    best[0][0] = 0
    total = np.concatenate([[0], np.cumsum(sizes)])
    for k in range(1, runs + 1):
        best[k][0] = 0
        for i in range(1, len(sizes) + 1):
            best[k][i] = min(max(best[k - 1][j], total[i] - total[j]) for j in range(i))
    return best[runs][len(sizes)]


def test_capacity_is_minimal():
    rng = random.Random(7)
    for _ in range(40):
        sizes = [rng.randint(1, 50) for _ in range(rng.randint(1, 25))]
        runs = rng.randint(1, 6)
        capacity = sharding.smallest_capacity(sizes, runs)
        assert capacity == best_capacity(sizes, runs) and sharding.greedy_cuts(sizes, capacity, runs) is not None


@pytest.mark.parametrize("detail", [0, 10, 100_000])
def test_cuts_match_those_of_all_sizes(spark, detail):
    rng = random.Random(detail)
    groups = sorted((f"{rng.randrange(16**10):010x}", rng.randint(1, 900)) for _ in range(3000))
    frame = spark.createDataFrame(groups, "group_key string, group_bytes long")
    sizes = [s for _, s in groups]
    want = sharding.greedy_cuts(sizes, sharding.smallest_capacity(sizes, 7), 7)
    cuts = sharding.find_cuts(frame, 7, detail_limit=detail)
    assert [next(i for i, (k, _) in enumerate(groups) if k >= c) for c in cuts] == want


def test_shards_of_odd_rows_and_hot_texts(spark):
    rows = [(i, "hot " * 50) for i in range(200)] + [(i, f"text {i}") for i in range(200, 400)] + [(400, None), (401, ""), (400, None)]
    found = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 16).collect()
    assert len(found) == 403
    groups = {}
    for r in found:
        groups.setdefault(r["shard"], []).append(r["slot"])
    assert len(groups) == 16 and all(sorted(v) == list(range(len(v))) for v in groups.values())
    assert len({r["shard"] for r in found if r["size"] == 201}) == 1
    assert {r["text_crc32"] for r in found if r["doc_id"] == 250} == {zlib.crc32(b"text 250")}
    assert sharding.assign_shards(odd_documents(spark).limit(0)).count() == 0


# language


def test_language_on_held_out_documents(spark):
    found = queries.op6_language_id(spark, MIDDLE).join(table(spark, MIDDLE, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in found) >= 0.99 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_posteriors_match_enumeration():
    rng = np.random.default_rng(3)
    scores, transitions = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    sizes = np.array([4, 2, 1])
    sums = langid.posterior_sums(scores.copy(), sizes, transitions)
    at = 0
    for row, n in enumerate(sizes):
        part, total, want = scores[at : at + n], 0.0, np.zeros(3)
        for path in np.ndindex(*(3,) * n):
            weight = math.exp(sum(part[t, y] for t, y in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:])))
            total += weight
            want += weight * np.bincount(path, minlength=3)
        assert np.allclose(sums[row], want / total)
        at += n


def test_languages_of_long_texts_are_learned(spark):
    rng = random.Random(31)
    rows = [(i, prose(rng, 50), "aa") for i in range(60)] + [(i, prose(rng, 4000).upper().translate(str.maketrans("ABDGK", "XZQWY")), "zz") for i in range(60, 70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = langid.sample(docs, F.lit(True))
    assert {y for _, y in learned} == {"aa", "zz"} and all(len(t) <= langid.SAMPLE_CHARS for t, _ in learned)
    found = langid.with_language(docs, langid.fit(learned)).collect()
    assert all(r["lang_pred"] == r["lang"] for r in found)
    with pytest.raises(ValueError):
        langid.fit([("42", "aa")])


def test_toxic_labels_of_long_texts_are_learned(spark):
    rng = random.Random(32)
    rows = [(i, ("vile " if i % 2 else "calm ") + prose(rng, 6000)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    learned = toxicity.sample(docs, labels, F.lit(True))
    assert sorted(y for _, y in learned) == [0] * 10 + [1] * 10 and {len(t) for t, _ in learned} == {toxicity.SAMPLE_CHARS}


def test_code_switched_words_and_odd_texts(spark):
    docs = table(spark, MIDDLE, "documents")
    model = langid.fit(langid.sample(docs, langid.learnable()))
    assert [x for x, _ in model.label([None, "", "12 !?", "\U0001f600"])] == ["und"] * 4
    found = {r["doc_id"]: r["lang_pred"] for r in langid.with_language(odd_documents(spark), model).collect()}
    assert (found[3], found[4], found[6]) == ("und", "und", "und") and len(found) == 10
    assert langid.with_language(odd_documents(spark).limit(0), model).count() == 0
    assert langid.fit([]).label(["abc"]) == [("und", 0.0)]


def test_long_runs_of_letters_count_whole():
    words = langid.Words(["ab" * 100, "x" * 64, None, "y" * 65 + " z"])
    assert (words.ends - words.starts).tolist() == [64, 64, 64, 8, 64, 64, 1, 1] and words.counts.tolist() == [4, 1, 0, 3]
    a, b = langid.Words(["q" * 64 + "abcd" * 10]), langid.Words(["q" * 64 + "dcba" * 10])
    model = langid.fit([("abcd " * 30, "one"), ("dcba " * 30, "two")] * 5)
    assert [model.label([x])[0][0] for x in ("q" * 64 + "abcd" * 50, "q" * 64 + "dcba" * 50)] == ["one", "two"]
    assert set(a.hashes.tolist()) != set(b.hashes.tolist())


def test_language_replaces_columns_of_its_names(spark):
    docs = spark.createDataFrame([(1, "abcd abcd", 0.5, "y")], "doc_id long, text string, Score double, lang_pred string")
    model = langid.fit([("abcd " * 30, "one"), ("dcba " * 30, "two")] * 5)
    out = langid.with_language(docs, model)
    assert out.columns == ["doc_id", "text", "lang_pred", "score"] and out.first()["lang_pred"] == "one"


# decontamination


def test_items_inside_long_documents(spark):
    rng = random.Random(21)
    items = [(i, prose(rng, n)) for i, n in enumerate((6, 15, 30, 60, 300))] + [(9, None), (10, "two words")]
    docs = []
    for i in range(40):
        w = prose(rng, 4000).split()
        if i % 2:
            _, text = items[i % 5]
            part = text.split()
            part = part[: len(part) - len(part) // 12] if i % 4 == 1 else part
            w[rng.randrange(3000) : 3000] = part
        docs.append((i, " ".join(w)))
    frame = spark.createDataFrame([*docs, (100, None), (101, ""), (102, "two words")], "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    sets = {i: word_set(t) for i, t in items}
    want = {(d, i) for d, t in [*docs, (102, "two words")] for i, s in sets.items() if s and 5 * len(s & word_set(t)) >= 4 * len(s)}
    assert found == want


def test_item_blocks_are_whole(spark, monkeypatch):
    frame, items = table(spark, SMALL, "documents"), table(spark, SMALL, "benchmark")
    whole = sorted(map(tuple, decontam.contaminated(frame, items).collect()))
    monkeypatch.setattr(decontam, "item_blocks", lambda *a: iter([[r for r in rows] for rows in _halves(items)]))
    assert whole and sorted(map(tuple, decontam.contaminated(frame, items).collect())) == whole


def _halves(items):
    rows = [(r["item_id"], r["text"]) for r in items.collect()]
    return rows[::2], rows[1::2]


def test_many_blocks_are_one_pass(spark, monkeypatch):
    rng = random.Random(61)
    items = [(i, prose(rng, rng.choice([3, 8, 40, 120]))) for i in range(60)]
    docs = [(i, " ".join([prose(rng, 50), *(items[k][1] for k in rng.sample(range(60), rng.choice([0, 1, 9]))), prose(rng, 50)])) for i in range(80)]
    docs += [(100 + k, items[k][1]) for k in range(5)] + [(200, None), (201, "")]
    frame, tests = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontam.contaminated(frame, tests).collect()))
    sets = {i: word_set(t) for i, t in items}
    assert {(d, i) for d, i, *_ in whole} == {(d, i) for d, t in docs for i, s in sets.items() if s and 5 * len(s & word_set(t)) >= 4 * len(s)}
    monkeypatch.setattr(decontam, "MOST_LOADED", 2)
    monkeypatch.setattr(decontam, "item_blocks", lambda *a: iter([items[k::7] for k in range(7)]))
    parted = decontam.contaminated(frame, tests)
    assert sorted(map(tuple, parted.collect())) == whole
    assert parted._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # one scan


def test_matches_of_several_blocks_and_text_ids(spark, monkeypatch):
    frame, items = table(spark, SMALL, "documents"), table(spark, SMALL, "benchmark").withColumn("item_id", F.concat(F.lit("i"), "item_id"))
    once = {r["doc_id"]: sorted(m["item_id"] for m in r["matches"]) for r in decontam.with_matches(frame, items).collect()}
    assert any(once.values()) and all(x.startswith("i") for v in once.values() for x in v)
    halves = list(_halves(items))
    monkeypatch.setattr(decontam, "item_blocks", lambda *a: iter(halves))
    found = decontam.with_matches(frame, items)
    assert {r["doc_id"]: sorted(m["item_id"] for m in r["matches"]) for r in found.collect()} == once
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_columns_pass_through(spark):
    docs = odd_documents(spark)
    kept = decontam.drop_contaminated(docs, table(spark, SMALL, "benchmark"))
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert decontam.drop_contaminated(docs, table(spark, SMALL, "benchmark").limit(0)).count() == docs.count()


# SentencePiece


@pytest.fixture(scope="module")
def vocabulary():
    with open(segmentation.MODEL, "rb") as file:
        return segmentation.Vocabulary(file.read())


def all_paths(lattices, unit):
    found, front = [], [((), int(lattices.first[unit]), 0.0)]
    while front:
        path, node, log = front.pop()
        if node < 0:
            found.append((path, log))
            continue
        front.extend(((*path, e), int(lattices.next[e]), log + float(lattices.log[e])) for e in range(int(lattices.start[node]), int(lattices.start[node + 1])))
    return found


@pytest.mark.parametrize("text", ["", "a", "  two  spaces ", "Hello, wörld!\n\t日本語 ▁▁ \x00", "\U0001f600 é", "x" * 3000])
def test_samples_are_distinct_and_decode(vocabulary, text):
    out = segmentation.sample_slice(segmentation.Lattices(vocabulary), [text], np.array([3], np.uint64), 5)[0]
    assert all(vocabulary.decode(ids.tolist()) == text for ids, *_ in out) and len({tuple(ids.tolist()) for ids, *_ in out}) == len(out)
    values = [x[2] for x in out]
    assert values == sorted(values, reverse=True)


def test_pieces_of_several_spaces_are_sampled(vocabulary):
    text = "def f(x):\n        return  x"
    out = segmentation.sample_slice(segmentation.Lattices(vocabulary), [text] * 40, np.arange(40, dtype=np.uint64) * np.uint64(7919), 3)
    ids = [i for samples in out for x in samples for i in x[0].tolist()]
    assert any(segmentation.SPACE * 2 in vocabulary.pieces[i] for i in ids)
    assert all(vocabulary.decode(x[0].tolist()) == text for samples in out for x in samples)


def test_samples_of_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a text", 3, "y", "z")], "doc_id long, text string, Samples int, sample_key string, __key string")
    out = segmentation.sample_segmentations(docs)
    assert out.columns == ["doc_id", "text", "sample_key", "__key", "samples"] and out.first()["samples"][0]["round_trip"]


def test_long_units_take_linear_time(vocabulary):
    def spent(n):
        start = time.perf_counter()
        segmentation.sample_slice(segmentation.Lattices(vocabulary), ["a" * n], np.array([3], np.uint64), 2)
        return time.perf_counter() - start

    assert spent(40_000) < 12 * spent(10_000)


def test_probabilities_are_those_of_all_segmentations(vocabulary):
    lattices = segmentation.Lattices(vocabulary)
    joined, starts, hashes, counts = vocabulary.units(["the erhe"])
    numbers = lattices.numbers(joined, starts, hashes)
    lattices.freeze()
    for n in numbers:
        assert sum(math.exp(log) for _, log in all_paths(lattices, n)) == pytest.approx(1.0)
    _, pieces = "the erhe", [joined[a:b] for a, b in zip(starts[:-1], starts[1:])]
    path, log = max(all_paths(lattices, numbers[0]), key=lambda x: x[1])
    weights = {}
    for p, value in all_paths(lattices, numbers[0]):
        weights[p] = sum(vocabulary.log_weight[lattices.piece[e]] for e in p)
    top = max(weights.values())
    total = top + math.log(sum(math.exp(w - top) for w in weights.values()))
    assert log == pytest.approx(weights[path] - total) and "".join(pieces) == "▁the▁erhe"


def test_inclusion_follows_sampling_without_replacement(vocabulary):
    keys = (np.arange(3000, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    seen, probability = Counter(), {}
    weight = Counter()
    for samples in segmentation.sample_slice(segmentation.Lattices(vocabulary), ["erh"] * len(keys), keys, 2):
        seen[frozenset(tuple(x[0].tolist()) for x in samples)] += 1
        for ids, log, _, inclusion in samples:
            probability[tuple(ids.tolist())] = math.exp(log)
            weight[tuple(ids.tolist())] += math.exp(log - inclusion)
    (pair, count), = seen.most_common(1)
    a, b = (probability[x] for x in pair)
    assert count / len(keys) == pytest.approx(a * b / (1 - a) + a * b / (1 - b), abs=0.03)
    # the inverse inclusion scores make an unbiased estimate of the probability
    for ids, p in probability.items():
        if p > 0.02:
            assert weight[ids] / len(keys) == pytest.approx(p, rel=0.15)


def test_rows_with_few_segmentations_have_them_all(vocabulary):
    lattices = segmentation.Lattices(vocabulary)
    joined, starts, hashes, _ = vocabulary.units(["the"])
    number = lattices.numbers(joined, starts, hashes)[0]
    lattices.freeze()
    count = len(all_paths(lattices, number))
    out = segmentation.sample_slice(lattices, ["the", ""], np.array([5, 6], np.uint64), count + 3)
    assert len(out[0]) == count and len(out[1]) == 1 and out[0][-1][3] == 0.0
    assert sum(math.exp(x[1]) for x in out[0]) == pytest.approx(1.0)


def test_samples_do_not_depend_on_batches(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    a = {r["doc_id"]: r["samples"] for r in segmentation.sample_segmentations(docs).collect()}
    b = {r["doc_id"]: r["samples"] for r in segmentation.sample_segmentations(docs.repartition(7)).collect()}
    assert a == b and all(s["round_trip"] for x in a.values() for s in x)


def test_samples_of_odd_rows(spark):
    found = {r["doc_id"]: r["samples"] for r in segmentation.sample_segmentations(odd_documents(spark)).collect()}
    assert found[3] == [] and len(found[4]) == 1 and all(s["round_trip"] for x in found.values() for s in x)
    assert segmentation.sample_segmentations(odd_documents(spark).limit(0)).count() == 0


# HTML


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<p>Only &amp; text&nbsp;here", "Only & text here"),
        ("<body><nav><a href=x>Home</a></nav><article><h1>T</h1><p>One <b>bo</b>ld.<p>Be.</article><footer>f</footer>", "T One bold. Be."),
        ("<div id='sidebar'>side bar text</div><div class=post><p>Some long enough text of the post.</p><ul><li>a</li><li>b</li></ul></div>", "Some long enough text of the post. a b"),
        ("<main><p>Text one is here.</p><div class='ad-box'>Buy now</div><form>name<input></form><p>Text two.</p></main>", "Text one is here. Text two."),
        ("<article><p>Body text goes here.</p><section class='comments'><p>I agree a lot with all of this.</p></section></article>", "Body text goes here."),
        ("<article>a<script>var x='<p>';</script><style>p{}</style><!-- c --> b</article>", "a b"),
        ("<article><table><tr><td>x<td>y</table> z</article></div></body>", "x y z"),
        ("<div hidden>no</div><div style='display: none'>no</div><p>yes, this one", "yes, this one"),
        ("<div class='ad'>left open<article><h1 class='header'>T</h1><p>Body text is here.</p></article>", "T Body text is here."),
        ("<div class='page-header-wrap'><p>All of the text is in here.</p></div>", "All of the text is in here."),
        ("<article><header><h1>Top</h1></header><p>Body of it.</p><div id='reader-comments'>me too</div><aside>x</aside></article>", "Body of it."),
        ("<div role=navigation>nav words here</div><p>kept text is kept.", "kept text is kept."),
    ],
)
def test_main_text(page, want):
    assert html.main_text(page) == want


def test_pages_of_the_tables(spark):
    rows = queries.op9_html_extraction(spark, SMALL).collect()
    assert len(rows) == 50 and all(r["n_chars"] == len(r["text"]) > 0 for r in rows)


LONG = "<p>" + "A sentence of the text that is told here. " * 6 + "</p>"


@pytest.mark.parametrize(
    "named",
    ["content has-sidebar", "layout-right-sidebar", "entry with-comments", "post-share-enabled", "page no-header", "post ad-free", "related-story main", "sidebar", "ad"],
)
@pytest.mark.parametrize("tag", ["div", "section", "article", "form"])
def test_names_never_take_the_article(named, tag):
    story = " ".join(re.sub("<[^>]*>", " ", LONG * 2).split())
    page = f"<body><{tag} class='{named}'>{LONG}{LONG}</{tag}><p>Imprint</p></body>"
    assert html.main_text(page) == story
    inner = f"<body><{tag} id='{named}'><div class='{named}'>{LONG}{LONG}</div><nav>Home About</nav></{tag}><footer>f</footer></body>"
    assert html.main_text(inner) == story


def test_a_form_around_the_page():
    story = " ".join(re.sub("<[^>]*>", " ", LONG * 2).split())
    page = f"<body><form id='aspnetForm'><nav>Home About</nav><div>{LONG}{LONG}</div><aside>{LONG}</aside><form class=search>find</form></form></body>"
    assert html.main_text(page) == story
    assert html.main_text(f"<body><div>{LONG}{LONG}</div><form>{LONG}</form></body>") == story


def test_long_texts_beside_the_article_go():
    story = " ".join(re.sub("<[^>]*>", " ", LONG * 2).split())
    for beside in (f"<div class='comments'>{LONG * 4}</div>", f"<div id=related><div>{LONG}</div></div>", f"<div class='post-comments'>{LONG}</div>", f"<aside>{LONG * 9}</aside>"):
        assert html.main_text(f"<body><div class='post'>{LONG}{LONG}</div>{beside}</body>") == story


def test_ratios_find_most_of_the_text_without_evidence(spark, monkeypatch):
    pages = [r["html"] for r in table(spark, MIDDLE, "pages").collect()]
    want = [Counter(html.main_text(p).split()) for p in pages]
    monkeypatch.setattr(html, "_excluded", lambda tag, attrs: None if tag in html.SKIPPED else 0.0)
    found = [Counter(html.main_text(p).split()) for p in pages]
    assert np.mean([2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values())) for a, b in zip(want, found)]) > 0.95
    monkeypatch.undo()
    monkeypatch.setattr(html, "ratios_of", lambda lines, beside: [1.0] * len(lines))
    assert sum(Counter(html.main_text(p).split()) != w for p, w in zip(pages, want)) > len(pages) / 2


MENU = "<div><p>Home</p><p>About us</p><p>Contact</p></div>"
STORY = "<div><h2>Title</h2><p>{0}</p><p>Be.</p><p>{0}</p><p>So.</p></div>".format("A sentence of the text that is told here. " * 4)


def test_ratios_decide_without_names_of_elements(monkeypatch):
    page = f"<body>{MENU}{STORY}<div><p>Top</p><p>Imprint</p></div></body>"
    story = " ".join(x for x in re.sub("<[^>]*>", " ", STORY).split())
    assert html.main_text(page) == story
    monkeypatch.setattr(html, "smoothed", lambda values: [1.0] * len(values))
    assert html.main_text(page) != story


def test_smoothing_keeps_short_lines_among_long_ones(monkeypatch):
    long = "A sentence of the text that is told here. " * 4
    parts = [long, long, "Be.", long, long]
    page = "<body>" + MENU + "".join(f"<div><p>{x}</p></div>" for x in parts) + MENU + "</body>"
    want = " ".join(" ".join(parts).split())
    assert html.main_text(page) == want
    monkeypatch.setattr(html, "smoothed", lambda values: values)
    assert html.main_text(page) != want


def random_page(rng):
    """A page, and its lines as (text, tags, link characters, elements around it)."""
    out, lines, tags = ["<html><body>"], [], [2]

    def block(tag, path, inner):
        out.append(f"<{tag}>")
        tags[0] += 1
        inner([*path, f"{tag} {rng.random()}"])
        out.append(f"</{tag}>")
        tags[0] += 1

    def words(path):
        text = prose(rng, rng.choice([1, 1, 2, 3, 8, 20, 60]))
        linked = rng.random() < 0.2
        out.append(f"<a href=x>{text}</a>" if linked else text)
        # the tag that ends the line is one of its tags
        lines.append((text, tags[0] + 2 * linked + 1, len(text) if linked else 0, path))
        tags[0] = -1

    def part(path, depth):
        for _ in range(rng.randint(1, 5)):
            if depth < 3 and rng.random() < 0.4:
                block(rng.choice(["div", "section", "blockquote"]), path, lambda q: part(q, depth + 1))
            elif rng.random() < 0.2:
                block("ul", path, lambda q: [block("li", q, words) for _ in range(rng.randint(1, 4))])
            else:
                block("p", path, words)

    part(["html", "body"], 0)
    return "".join(out) + "</body></html>", lines


def plain_content(lines):
    def kind(e):
        return e.split(" ")[0]

    def container(path):
        while path and kind(path[-1]) in ("p", "ul", "li", "blockquote"):
            path = path[:-1]
        return path[-1] if path else ""

    n = len(lines)
    raw = [((len(t) - k) / max(1, g)) ** 0.5 for t, g, k, _ in lines]
    soft = []
    for i in range(n):
        w = {j: math.exp(-((i - j) ** 2) / 2) for j in range(n) if abs(i - j) <= 3}
        soft.append(sum(raw[j] * x for j, x in w.items()) / sum(w.values()))
    centre, near = max(soft), None
    while near != (near := [x >= centre / 2 for x in soft]):
        centre = np.mean([x for x, y in zip(soft, near) if y])
    over = [i for i in range(n) if raw[i] >= centre / 2]
    near = [any(j <= i <= k and all(near[j : k + 1]) for j in over for k in over) for i in range(n)]
    kept = []
    for i, (text, _, k, path) in enumerate(lines):
        own = [j for j in range(n) if near[j] and container(lines[j][3]) == container(path)]
        inner = bool(own) and min(own) < i < max(own)
        links = any(kind(e) == "li" for e in path) and k >= 0.9 * len(text)
        kept.append(near[i] or inner or bool(own) and kind(container(path)) not in ("html", "body") and not links)
    return " ".join(line[0] for line, x in zip(lines, kept) if x)


def test_main_text_matches_brute_force():
    rng = random.Random(31)
    changed = 0
    for _ in range(150):
        page, lines = random_page(rng)
        found = html.main_text(page)
        assert found == plain_content(lines)
        changed += found != " ".join(x[0] for x in lines)
    assert changed > 50


def test_main_text_takes_linear_time():
    def spent(page):
        start = time.perf_counter()
        html.main_text(page)
        return time.perf_counter() - start

    for unit in ("<div>text", "<div class=ad><article>", "<section>x</b></i></p>", "</div><foo>y"):
        assert spent(unit * 16_000) < 16 * max(spent(unit * 4_000), 0.02)


def test_pages_of_odd_rows(spark):
    rows = [(1, "u", None, "t"), (1, "u", None, "t"), (2, None, "", "t"), (None, "v", "<p>A word or two.", "t"), (3, "w", "<nav>x</nav>", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = [tuple(r) for r in html.extract_text(pages).collect()]
    assert sorted(found, key=str) == sorted([(1, "u", ""), (1, "u", ""), (2, None, ""), (None, "v", "A word or two."), (3, "w", "")], key=str)
    assert html.extract_text(pages.limit(0)).count() == 0


# toxicity


def plain_segments(scores):
    """Maximal segments by their definition: recursively, the best segment, then both sides."""
    if not scores or max(scores) <= 0:
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    best = max(((total[j] - total[i], -(j - i), -i, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))
    i, j = best[3], best[4]
    return plain_segments(scores[:i]) + [(i, j - 1)] + [(a + j, b + j) for a, b in plain_segments(scores[j:])]


def test_segments_match_their_definition():
    rng = random.Random(10)
    for _ in range(60):
        scores = [rng.choice([-1.0, -1.0, -1.0, 2.5, 1.3, 0.7]) for _ in range(rng.randint(0, 25))]
        items = [(i, s) for i, s in enumerate(scores) if s > 0]
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(items, -1.0)] == plain_segments(scores)


def test_toxicity_on_held_out_labels(spark):
    found = queries.op10_toxicity(spark, MIDDLE).join(table(spark, MIDDLE, "labels"), "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in found)
    assert right >= 0.9 * len(found) and all(0 <= r["score"] <= 1 for r in found)


def test_toxicity_without_labels_and_of_odd_rows(spark):
    assert toxicity.fit([]).judge("x")[0] == pytest.approx(0.0, abs=1e-9)
    model = toxicity.fit([("you vile thing here", 1)] * 40 + [("a calm sentence here", 0)] * 200)
    rows = toxicity.with_toxicity(odd_documents(spark), model).collect()
    assert len(rows) == 11 and len({r["score"] for r in rows if r["doc_id"] in (3, 4, 5)}) == 1
    assert model.judge("so vile and vile")[0] > 0.5 > model.judge("a calm day")[0]
    assert model.judge("vile " * 50_000)[0] > 0.5
    assert toxicity.with_toxicity(odd_documents(spark).limit(0), model).count() == 0


# SQL


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    frame = queries.queries()[name](spark, SMALL)
    columns = sorted(frame.columns)
    got = sorted(map(tuple, frame.select(columns).collect()), key=repr)
    result = con.execute(queries.oracle_sql()[name])
    order = [[d[0] for d in result.description].index(c) for c in columns]
    assert got == sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=repr)


def test_e_values_are_those_of_ordinary_texts():
    con = duckdb.connect()
    rows = con.sql(
        "SELECT d.doc_id, d.text, l.toxic FROM '/root/testdata/sf0.1/documents.parquet' d JOIN '/root/testdata/sf0.1/labels.parquet' l USING (doc_id)"
        " WHERE d.text IS NOT NULL AND l.toxic IS NOT NULL ORDER BY 1"
    ).fetchall()
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows]
    model = toxicity.fit([(text, y) for (_, text, y), out in zip(rows, held) if not out])
    ordinary = [min((e for *_, e in model.segments(text)[0]), default=math.inf) for (_, text, y), out in zip(rows, held) if out and not y]
    for c in (0.01, 0.1, 1.0):
        want = 1 - math.exp(-c)
        assert np.mean(np.array(ordinary) < c) == pytest.approx(want, abs=3 * math.sqrt(want * (1 - want) / len(ordinary)))
    right = [(model.judge(text)[0] >= 0.3) == bool(y) for (_, text, y), out in zip(rows, held) if out]
    assert np.mean(right) >= 0.985


def test_toxicity_replaces_columns_of_its_names(spark):
    docs = spark.createDataFrame([(1, "x", 0.5, "y")], "doc_id long, text string, Score double, passages string")
    model = toxicity.fit([("you vile thing here", 1)] * 40 + [("a calm sentence here", 0)] * 200)
    out = toxicity.with_toxicity(docs, model)
    assert out.columns == ["doc_id", "text", "score", "passages"] and out.first()["passages"] == []


def test_copies_count_once():
    rng = random.Random(33)
    text = prose(rng, 60)
    copies = [(text + " end" * i, 1) for i in range(5)]
    grouped = toxicity.in_groups([*copies, *((prose(rng, 60), 1) for _ in range(toxicity.FOLDS)), ("", 0)])
    assert len({g for g, _, y in grouped if y}) == 1 + toxicity.FOLDS
    _, sizes = toxicity.document_counts(grouped)
    assert [sum(s[k] for s in sizes) for k in (0, 1)] == [1, 1 + toxicity.FOLDS]
    assert len({g for g, *_ in toxicity.in_groups(copies)}) == 5


def test_sharding_query_matches_brute_force(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{MIDDLE}/documents.parquet'").fetchall()
    sizes = {}
    for _, text in rows:
        key = hashlib.sha256(text.encode()).hexdigest() if text is not None else ""
        sizes[key] = sizes.get(key, 0) + len((text or "").encode()) + 1
    own, rest = [], sum(sizes.values())
    for key in sorted(sizes, key=lambda k: (-sizes[k], k)):
        if len(own) == 15 or sizes[key] * (16 - len(own)) <= rest:
            break
        own.append(key)
        rest -= sizes[key]
    others = sorted(k for k in sizes if k not in own)

    def runs(capacity):
        found, used = [0], 0
        for key in others:
            if used + sizes[key] > capacity:
                found, used = [*found, 0], 0
            used += sizes[key]
            found[-1] += 1
        return found

    low, high = max(sizes[k] for k in others), rest
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if len(runs(middle)) <= 16 - len(own) else (middle + 1, high)
    place, want = 0, {k: i for i, k in enumerate(own)}
    for i, count in enumerate(runs(low)):
        want.update(dict.fromkeys(others[place : place + count], len(own) + i))
        place += count
    found = queries.op5_sharding(spark, MIDDLE).collect()
    texts = {}
    for i, text in rows:
        texts.setdefault(i, []).append(text)
    slots = {}
    for r in found:
        options = [t for t in texts[r["doc_id"]] if (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) == (r["size"], r["text_crc32"])]
        assert any(want[hashlib.sha256(t.encode()).hexdigest() if t is not None else ""] == r["shard"] for t in options)
        assert r["law"] == "bytes" and r["grown_shard"] is None
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(found) == len(rows) and all(sorted(v) == list(range(len(v))) for v in slots.values())


# fill-in-middle


def plain_fim(doc_id, text):
    """Output, form and cuts by characters."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return text, "plain", n, None, None
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if h4 % 100 < 20 else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return output, "spm" if h4 % 100 < 20 else "psm", n, a, b - a


def odd_texts(rng, count):
    letters = ["a", "é", "ß", "漢", "😀", "́", "\n", " ", "<", "P", ">", "S", "M", "\x00", "‍"]
    sizes = [0, 1, 2, 7, 63, 64, 65, 511, 512, 513, 5000]
    return ["".join(rng.choice(letters) for _ in range(rng.choice(sizes))) for _ in range(count)]


@pytest.mark.parametrize("text", ["", "a", "漢" * 700, "é", "😀" * 129, "x" * 512, "x" * 511 + "漢", "ab漢é😀" * 200])
def test_rank_and_select(text):
    data = np.frombuffer(text.encode(), np.uint8)
    marks = fim.Boundaries(data)
    starts = [k for k, c in enumerate(text.encode()) if c & 0xC0 != 0x80]
    assert marks.before[-1] == len(text) == len(starts)
    assert marks.select(np.arange(len(text) + 1)).tolist() == [*starts, len(data)]
    assert marks.rank(np.arange(len(data) + 1)).tolist() == [sum(s < at for s in starts) for at in range(len(data) + 1)]


def test_fill_in_middle_matches_brute_force(spark):
    rng = random.Random(3)
    texts = odd_texts(rng, 300) + [None, "<P>", "a<", "<", ">", "漢" * 100_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "text"), (5, "again"), (5, "again")]
    made = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"))
    found = made.select("doc_id", "text", "output", "form", "n", "prefix_chars", "middle_chars", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert len(found) == len(rows) and {r["form"] for r in found} == {"plain", "psm", "spm"}
    for r in found:
        assert tuple(r)[2:7] == plain_fim(r["doc_id"], r["text"]) and r["back"] == (r["text"] or "")


def test_fill_in_middle_of_odd_rows(spark):
    docs = odd_documents(spark).withColumn("N", F.lit(1)).withColumn("output", F.lit("x")).withColumn("draw", F.lit("y"))
    made = fim.fill_in_middle(docs)
    assert made.columns == ["doc_id", "text", "lang", "source", "n_chars", "matches", "draw", "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = made.collect()
    assert len(rows) == 11 and {r["draw"] for r in rows} == {"y"}
    assert all((r["output"], r["form"]) == plain_fim(r["doc_id"], r["text"])[:2] for r in rows)
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
    keyed = fim.fill_in_middle(spark.createDataFrame([("k", "abc")], "key string, body string"), "key", "body", salt="s", rate=100, spm_rate=100).first()
    assert keyed["form"] == "spm"


# whitening


def plain_whitening(vectors):
    x = np.floor(1024 * np.array(vectors, np.float64)) + 100_000
    n = len(x)
    centred = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:8]
    exact = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, x.sum(axis=0), strict=True)) for row in x]
    return exact, (centred @ vectors[:, order]) / np.sqrt(values[order]), values[order] / values.sum()


def test_whitening_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    mixed = rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12)) * np.linspace(0.1, 2, 12)
    vectors = [[float(np.float32(v)) for v in row] for row in mixed] + [[0.0] * 12] * 30
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(7)
    exact, white, shares = plain_whitening(vectors)
    rows = whitening.whiten(frame).collect()
    assert len(rows) == 8 * len(vectors) and {r["n"] for r in rows} == {len(vectors)}
    found = np.zeros((len(vectors), 8))
    for r in rows:
        found[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == exact[r["vec_id"]] and abs(r["explained"] / shares[r["component"] - 1] - 1) < 1e-9
    signs = np.sign((found * white).sum(axis=0))
    assert np.abs(found - white * signs).max() < 1e-8
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-10
    assert rows[0]["identity_error"] >= np.abs(white.T @ white / len(white) - np.eye(8)).max() - 1e-10


def test_moments_merge_in_any_tree():
    rng = np.random.default_rng(1)
    rows = (rng.normal(size=(300, 5)) * 1000 + 1e5).astype(np.int64)
    whole = whitening.Moments.of(rows)
    cuts = [0, 0, 1, 2, 50, 51, 200, 300]
    parts_ = [whitening.Moments.of(rows[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    left = whitening.Moments.none(5)
    for p in parts_:
        left = left.merge(p)
    right = parts_[0]
    for p in reversed(parts_[1:]):
        right = p.merge(right)
    for got in (left, right):
        assert (got.n, got.sums) == (300, [int(v) for v in rows.sum(axis=0)])
        assert np.allclose(got.covariance, np.cov(rows.T, bias=True), rtol=1e-12) and np.allclose(got.covariance, whole.covariance, rtol=1e-12)


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.1, 0.2]), (1, [0.1, 0.2]), (2, [0.3, -0.2]), (None, [0.0, 0.5])]
    bad = [(3, None), (4, []), (5, [0.1, None]), (6, [nan, 0.0]), (7, [inf, 0.0]), (8, [-inf, 0.0]), (9, [0.1]), (10, [0.1, 0.2, 0.3])]
    frame = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").withColumn("n", F.lit("x")).withColumn("component", F.lit("y"))
    rows = whitening.whiten(frame).collect()
    assert len(rows) == 8 and {r["vec_id"] for r in rows} == {1, 2, None} and {r["n"] for r in rows} == {4}
    assert whitening.whiten(frame.limit(0)).count() == 0 and whitening.whiten(frame.where("vec_id = 3")).count() == 0
    assert whitening.whiten(frame.where("vec_id = 1")).count() == 0  # no variance
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(9)], "vec_id long, embedding array<double>")
    assert {r["component"] for r in whitening.whiten(flat).collect()} == {1}
    with pytest.raises(OverflowError):
        whitening._blocks(pa.array([[1e300, 0.0]]), 2)
    wide = whitening.Whitening(10, [0, 0], np.ones(2), np.eye(2), 2.0)
    with pytest.raises(OverflowError):
        wide.centred(np.array([[2**39, 0]]))


# n-gram Jaccard join


def quad_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def quad_classes(texts, num=85, den=100):
    sets = {i: quad_set(t) for i, t in texts.items()}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    return parts(texts, links)


def variants(rng, bases, most, length):
    """Texts in groups of copies with a few words changed, some about at the threshold."""
    texts = {}
    for base in range(bases):
        words = prose(rng, rng.randint(3, length)).split()
        for copy in range(rng.choice((1, 2, 3, most))):
            changed = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                changed[rng.randrange(len(changed))] = prose(rng, 1)
            texts[base * 1000 + copy] = " ".join(changed)
    return texts


@pytest.mark.parametrize("count", [1, 2, 15, 16, 17, 65, 300])
@pytest.mark.parametrize("num", [50, 85, 100])
def test_trees_find_all_pairs_in_bound(count, num):
    rng = np.random.default_rng(count)
    bases = [shingles.mix(rng.integers(0, 2**63, int(rng.integers(1, 200))).astype(np.uint64)) for _ in range(max(1, count // 6))]
    sets = []
    for _ in range(count):
        base = bases[int(rng.integers(len(bases)))].copy()
        at = rng.integers(0, len(base), int(rng.integers(0, 6)))
        base[at] = shingles.mix(rng.integers(0, 2**63, len(at)).astype(np.uint64))
        sets.append(np.unique(base))
    points, sizes = np.stack([countjoin.at_width(countjoin.point(s)) for s in sets]), np.array([len(s) for s in sets])
    assert (points.sum(axis=1) == sizes).all()
    found = [(min(a, b), max(a, b)) for i, j in countjoin.Tree(points, sizes).pairs(num, 100) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    bound = {(i, j): int(np.minimum(points[i], points[j]).sum()) for i, j in combinations(range(count), 2)}
    assert len(found) == len(set(found)) and set(found) == {p for p, o in bound.items() if (num + 100) * o >= num * int(sizes[p[0]] + sizes[p[1]])}
    for (i, j), least in bound.items():  # the bound is one
        assert len(np.intersect1d(sets[i], sets[j])) <= least


def test_trees_prune_nodes():
    rng = np.random.default_rng(4)
    sets = [shingles.mix(rng.integers(0, 2**63, 40).astype(np.uint64)) for _ in range(512)]
    tree = countjoin.Tree(np.stack([countjoin.at_width(countjoin.point(s)) for s in sets]), np.array([len(s) for s in sets]))
    assert len(tree.levels) > 3 and sum(len(i) for i, _ in tree.pairs(85, 100)) < 20


def test_points_of_large_sets_bound_more_closely():
    rng = np.random.default_rng(3)
    sets = [np.unique(shingles.mix(rng.integers(0, 2**63, n).astype(np.uint64))) for n in (3000, 3100, 9000, 9500, 40, 45)]
    sets += [np.unique(np.concatenate([sets[0][:2900], sets[1][:40]])), np.unique(np.concatenate([sets[2][:8800], sets[4]]))]
    points, sizes = [countjoin.point(s) for s in sets], np.array([len(s) for s in sets])
    assert [len(p) for p in points[:6]] == [512, 512, 2048, 2048, 32, 32] and all(int(p.sum()) == n for p, n in zip(points, sizes))
    found = {(min(a, b), max(a, b)) for i, j in countjoin.surviving(points, sizes, 85, 100) for a, b in zip(i.tolist(), j.tolist())}
    assert found == {(0, 6), (2, 7)}
    many = [np.unique(shingles.mix(rng.integers(0, 2**63, 600).astype(np.uint64)) >> np.uint64(5)) for _ in range(3)]  # all in one group of 32
    assert all(countjoin.point(s).max() < 256 and countjoin.point(s).sum() == len(s) for s in many)


def test_similar_sets_share_a_prefix_shingle():
    rng = np.random.default_rng(8)
    rank = rng.integers(0, 255, countjoin.COUNTERS).astype(np.uint8)
    for _ in range(300):
        base = shingles.mix(rng.integers(0, 2**63, int(rng.integers(1, 120))).astype(np.uint64))
        other = base.copy()
        at = rng.integers(0, len(base), int(rng.integers(0, 1 + len(base) // 8)))
        other[at] = shingles.mix(rng.integers(0, 2**63, len(at)).astype(np.uint64))
        a, b = np.unique(base), np.unique(other)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both):
            assert len(np.intersect1d(countjoin.prefix(a, rank, 85, 100), countjoin.prefix(b, rank, 85, 100)))


def test_jaccard_classes_match_brute_force(spark):
    rng = random.Random(12)
    texts = variants(rng, 40, 30, 150)
    passage = prose(rng, 60)
    texts |= {90_000 + k: f"{passage} {prose(rng, 40)}" for k in range(60)}  # alike by what all have
    texts |= {95_000 + k: " ".join(WORDS[k : k + 1 + k % 6]) for k in range(30)}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = countjoin.jaccard_classes(rows).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == quad_classes(texts)
    assert {r["doc_id"]: r["n_shingles"] for r in found} == {i: len(quad_set(t)) for i, t in texts.items()}
    assert len({r["component_id"] for r in found}) < len(texts) - 30


def test_regular_long_words_keep_hashes_of_their_own(spark):
    """Thue-Morse words, which polynomial hashes modulo a power of two can't tell apart."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    texts = {1: a, 2: b, 3: f"u v w {a}", 4: f"u v w {b}", 5: f"{a} {b} x y {b} {a} x y"}
    found = countjoin.jaccard_classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == quad_classes(texts) == {i: i for i in texts}
    assert {r["doc_id"]: r["n_shingles"] for r in found} == {i: len(quad_set(t)) for i, t in texts.items()}


def test_jaccard_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SET_BLOCK", 4)
    monkeypatch.setattr(countjoin, "BUCKET_BLOCK", 4)
    rng = random.Random(2)
    words = prose(rng, 200).split()
    rows = []
    for i in range(25):
        words[i * 7] = prose(rng, 1)  # a chain: neighbours are alike, the ends are not
        rows.append((i, " ".join(words)))
    found = countjoin.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in found} == {0}


def test_hot_shingles_that_connect_nothing_else(spark, monkeypatch):
    """A large group of near copies, and texts that share its words without being alike, or alike to one another only."""
    monkeypatch.setattr(countjoin, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(neardup, "SET_BLOCK", 16)
    rng = random.Random(3)
    base = prose(rng, 80).split()
    texts = {}
    for i in range(150):
        words = list(base)
        words[rng.randrange(80)] = prose(rng, 1)
        texts[i] = " ".join(words)
    for i in range(40):
        texts[1000 + i] = " ".join([*base[:66], *prose(rng, 14).split()])  # just under or over
        texts[2000 + i] = " ".join([*base[:40], *prose(rng, 40).split()])
    for i in range(0, 40, 2):
        texts[3000 + i] = texts[2000 + i] + " end"
    found = countjoin.jaccard_classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == quad_classes(texts)


def test_jaccard_at_other_thresholds(spark):
    texts = variants(random.Random(5), 12, 8, 60)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for num, den in ((1, 2), (95, 100)):
        found = countjoin.jaccard_classes(rows, num, den).collect()
        assert {r["doc_id"]: r["component_id"] for r in found} == quad_classes(texts, num, den)


def test_jaccard_classes_of_odd_rows(spark):
    docs = odd_documents(spark).withColumn("set", F.lit(1)).withColumn("point", F.lit("x")).withColumn("block", F.lit(2))
    found = countjoin.jaccard_classes(docs).collect()
    assert len(found) == 11
    by = {r["doc_id"]: r for r in found}
    assert (by[2]["component_id"], by[9]["component_id"], by[3]["n_shingles"], by[5]["component_id"], by[None]["component_id"]) == (1, 8, 0, 5, None)
    assert by[8]["n_shingles"] == 1 and by[7]["n_shingles"] == 1
    assert countjoin.jaccard_classes(docs.limit(0)).count() == 0 and countjoin.jaccard_classes(docs.where("doc_id = 4")).count() == 1


def test_counters_add_up(spark):
    rng = random.Random(6)
    texts = [prose(rng, 50) for _ in range(40)] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(9)
    rank = countjoin.rarity(countjoin.describe(docs, "doc_id", "text"))
    elements = np.concatenate(list(shingles.text_sets(pa.array(texts), 4)))
    counts = np.bincount((elements >> countjoin.COUNTER_SHIFT).astype(np.int64), minlength=countjoin.COUNTERS)
    assert (rank == np.minimum(np.log2(counts + 1) * countjoin.STEPS, 255).astype(np.uint8)).all() and rank.max() > 0


# queries that SQL can't express, against brute force


def tables_of(spark, path, **frames):
    """A folder of tables, as queries read them."""
    for name, frame in frames.items():
        frame.write.parquet(f"{path}/{name}.parquet")
    return str(path)


def plain_language(model, text):
    """Language and score by sums over words of forward and backward passes, word by word."""
    words = langid.Words([text])
    if not len(words.hashes):
        return "und", 0.0
    rows = model.emissions(words)
    local = model.scores[rows].astype(np.float64)
    n, k = local.shape

    def log_sum(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    forward, backward = np.zeros((n, k)), np.zeros((n, k))
    forward[0] = local[0]
    for t in range(1, n):
        forward[t] = local[t] + log_sum(forward[t - 1][:, None] + model.transitions, 0)
    for t in range(n - 2, -1, -1):
        backward[t] = log_sum(model.transitions + (local[t + 1] + backward[t + 1])[None, :], 1)
    both = forward + backward
    shares = np.exp(both - log_sum(both, 1)[:, None]).sum(axis=0) / n
    return model.languages[int(shares.argmax())], float(shares.max())


def test_language_query_matches_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    model = langid.fit(langid.sample(docs, langid.learnable()))
    found = {r["doc_id"]: r for r in queries.op6_language_id(spark, SMALL).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(found) == set(texts)
    for i, text in texts.items():
        language, score = plain_language(model, text)
        assert found[i]["lang_pred"] == language and found[i]["score"] == pytest.approx(score, abs=2e-3), i
        assert found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)


def plain_toxicity(model, text):
    """Score and passages by the definition of segments, over all tokens."""
    tokens = re.findall(r"[^\W\d_]+", (text or "").lower())
    own = [max((model.marks.get(x, 0.0) for x in (t, *(t[:k] + "-" for k in range(4, min(8, len(t) - 1) + 1)))), default=0.0) for t in tokens]
    found = [(a, b, sum(s if s > toxicity.LEAST_MARK else -toxicity.COST for s in own[a : b + 1])) for a, b in plain_segments([s if s > toxicity.LEAST_MARK else -toxicity.COST for s in own])]
    if not found and own and max(own) > 0:
        at = own.index(max(own))
        found = [(at, at, own[at])]
    shift = math.log(max(model.least, len(tokens))) / model.rate
    best = {}
    rare = []
    for a, b, s in found:
        e = model.law.e_value(s - shift)
        rare += [(a, b)] if e < toxicity.SIGNIFICANT else []
        if e < 1:
            best[tokens[a]] = max(best.get(tokens[a], 0.0), min(30.0, -math.log(max(e, 1e-300))))
    top = sorted(best.values(), reverse=True) + [0.0, 0.0]
    w = model.weights
    return 1 / (1 + math.exp(-(w[0] + w[1] * top[0] / 10 + w[2] * top[1] / 10 + w[3] * math.log1p(sum(best.values()))))), rare


def test_toxicity_query_matches_brute_force(spark, tmp_path):
    rng = random.Random(14)
    bad = [prose(rng, 1) + "x" for _ in range(12)]
    docs, labels = [], []
    for i in range(600):
        words = prose(rng, rng.randint(0, 60)).split()
        toxic = rng.random() < 0.2
        for _ in range(rng.randint(1, 6) if toxic else rng.random() < 0.05):
            words.insert(rng.randint(0, len(words)), rng.choice(bad) + rng.choice(["", "", "ing"]))
        docs.append((i, " ".join(words) if i % 50 else None))
        labels.append((i, int(toxic) if i % 7 else None))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    folder = tables_of(spark, tmp_path, documents=frames[0], labels=frames[1])
    model = toxicity.fit(toxicity.sample(*frames, toxicity.learnable()))
    found = {r["doc_id"]: r for r in queries.op10_toxicity(spark, folder).collect()}
    assert len(found) == 600 and {r["predicted"] for r in found.values()} == {0, 1}
    for i, text in docs:
        score, rare = plain_toxicity(model, text)
        assert found[i]["score"] == pytest.approx(score, abs=1e-9) and found[i]["n_passages"] == len(rare)
        assert found[i]["predicted"] == (found[i]["score"] >= 0.3) and found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    right = [found[i]["predicted"] == y for i, y in labels if y is not None and found[i]["held_out"]]
    assert np.mean(right) > 0.9


@pytest.mark.parametrize("sf", [SMALL, MIDDLE])
def test_texts_without_marks_are_not_toxic(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.fit(toxicity.sample(docs, labels, toxicity.learnable()))
    plain = 0
    for text in ["x", "hello", "hello world", "", None, *(r["text"] for r in docs.select("text").collect())]:
        if not any(model.scores[t] > 0 for t in re.findall(r"[^\W\d_]+", (text or "").lower())):
            score, passages = model.judge(text)
            assert score < 0.3 and not passages
            plain += 1
    assert plain >= 5


def test_sampling_query_matches_enumeration(spark, tmp_path, vocabulary):
    texts = ["the", "erh", "a", "", None, "of a", "zz", "the erh", "12"]
    folder = tables_of(spark, tmp_path, documents=spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    rows = queries.op8_sentencepiece(spark, folder).collect()
    for i, text in enumerate(texts):
        found = sorted((r["sample"], r["log_prob"], r["n_pieces"], r["ids_hash"]) for r in rows if r["doc_id"] == i)
        if text is None:
            assert not found
            continue
        # every way through every unit of the text, with the product of their probabilities
        lattices = segmentation.Lattices(vocabulary)
        joined, starts, hashes, counts = vocabulary.units([text])
        numbers = lattices.numbers(joined, starts, hashes)
        lattices.freeze()
        whole = [((), 0.0)]
        for n in numbers:
            whole = [(p + tuple(lattices.piece[e] for e in q), a + b) for p, a in whole for q, b in all_paths(lattices, n)]
        assert len(found) == min(2, len(whole)) and len({x[3] for x in found}) == len(found)
        for _, log, size, _ in found:
            assert any(abs(log - b) < 1e-6 and len(p) == size for p, b in whole), text
    assert all(r["round_trip"] for r in rows)
