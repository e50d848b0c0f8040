"""Queries of queues, pauses, endpoints, token places and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions import stats, tokens
from tideline.operators import queues, scoring
from tideline.plans import sqltext as sq
from tideline.plans.conversations import turns
from tideline.plans.registry import register
from tideline.plans.series import HOUR, series

_AT = "epoch_us(ts) / 1e6"
_ROWS = f"o AS (SELECT user_id AS session_id, event_id AS seq, {_AT} AS at_s, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"


@register(
    "draft_cache",
    """WITH RECURSIVE o AS (SELECT user_id AS session_id, event_id AS seq, event_type = 'purchase' AS settled, event_id % 3 AS line_id, event_id % 2 AS source, 'a' || event_id AS answer,
      row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
    k AS (SELECT session_id, NULL::BIGINT AS seq, 0 AS rn, false AS settled, []::STRUCT(line_id BIGINT, source BIGINT, answer VARCHAR)[] AS held, NULL::VARCHAR AS answer FROM o GROUP BY session_id
      UNION ALL SELECT o.session_id, o.seq, o.rn, o.settled,
        CASE WHEN o.settled THEN list_filter(k.held, lambda x: x.line_id <> o.line_id)
          ELSE list_slice(list_append(k.held, {'line_id': o.line_id, 'source': o.source, 'answer': o.answer}), greatest(len(k.held) - 6, 1), len(k.held) + 1) END,
        CASE WHEN o.settled THEN list_filter(k.held, lambda x: x.line_id = o.line_id AND x.source = o.source)[-1].answer END
      FROM k JOIN o ON o.session_id = k.session_id AND o.rn = k.rn + 1)
    SELECT session_id, seq, answer FROM k WHERE settled""",
)
def draft_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("seq")
    jobs = series(spark, sf_dir).select(
        "session_id", "seq", (F.col("event_type") == "purchase").alias("settled"), (seq % 3).alias("line_id"), (seq % 2).cast("string").alias("source"), F.concat(F.lit("a"), seq).alias("answer")
    )
    return queues.reuse_once(jobs)


def _queue_sql(name: str, capacity: int, policy: str) -> str:
    wait = f"len(busy) >= {capacity}"
    if policy == "drop":
        step = f"""SELECT session_id, seq, rn, clock, CASE WHEN {wait} THEN free_at ELSE greatest(free_at, clock) + work END AS free_at,
          CASE WHEN {wait} THEN busy ELSE list_append(busy, greatest(free_at, clock) + work) END AS busy, NOT {wait} AS admitted,
          CASE WHEN NOT {wait} THEN greatest(free_at, clock) + work END AS done_at FROM found"""
    else:
        step = f"""SELECT session_id, seq, rn, began, greatest(free_at, began) + work, list_append(CASE WHEN {wait} THEN list_slice(busy, 2, len(busy)) ELSE busy END, greatest(free_at, began) + work), true,
          greatest(free_at, began) + work FROM (SELECT *, CASE WHEN {wait} THEN busy[1] ELSE clock END AS began FROM found)"""
    return f"""{name} AS (SELECT session_id, NULL::BIGINT AS seq, 0::BIGINT AS rn, 0::DOUBLE AS clock, 0::DOUBLE AS free_at, []::DOUBLE[] AS busy, false AS admitted, NULL::DOUBLE AS done_at FROM o GROUP BY session_id
      UNION ALL ({step.replace("FROM found", f"FROM (SELECT o.session_id, o.seq, o.rn, o.value * 300 AS work, greatest(k.clock, o.at_s) AS clock, k.free_at, list_filter(k.busy, lambda x: x > greatest(k.clock, o.at_s)) AS busy FROM {name} k JOIN o ON o.session_id = k.session_id AND o.rn = k.rn + 1)")}))"""


@register(
    "lossy_queues",
    f"WITH RECURSIVE {_ROWS}, {', '.join(_queue_sql(n, c, p) for n, (c, p) in queues.QUEUES.items())} "
    + " UNION ALL ".join(f"SELECT '{n}' AS queue, session_id, seq, admitted, round(done_at, 3) AS done_at FROM {n} WHERE rn > 0" for n in queues.QUEUES),
)
def lossy_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = series(spark, sf_dir).select("session_id", "seq", "at", (F.col("value") * 300).alias("work"))
    parts = [queues.queued(offers, capacity, policy).withColumn("queue", F.lit(name)) for name, (capacity, policy) in queues.QUEUES.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.select("queue", "session_id", "seq", "admitted", F.round("done_at", 3).alias("done_at"))


@register(
    "endpoint_rules",
    f"""WITH RECURSIVE {_ROWS}, k AS (
      SELECT session_id, NULL::BIGINT AS seq, 0::BIGINT AS rn, 0::BIGINT AS segment_no, 0::BIGINT AS next_no, NULL::DOUBLE AS start, NULL::DOUBLE AS loud, false AS text, NULL::VARCHAR AS rule FROM o GROUP BY session_id
      UNION ALL SELECT session_id, seq, rn, segment_no, segment_no + (rule IS NOT NULL)::INT, CASE WHEN rule IS NULL THEN start ELSE at_s END, CASE WHEN rule IS NULL THEN loud ELSE at_s END, rule IS NULL AND text, rule
      FROM (SELECT *, CASE WHEN text AND at_s - loud >= 7200 THEN 'text' WHEN NOT text AND at_s - loud >= 21600 THEN 'blank' WHEN at_s - start >= 86400 THEN 'long' END AS rule
        FROM (SELECT o.session_id, o.seq, o.rn, o.at_s, k.next_no AS segment_no, coalesce(k.start, o.at_s) AS start, CASE WHEN o.event_type <> 'view' OR k.start IS NULL THEN o.at_s ELSE k.loud END AS loud,
          k.text OR o.event_type IN ('click', 'error') AS text FROM k JOIN o ON o.session_id = k.session_id AND o.rn = k.rn + 1))
    ) SELECT session_id, seq, segment_no, rule FROM k WHERE rn > 0""",
)
def endpoint_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    steps = series(spark, sf_dir).select("session_id", "at", "seq", (kind != "view").alias("voiced"), kind.isin("click", "error").alias("decoded"))
    return queues.endpoints(steps, 6 * HOUR, 2 * HOUR, 24 * HOUR)


@register(
    "display_dwell",
    f"""WITH RECURSIVE {_ROWS}, k AS (
      SELECT session_id, 0::BIGINT AS rn, '-infinity'::DOUBLE AS until, NULL::BIGINT AS waiting, []::STRUCT(seq BIGINT, shown_at DOUBLE)[] AS shown FROM o GROUP BY session_id
      UNION ALL SELECT session_id, rn, CASE WHEN at_s >= until THEN at_s + 7200 ELSE until END, CASE WHEN at_s >= until THEN NULL ELSE seq END,
        list_concat(late, CASE WHEN at_s >= until THEN [{{'seq': seq, 'shown_at': at_s}}] ELSE [] END)
      FROM (SELECT o.session_id, o.rn, o.seq, o.at_s, CASE WHEN k.waiting IS NOT NULL AND o.at_s >= k.until THEN k.until + 7200 ELSE k.until END AS until,
        CASE WHEN k.waiting IS NOT NULL AND o.at_s >= k.until THEN [{{'seq': k.waiting, 'shown_at': k.until}}] ELSE [] END AS late
        FROM k JOIN o ON o.session_id = k.session_id AND o.rn = k.rn + 1)
    ), e AS (SELECT session_id, unnest(shown) AS x FROM k UNION ALL
      SELECT session_id, {{'seq': arg_max(waiting, rn), 'shown_at': arg_max(until, rn)}} FROM (SELECT session_id, rn, coalesce(waiting, -1) AS waiting, until FROM k) GROUP BY session_id HAVING arg_max(waiting, rn) >= 0)
    SELECT session_id, x.seq AS seq, round(x.shown_at, 3) AS shown_at FROM e""",
)
def display_dwell(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = queues.dwelt(series(spark, sf_dir).select("session_id", "at", "seq"), 2 * HOUR)
    return shown.select("session_id", "seq", F.round("shown_at", 3).alias("shown_at"))


@register(
    "unpaused_audio",
    f"""WITH {_ROWS}, m AS (SELECT *, CASE event_type WHEN 'signup' THEN true WHEN 'purchase' THEN false END AS control FROM o),
    p AS (SELECT *, coalesce(last_value(control IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY rn), false) AS paused FROM m)
    SELECT session_id, seq, coalesce(sum(seq % 5 * 160) OVER (PARTITION BY session_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 16000.0::DOUBLE AS audio_s
    FROM p WHERE control IS NULL AND NOT paused""",
)
def unpaused_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = F.when(F.col("event_type") == "signup", True).when(F.col("event_type") == "purchase", False)
    rows = series(spark, sf_dir).withColumn("samples", F.col("seq") % 5 * 160)
    return queues.unpaused(rows, control).select("session_id", "seq", "audio_s")


@register(
    "retained_rows",
    f"WITH {_ROWS} SELECT session_id, seq, count(*) OVER (PARTITION BY session_id ORDER BY at_s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n_held FROM o",
)
def retained_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.retained(series(spark, sf_dir), 24 * HOUR).select("session_id", "seq", "n_held")


_W = sq.words("text")


@register(
    "token_times",
    f"""SELECT conv_id AS session_id, turn AS line_id, list_transform(list_filter(generate_series(1, len(w)), lambda i: i % 7 <> 0), lambda i: w[i]) AS tokens,
    list_transform(list_filter(generate_series(1, len(w)), lambda i: i % 7 <> 0), lambda i: round(least(greatest((i - 1) * 0.4::DOUBLE + 2.5::DOUBLE - 4.0::DOUBLE, 0), 20), 6)) AS starts
    FROM (SELECT *, {_W} AS w FROM conversations WHERE text IS NOT NULL)""",
)
def token_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.functions.text import words

    w = words(F.col("text"))
    marked = F.transform(w, lambda x, i: F.when((i + 1) % 7 == 0, F.lit("<|x|>")).otherwise(x))
    timed = tokens.with_times(marked, F.transform(w, lambda x, i: i * F.lit(0.4)), F.lit(2.5), F.lit(4.0), F.lit(20.0))
    found = turns(spark, sf_dir).select("session_id", "line_id", timed.alias("t"))
    return found.select("session_id", "line_id", F.transform("t", lambda x: x["token"]).alias("tokens"), F.transform("t", lambda x: F.round(x["start"], 6)).alias("starts"))


@register(
    "token_text",
    f"""SELECT conv_id AS session_id, turn AS line_id, trim(array_to_string(list_transform(generate_series(1, len(w)), lambda i: ' ' || CASE WHEN i % 5 = 0 THEN '□' ELSE replace(w[i], '▁', ' ') END), '')) AS spelled
    FROM (SELECT *, {_W} AS w FROM conversations WHERE text IS NOT NULL)""",
)
def token_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.functions.text import words

    spoken = F.transform(words(F.col("text")), lambda x, i: F.when((i + 1) % 5 == 0, F.lit(tokens.UNKNOWN)).otherwise(F.concat(F.lit("▁"), x)))
    framed = F.concat(F.array(F.lit("eng_Latn")), spoken, F.array(F.lit("</s>")))
    return turns(spark, sf_dir).select("session_id", "line_id", tokens.token_text(framed).alias("spelled"))


@register(
    "reference_places",
    f"""SELECT conv_id AS session_id, turn AS line_id, list_filter(generate_series(0, len(w) - 1), lambda i: i % 4 <> 3) AS places
    FROM (SELECT *, list_transform(generate_series(1, len({_W})), lambda i: i) AS w FROM conversations WHERE text IS NOT NULL)""",
)
def reference_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.functions.text import words
    from tideline.session import ship_package, small_batches

    ship_package(spark)
    small_batches(spark)
    numbered = F.transform(words(F.col("text")), lambda x, i: i.cast("string"))
    rows = turns(spark, sf_dir).select("session_id", "line_id", numbered.alias("r"), F.filter(numbered, lambda x: x.cast("int") % 4 != 3).alias("h"))
    return rows.select("session_id", "line_id", F.transform(tokens.reference_places(scoring.alignment("r", "h")), lambda x: x.cast("long")).alias("places"))


@register(
    "scattered_pieces",
    f"""SELECT conv_id AS session_id, turn AS line_id, list_transform(w, lambda x: CASE WHEN length(x) > 4 THEN reverse(x) ELSE x END) AS pieces
    FROM (SELECT *, {_W} AS w FROM conversations WHERE text IS NOT NULL)""",
)
def scattered_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.functions.text import words

    rows = turns(spark, sf_dir).select("session_id", "line_id", words(F.col("text")).alias("pieces"))
    return tokens.scatter_gather(rows, ["session_id", "line_id"], "pieces", lambda p: F.length(p) > 4, lambda asked: asked.withColumn("answer", F.reverse("piece")))


@register(
    "durations",
    """SELECT event_id AS seq, floor(floor(round(value * 1000, 6)) / 32)::BIGINT AS windows, least(greatest(ceil((value + 1) * 50), 512), 1500)::BIGINT AS context,
    regexp_replace(regexp_replace(event_type || '.part/x' || event_id || '.en.txt', '^.*/', ''), '[.][^.]*$', '') AS stem, '/home/u/' || event_type AS home FROM events""",
)
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat("event_type", F.lit(".part/x"), "seq", F.lit(".en.txt"))
    return series(spark, sf_dir).select(
        "seq",
        tokens.windows_in(F.col("value")).alias("windows"),
        tokens.context_size(F.col("value")).alias("context"),
        tokens.stem(path).alias("stem"),
        tokens.expand_home(F.concat(F.lit("~/"), "event_type"), "/home/u").alias("home"),
    )


_GATES = """WITH t AS (SELECT event_type AS label, list_sort(list(value / 100)) AS v FROM events GROUP BY event_type),
    l AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view', 'resume']) AS label)"""


@register(
    "gate_report",
    _GATES
    + """ SELECT label, coalesce(len(v), 0)::BIGINT AS n, v[round(0.5 * (len(v) - 1))::BIGINT + 1] AS p50, v[round(0.9 * (len(v) - 1))::BIGINT + 1] AS p90, v[len(v)] AS longest,
      coalesce(CASE WHEN v[round(0.5 * (len(v) - 1))::BIGINT + 1] <= 1.2 AND v[round(0.9 * (len(v) - 1))::BIGINT + 1] <= 2.0 THEN 'pass' WHEN len(v) > 0 THEN 'fail' END, 'n/a') AS g1,
      coalesce(CASE WHEN v[round(0.9 * (len(v) - 1))::BIGINT + 1] <= 4.0 THEN 'pass' WHEN len(v) > 0 THEN 'fail' END, 'n/a') AS g3
    FROM l LEFT JOIN t USING (label)""",
)
def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each label that a report has, also without readings, and the verdicts on it."""
    rows = series(spark, sf_dir).select(F.col("event_type").alias("label"), (F.col("value") / 100).alias("v"))
    ranks = stats.at_ranks(rows, ["label"], "v", {"p50": stats.near_rank(0.5), "p90": stats.near_rank(0.9)})
    labels = spark.createDataFrame([(x,) for x in ("click", "error", "purchase", "signup", "view", "resume")], "label string")
    return labels.join(ranks, "label", "left").select(
        "label",
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        "p50",
        "p90",
        "longest",
        stats.verdict((F.col("p50") <= 1.2) & (F.col("p90") <= 2.0)).alias("g1"),
        stats.verdict(F.col("p90") <= 4.0).alias("g3"),
    )


@register(
    "silence_sweep",
    f"""WITH {_ROWS}, q AS (SELECT *, value < 20 AS quiet FROM o), c AS (SELECT *, sum(CASE WHEN quiet THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY rn) AS run FROM q),
    r AS (SELECT session_id, run, min(at_s) AS start, max(at_s) - min(at_s) AS length, min(rn) AS open_words FROM c WHERE quiet GROUP BY session_id, run),
    t AS (SELECT unnest([0.0, 3600.0, 14400.0])::DOUBLE AS threshold),
    v AS (SELECT threshold, list_sort(list(open_words)) AS w, list_sort(list(length - threshold)) AS s FROM t JOIN r ON length >= threshold GROUP BY threshold)
    SELECT threshold, len(w)::BIGINT AS n, w[round(0.5 * (len(w) - 1))::BIGINT + 1] AS words_p50, round(s[round(0.5 * (len(s) - 1))::BIGINT + 1], 3) AS saved_p50,
      round(s[round(0.9 * (len(s) - 1))::BIGINT + 1], 3) AS saved_p90, round(s[len(s)], 3) AS saved_max FROM v""",
)
def silence_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of quiet rows, with the words that are open then, and what each threshold would save of the wait."""
    order = Window.partitionBy("session_id").orderBy("at", "seq")
    rows = series(spark, sf_dir).select("session_id", "at", "seq", (F.col("value") < 20).alias("quiet"), F.row_number().over(order).cast("long").alias("place"))
    marked = rows.withColumn("run", F.sum((~F.col("quiet")).cast("int")).over(order)).where("quiet")
    runs = marked.groupBy("session_id", "run").agg((F.max("at") - F.min("at")).alias("length"), F.min("place").alias("open_words"))
    met = F.explode(F.filter(F.array(*(F.lit(x) for x in (0.0, 3600.0, 14400.0))), lambda t: t <= F.col("length")))
    under = runs.select("length", "open_words", met.alias("threshold")).withColumn("saved", F.col("length") - F.col("threshold"))
    words = stats.at_ranks(under, ["threshold"], "open_words", {"words_p50": stats.near_rank(0.5)}).select("threshold", "n", "words_p50")
    saved = stats.at_ranks(under, ["threshold"], "saved", {"saved_p50": stats.near_rank(0.5), "saved_p90": stats.near_rank(0.9)})
    return words.join(saved.drop("n").withColumnRenamed("longest", "saved_max"), "threshold").select(
        "threshold", "n", "words_p50", *(F.round(c, 3).alias(c) for c in ("saved_p50", "saved_p90", "saved_max"))
    )


@register(
    "model_totals",
    """WITH w AS (SELECT p_brand AS model, p_partkey AS place, (p_size * 1000)::BIGINT AS size, p_partkey % 3 > 0 AS there FROM part)
    SELECT model, min(place) AS first_place, count(*) AS n_files, sum(size)::BIGINT AS bytes, coalesce(sum(size) FILTER (WHERE NOT there), 0)::BIGINT AS missing_bytes FROM w GROUP BY model""",
)
def model_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each model of a manifest takes, in the order of first sight, and what of it isn't there in the very size."""
    from tideline.operators import joins
    from tideline.session import table

    wanted = table(spark, sf_dir, "part").select(F.col("p_brand").alias("model"), F.col("p_partkey").alias("place"), F.col("p_partkey").cast("string").alias("path"), (F.col("p_size") * 1000).cast("long").alias("size"))
    present = wanted.where("place % 3 > 0").select("path", "size")
    missing = joins.missing(wanted, present).groupBy("model").agg(F.sum("size").alias("missing_bytes"))
    totals = wanted.groupBy("model").agg(F.min("place").alias("first_place"), F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes"))
    return totals.join(missing, "model", "left").withColumn("missing_bytes", F.coalesce("missing_bytes", F.lit(0)))
