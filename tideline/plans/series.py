"""Queries over events: a user's events are a session's scored series."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions import stats
from tideline.operators import gate, joins, segment, waiting
from tideline.plans.registry import register
from tideline.session import table

HOUR = 3600.0


def listed(name: str, sql: str | None = None):  # noqa: ANN201
    """``register``, with the column name ``at``, a word of DuckDB's, in quotes."""
    return register(name, re.sub(r"\bat\b", '"at"', sql) if sql else None)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000.0
    return events.select(F.col("user_id").alias("session_id"), at.alias("at"), F.col("event_id").alias("seq"), F.least(F.col("value") / 200, F.lit(1.0)).alias("p"), "event_type", "value")


_SERIES = """s AS (SELECT user_id AS session_id, epoch_us(ts) / 1000000.0 AS at, event_id AS seq, least(value / 200, 1.0) AS p, event_type, value FROM events),
o AS (SELECT *, lag(at) OVER (PARTITION BY session_id ORDER BY at, seq) AS before, row_number() OVER (PARTITION BY session_id ORDER BY at, seq) AS rn FROM s),
g0 AS (SELECT *, at - coalesce(last_value(CASE WHEN p >= 0.35 THEN at END IGNORE NULLS) OVER w, min(at) OVER w) AS silence FROM o
  WINDOW w AS (PARTITION BY session_id ORDER BY at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def _gate(min_silence: float) -> str:
    return f"""WITH {_SERIES}, g AS (SELECT *, coalesce(last_value(CASE WHEN p >= 0.5 THEN true WHEN silence >= {min_silence} THEN false END IGNORE NULLS) OVER (
      PARTITION BY session_id ORDER BY at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS speaking FROM g0),
    e AS (SELECT *, coalesce(lag(speaking) OVER (PARTITION BY session_id ORDER BY at, seq), false) AS earlier FROM g)
    """


@listed("gate_events", _gate(HOUR) + "SELECT session_id, at, seq, CASE WHEN speaking THEN 'start' ELSE 'end' END AS event FROM e WHERE speaking <> earlier")
def gate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.gate_events(series(spark, sf_dir), min_silence=HOUR)


@listed(
    "silence_runs",
    f"""WITH {_SERIES}, q AS (SELECT *, silence >= 7200 AS quiet FROM g0),
    r AS (SELECT *, CASE WHEN quiet AND NOT coalesce(lag(quiet) OVER (PARTITION BY session_id ORDER BY at, seq), false) THEN 1 ELSE 0 END AS opens FROM q),
    n AS (SELECT *, sum(opens) OVER (PARTITION BY session_id ORDER BY at, seq) AS run FROM r)
    SELECT session_id, min(at) AS start_at, max(silence) AS longest, count(*) AS n FROM n WHERE quiet GROUP BY session_id, run""",
)
def silence_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.silence_runs(series(spark, sf_dir), 2 * HOUR)


@listed("gap_fill", f"WITH {_SERIES} SELECT session_id, seq, CASE WHEN at - before >= 3600 THEN least(at - before, 14400) ELSE 0 END::DOUBLE AS filled FROM o")
def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.missing_silence(series(spark, sf_dir), idle=HOUR, most=4 * HOUR).select("session_id", "seq", "filled")


@listed(
    "session_segments",
    f"""WITH {_SERIES}, r AS (SELECT *, sum(CASE WHEN before IS NULL OR at - before >= 7200 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY at, seq) AS run FROM o)
    SELECT session_id, min(at) AS start_at, max(at) AS end_at, count(*) AS n FROM r GROUP BY session_id, run""",
)
def session_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.sessions(series(spark, sf_dir), 2 * HOUR)


_PIECE = "STRUCT(f BIGINT, e BIGINT, b BOOLEAN, a BOOLEAN)"
_CLOSED = """CASE WHEN start <= voiced THEN list_append(pieces, {'f': start, 'e': voiced + 1, 'b': forced, 'a': false})
      WHEN forced AND len(pieces) > 0 THEN list_append(list_slice(pieces, 1, len(pieces) - 1), {'f': pieces[-1].f, 'e': pieces[-1].e, 'b': pieces[-1].b, 'a': false}) ELSE pieces END"""


@register(
    "capped_segments",
    f"""WITH RECURSIVE o AS (SELECT user_id AS session_id, least(value / 200, 1.0) AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    k AS (
      SELECT session_id, 0::BIGINT AS rn, NULL::BIGINT AS start, false AS forced, 0::BIGINT AS voiced, 0::BIGINT AS silent, []::DOUBLE[] AS recent, []::{_PIECE}[] AS pieces FROM o GROUP BY session_id
      UNION ALL
      SELECT session_id, rn, CASE WHEN start IS NULL THEN CASE WHEN p >= {segment.OPEN_AT} THEN rn - 1 END WHEN silent >= 6 THEN NULL WHEN rn - start >= 40 THEN cut ELSE start END,
        CASE WHEN start IS NULL THEN CASE WHEN p >= {segment.OPEN_AT} THEN false ELSE forced END WHEN silent < 6 AND rn - start >= 40 THEN true ELSE forced END, voiced, silent, recent,
        CASE WHEN start IS NULL THEN pieces WHEN silent >= 6 THEN {_CLOSED}
          WHEN rn - start >= 40 THEN list_append(pieces, {{'f': start, 'e': cut, 'b': forced, 'a': true}}) ELSE pieces END
      FROM (SELECT *, rn - len(recent) + list_position(recent, list_min(recent)) - 1 AS cut FROM (
        SELECT o.session_id, o.rn, o.p, k.start, k.forced, CASE WHEN o.p >= {segment.SILENT_BELOW} THEN o.rn - 1 ELSE k.voiced END AS voiced, CASE WHEN o.p >= {segment.SILENT_BELOW} THEN 0 ELSE k.silent + 1 END AS silent,
          list_append(list_slice(k.recent, greatest(len(k.recent) - 8, 1), len(k.recent)), o.p::DOUBLE) AS recent, k.pieces
        FROM k JOIN o ON o.session_id = k.session_id AND o.rn = k.rn + 1))
    ), z AS (SELECT session_id, rn AS n, CASE WHEN start IS NULL THEN pieces ELSE {_CLOSED} END AS pieces FROM k QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY rn DESC) = 1)
    SELECT session_id, (i - 1)::BIGINT AS piece_no, greatest(0, pieces[i].f - CASE WHEN pieces[i].b THEN 0 ELSE {segment.PAD} END)::BIGINT AS first,
      least(n, pieces[i].e + CASE WHEN pieces[i].a THEN 0 ELSE {segment.PAD} END)::BIGINT AS last_end
    FROM z, unnest(generate_series(1, len(pieces))) AS t(i)""",
)
def capped_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.capped_pieces(series(spark, sf_dir), pause=segment.WINDOW_S * 6, longest=segment.WINDOW_S * 40, look_back=segment.WINDOW_S * 10)


@listed(
    "changed_types",
    f"""WITH {_SERIES}, c AS (SELECT *, lag(event_type) OVER (PARTITION BY session_id ORDER BY at, seq) AS earlier FROM o)
    SELECT session_id, seq, event_type FROM c WHERE rn = 1 OR event_type IS DISTINCT FROM earlier""",
)
def changed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.changed_only(series(spark, sf_dir), "event_type").select("session_id", "seq", "event_type")


@listed(
    "quiescent_types",
    f"""WITH {_SERIES}, c AS (SELECT *, lag(event_type) OVER (PARTITION BY session_id ORDER BY at, seq) AS earlier FROM o),
    d AS (SELECT *, lead(at) OVER (PARTITION BY session_id ORDER BY at, seq) AS after FROM c WHERE rn = 1 OR event_type IS DISTINCT FROM earlier)
    SELECT session_id, seq, event_type FROM d WHERE after IS NULL OR after - at >= 7200""",
)
def quiescent_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.settled_after(series(spark, sf_dir), "event_type", 2 * HOUR).select("session_id", "seq", "event_type")


@listed(
    "next_endpoint_asof",
    f"""WITH {_SERIES} SELECT r.session_id, r.seq, (SELECT min(e.at) FROM s e WHERE e.session_id = r.session_id AND e.event_type = 'purchase' AND e.at >= r.at) AS endpoint_at
    FROM s r WHERE r.event_type = 'error'""",
)
def next_endpoint_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir)
    errors = rows.where("event_type = 'error'").select("session_id", "at", "seq")
    return joins.next_at(errors, rows.where("event_type = 'purchase'"), "endpoint_at").select("session_id", "seq", "endpoint_at")


@listed(
    "wall_clock_asof",
    f"""WITH {_SERIES}, a AS (SELECT session_id, at, max(at + value) AS wall FROM s WHERE event_type = 'view' GROUP BY ALL), f AS (SELECT session_id, arg_min(at, at) AS at, arg_min(wall, at) AS wall FROM a GROUP BY session_id),
    j AS (SELECT r.session_id, r.seq, r.at, a.at AS a_at, a.wall AS a_wall FROM s r ASOF LEFT JOIN a ON r.session_id = a.session_id AND r.at >= a.at WHERE r.event_type = 'click')
    SELECT j.session_id, j.seq, coalesce(j.a_wall, f.wall) + (j.at - coalesce(j.a_at, f.at)) AS wall FROM j LEFT JOIN f USING (session_id)""",
)
def wall_clock_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir)
    anchors = rows.where("event_type = 'view'").groupBy("session_id", "at").agg(F.max(F.col("at") + F.col("value")).alias("wall"))
    return joins.wall_clock(rows.where("event_type = 'click'").select("session_id", "at", "seq"), anchors).select("session_id", "seq", "wall")


@listed(
    "timeout_promotion",
    f"""WITH {_SERIES} SELECT session_id, seq, coalesce(at >= before + 8, false) AS promoted FROM o""",
)
def timeout_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.operators.merge import timed_out

    rows = series(spark, sf_dir)
    deadline = F.lag("at").over(Window.partitionBy("session_id").orderBy("at", "seq"))
    return rows.withColumn("deadline", deadline).select("session_id", "seq", timed_out(F.col("at"), F.col("deadline")).alias("promoted"))


@listed(
    "rolling_load",
    """SELECT user_id AS session_id, event_id AS seq, sum(value) OVER w / sum(value + 1) OVER w AS load FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 31 PRECEDING AND CURRENT ROW)""",
)
def rolling_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = Window.partitionBy("session_id").orderBy("at", "seq").rowsBetween(-31, 0)
    return series(spark, sf_dir).select("session_id", "seq", (F.sum("value").over(last) / F.sum(F.col("value") + 1).over(last)).alias("load"))


def _rank(q: float) -> str:
    return f"v[round({q} * (len(v) - 1))::BIGINT + 1]"


@listed(
    "latency_table",
    f"""WITH t AS (SELECT event_type AS label, list_sort(list(value)) AS v FROM events GROUP BY event_type)
    SELECT label, len(v)::BIGINT AS n, {_rank(0.5)} AS p50, {_rank(0.9)} AS p90, v[len(v)] AS longest, v[least(floor(len(v) * 0.9)::BIGINT, len(v) - 1) + 1] AS p90_floor, v[len(v) // 2 + 1] AS median_upper FROM t""",
)
def latency_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir).select(F.col("event_type").alias("label"), "value")
    picks = {"p50": stats.near_rank(0.5), "p90": stats.near_rank(0.9), "p90_floor": stats.low_rank(0.9), "median_upper": lambda n: F.floor(n / 2).cast("long")}
    return stats.at_ranks(rows, ["label"], "value", picks)


@listed(
    "gate_verdicts",
    f"""WITH t AS (SELECT user_id AS session_id, list_sort(list(value / 100)) AS v FROM events GROUP BY user_id)
    SELECT session_id, {_rank(0.5)} <= 1.2 AND {_rank(0.9)} <= 2.0 AS passed FROM t""",
)
def gate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir).select("session_id", (F.col("value") / 100).alias("v"))
    found = stats.at_ranks(rows, ["session_id"], "v", {"median": stats.near_rank(0.5), "p90": stats.near_rank(0.9)})
    return found.select("session_id", ((F.col("median") <= 1.2) & (F.col("p90") <= 2.0)).alias("passed"))


@listed(
    "threshold_sweep",
    f"""WITH {_SERIES}, g AS (SELECT at - before AS gap FROM o WHERE before IS NOT NULL), t AS (SELECT unnest([600.0, 1800.0, 3600.0, 7200.0]) AS threshold),
    v AS (SELECT threshold, list_sort(list(gap)) AS v FROM t JOIN g ON gap >= threshold GROUP BY threshold)
    SELECT threshold::DOUBLE AS threshold, len(v)::BIGINT AS n, {_rank(0.5)} AS p50, {_rank(0.9)} AS p90, v[len(v)] AS longest FROM v""",
)
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.col("at") - F.lag("at").over(Window.partitionBy("session_id").orderBy("at", "seq"))
    gaps = series(spark, sf_dir).select(gap.alias("gap")).where("gap is not null")
    # each gap is put under the thresholds that it reaches: four literals, no join
    reached = F.explode(F.filter(F.array(*(F.lit(x) for x in (600.0, 1800.0, 3600.0, 7200.0))), lambda t: t <= F.col("gap")))
    return stats.at_ranks(gaps.select("gap", reached.alias("threshold")), ["threshold"], "gap", {"p50": stats.near_rank(0.5), "p90": stats.near_rank(0.9)})


@listed(
    "top3_gaps",
    f"""WITH {_SERIES} SELECT session_id, seq, at - before AS gap FROM o WHERE before IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY at - before DESC, seq) <= 3""",
)
def top3_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.col("at") - F.lag("at").over(Window.partitionBy("session_id").orderBy("at", "seq"))
    gaps = series(spark, sf_dir).select("session_id", "seq", gap.alias("gap")).where("gap is not null")
    widest = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("gap"), "seq"))
    return gaps.withColumn("place", widest).where("place <= 3").drop("place")


@listed(
    "onset_gap_stats",
    f"""WITH {_SERIES}, t AS (SELECT session_id, list_sort(list(at - before)) AS v FROM o WHERE before IS NOT NULL GROUP BY session_id)
    SELECT session_id, {_rank(0.5)} AS p50, {_rank(0.9)} AS p90, {_rank(0.99)} AS p99, v[len(v)] AS longest, len(list_filter(v, lambda x: x >= 3600))::BIGINT AS n_long,
    100.0 * len(list_filter(v, lambda x: x >= 3600)) / greatest(len(v), 1) AS pct_long FROM t""",
)
def onset_gap_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.col("at") - F.lag("at").over(Window.partitionBy("session_id").orderBy("at", "seq"))
    gaps = series(spark, sf_dir).select("session_id", gap.alias("gap")).where("gap is not null")
    ranks = stats.at_ranks(gaps, ["session_id"], "gap", {f"p{q}": stats.near_rank(q / 100) for q in (50, 90, 99)})
    long = gaps.groupBy("session_id").agg(F.count(F.when(F.col("gap") >= HOUR, 1)).alias("n_long"))
    pct = (100.0 * F.col("n_long") / F.greatest("n", F.lit(1))).alias("pct_long")
    return ranks.join(long, "session_id").select("session_id", "p50", "p90", "p99", "longest", "n_long", pct)


@listed(
    "ema_level",
    """WITH RECURSIVE o AS (SELECT user_id AS session_id, event_id AS seq, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    e AS (SELECT session_id, seq, rn, CASE WHEN x < 5 THEN NULL ELSE x END AS level FROM o WHERE rn = 1
      UNION ALL SELECT o.session_id, o.seq, o.rn, CASE WHEN o.x < 5 THEN e.level WHEN e.level IS NULL THEN o.x ELSE e.level * 0.95::DOUBLE + o.x * (1 - 0.95::DOUBLE) END
      FROM e JOIN o ON o.session_id = e.session_id AND o.rn = e.rn + 1)
    SELECT session_id, seq, level FROM e""",
)
def ema_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.fold_levels(series(spark, sf_dir), keep=0.95, floor=5.0)


@listed(
    "superseded",
    """WITH q AS (SELECT user_id AS session_id, event_id AS job_id, event_id // 3 AS line_id, CASE event_type WHEN 'purchase' THEN 2 WHEN 'view' THEN 1 ELSE 0 END AS rank FROM events),
    b AS (SELECT *, max(line_id * 3 + rank) OVER (PARTITION BY session_id) AS best FROM q),
    l AS (SELECT *, max(CASE WHEN line_id * 3 + rank = best THEN job_id END) OVER (PARTITION BY session_id) AS newest FROM b)
    SELECT session_id, job_id, line_id, rank FROM l WHERE rank = 2 OR (line_id * 3 + rank = best AND job_id = newest)""",
)
def superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "view", 1).otherwise(0)
    queue = series(spark, sf_dir).select("session_id", F.col("seq").alias("job_id"), F.expr("seq div 3").alias("line_id"), rank.alias("rank"))
    return waiting.prune_superseded(queue)


@listed(
    "monotone_display",
    """WITH o AS (SELECT user_id AS session_id, event_id AS seq, (event_id * 7) % 11 AS line_id FROM events)
    SELECT session_id, seq, line_id FROM (SELECT *, max(line_id) OVER (PARTITION BY session_id ORDER BY seq) AS top FROM o) WHERE line_id >= top""",
)
def monotone_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = series(spark, sf_dir).select("session_id", "seq", ((F.col("seq") * 7) % 11).alias("line_id"))
    past = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return shown.withColumn("top", F.max("line_id").over(past)).where("line_id >= top").drop("top")


@listed(
    "keep_last_two",
    """WITH RECURSIVE o AS (SELECT user_id AS session_id, (event_id * 7) % 11 AS line_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
    k AS (SELECT session_id, 0 AS rn, []::BIGINT[] AS shown FROM o GROUP BY session_id
      UNION ALL SELECT o.session_id, o.rn, CASE WHEN list_contains(k.shown, o.line_id) OR (len(k.shown) > 0 AND o.line_id < k.shown[len(k.shown)]) THEN k.shown
        ELSE list_slice(list_append(k.shown, o.line_id), greatest(len(k.shown), 1), len(k.shown) + 1) END
      FROM k JOIN o ON o.session_id = k.session_id AND o.rn = k.rn + 1)
    SELECT session_id, arg_max(shown, rn) AS shown FROM k GROUP BY session_id""",
)
def keep_last_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = series(spark, sf_dir).select("session_id", "seq", ((F.col("seq") * 7) % 11).alias("line_id"))
    return segment.keep_newest(shown, 2)


@listed(
    "admission",
    """WITH RECURSIVE o AS (SELECT user_id AS session_id, event_id AS seq, epoch_us(ts) / 1e6 AS at_s, epoch_us(ts) / 1e6 + value * 100 AS done_at, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    k AS (SELECT session_id, NULL::BIGINT AS seq, 0 AS rn, []::DOUBLE[] AS busy, false AS admitted FROM o GROUP BY session_id
      UNION ALL SELECT session_id, seq, rn, CASE WHEN len(free) < 2 THEN list_append(free, done_at) ELSE free END, len(free) < 2
      FROM (SELECT o.session_id, o.seq, o.rn, o.done_at, list_filter(k.busy, lambda x: x > o.at_s) AS free FROM k JOIN o ON o.session_id = k.session_id AND o.rn = k.rn + 1))
    SELECT session_id, seq, admitted FROM k WHERE rn > 0""",
)
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = series(spark, sf_dir).select("session_id", "seq", "at", (F.col("at") + F.col("value") * 100).alias("done_at"))
    return segment.admit(offers, 2)
