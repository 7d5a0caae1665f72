"""Queries over quotes: projections, lag and rolling features, segmentation, scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quotes as q
from ..operators import features as f
from ..queries import register
from ..sources.views import QUOTES_SQL, quotes, table

HORIZON, GAP_NS, POINTS = 20, 2 * 3600 * 10**9, 50
#: Coefficients of the scoring queries: any fixed numbers will do.
WEIGHTS = {"imbalance": 0.8, "microprice_edge_bps": 0.05, "mid_return_1": -0.01, "spread_bps": 0.002}
THRESHOLD = 0.5

BASE_SQL = f"""SELECT *, (best_bid + best_ask) / 2 AS mid, (best_ask - best_bid) / ((best_bid + best_ask) / 2) * CAST(1e4 AS DOUBLE) AS spread_bps,
  CASE WHEN bid_qty + ask_qty > 0 THEN (bid_qty - ask_qty) / (bid_qty + ask_qty) ELSE CAST(0 AS DOUBLE) END AS imbalance,
  (CASE WHEN bid_qty + ask_qty > 0 THEN (best_ask * bid_qty + best_bid * ask_qty) / (bid_qty + ask_qty) ELSE (best_bid + best_ask) / 2 END - (best_bid + best_ask) / 2) / ((best_bid + best_ask) / 2) * CAST(1e4 AS DOUBLE) AS microprice_edge_bps,
  ln((bid_qty + CAST(1e-12 AS DOUBLE)) / (ask_qty + CAST(1e-12 AS DOUBLE))) AS log_quantity_ratio, bid_qty + ask_qty AS total_qty
  FROM ({QUOTES_SQL}) WHERE ts_ns > 0 AND isfinite(best_bid) AND isfinite(best_ask) AND best_bid > 0 AND best_ask > 0 AND best_bid <= best_ask"""

_RETURNS = ", ".join(f"ln(mid / lag(mid, {k}) OVER w) * CAST(1e4 AS DOUBLE) AS mid_return_{k}" for k in f.RETURN_LAGS)
LAGGED_SQL = f"""SELECT *, CASE WHEN count(mid_return_1) OVER v = 20 THEN sqrt(greatest(avg(mid_return_1 * mid_return_1) OVER v - (avg(mid_return_1) OVER v) * (avg(mid_return_1) OVER v), 0)) END AS realized_volatility_20
  FROM (SELECT *, {_RETURNS}, imbalance - lag(imbalance, 1) OVER w AS imbalance_change_1, imbalance - lag(imbalance, 5) OVER w AS imbalance_change_5, spread_bps - lag(spread_bps, 1) OVER w AS spread_change_1,
    ln(1 + greatest(CAST(ts_ns - lag(ts_ns, 1) OVER w AS DOUBLE), 0) / CAST(1e3 AS DOUBLE)) AS log_interarrival_us,
    CASE WHEN lag(ts_ns, 10) OVER w IS NULL THEN NULL WHEN ts_ns - lag(ts_ns, 10) OVER w > 0 THEN 10 / ((ts_ns - lag(ts_ns, 10) OVER w) / CAST(1e9 AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END AS event_rate_10,
    ln((total_qty + CAST(1e-12 AS DOUBLE)) / (lag(total_qty, 1) OVER w + CAST(1e-12 AS DOUBLE))) AS log_total_quantity_change_1, row_number() OVER w - 1 AS ix
    FROM ({BASE_SQL}) WINDOW w AS (PARTITION BY session_id ORDER BY event_ix)) WINDOW v AS (PARTITION BY session_id ORDER BY event_ix ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""

LABELLED_SQL = f"""SELECT *, ln(future_mid / mid) * CAST(1e4 AS DOUBLE) AS target FROM (SELECT *, lead(best_bid, {HORIZON}) OVER w AS future_best_bid, lead(best_ask, {HORIZON}) OVER w AS future_best_ask,
  lead(bid_qty, {HORIZON}) OVER w AS future_bid_qty, lead(ask_qty, {HORIZON}) OVER w AS future_ask_qty, lead(mid, {HORIZON}) OVER w AS future_mid, count(*) OVER (PARTITION BY session_id) AS session_rows
  FROM ({LAGGED_SQL}) WINDOW w AS (PARTITION BY session_id ORDER BY event_ix))"""
FEATURES_SQL = f"SELECT * FROM ({LABELLED_SQL}) WHERE ix >= 25 AND target IS NOT NULL AND session_rows >= {25 + HORIZON + 2}"

KEYS = ("session_id", "event_ix")
_keys = ", ".join(KEYS)


def _simple(name: str, columns: str, source, sql: str) -> None:
    names = columns.split()
    register(name, f"SELECT {_keys}, {', '.join(names)} FROM ({sql})", columns)(lambda spark, sf_dir: source(spark, sf_dir).select(*KEYS, *names))


def base(spark, sf_dir):
    return f.quote_columns(quotes(spark, sf_dir))


def lagged(spark, sf_dir):
    return f.lagged(quotes(spark, sf_dir))


def features(spark, sf_dir):
    return f.tob_features(quotes(spark, sf_dir), HORIZON)


_simple("tob_mid_spread", "mid spread_bps", base, BASE_SQL)
_simple("tob_imbalance", "imbalance", base, BASE_SQL)
_simple("tob_microprice_edge", "microprice_edge_bps", base, BASE_SQL)
_simple("tob_log_qty_ratio", "log_quantity_ratio total_qty", base, BASE_SQL)
_simple("tob_log_returns", " ".join(f"mid_return_{k}" for k in f.RETURN_LAGS), lagged, LAGGED_SQL)
_simple("tob_diffs", "imbalance_change_1 imbalance_change_5 spread_change_1", lagged, LAGGED_SQL)
_simple("tob_interarrival", "log_interarrival_us", lagged, LAGGED_SQL)
_simple("tob_event_rate", "event_rate_10", lagged, LAGGED_SQL)
_simple("tob_rolling_vol", "realized_volatility_20", lagged, LAGGED_SQL)
_simple("tob_qty_change", "log_total_quantity_change_1", lagged, LAGGED_SQL)
_simple("tob_forward_label", "mid future_mid future_best_bid future_best_ask future_bid_qty future_ask_qty target", features, FEATURES_SQL)
_simple("tob_features_16", " ".join((*f.FEATURES, "target")), features, FEATURES_SQL)
_simple("tob_features_in_blocks", " ".join((*f.FEATURES, "target")), lambda s, d: f.tob_features_in_blocks(quotes(s, d), HORIZON), FEATURES_SQL)


@register("tob_valid_quotes", f"SELECT session_id, count(*) AS n, CAST(count(*) FILTER (WHERE ts_ns > 0 AND best_bid > 0 AND best_ask > 0 AND best_bid <= best_ask) AS BIGINT) AS valid FROM ({QUOTES_SQL}) GROUP BY session_id")
def valid_quotes(spark, sf_dir):
    return quotes(spark, sf_dir).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(q.valid_quote()).alias("valid"))


_PICK = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_ix) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS total FROM ({BASE_SQL}))
  WHERE total <= {POINTS} OR i IN (SELECT CAST(floor(j * (total - 1) / {POINTS - 1}) AS BIGINT) FROM range({POINTS}) r(j))"""
_simple("tob_chart_series", "mid spread_bps imbalance", lambda s, d: f.downsample(base(s, d), POINTS), _PICK)
_simple("downsample_even", "best_bid best_ask", lambda s, d: f.downsample(base(s, d), POINTS), _PICK)

SEGMENTS_SQL = f"""SELECT *, CAST(sum(fresh) OVER (PARTITION BY session_id ORDER BY event_ix ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM (
  SELECT *, CASE WHEN ts_ns - lag(ts_ns) OVER (PARTITION BY session_id ORDER BY event_ix) > {GAP_NS} THEN 1 ELSE 0 END AS fresh FROM ({QUOTES_SQL}))"""


@register("segments_by_gap", f"SELECT session_id, event_ix, segment FROM ({SEGMENTS_SQL})")
def segments_by_gap(spark, sf_dir):
    return f.segments(quotes(spark, sf_dir), GAP_NS).select(*KEYS, "segment")


@register("segment_summary", f"SELECT session_id, segment, min(event_ix) AS first_ix, max(event_ix) AS last_ix, max(ts_ns) - min(ts_ns) AS span_ns, count(*) AS n FROM ({SEGMENTS_SQL}) GROUP BY session_id, segment")
def segment_summary(spark, sf_dir):
    return f.segment_summary(f.segments(quotes(spark, sf_dir), GAP_NS))


_CUTS = "event_type = 'error' AND event_id % 7 = 0"


@register(
    "segments_with_boundaries",
    f"""SELECT session_id, event_ix, CAST(sum(fresh) OVER (PARTITION BY session_id ORDER BY event_ix ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM (
      SELECT session_id, event_ix, CASE WHEN ts_ns - lag(ts_ns) OVER w > {GAP_NS} OR (row_number() OVER w > 1 AND event_ix IN (SELECT event_id FROM events WHERE {_CUTS})) THEN 1 ELSE 0 END AS fresh
      FROM ({QUOTES_SQL}) WINDOW w AS (PARTITION BY session_id ORDER BY event_ix))""",
)
def segments_with_boundaries(spark, sf_dir):
    cuts = table(spark, sf_dir, "events").where(_CUTS).select((F.col("user_id") % 5).cast("int").alias("session_id"), F.col("event_id").alias("event_ix"))
    return f.segments(quotes(spark, sf_dir), GAP_NS, cuts).select(*KEYS, "segment")


@register("session_windows", f"""SELECT session_id, min(ts_ns) AS start_ns, max(ts_ns) AS last_ns, count(*) AS n FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts_ns, event_ix ROWS UNBOUNDED PRECEDING) AS part FROM (
    SELECT *, CASE WHEN ts_ns - lag(ts_ns) OVER (PARTITION BY session_id ORDER BY ts_ns, event_ix) >= {GAP_NS} THEN 1 ELSE 0 END AS fresh FROM ({QUOTES_SQL}))) GROUP BY session_id, part""")
def session_windows(spark, sf_dir):
    """Gap windows by event time, as the streaming form has them."""
    rows = quotes(spark, sf_dir).withColumn("at", F.timestamp_micros(F.expr("ts_ns div 1000")))
    return rows.groupBy("session_id", F.session_window("at", f"{GAP_NS // 10**9} seconds")).agg(F.min("ts_ns").alias("start_ns"), F.max("ts_ns").alias("last_ns"), F.count(F.lit(1)).alias("n")).drop("session_window")


@register("rate_by_window", f"SELECT session_id, ts_ns // 3600000000000 AS hour, count(*) AS n FROM ({QUOTES_SQL}) GROUP BY ALL")
def rate_by_window(spark, sf_dir):
    """Events in tumbling windows of an hour."""
    rows = quotes(spark, sf_dir).withColumn("at", F.timestamp_micros(F.expr("ts_ns div 1000")))
    return rows.groupBy("session_id", F.window("at", "1 hour")).agg(F.count(F.lit(1)).alias("n")).select("session_id", (F.unix_seconds("window.start") / 3600).cast("long").alias("hour"), "n")


@register("session_ranges", f"SELECT session_id, CAST(sum(n) OVER (ORDER BY session_id ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS start, CAST(sum(n) OVER (ORDER BY session_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM (SELECT session_id, count(*) AS n FROM ({QUOTES_SQL}) GROUP BY session_id)")
def session_ranges(spark, sf_dir):
    return f.session_ranges(quotes(spark, sf_dir))


@register(
    "quality_violations",
    f"""SELECT session_id, count(*) FILTER (WHERE ts_ns <= 0) AS bad_time, count(*) FILTER (WHERE best_bid <= 0 OR best_ask <= 0) AS bad_price, count(*) FILTER (WHERE best_bid > best_ask) AS crossed,
      count(*) FILTER (WHERE back) AS backward, min(event_ix) FILTER (WHERE back OR ts_ns <= 0 OR best_bid <= 0 OR best_ask <= 0 OR best_bid > best_ask) AS first_bad_ix
      FROM (SELECT *, coalesce(ts_ns < lag(ts_ns) OVER (PARTITION BY session_id ORDER BY event_ix), false) AS back FROM (SELECT * REPLACE (CASE WHEN event_ix % 97 = 0 THEN ts_ns - 7200000000000 ELSE ts_ns END AS ts_ns, CASE WHEN event_ix % 89 = 0 THEN best_bid + 1 ELSE best_bid END AS best_bid) FROM ({QUOTES_SQL}))) GROUP BY session_id""",
)
def quality_violations(spark, sf_dir):
    """Rule breaks in quotes of which some are spoiled on purpose."""
    bad = quotes(spark, sf_dir).withColumns({"ts_ns": F.when(F.col("event_ix") % 97 == 0, F.col("ts_ns") - 2 * 3600 * 10**9).otherwise(F.col("ts_ns")), "best_bid": F.when(F.col("event_ix") % 89 == 0, F.col("best_bid") + 1).otherwise(F.col("best_bid"))})
    return f.violations(bad)


@register(
    "recording_summary",
    f"""SELECT session_id, count(*) AS n, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns, arg_min(best_bid, event_ix) AS first_bid, arg_max(best_ask, event_ix) AS last_ask, min(best_bid) AS low, max(best_ask) AS high,
      (max(ts_ns) - min(ts_ns)) / CAST(1e9 AS DOUBLE) AS seconds, CASE WHEN max(ts_ns) > min(ts_ns) THEN count(*) / ((max(ts_ns) - min(ts_ns)) / CAST(1e9 AS DOUBLE)) END AS rate FROM ({QUOTES_SQL}) GROUP BY session_id""",
    "first_bid last_ask low high seconds rate",
)
def recording_summary(spark, sf_dir):
    return f.recording_summary(quotes(spark, sf_dir))


@register("event_type_counts", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(event_id) AS first_ix, max(event_id) AS last_ix FROM events GROUP BY event_type")
def event_type_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.min("event_id").alias("first_ix"), F.max("event_id").alias("last_ix"))


_SCORE = " + ".join(f"{c} * CAST({w} AS DOUBLE)" for c, w in WEIGHTS.items())
SCORED_SQL = f"SELECT *, CAST(0.01 AS DOUBLE) + {_SCORE} AS score FROM ({FEATURES_SQL})"


def scored(spark, sf_dir):
    return features(spark, sf_dir).withColumn("score", q.linear_score([F.col(c) for c in WEIGHTS], list(WEIGHTS.values()), 0.01))


_simple("linear_score", "score", scored, SCORED_SQL)


@register("signal_class", f"SELECT session_id, event_ix, CASE WHEN score > 0 AND score >= {THRESHOLD} THEN 'LONG' WHEN score < 0 AND score <= -{THRESHOLD} THEN 'SHORT' ELSE 'FLAT' END AS signal, abs(score) / {THRESHOLD} AS multiple FROM ({SCORED_SQL})", "multiple")
def signal_class(spark, sf_dir):
    return scored(spark, sf_dir).select(*KEYS, q.signal(F.col("score"), F.lit(THRESHOLD)).alias("signal"), q.threshold_multiple(F.col("score"), F.lit(THRESHOLD)).alias("multiple"))


_simple("delayed_signal", "late", lambda s, d: scored(s, d).withColumn("late", f.delayed("score", 5)), f"SELECT *, coalesce(lag(score, 5) OVER (PARTITION BY session_id ORDER BY event_ix), 0) AS late FROM ({SCORED_SQL})")


@register(
    "standardize_clip",
    f"SELECT session_id, event_ix, greatest(-2, least(2, (spread_bps - m) / CASE WHEN s > 1e-12 THEN s ELSE 1 END)) AS z FROM ({FEATURES_SQL}), (SELECT avg(spread_bps) AS m, stddev_pop(spread_bps) AS s FROM ({FEATURES_SQL}))",
    "z",
)
def standardize_clip(spark, sf_dir):
    rows = features(spark, sf_dir).select(*KEYS, "spread_bps")
    moments = rows.agg(F.avg("spread_bps").alias("m"), F.stddev_pop("spread_bps").alias("s"))
    return rows.crossJoin(F.broadcast(moments)).select(*KEYS, q.standardized(F.col("spread_bps"), F.col("m"), F.col("s"), 2.0).alias("z"))


@register("content_fingerprint", f"SELECT session_id, CAST(sum(k) AS BIGINT) AS n, sha256(string_agg(d, ',' ORDER BY b)) AS fingerprint FROM (SELECT session_id, event_ix // 10000 AS b, count(*) AS k, sha256(string_agg(event_ix || ':' || ts_ns, ',' ORDER BY event_ix)) AS d FROM ({QUOTES_SQL}) GROUP BY ALL) GROUP BY session_id")
def content_fingerprint(spark, sf_dir):
    from ..operators.fingerprints import fingerprint

    return fingerprint(quotes(spark, sf_dir), "session_id", ("event_ix", "ts_ns"))


