"""Time-series features of quotes. Order within a session is event_ix, never the time (times may tie).

All columns of one builder share one window order, so that a plan has one exchange and one sort by session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quotes as q

WARM_UP, RATE_EVENTS, VOLATILITY = 25, 10, 20
RETURN_LAGS = (1, 2, 5, 10, 25)
FEATURES = ("spread_bps", "imbalance", "microprice_edge_bps", "log_quantity_ratio", *(f"mid_return_{k}" for k in RETURN_LAGS), "imbalance_change_1", "imbalance_change_5", "spread_change_1", "log_interarrival_us", "event_rate_10", "realized_volatility_20", "log_total_quantity_change_1")


def in_order(*keys: str) -> Window:
    return Window.partitionBy(*(keys or ("session_id",))).orderBy("event_ix")


def log_return(x: str, lag: int, w) -> Column:
    """Log return over lag events, in basis points."""
    return F.ln(F.col(x) / F.lag(x, lag).over(w)) * 1e4


def event_rate(w, events: int = RATE_EVENTS) -> Column:
    """Events a second over the last ones; 0 if no time has passed, null before there are enough."""
    delta = (F.col("ts_ns") - F.lag("ts_ns", events).over(w)) / 1e9
    return F.when(delta.isNull(), F.lit(None).cast("double")).when(delta > 0, events / delta).otherwise(F.lit(0.0))


def rolling_std(x: str, w, rows: int = VOLATILITY) -> Column:
    """Population deviation of the last rows; null before there are enough."""
    last = w.rowsBetween(-(rows - 1), 0)
    mean = F.avg(x).over(last)
    return F.when(F.count(x).over(last) == rows, F.sqrt(F.greatest(F.avg(F.col(x) * F.col(x)).over(last) - mean * mean, F.lit(0.0))))


def quote_columns(quotes: DataFrame) -> DataFrame:
    """Quotes with what depends on one row alone."""
    return quotes.where(q.valid_quote()).select("*", q.mid().alias("mid"), q.spread_bps().alias("spread_bps"), q.imbalance().alias("imbalance"), q.microprice_edge_bps().alias("microprice_edge_bps"), q.log_qty_ratio().alias("log_quantity_ratio"), (F.col("bid_qty") + F.col("ask_qty")).alias("total_qty"))


def lagged(quotes: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """All 16 features on every valid quote, null while the history is too short, with ix (place in the session) and n."""
    w = in_order(*keys)
    change = lambda x, k: F.col(x) - F.lag(x, k).over(w)
    rows = quote_columns(quotes).withColumns({f"mid_return_{k}": log_return("mid", k, w) for k in RETURN_LAGS})
    return rows.withColumns({
        "imbalance_change_1": change("imbalance", 1), "imbalance_change_5": change("imbalance", 5), "spread_change_1": change("spread_bps", 1),
        "log_interarrival_us": q.log_interarrival_us(F.col("ts_ns") - F.lag("ts_ns", 1).over(w)), "event_rate_10": event_rate(w), "realized_volatility_20": rolling_std("mid_return_1", w),
        "log_total_quantity_change_1": F.ln((F.col("total_qty") + q.EPSILON) / (F.lag("total_qty", 1).over(w) + q.EPSILON)), "ix": (F.row_number().over(w) - 1).cast("long"),
    })


def labelled(rows: DataFrame, horizon: int, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """rows with the quote horizon events ahead (null at the end of the session) and the log return to it in basis points."""
    w = in_order(*keys)
    ahead = {f"future_{c}": F.lead(c, horizon).over(w) for c in ("best_bid", "best_ask", "bid_qty", "ask_qty", "mid")}
    return rows.withColumns(ahead).withColumn("target", F.ln(F.col("future_mid") / F.col("mid")) * 1e4)


def tob_features(quotes: DataFrame, horizon: int = 20, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Features and labels of every quote with WARM_UP before it and horizon after it, in sessions long enough for two such."""
    rows = labelled(lagged(quotes, keys), horizon, keys)
    length = F.count(F.lit(1)).over(Window.partitionBy(*keys).orderBy("event_ix").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("session_rows", length).where((F.col("ix") >= WARM_UP) & F.col("target").isNotNull() & (F.col("session_rows") >= WARM_UP + horizon + 2))
    good = F.lit(True)
    for c in (*FEATURES, "target"):
        good = good & q.finite(F.col(c))
    return rows.where(good)


def segments(quotes: DataFrame, max_gap_ns: int, cuts: DataFrame | None = None) -> DataFrame:
    """Quotes with segment (from 0 in each session): a new one starts after a gap longer than max_gap_ns and at each of cuts (session_id, event_ix)."""
    w = in_order()
    rows = quotes
    cut = F.lit(False)
    if cuts is not None:
        rows = rows.join(cuts.select("session_id", "event_ix").distinct().withColumn("_cut", F.lit(True)), ["session_id", "event_ix"], "left")
        cut = F.coalesce("_cut", F.lit(False)) & (F.row_number().over(w) > 1)
    gap = F.coalesce(F.col("ts_ns") - F.lag("ts_ns", 1).over(w) > max_gap_ns, F.lit(False))
    rows = rows.withColumn("_new", (gap | cut).cast("int"))
    out = rows.withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return out.drop("_new", "_cut")


def segment_summary(segmented: DataFrame) -> DataFrame:
    """First and last event, time span and number of rows of each segment."""
    return segmented.groupBy("session_id", "segment").agg(F.min("event_ix").alias("first_ix"), F.max("event_ix").alias("last_ix"), (F.max("ts_ns") - F.min("ts_ns")).alias("span_ns"), F.count(F.lit(1)).alias("n"))


def violations(quotes: DataFrame) -> DataFrame:
    """Numbers of quotes against each rule of a valid recording, by session, and the first offending event."""
    w = in_order()
    rows = quotes.withColumn("_back", F.coalesce(F.col("ts_ns") < F.lag("ts_ns", 1).over(w), F.lit(False)))
    crossed, bad_price = F.col("best_bid") > F.col("best_ask"), ~(q.finite(F.col("best_bid")) & q.finite(F.col("best_ask")) & (F.col("best_bid") > 0) & (F.col("best_ask") > 0))
    any_bad = F.col("_back") | crossed | bad_price | (F.col("ts_ns") <= 0)
    tally = lambda c, name: F.count_if(c).alias(name)
    return rows.groupBy("session_id").agg(tally(F.col("ts_ns") <= 0, "bad_time"), tally(bad_price, "bad_price"), tally(crossed, "crossed"), tally(F.col("_back"), "backward"), F.min(F.when(any_bad, F.col("event_ix"))).alias("first_bad_ix"))


def require_valid(quotes: DataFrame) -> DataFrame:
    """quotes, if they break no rule; an error that names the first offending event otherwise."""
    bad = violations(quotes).where(F.col("first_bad_ix").isNotNull()).orderBy("session_id").limit(1).collect()
    if bad:
        raise ValueError(f"invalid quote at session {bad[0].session_id}, event {bad[0].first_bad_ix}")
    return quotes


def downsample(rows: DataFrame, points: int, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """At most that many evenly spaced rows of each session, first and last included."""
    w = in_order(*keys)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    numbered = rows.withColumns({"_i": (F.row_number().over(w) - 1).cast("long"), "_n": n})
    # row i is point j if i = floor(j * (n - 1) / (points - 1)) for j = ceil(i * (points - 1) / (n - 1))
    j = F.ceil(F.col("_i") * (points - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    spot = F.floor(j * (F.col("_n") - 1) / (points - 1))
    return numbered.where((F.col("_n") <= points) | (spot == F.col("_i"))).drop("_i", "_n")


def session_ranges(rows: DataFrame) -> DataFrame:
    """session_id, start, stop: half-open ranges of row numbers when sessions stand one after another."""
    counts = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    ends = F.sum("n").over(Window.orderBy("session_id").rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("stop", ends).select("session_id", (F.col("stop") - F.col("n")).alias("start"), "stop")


def recording_summary(quotes: DataFrame) -> DataFrame:
    """First, last, extremes, duration and rate of each session."""
    span = (F.max("ts_ns") - F.min("ts_ns")) / 1e9
    return quotes.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"), F.min_by("best_bid", "event_ix").alias("first_bid"), F.max_by("best_ask", "event_ix").alias("last_ask"), F.min("best_bid").alias("low"), F.max("best_ask").alias("high"), span.alias("seconds"), F.when(span > 0, F.count(F.lit(1)) / span).alias("rate"))


def delayed(column: str, delay: int) -> Column:
    """The column as it was delay events before, 0 at the start of a session."""
    return F.coalesce(F.lag(column, delay).over(in_order()), F.lit(0.0))


def _cuts(rows: DataFrame, blocks: int, least: int) -> list[tuple]:
    """(session_id, cuts) of the sessions of at least least rows: approximate quantiles of event_ix.

    They are worked out once, here, as their values depend on the order in which partial results arrive: a plan that
    worked them out in each of its branches would cut the same session in several ways.
    """
    shares = F.array(*(F.lit(i / blocks) for i in range(1, blocks)))
    known = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("event_ix", shares, F.lit(100 * blocks)).alias("cuts"))
    return [(r.session_id, sorted(set(r.cuts))) for r in known.where(F.col("n") >= least).select("session_id", "cuts").collect()]


def in_blocks(rows: DataFrame, before: int, after: int, blocks: int, least: int) -> DataFrame:
    """rows with block, first (place in the session of the block's first row), session_rows and halo.

    Sessions of at least least rows are cut at approximate quantiles of event_ix into about that many blocks; the
    before last rows of a block are repeated in the next one and the after first rows in the one before it (halo true).
    """
    lengths = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("session_rows"))
    placed = rows.join(lengths, "session_id")
    cuts = _cuts(rows, blocks, max(least, 20 * blocks * (before + after)))
    if cuts:
        known = rows.sparkSession.createDataFrame(cuts, f"session_id {rows.schema['session_id'].dataType.simpleString()}, _cuts array<bigint>")
        placed = placed.join(F.broadcast(known), "session_id", "left").withColumn("block", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("event_ix"))), F.lit(0))).drop("_cuts")
    else:
        placed = placed.withColumn("block", F.lit(0))
    sizes = placed.groupBy("session_id", "block").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("session_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("first", F.coalesce(F.sum("_n").over(w), F.lit(0)))  # one row a block
    inside = Window.partitionBy("session_id", "block").orderBy("event_ix")
    own = placed.join(sizes, ["session_id", "block"]).withColumns({"_i": F.row_number().over(inside), "halo": F.lit(False)})
    to = lambda step, which: own.where(which).withColumns({"block": F.col("block") + step, "halo": F.lit(True)})
    copies = to(1, F.col("_i") > F.col("_n") - before).unionByName(to(-1, F.col("_i") <= after)).drop("first", "_n")
    starts = sizes.select("session_id", "block", "first")
    return own.drop("first", "_n").unionByName(copies).join(starts, ["session_id", "block"]).drop("_i")


def tob_features_in_blocks(quotes: DataFrame, horizon: int = 20, blocks: int = 64, least: int = 1_000_000) -> DataFrame:
    """tob_features() for sessions of any length: a long session is worked on in blocks, side by side.

    A feature looks back WARM_UP rows and a label ahead horizon rows, so these many rows of its neighbours are all that
    a block needs.
    """
    keys = ("session_id", "block")
    rows = in_blocks(quotes.where(q.valid_quote()), WARM_UP, horizon, blocks, least)
    out = labelled(lagged(rows, keys), horizon, keys)
    lead = F.when(F.col("block") > 0, WARM_UP).otherwise(0)
    out = out.withColumn("ix", F.col("first") + F.col("ix") - lead).where(~F.col("halo"))
    out = out.where((F.col("ix") >= WARM_UP) & F.col("target").isNotNull() & (F.col("session_rows") >= WARM_UP + horizon + 2))
    good = F.lit(True)
    for c in (*FEATURES, "target"):
        good = good & q.finite(F.col(c))
    return out.where(good).drop("block", "first", "halo")
