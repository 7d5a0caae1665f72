"""Queries over depth changes: levels, invariants, depth features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import book
from ..queries import register
from ..sources.views import DEPTH_SQL, TRADES_SQL, depth_changes, trades

LIFE_SQL = f"SELECT session_id, side, price, qty, event_ix AS born, lead(event_ix) OVER (PARTITION BY session_id, side, price ORDER BY event_ix) AS died FROM ({DEPTH_SQL})"
LEVELS_SQL = f"""SELECT e.session_id, e.event_ix, e.ts_ns, l.side, l.price, l.qty, row_number() OVER (PARTITION BY e.session_id, e.event_ix, l.side ORDER BY CASE WHEN l.side = 'bid' THEN -l.price ELSE l.price END) AS rank
  FROM ({DEPTH_SQL}) e JOIN ({LIFE_SQL}) l ON l.session_id = e.session_id AND e.event_ix >= l.born AND (l.died IS NULL OR e.event_ix < l.died) AND l.qty > 0"""

_S = lambda side, n, what="qty": f"coalesce(sum({what}) FILTER (WHERE side = '{side}' AND rank <= {n}), 0)"
TOP_SQL = f"""SELECT session_id, event_ix, any_value(ts_ns) AS ts_ns, CAST(max(price) FILTER (WHERE side = 'bid' AND rank = 1) AS DOUBLE) AS best_bid, CAST(max(price) FILTER (WHERE side = 'ask' AND rank = 1) AS DOUBLE) AS best_ask,
  CAST({_S('bid', 1)} AS DOUBLE) AS bid_qty, CAST({_S('ask', 1)} AS DOUBLE) AS ask_qty, {', '.join(f"CAST({_S(s, n)} AS DOUBLE) AS {s}_{n}" for s in ('bid', 'ask') for n in (5, 10, 20))},
  CAST(sum(price * qty) FILTER (WHERE rank <= 5) AS DOUBLE) / sum(qty) FILTER (WHERE rank <= 5) AS weighted FROM ({LEVELS_SQL}) GROUP BY session_id, event_ix HAVING count(*) FILTER (WHERE side = 'bid') > 0 AND count(*) FILTER (WHERE side = 'ask') > 0"""
_imb = lambda b, a: f"CASE WHEN {b} + {a} > 0 THEN ({b} - {a}) / ({b} + {a}) ELSE CAST(0 AS DOUBLE) END"
DEPTH_COLUMNS_SQL = f"""SELECT *, (best_bid + best_ask) / 2 AS mid, (best_ask - best_bid) / ((best_bid + best_ask) / 2) * CAST(1e4 AS DOUBLE) AS spread_bps, {_imb('bid_qty', 'ask_qty')} AS imbalance_1, {', '.join(f"{_imb(f'bid_{n}', f'ask_{n}')} AS imbalance_{n}" for n in (5, 10, 20))},
  ((best_ask * bid_qty + best_bid * ask_qty) / (bid_qty + ask_qty) - (best_bid + best_ask) / 2) / ((best_bid + best_ask) / 2) * CAST(1e4 AS DOUBLE) AS microprice_edge_1_bps, (weighted - (best_bid + best_ask) / 2) / ((best_bid + best_ask) / 2) * CAST(1e4 AS DOUBLE) AS depth_weighted_mid_edge_5_bps,
  ln(1 + bid_5) AS log_bid_depth_5, ln(1 + ask_5) AS log_ask_depth_5, bid_qty / bid_10 AS bid_concentration_1_10, ask_qty / ask_10 AS ask_concentration_1_10, ln((bid_20 + CAST(1e-12 AS DOUBLE)) / (bid_5 + CAST(1e-12 AS DOUBLE))) AS bid_convexity_5_20, ln((ask_20 + CAST(1e-12 AS DOUBLE)) / (ask_5 + CAST(1e-12 AS DOUBLE))) AS ask_convexity_5_20 FROM ({TOP_SQL})"""
KEYS = ("session_id", "event_ix")


def changes(spark, sf_dir):
    return depth_changes(spark, sf_dir).withColumn("epoch", F.lit(0).cast("long"))


def columns(spark, sf_dir):
    return book.depth_columns(book.states(changes(spark, sf_dir)))


def _simple(name: str, names: str, source, sql: str) -> None:
    register(name, f"SELECT session_id, event_ix, {', '.join(names.split())} FROM ({sql})", names)(lambda spark, sf_dir: source(spark, sf_dir).select(*KEYS, *names.split()))


@register("book_level_lifetimes", f"SELECT * FROM ({LIFE_SQL})")
def level_lifetimes(spark, sf_dir):
    return book.lifetimes(changes(spark, sf_dir)).drop("epoch")


@register("book_top5", f"SELECT session_id, event_ix, side, price, qty, rank FROM ({LEVELS_SQL}) WHERE rank <= 5")
def top5(spark, sf_dir):
    """By the sequential fold; the SQL joins lifetimes."""
    state = book.states(changes(spark, sf_dir), 5)
    side = lambda s: state.select(*KEYS, F.lit(s).alias("side"), F.posexplode(f"{s}s").alias("rank", "level"))
    return side("bid").unionByName(side("ask")).select(*KEYS, "side", "level.price", "level.qty", (F.col("rank") + 1).cast("long").alias("rank"))


@register("book_top5_by_interval", f"SELECT session_id, event_ix, side, price, qty, CAST(rank AS INTEGER) AS rank FROM ({LEVELS_SQL}) WHERE rank <= 5")
def top5_by_interval(spark, sf_dir):
    return book.levels_by_interval(changes(spark, sf_dir), 5).drop("epoch")


_simple("book_best_quotes", "best_bid best_ask bid_qty ask_qty", columns, TOP_SQL)


@register("book_invariants", f"SELECT session_id, count(*) AS events, count(*) FILTER (WHERE best_bid >= best_ask) AS crossed FROM ({TOP_SQL}) GROUP BY session_id")
def invariants(spark, sf_dir):
    return columns(spark, sf_dir).groupBy("session_id").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("best_bid") >= F.col("best_ask")).alias("crossed"))


@register("book_quantity_at", f"SELECT e.session_id, e.event_ix, coalesce(arg_max(c.qty, c.event_ix), 0) AS quantity FROM ({DEPTH_SQL}) e LEFT JOIN ({DEPTH_SQL}) c ON c.session_id = e.session_id AND c.side = 'bid' AND c.price = 9990 AND c.event_ix <= e.event_ix GROUP BY e.session_id, e.event_ix")
def quantity_at(spark, sf_dir):
    """After every event."""
    rows = changes(spark, sf_dir)
    return _quantities(rows, rows)


def _quantities(rows, at):
    looks = at.select("session_id", "epoch", "event_ix", F.lit("bid").alias("side"), F.lit(9990).cast("long").alias("price"))
    return book.quantity_at(rows, looks).select(*KEYS, "quantity")


_simple("depth_imbalance_n", "imbalance_1 imbalance_5 imbalance_10 imbalance_20", columns, DEPTH_COLUMNS_SQL)
_simple("depth_weighted_mid", "microprice_edge_1_bps depth_weighted_mid_edge_5_bps spread_bps", columns, DEPTH_COLUMNS_SQL)
_simple("depth_logs", "log_bid_depth_5 log_ask_depth_5", columns, DEPTH_COLUMNS_SQL)
_simple("depth_concentration_convexity", "bid_concentration_1_10 ask_concentration_1_10 bid_convexity_5_20 ask_convexity_5_20", columns, DEPTH_COLUMNS_SQL)

_SLOPE = f"""SELECT session_id, event_ix, coalesce(regr_slope(y, x) FILTER (WHERE side = 'bid'), 0) AS bid_depth_slope_10, coalesce(regr_slope(y, x) FILTER (WHERE side = 'ask'), 0) AS ask_depth_slope_10 FROM (
  SELECT *, CAST(abs(price - first_value(price) OVER w) AS DOUBLE) / first_value(price) OVER w * CAST(1e4 AS DOUBLE) AS x, ln(1 + CAST(sum(qty) OVER w AS DOUBLE)) AS y FROM ({LEVELS_SQL}) WHERE rank <= 10 WINDOW w AS (PARTITION BY session_id, event_ix, side ORDER BY rank ROWS UNBOUNDED PRECEDING))
  GROUP BY session_id, event_ix HAVING count(*) FILTER (WHERE side = 'bid') > 0 AND count(*) FILTER (WHERE side = 'ask') > 0"""
_SLOPES = _SLOPE.replace("coalesce(regr_slope(y, x) FILTER (WHERE side = 'bid'), 0)", "CASE WHEN count(*) FILTER (WHERE side = 'bid') > 1 THEN regr_slope(y, x) FILTER (WHERE side = 'bid') ELSE 0 END").replace("coalesce(regr_slope(y, x) FILTER (WHERE side = 'ask'), 0)", "CASE WHEN count(*) FILTER (WHERE side = 'ask') > 1 THEN regr_slope(y, x) FILTER (WHERE side = 'ask') ELSE 0 END")
_simple("depth_slope", "bid_depth_slope_10 ask_depth_slope_10", columns, _SLOPES)


def history(spark, sf_dir):
    return book.l2_history(columns(spark, sf_dir))


_W = "WINDOW w AS (PARTITION BY session_id ORDER BY event_ix)"
HISTORY_SQL = f"""SELECT *, CASE WHEN place >= 20 THEN sqrt(greatest(avg(mid_return_1 * mid_return_1) OVER v - (avg(mid_return_1) OVER v) * (avg(mid_return_1) OVER v), 0)) ELSE 0 END AS realized_volatility_20 FROM (SELECT *, row_number() OVER w AS place, coalesce(ln(mid / lag(mid, 1) OVER w) * CAST(1e4 AS DOUBLE), 0) AS mid_return_1, coalesce(ln(mid / lag(mid, 5) OVER w) * CAST(1e4 AS DOUBLE), 0) AS mid_return_5,
  ln(1 + greatest(coalesce(ts_ns - lag(ts_ns, 1) OVER w, 0), 0) / CAST(1e3 AS DOUBLE)) AS log_interarrival_us, CASE WHEN ts_ns - lag(ts_ns, 10) OVER w > 0 THEN 10 / ((ts_ns - lag(ts_ns, 10) OVER w) / CAST(1e9 AS DOUBLE)) ELSE 0 END AS event_rate_10,
  coalesce(spread_bps - lag(spread_bps) OVER w, 0) AS spread_change_1, coalesce(imbalance_1 - lag(imbalance_1) OVER w, 0) AS imbalance_change_1,
  CASE WHEN lag(best_bid) OVER w IS NULL THEN 0 ELSE CASE WHEN best_bid > lag(best_bid) OVER w THEN bid_qty WHEN best_bid = lag(best_bid) OVER w THEN bid_qty - lag(bid_qty) OVER w ELSE -lag(bid_qty) OVER w END + CASE WHEN best_ask < lag(best_ask) OVER w THEN -ask_qty WHEN best_ask = lag(best_ask) OVER w THEN lag(ask_qty) OVER w - ask_qty ELSE lag(ask_qty) OVER w END END AS top_of_book_ofi
  FROM ({DEPTH_COLUMNS_SQL}) {_W}) WINDOW v AS (PARTITION BY session_id ORDER BY event_ix ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""
_simple("ofi_top", "top_of_book_ofi", history, HISTORY_SQL)
_simple("l2_returns_vol_rate", "mid_return_1 mid_return_5 realized_volatility_20 log_interarrival_us event_rate_10", history, HISTORY_SQL)
_simple("l2_changes", "spread_change_1 imbalance_change_1", history, HISTORY_SQL)

_OLD = f"SELECT *, qty - coalesce(lag(qty) OVER (PARTITION BY session_id, side, price ORDER BY event_ix), 0) AS change FROM ({DEPTH_SQL})"
_FLOW = lambda s, plus: f"CAST(CASE WHEN side = '{s}' AND change {'>=' if plus else '<'} 0 THEN abs(change) ELSE 0 END AS DOUBLE)"
_FLOWS = f"SELECT session_id, event_ix, {_imb(_FLOW('bid', 1), _FLOW('ask', 1))} AS depth_addition_imbalance, {_imb(_FLOW('ask', 0), _FLOW('bid', 0))} AS cancellation_imbalance FROM ({_OLD}) WHERE (session_id, event_ix) IN (SELECT (session_id, event_ix) FROM ({TOP_SQL}))"
_simple("add_cancel_imbalance", "depth_addition_imbalance cancellation_imbalance", columns, _FLOWS)

_TW = "OVER (PARTITION BY session_id ORDER BY event_ix ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
_TF = f"SELECT session_id, event_ix, sum(signed_qty) {_TW} / sum(abs(signed_qty)) {_TW} AS trade_imbalance_20 FROM ({TRADES_SQL})"


_TRADE_FLOW = f"SELECT d.session_id, d.event_ix, coalesce(t.trade_imbalance_20, 0) AS trade_imbalance_20 FROM ({DEPTH_SQL}) d ASOF LEFT JOIN ({_TF}) t ON t.session_id = d.session_id AND t.event_ix < d.event_ix"


@register("trade_imbalance_20", _TRADE_FLOW, "trade_imbalance_20")
def trade_imbalance(spark, sf_dir):
    own = trades(spark, sf_dir).withColumn("epoch", F.lit(0).cast("long"))
    return book.with_trade_flow(changes(spark, sf_dir).select("session_id", "epoch", "event_ix"), own).select(*KEYS, "trade_imbalance_20")


_ALL_26 = f"""SELECT session_id, event_ix, {', '.join(book.L2_FEATURES)}, ln(lead(mid, 20) OVER w / mid) * CAST(1e4 AS DOUBLE) AS target FROM (SELECT * FROM ({HISTORY_SQL}) JOIN ({_SLOPES}) USING (session_id, event_ix) JOIN ({_FLOWS}) USING (session_id, event_ix) JOIN ({_TRADE_FLOW}) USING (session_id, event_ix) WHERE place > {book.L2_WARM_UP})
  WINDOW w AS (PARTITION BY session_id ORDER BY event_ix) QUALIFY lead(mid, 20) OVER w IS NOT NULL"""


@register("l2_features_26", _ALL_26, " ".join((*book.L2_FEATURES, "target")))
def l2_features(spark, sf_dir):
    """All 26 depth features with labels."""
    own = trades(spark, sf_dir).withColumn("epoch", F.lit(0).cast("long"))
    return book.l2_features(changes(spark, sf_dir), own, 20).select(*KEYS, *book.L2_FEATURES, "target")


@register("stale_and_gap_flags", f"""SELECT session_id, event_ix, final_id <= coalesce(seen, 0) AS stale, first_id > coalesce(seen, first_id) + 1 AS gap FROM (SELECT *, max(final_id) OVER (PARTITION BY session_id ORDER BY event_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
  FROM (SELECT session_id, event_ix, event_ix - price % 3 AS first_id, event_ix + price % 4 AS final_id FROM ({DEPTH_SQL})))""")
def stale_and_gap_flags(spark, sf_dir):
    from ..operators.sync import continuity

    rows = depth_changes(spark, sf_dir).select("session_id", "event_ix", (F.col("event_ix") - F.col("price") % 3).alias("first_id"), (F.col("event_ix") + F.col("price") % 4).alias("final_id"))
    return continuity(rows, ("session_id",)).select(*KEYS, "stale", "gap")


# FNV-1a over little-endian 64-bit numbers, byte by byte, in 128-bit arithmetic modulo 2**64
_PAIRS = lambda side: f"list_concat([CAST(count(*) FILTER (WHERE side = '{side}') AS BIGINT)], flatten(coalesce(list([price, CAST(qty AS BIGINT)] ORDER BY rank) FILTER (WHERE side = '{side}'), [])))"
_NUMBERS = f"SELECT session_id, event_ix, list_concat([event_ix], list_concat({_PAIRS('bid')}, {_PAIRS('ask')})) AS v FROM ({LEVELS_SQL}) GROUP BY session_id, event_ix"
_EVERY = f"SELECT d.session_id, d.event_ix, coalesce(n.v, [d.event_ix, 0, 0]) AS v FROM ({DEPTH_SQL}) d LEFT JOIN ({_NUMBERS}) n USING (session_id, event_ix)"
_FNV = "list_reduce(list_concat([CAST('14695981039346656037' AS HUGEINT)], flatten(list_transform(v, lambda x: list_transform(range(8), lambda i: CAST((x >> CAST(i * 8 AS BIGINT)) & 255 AS HUGEINT))))), lambda h, b: (CAST(xor(CAST(h AS UBIGINT), CAST(b AS UBIGINT)) AS HUGEINT) * 1099511628211) % CAST('18446744073709551616' AS HUGEINT))"


@register("book_state_hash", f"SELECT session_id, event_ix, CAST({_FNV} AS VARCHAR) AS state_hash FROM ({_EVERY})")
def book_state_hash(spark, sf_dir):
    """A hash of the whole book, with all levels, after each event."""
    state = book.states(changes(spark, sf_dir), None)
    return book.hashed(state).select(*KEYS, "state_hash")
