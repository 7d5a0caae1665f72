"""Queries over simulated execution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import book, simulator
from ..queries import register
from ..sources.views import QUOTES_SQL, depth_changes, quotes, trades
from .depth import LEVELS_SQL, changes

KEYS = ("session_id", "event_ix")


@register(
    "taker_sweep",
    f"SELECT session_id, event_ix, price, CAST(least(qty, 120 - before) AS BIGINT) AS taken FROM (SELECT *, coalesce(sum(qty) OVER (PARTITION BY session_id, event_ix ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({LEVELS_SQL}) WHERE side = 'ask') WHERE before < 120",
)
def taker_sweep(spark, sf_dir):
    """What an order of 120 takes after every event, over all levels."""
    return _sweep(book.states(changes(spark, sf_dir), None))


def _sweep(state):
    levels = state.select(*KEYS, F.posexplode("asks").alias("rank", "x")).select(*KEYS, "rank", "x.price", "x.qty")
    return simulator.taker_sweep(levels, F.lit(120), KEYS).select(*KEYS, "price", "taken")


_FILLS = f"SELECT session_id, event_ix, ts_ns, CASE WHEN event_ix % 2 = 0 THEN 1 ELSE -1 END AS side, CASE WHEN event_ix % 2 = 0 THEN best_ask ELSE best_bid END AS price, bid_qty AS qty, event_ix % 3 = 0 AS maker FROM ({QUOTES_SQL})"


def fills(rows):
    buys = F.col("event_ix") % 2 == 0
    return rows.select(*KEYS, "ts_ns", F.when(buys, 1).otherwise(-1).alias("side"), F.when(buys, F.col("best_ask")).otherwise(F.col("best_bid")).alias("price"), F.col("bid_qty").alias("qty"), (F.col("event_ix") % 3 == 0).alias("maker"))


_FEE = "price * qty * CASE WHEN maker THEN CAST(-0.3141592653 AS DOUBLE) ELSE CAST(2.718281828 AS DOUBLE) END / CAST(1e4 AS DOUBLE)"


@register("fill_accounting", f"SELECT session_id, event_ix, {_FEE} AS fee, sum(side * qty) OVER w AS position, sum(-(side * price * qty + {_FEE})) OVER w AS cash, sum({_FEE}) OVER w AS fees FROM ({_FILLS}) WINDOW w AS (PARTITION BY session_id ORDER BY event_ix ROWS UNBOUNDED PRECEDING)", "fee position cash fees")
def fill_accounting(spark, sf_dir):
    return _accounts(quotes(spark, sf_dir))


def _accounts(rows):
    return simulator.accounting(fills(rows), -0.3141592653, 2.718281828).select(*KEYS, "fee", "position", "cash", "fees")


_HOUR = 3600 * 10**9


@register("markouts_asof", f"SELECT f.session_id, f.event_ix, f.side * (m.mid - f.price) / f.price * CAST(1e4 AS DOUBLE) AS markout_bps FROM ({_FILLS}) f ASOF LEFT JOIN (SELECT session_id, ts_ns, (best_bid + best_ask) / 2 AS mid FROM ({QUOTES_SQL})) m ON m.session_id = f.session_id AND m.ts_ns >= f.ts_ns + {_HOUR}", "markout_bps")
def markouts_asof(spark, sf_dir):
    rows = quotes(spark, sf_dir)
    return _markouts(rows, rows)


def _markouts(filled, rows):
    mids = rows.select(*KEYS, "ts_ns", ((F.col("best_bid") + F.col("best_ask")) / 2).alias("mid"))
    return simulator.markouts(fills(filled), mids, _HOUR).select(*KEYS, "markout_bps")


def market(spark, sf_dir):
    """Depth events, with a first two-sided snapshot in each session, and trades, in the form the simulator takes."""
    rows = depth_changes(spark, sf_dir)
    unit = F.lit(simulator.SCALE)
    level = F.array(F.struct((F.col("price") * unit).cast("long").alias("price"), (F.col("qty") * unit).cast("long").alias("qty")))
    none = F.array().cast("array<struct<price:bigint,qty:bigint>>")
    pick = lambda s: F.when(F.col("side") == s, level).otherwise(none)
    ids = F.col("event_ix") + 2
    # ids of a session are made consecutive by letting each update reach back to the one before
    from pyspark.sql import Window

    before = F.coalesce(F.lag(ids, 1).over(Window.partitionBy("session_id").orderBy("event_ix")), F.lit(1))
    depth = rows.select("session_id", (F.col("event_ix") * 2).alias("event_ix"), "ts_ns", F.lit("depth").alias("kind"), (before + 1).alias("first_id"), ids.alias("final_id"), pick("bid").alias("bids"), pick("ask").alias("asks"), F.lit(None).cast("long").alias("trade_price"), F.lit(None).cast("long").alias("trade_qty"), F.lit(None).cast("boolean").alias("buyer_is_maker"))
    start = rows.groupBy("session_id").agg(F.min("ts_ns").alias("ts_ns"))
    one = lambda p: F.array(F.struct(F.lit(p * simulator.SCALE).cast("long").alias("price"), F.lit(10 * simulator.SCALE).cast("long").alias("qty")))
    snapshot = start.select("session_id", F.lit(-1).cast("long").alias("event_ix"), "ts_ns", F.lit("snapshot").alias("kind"), F.lit(1).cast("long").alias("first_id"), F.lit(1).cast("long").alias("final_id"), one(9950).alias("bids"), one(10050).alias("asks"), F.lit(None).cast("long").alias("trade_price"), F.lit(None).cast("long").alias("trade_qty"), F.lit(None).cast("boolean").alias("buyer_is_maker"))
    own = trades(spark, sf_dir).join(rows.select(*KEYS, "ts_ns"), list(KEYS))
    traded = own.select("session_id", (F.col("event_ix") * 2 + 1).alias("event_ix"), "ts_ns", F.lit("trade").alias("kind"), F.lit(0).cast("long").alias("first_id"), F.lit(0).cast("long").alias("final_id"), none.alias("bids"), none.alias("asks"), ((9990 + F.col("event_ix") % 20) * unit).cast("long").alias("trade_price"), (F.abs("signed_qty") * unit).cast("long").alias("trade_qty"), (F.col("signed_qty") < 0).alias("buyer_is_maker"))
    return depth.unionByName(snapshot).unionByName(traded)


def requests(spark, sf_dir):
    """One order for each quote."""
    rows = quotes(spark, sf_dir)
    limit = F.when(F.col("event_ix") % 80 == 0, ((9985 + F.col("event_ix") % 30) * simulator.SCALE).cast("long"))
    return rows.select("session_id", F.lit("order").alias("kind"), F.col("event_ix").cast("string").alias("order_id"), F.col("ts_ns").alias("decision_ns"), F.when(F.col("event_ix") % 160 < 80, "buy").otherwise("sell").alias("side"), F.lit(simulator.SCALE).cast("long").alias("qty"), limit.alias("limit_price"), F.lit(6 * _HOUR).cast("long").alias("ttl_ns"))


def grid(spark, sf_dir):
    cases = {f"{m}-{d}": simulator.Case(model=m, transmission_ns=d, maker_bps=-0.5, taker_bps=2.0, most_position=1000 * simulator.SCALE) for m in simulator.MODELS for d in (250_000, _HOUR)}
    return simulator.sensitivity_grid(market(spark, sf_dir), requests(spark, sf_dir), cases)


@register("simulate_orders")
def simulate_orders(spark, sf_dir):
    """Summaries by case and session."""
    return grid(spark, sf_dir)


@register("sensitivity_grid")
def sensitivity_grid(spark, sf_dir):
    """Sums over sessions by case."""
    return simulator.aggregate(grid(spark, sf_dir))


