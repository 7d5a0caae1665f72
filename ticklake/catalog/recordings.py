"""Queries that write recordings and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..queries import register
from ..sources import codecs, recordings
from ..sources.views import DEPTH_SQL, QUOTES_SQL, TRADES_SQL, quotes
from .execution import market

_NUMBERED = f"SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY event_ix) - 1 AS ix, ts_ns, best_bid, best_ask, CAST(round(bid_qty * 1000000) AS BIGINT) AS bid_volume, CAST(round(ask_qty * 1000000) AS BIGINT) AS ask_volume, event_ix + 1 AS update_id FROM ({QUOTES_SQL})"


def written(spark, sf_dir):
    """A folder with one recording a session."""
    units = lambda c: F.round(F.col(c) * 1_000_000).cast("long")
    rows = quotes(spark, sf_dir).withColumns({"bid_volume": units("bid_qty"), "ask_volume": units("ask_qty"), "update_id": F.col("event_ix") + 1})
    path = recordings.scratch(spark)
    recordings.write_recordings(rows, path)
    return path


@register("recording_round_trip", _NUMBERED)
def round_trip(spark, sf_dir):
    """Every quote, with its update id, from recordings that were written before; files are read in ranges."""
    found = recordings.read_recordings(spark, written(spark, sf_dir), rows=10_000, require_complete=True)
    session = F.regexp_extract("recording", r"session-(\d+)\.qbin$", 1).cast("int")
    return found.select(session.alias("session_id"), F.col("event_ix").alias("ix"), "ts_ns", "best_bid", "best_ask", "bid_volume", "ask_volume", "update_id")


@register("recording_metadata", f"SELECT session_id, count(*) AS records, CAST(session_id + 1 AS BIGINT) AS created, true AS complete, CAST(0 AS INTEGER) AS boundaries FROM ({_NUMBERED}) GROUP BY session_id")
def metadata(spark, sf_dir):
    """What headers, sidecars and id files say of the recordings."""
    session = F.regexp_extract("recording", r"session-(\d+)\.qbin$", 1).cast("int")
    return recordings.metadata(spark, written(spark, sf_dir)).select(session.alias("session_id"), "records", "created", "complete", F.size("boundaries").alias("boundaries"))


def depth_written(spark, sf_dir):
    """A folder with one depth file a session, and its checkpoints."""
    path = recordings.scratch(spark)
    recordings.write_depth(market(spark, sf_dir), path, "BTCUSDT", every=100)
    return path


_SESSION = "CAST(regexp_extract(path, 'session-([0-9]+)[.]l2bin$', 1) AS INT) AS session_id"
_UNIT = "100000000"
_MARKET = f"""SELECT session_id, 2 * event_ix AS place, 'depth' AS kind, ts_ns, side, price * {_UNIT} AS price, qty * {_UNIT} AS qty FROM ({DEPTH_SQL})
  UNION ALL SELECT session_id, 2 * event_ix + 1, 'trade', ts_ns, CASE WHEN signed_qty < 0 THEN 'bid' ELSE 'ask' END, (9990 + event_ix % 20) * {_UNIT}, CAST(abs(signed_qty) AS BIGINT) * {_UNIT} FROM ({TRADES_SQL}) JOIN (SELECT session_id, event_ix, ts_ns FROM ({DEPTH_SQL})) USING (session_id, event_ix)
  UNION ALL SELECT DISTINCT session_id, -1, 'snapshot', min(ts_ns) OVER (PARTITION BY session_id), NULL, NULL, NULL FROM ({DEPTH_SQL})"""


@register("depth_round_trip", f"SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY place) - 1 AS ix, kind, ts_ns, CASE WHEN kind <> 'snapshot' THEN side END AS side, CAST(price AS BIGINT) AS price, CAST(qty AS BIGINT) AS qty FROM ({_MARKET})")
def depth_round_trip(spark, sf_dir):
    """Every snapshot, level change and trade, from depth files that were written before."""
    rows = codecs.read_depth(spark, depth_written(spark, sf_dir))
    one, traded = F.concat("bids", "asks")[0], F.col("kind") == "trade"
    side = F.when(traded, F.when(F.col("flags") == 1, "bid").otherwise("ask")).when(F.col("kind") == "depth", F.when(F.size("bids") > 0, "bid").otherwise("ask"))
    of = lambda level, trade: F.when(traded, F.col(trade)).when(F.col("kind") == "depth", one[level])
    return rows.select(F.expr(_SESSION), F.col("event_ix").alias("ix"), "kind", "ts_ns", side.alias("side"), of("price", "trade_price").alias("price"), of("qty", "trade_qty").alias("qty"))


@register("depth_replay_check", f"SELECT session_id, CAST(0 AS BIGINT) AS mismatches, count(*) > 200 AS has_checkpoints FROM ({_MARKET}) GROUP BY session_id HAVING count(*) > 200")
def depth_replay_check(spark, sf_dir):
    """Checkpoints of depth files against a replay of all their events, for sessions long enough to have some."""
    found = codecs.verify_replay(spark, depth_written(spark, sf_dir))
    return found.select(F.expr(_SESSION), "mismatches", (F.col("checkpoints") > 0).alias("has_checkpoints"))
