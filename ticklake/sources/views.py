"""Quotes and depth changes as views of the events table, in Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SESSIONS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    ts = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))") * 1000
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", ts.alias("ts_ns"), k.alias("k"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, event_ix, ts_ns, best_bid, best_ask, bid_qty, ask_qty: one quote for each event."""
    e, ix = _events(spark, sf_dir), F.col("event_id")
    bid = (F.lit(10000) + (ix * 37) % 101 + F.floor("value")) / 100
    return e.select(
        (F.col("user_id") % SESSIONS).cast("int").alias("session_id"), ix.alias("event_ix"), "ts_ns", bid.alias("best_bid"), (bid + (1 + F.col("k") % 3) / 100).alias("best_ask"), ((F.col("k") + 1) / 100).alias("bid_qty"), (((ix * 7919) % 100 + 1) / 100).alias("ask_qty")
    )


EVENTS_SQL = "SELECT event_id, user_id, event_type, value, epoch_us(ts) * 1000 AS ts_ns, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"

QUOTES_SQL = f"""SELECT CAST(user_id % {SESSIONS} AS INTEGER) AS session_id, event_id AS event_ix, ts_ns,
  (10000 + (event_id * 37) % 101 + floor(value)) / 100 AS best_bid, (10000 + (event_id * 37) % 101 + floor(value)) / 100 + (1 + k % 3) / 100 AS best_ask,
  (k + 1) / 100 AS bid_qty, ((event_id * 7919) % 100 + 1) / 100 AS ask_qty FROM ({EVENTS_SQL})"""


def depth_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, event_ix, ts_ns, side (bid or ask), price and qty (whole numbers; qty 0 deletes the level)."""
    e, ix = _events(spark, sf_dir), F.col("event_id")
    bid = ix % 2 == 0
    price = F.when(bid, 10000 - (ix * 31) % 40).otherwise(10001 + (ix * 29) % 40)
    qty = F.when(F.col("k") % 10 == 0, F.lit(0)).otherwise(F.col("k"))
    return e.select((F.col("user_id") % SESSIONS).cast("int").alias("session_id"), ix.alias("event_ix"), "ts_ns", F.when(bid, "bid").otherwise("ask").alias("side"), price.cast("long").alias("price"), qty.cast("long").alias("qty"))


DEPTH_SQL = f"""SELECT CAST(user_id % {SESSIONS} AS INTEGER) AS session_id, event_id AS event_ix, ts_ns,
  CASE WHEN event_id % 2 = 0 THEN 'bid' ELSE 'ask' END AS side,
  CASE WHEN event_id % 2 = 0 THEN 10000 - (event_id * 31) % 40 ELSE 10001 + (event_id * 29) % 40 END AS price,
  CASE WHEN k % 10 = 0 THEN 0 ELSE k END AS qty FROM ({EVENTS_SQL})"""


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, event_ix, signed_qty: purchases as trades; an odd k has a buyer that waited, so the seller was active."""
    e = _events(spark, sf_dir).where("event_type = 'purchase'")
    return e.select((F.col("user_id") % SESSIONS).cast("int").alias("session_id"), F.col("event_id").alias("event_ix"), F.when(F.col("k") % 2 == 1, -(F.col("k") + 1)).otherwise(F.col("k") + 1).cast("double").alias("signed_qty"))


TRADES_SQL = f"""SELECT CAST(user_id % {SESSIONS} AS INTEGER) AS session_id, event_id AS event_ix, CAST(CASE WHEN k % 2 = 1 THEN -(k + 1) ELSE k + 1 END AS DOUBLE) AS signed_qty
  FROM ({EVENTS_SQL}) WHERE event_type = 'purchase'"""
