"""Strict parsers of market messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Digits, at most eight of them significant after the point; no sign, no exponent.
PATTERN = r"^[0-9]+(\.[0-9]{0,8}0*)?$"
UNIT = 100_000_000


def fixed_decimal(text: Column) -> Column:
    """A non-negative decimal as a whole number of 1e-8; null if it is malformed, has more decimals than zeros, or is too large."""
    good = text.rlike(PATTERN)
    decimals = F.when(text.contains("."), F.substring_index(text, ".", -1)).otherwise(F.lit(""))
    return F.when(good, (F.substring_index(text, ".", 1).try_cast("decimal(28,0)") * UNIT + F.rpad(F.substring(decimals, 1, 8), 8, "0").try_cast("decimal(28,0)")).try_cast("long"))


def positive(units: Column) -> Column:
    return F.when(units > 0, units)


def top_of_book(messages: DataFrame, symbol: str) -> DataFrame:
    """Quotes from bookTicker messages (column value, JSON): bad ones and other symbols' are dropped.

    Quantities become whole numbers of 1e-6 that fit in 32 bits; update ids are text of up to 20 digits.
    """
    at = lambda c: F.get_json_object("value", f"$.{c}")  # noqa: E731  field names differ in case alone, which a struct can't hold
    rows = messages.select("*", at("s").alias("s"), at("u").try_cast("decimal(20,0)").alias("update_id"), *(fixed_decimal(at(c)).alias(n) for c, n in (("b", "_b"), ("B", "_bq"), ("a", "_a"), ("A", "_aq"))))
    scaled = lambda c: F.round(F.col(c) / 100).cast("long")
    out = rows.where((F.upper(F.trim("s")) == symbol) & (F.col("update_id") > 0) & (F.col("_b") > 0) & (F.col("_a") > 0) & (F.col("_b") <= F.col("_a")) & F.col("_bq").isNotNull() & F.col("_aq").isNotNull())
    out = out.select(*[c for c in messages.columns if c != "value"], "update_id", (F.col("_b") / UNIT).alias("best_bid"), (F.col("_a") / UNIT).alias("best_ask"), scaled("_bq").alias("bid_volume"), scaled("_aq").alias("ask_volume"))
    return out.where("bid_volume < 4294967296 AND ask_volume < 4294967296")


def depth_messages(messages: DataFrame) -> DataFrame:
    """Depth updates and trades from combined-stream messages (column value, JSON), with corrupt ones marked."""
    at = lambda c: F.get_json_object("value", f"$.data.{c}")
    levels = lambda c: F.transform(F.from_json(at(c), "array<array<string>>"), lambda x: F.struct(fixed_decimal(x[0]).alias("price"), fixed_decimal(x[1]).alias("qty")))
    depth, trade = at("e") == "depthUpdate", at("e") == "aggTrade"
    number = lambda c: at(c).try_cast("decimal(20,0)")
    out = messages.select(*[c for c in messages.columns if c != "value"], F.when(depth, "depth").when(trade, "trade").alias("kind"), F.upper(at("s")).alias("symbol"), at("E").try_cast("long").alias("event_ms"), number("U").alias("first_id"), number("u").alias("final_id"), levels("b").alias("bids"), levels("a").alias("asks"), fixed_decimal(at("p")).alias("trade_price"), fixed_decimal(at("q")).alias("trade_qty"), at("m").try_cast("boolean").alias("buyer_is_maker"))
    whole = F.when(F.col("kind") == "depth", (F.col("first_id") <= F.col("final_id")) & F.forall(F.concat("bids", "asks"), lambda x: (x["price"] > 0) & x["qty"].isNotNull())).when(F.col("kind") == "trade", (F.col("trade_price") > 0) & (F.col("trade_qty") > 0))
    return out.withColumn("corrupt", ~F.coalesce(whole, F.lit(False)))
