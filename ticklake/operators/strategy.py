"""Trades from forecasts: greedy non-overlapping selection, costs, metrics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import once
from .stats import pearson, quantiles, value_places


def opportunities(rows: DataFrame, prediction: str, threshold: Column, participation: float = 1.0) -> DataFrame:
    """rows with side (1 long, -1 short), gross_bps and capacity, where the forecast reaches the threshold.

    A long trade buys at the ask and sells at the later bid, a short one the other way round.
    """
    p = F.col(prediction)
    long, short = (p > 0) & (p >= threshold), (p < 0) & (p <= -threshold)
    side = F.when(long, 1).when(short, -1)
    gross = F.when(long, F.ln(F.col("future_best_bid") / F.col("best_ask"))).when(short, F.ln(F.col("best_bid") / F.col("future_best_ask"))) * 1e4
    capacity = F.when(long, F.least("ask_qty", "future_bid_qty")).when(short, F.least("bid_qty", "future_ask_qty")) * participation
    return rows.withColumns({"side": side, "gross_bps": gross, "capacity": capacity}).where(F.col("side").isNotNull())


def greedy(candidates: DataFrame, keys: tuple[str, ...], horizon: int, place: str = "ix") -> DataFrame:
    """Of each key's candidates in order of place, the first, then always the next at least horizon places later.

    A fold over sorted rows: rows of a key need to be in one task, but stream through it with one number of state.
    """
    names = candidates.columns
    at = [names.index(k) for k in keys]
    where = names.index(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, free = None, 0
        for b in batches:
            places = b.column(where).to_pylist()
            keep = []
            for i, key in enumerate(zip(*(b.column(k).to_pylist() for k in at), strict=True)):
                if key != current:
                    current, free = key, places[i]
                if places[i] >= free:
                    keep.append(i)
                    free = places[i] + horizon
            yield b.take(pa.array(keep, pa.int64()))

    return candidates.repartition(*keys).sortWithinPartitions(*keys, place).mapInArrow(run, candidates.schema)


def select_trades(rows: DataFrame, prediction: str, thresholds: list[float], horizon: int, cost_bps: float = 0.0, size: float = 0.0, participation: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Trades at each threshold, and the numbers of signals whose shown quantity was too small.

    A refused signal starts no waiting time, but counts only if the session was free: it is counted against the trades.
    """
    grid = rows.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    found = opportunities(grid, prediction, F.col("threshold"), participation)
    fits = (F.col("capacity") >= size) if size > 0 else F.lit(True)
    trades = greedy(found.where(fits), ("threshold", "session_id"), horizon).withColumn("net_bps", F.col("gross_bps") - cost_bps)
    # a signal is free if the last trade before it lies at least a horizon back
    events = trades.select("threshold", "session_id", "ix", F.col("ix").alias("_trade"), F.lit(0).alias("_signal")).unionByName(found.where(~fits).select("threshold", "session_id", "ix", F.lit(None).cast("long").alias("_trade"), F.lit(1).alias("_signal")))
    last = F.last("_trade", ignorenulls=True).over(Window.partitionBy("threshold", "session_id").orderBy("ix").rowsBetween(Window.unboundedPreceding, -1))
    refused = events.withColumn("_last", last).where((F.col("_signal") == 1) & (F.col("_last").isNull() | (F.col("ix") >= F.col("_last") + horizon))).groupBy("threshold").agg(F.count(F.lit(1)).alias("refused"))
    return trades, refused


def drawdowns(trades: DataFrame, keys: tuple[str, ...] = (), order: tuple[str, str] = ("session_id", "ix")) -> DataFrame:
    """trades with cumulative result and drawdown below the running peak (which starts at 0), by keys.

    Sums run within sessions; what earlier sessions add to them, and their peak, is one row a session.
    """
    session, place = order
    inside = Window.partitionBy(*keys, session).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    local = trades.withColumn("_sum", F.sum("net_bps").over(inside)).withColumn("_peak", F.max("_sum").over(inside))
    ends = trades.groupBy(*keys, session).agg(F.sum("net_bps").alias("_total"))
    earlier = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(session).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.join(local.groupBy(*keys, session).agg(F.max("_sum").alias("_top")), [*keys, session]).withColumn("_carry", F.coalesce(F.sum("_total").over(earlier), F.lit(0.0)))
    carried = carried.withColumn("_before", F.greatest(F.lit(0.0), F.max(F.col("_carry") + F.col("_top")).over(earlier))).select(*keys, session, "_carry", "_before")
    out = local.join(carried, [*keys, session]).withColumn("cumulative", F.col("_carry") + F.col("_sum"))
    return out.withColumn("drawdown", F.col("cumulative") - F.greatest("_before", F.col("_carry") + F.col("_peak"))).select(*trades.columns, "cumulative", "drawdown")


def strategy_metrics(trades: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts, means, ratios, drawdown and expected shortfall of trades by keys; profit_factor is infinite without a loss.

    The median and the worst twentieth come from distinct results in value ranges, so that no task holds all trades.
    """

    def build(trades: DataFrame) -> DataFrame:
        net = F.col("net_bps")
        n, mean, dev = F.count(F.lit(1)), F.avg(net), F.stddev_samp(net)
        won, lost = F.sum(F.when(net > 0, net)), F.sum(F.when(net < 0, net))
        sums = drawdowns(trades, keys).groupBy(*keys).agg(
            n.alias("trades"), F.avg((net > 0).cast("int")).alias("win_rate"), mean.alias("mean_bps"), F.sum(net).alias("total_bps"), F.avg("gross_bps").alias("gross_mean_bps"), F.sum("gross_bps").alias("gross_total_bps"), (-F.min("drawdown")).alias("max_drawdown_bps"),
            F.when(dev > 1e-15, mean / dev * F.sqrt(n)).otherwise(F.lit(0.0)).alias("naive_t"), F.when(dev > 1e-15, mean / dev).otherwise(F.lit(0.0)).alias("sharpe"),
            F.when(F.abs(lost) > 1e-15, F.coalesce(won, F.lit(0.0)) / F.abs(lost)).when(won.isNotNull(), F.lit(math.inf)).otherwise(F.lit(0.0)).alias("profit_factor"),
            F.when(F.abs(lost) > 1e-15, F.coalesce(F.avg(F.when(net > 0, net)) / F.abs(F.avg(F.when(net < 0, net))), F.lit(0.0))).otherwise(F.lit(0.0)).alias("payoff"), F.greatest(F.lit(0.0), mean / 2).alias("breakeven_bps"), F.countDistinct("session_id").alias("sessions"),
        )
        worst = F.greatest(F.lit(1), F.ceil(F.col("_n") * 0.05))
        share = F.greatest(F.lit(0), F.least(F.col("_c"), worst - F.col("_below")))
        tails = value_places(trades, "net_bps", keys).groupBy(*keys).agg((F.sum(net * share) / F.sum(share)).alias("shortfall_bps"))
        medians = quantiles(trades, "net_bps", [0.5], keys).select(*keys, F.col("_q")[0].alias("median_bps"))
        out = sums
        for part in (medians, tails):
            out = out.join(part, list(keys), "left") if keys else out.join(F.broadcast(part), how="left")
        return out

    return once(trades, build)


def cost_stress(trades: DataFrame, fee: float, slippage: float, extra: list[float], keys: tuple[str, ...] = ()) -> DataFrame:
    """Results with each extra cost a side: net = gross - 2 * (fee + slippage + extra)."""
    grid = trades.withColumn("extra_bps", F.explode(F.array(*(F.lit(float(x)) for x in extra))))
    net = F.col("gross_bps") - 2 * (F.lit(fee + slippage) + F.col("extra_bps"))
    return grid.withColumn("net_bps", net).groupBy(*keys, "extra_bps").agg(F.count(F.lit(1)).alias("trades"), F.avg("net_bps").alias("mean_bps"), F.sum("net_bps").alias("total_bps"), F.avg((F.col("net_bps") > 0).cast("int")).alias("win_rate"))


def session_table(trades: DataFrame, sessions: DataFrame) -> DataFrame:
    """Trades and results of every evaluated session, those without trades included."""
    return sessions.select("session_id").distinct().join(trades, "session_id", "left").groupBy("session_id").agg(F.count("net_bps").alias("trades"), F.coalesce(F.avg("net_bps"), F.lit(0.0)).alias("mean_bps"), F.coalesce(F.sum("net_bps"), F.lit(0.0)).alias("total_bps"))


def regimes(rows: DataFrame, column: str, prediction: str, target: str, least: int = 10) -> DataFrame:
    """Tercile buckets of a column with samples, IC and mean absolute error; buckets below least rows have samples only."""

    def build(rows: DataFrame) -> DataFrame:
        cuts = quantiles(rows, column, [1 / 3, 2 / 3]).select(F.col("_q")[0].alias("_a"), F.col("_q")[1].alias("_b"))
        bucket = F.when(F.col(column) <= F.col("_a"), "low").when(F.col(column) <= F.col("_b"), "middle").otherwise("high")
        enough = F.count(F.lit(1)) >= least
        return rows.crossJoin(F.broadcast(cuts)).groupBy(bucket.alias("regime")).agg(F.count(F.lit(1)).alias("samples"), F.when(enough, pearson(prediction, target)).alias("ic"), F.when(enough, F.avg(F.abs(F.col(prediction) - F.col(target)))).alias("mae"))

    return once(rows.select(column, prediction, target), build)


def capacity_summary(trades: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:

    def build(trades: DataFrame) -> DataFrame:
        ends = trades.groupBy(*keys).agg(F.min("capacity").alias("least"), F.max("capacity").alias("most"))
        middle = quantiles(trades, "capacity", [0.5], keys).select(*keys, F.col("_q")[0].alias("median"))
        return (ends.join(middle, list(keys), "left") if keys else ends.join(F.broadcast(middle), how="left")).select(*keys, "least", "median", "most")

    return once(trades.select(*keys, "capacity"), build)


def best_threshold(metrics: DataFrame, smallest: float, least_trades: int) -> float:
    """The threshold with the largest (mean, total, -drawdown) among those with enough trades; the smallest one otherwise."""
    rows = metrics.where(F.col("trades") >= least_trades).orderBy(F.desc("mean_bps"), F.desc("total_bps"), "max_drawdown_bps", "threshold").limit(1).collect()
    return rows[0].threshold if rows else smallest
