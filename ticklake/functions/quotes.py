"""Expressions over a quote: best_bid, best_ask, bid_qty, ask_qty, ts_ns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-12
bid, ask, bid_qty, ask_qty = "best_bid", "best_ask", "bid_qty", "ask_qty"


def finite(x: Column) -> Column:
    """Neither null, nor NaN, nor infinite."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def valid_quote() -> Column:
    """A positive time and finite, positive, uncrossed prices."""
    b, a = F.col(bid), F.col(ask)
    return (F.col("ts_ns") > 0) & finite(b) & finite(a) & (b > 0) & (a > 0) & (b <= a)


def mid() -> Column:
    return (F.col(bid) + F.col(ask)) / 2


def spread_bps() -> Column:
    return (F.col(ask) - F.col(bid)) / mid() * 1e4


def imbalance(b: Column | None = None, a: Column | None = None) -> Column:
    """(bid - ask) / (bid + ask); 0 where nothing is shown."""
    b, a = F.col(bid_qty) if b is None else b, F.col(ask_qty) if a is None else a
    return F.when(b + a > 0, (b - a) / (b + a)).otherwise(F.lit(0.0))


def microprice() -> Column:
    """Each price weighted by the other side's quantity; the mid where nothing is shown."""
    b, a, total = F.col(bid_qty), F.col(ask_qty), F.col(bid_qty) + F.col(ask_qty)
    return F.when(total > 0, (F.col(ask) * b + F.col(bid) * a) / total).otherwise(mid())


def microprice_edge_bps() -> Column:
    return (microprice() - mid()) / mid() * 1e4


def log_qty_ratio() -> Column:
    return F.ln((F.col(bid_qty) + EPSILON) / (F.col(ask_qty) + EPSILON))


def log_interarrival_us(delta_ns: Column) -> Column:
    return F.log1p(F.greatest(delta_ns.cast("double"), F.lit(0.0)) / 1e3)


def scaled(volume: Column, scale: float = 1e6) -> Column:
    """A stored whole number as a quantity."""
    return volume / F.lit(scale)


def standardized(x: Column, mean: Column, scale: Column, limit: float = 20.0) -> Column:
    """(x - mean) / scale, clipped; a scale of 1e-12 or less counts as 1."""
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), (x - mean) / F.when(scale > 1e-12, scale).otherwise(F.lit(1.0))))


def linear_score(values: list[Column], weights: list[float], intercept: float) -> Column:
    """intercept + sum of weight * value; null if a value is not finite."""
    if len(values) != len(weights):
        raise ValueError("as many weights as values are needed")
    total, good = F.lit(float(intercept)), F.lit(True)
    for v, w in zip(values, weights, strict=True):
        total, good = total + v * F.lit(float(w)), good & finite(v)
    return F.when(good, total)


def signal(prediction: Column, threshold: Column) -> Column:
    """LONG, SHORT or FLAT; a prediction of zero is FLAT at any threshold."""
    return F.when((prediction > 0) & (prediction >= threshold), "LONG").when((prediction < 0) & (prediction <= -threshold), "SHORT").otherwise("FLAT")


def threshold_multiple(prediction: Column, threshold: Column) -> Column:
    """abs(prediction) / threshold; null at threshold zero."""
    return F.when(threshold > 0, F.abs(prediction) / threshold)


def json_safe(x: Column) -> Column:
    """Null instead of NaN and infinities."""
    return F.when(finite(x), x)
