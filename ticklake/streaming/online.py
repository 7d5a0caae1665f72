"""Streaming forms: online quote features and scores, book synchronisation, monitor counters.

State is per session or symbol; rows of a micro-batch are put in order of event_ix inside the handler, since Spark
does not keep an order within a key. Results equal those of the batch plans.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..operators.features import FEATURES, WARM_UP
from ..operators.sync import SYNC_SCHEMA, Synchronizer, step

EPSILON = 1e-12


def online_row(history: list[tuple]) -> list[float] | None:
    """The 16 features of the last of WARM_UP + 1 quotes (ts_ns, bid, ask, bid_qty, ask_qty); None before there are as many."""
    if len(history) < WARM_UP + 1:
        return None
    ts = [h[0] for h in history]
    mid = [(h[1] + h[2]) / 2 for h in history]
    spread = [(h[2] - h[1]) / m * 1e4 for h, m in zip(history, mid, strict=True)]
    total = [h[3] + h[4] for h in history]
    imb = [(h[3] - h[4]) / t if t > 0 else 0.0 for h, t in zip(history, total, strict=True)]
    _, bid, ask, bq, aq = history[-1]
    micro = (ask * bq + bid * aq) / total[-1] if total[-1] > 0 else mid[-1]
    ret = lambda k, at=-1: math.log(mid[at] / mid[at - k]) * 1e4
    ones = [math.log(b / a) * 1e4 for a, b in zip(mid[-21:-1], mid[-20:], strict=True)]
    mean = sum(ones) / 20
    ten = (ts[-1] - ts[-11]) / 1e9
    return [spread[-1], imb[-1], (micro - mid[-1]) / mid[-1] * 1e4, math.log((bq + EPSILON) / (aq + EPSILON)), *(ret(k) for k in (1, 2, 5, 10, 25)), imb[-1] - imb[-2], imb[-1] - imb[-6], spread[-1] - spread[-2], math.log1p(max(ts[-1] - ts[-2], 0) / 1e3), 10 / ten if ten > 0 else 0.0, math.sqrt(max(sum(x * x for x in ones) / 20 - mean * mean, 0.0)), math.log((total[-1] + EPSILON) / (total[-2] + EPSILON))]


ONLINE = "session_id int, event_ix long, ts_ns long, " + ", ".join(f"{f} double" for f in FEATURES)
_COLUMNS = ["ts_ns", "best_bid", "best_ask", "bid_qty", "ask_qty"]


def online_features(quotes: DataFrame, max_gap_ns: int | None = None) -> DataFrame:
    """Features of a stream of quotes (session_id, event_ix, ts_ns, prices, quantities).

    A step back in time, a gap longer than max_gap_ns or a row with reset = true (if there is such a column) starts a
    new history. Invalid quotes are dropped.
    """

    def handle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        history = list(zip(*state.get, strict=True)) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("event_ix")
        out = []
        for ix, reset, *q in rows[["event_ix", "reset", *_COLUMNS]].itertuples(index=False):
            if history and (reset or q[0] < history[-1][0] or max_gap_ns is not None and q[0] - history[-1][0] > max_gap_ns):
                history = []
            history = [*history[-WARM_UP:], (int(q[0]), *map(float, q[1:]))]
            if values := online_row(history):
                out.append((key[0], ix, int(q[0]), *values))
        if history:
            state.update(tuple(list(c) for c in zip(*history, strict=True)))
        yield pd.DataFrame(out, columns=["session_id", "event_ix", "ts_ns", *FEATURES])

    from ..functions.quotes import valid_quote

    rows = quotes if "reset" in quotes.columns else quotes.withColumn("reset", F.lit(False))
    rows = rows.where(valid_quote()).select("session_id", "event_ix", "reset", *_COLUMNS)
    return rows.groupBy("session_id").applyInPandasWithState(handle, ONLINE, "ts array<bigint>, bid array<double>, ask array<double>, bq array<double>, aq array<double>", "append", "NoTimeout")


def scored_signals(features: DataFrame, score, threshold: float) -> DataFrame:
    """Scores and signals of a stream of features."""
    from ..functions.quotes import signal, threshold_multiple

    return features.withColumn("score", score).withColumns({"signal": signal(F.col("score"), F.lit(threshold)), "multiple": threshold_multiple(F.col("score"), F.lit(threshold))})


def synchronized(events: DataFrame) -> DataFrame:
    """Outcomes of a stream of depth events and snapshots (symbol, event_ix, kind, first_id, final_id) by symbol."""

    def handle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = Synchronizer()
        if state.exists:
            status, last, first, final = state.get
            s = Synchronizer(status, last, list(zip(first, final, strict=True)))
        rows = pd.concat(list(frames)).sort_values("event_ix")
        out = [step(s, r) for r in rows.to_dict("records")]
        state.update((s.status, int(s.last), [int(a) for a, _ in s.waiting], [int(b) for _, b in s.waiting]))
        yield pd.DataFrame(out)

    return events.select("symbol", "event_ix", "kind", "first_id", "final_id").groupBy("symbol").applyInPandasWithState(handle, SYNC_SCHEMA, "status string, last bigint, first array<bigint>, final array<bigint>", "append", "NoTimeout")


def counters(rows: DataFrame, kind: str = "signal") -> DataFrame:
    """Running counts by kind, for the monitor (complete output mode)."""
    return rows.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def gap_windows(rows: DataFrame, gap: str, lateness: str) -> DataFrame:
    """Session windows by event time (column at) with a watermark."""
    return rows.withWatermark("at", lateness).groupBy("session_id", F.session_window("at", gap)).agg(F.count(F.lit(1)).alias("n"))
