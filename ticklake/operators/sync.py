"""Joining a depth stream to its snapshot: which updates to drop, apply or wait with, and where the stream has a gap."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .book import fold


def continuity(updates: DataFrame, keys: tuple[str, ...], order: str = "event_ix") -> DataFrame:
    """updates with stale (all of it was seen before) and gap (ids are missing before it), by the largest final id so far."""
    seen = F.max("final_id").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return updates.withColumn("_seen", seen).withColumns({"stale": F.col("final_id") <= F.coalesce("_seen", F.lit(0)), "gap": F.col("first_id") > F.coalesce("_seen", "first_id") + 1}).drop("_seen")


@dataclass
class Synchronizer:
    """One symbol's stream. status: awaiting_snapshot, awaiting_bridge, live or gap; last is the newest applied id."""

    status: str = "awaiting_snapshot"
    last: int = 0
    waiting: list[tuple[int, int]] = field(default_factory=list)
    most: int = 200_000

    def update(self, first: int, final: int) -> str:
        """What becomes of an update: buffered, out_of_order, ignored_stale, applied or gap_detected.

        An update that ends before the last one that waits is refused, and the stream counts as broken.
        """
        if self.status in ("awaiting_snapshot", "gap"):
            if len(self.waiting) >= self.most:
                raise OverflowError("too many updates wait for a snapshot")
            if self.waiting and final < self.waiting[-1][1]:
                self.status = "gap"
                return "out_of_order"
            self.waiting.append((first, final))
            return "buffered"
        if final <= self.last:
            return "ignored_stale"
        if first > self.last + 1:
            self.status = "gap"
            self.waiting = [(first, final)]
            return "gap_detected"
        self.status, self.last = "live", final
        return "applied"

    def snapshot(self, last_id: int) -> tuple[str, list[tuple[int, int]]]:
        """Installs a snapshot; gives snapshot_too_old, awaiting_bridge, live or gap, and the waiting updates it let through.

        A gap among the waiting updates keeps that update and the rest waiting for the next snapshot.
        """
        rest = self.waiting = [u for u in self.waiting if u[1] > last_id]
        if rest and rest[0][0] > last_id + 1:
            return "snapshot_too_old", []
        self.last, self.waiting = last_id, []
        if not rest:
            self.status = "awaiting_bridge"
            return self.status, []
        self.status, done = "live", []
        for i, (first, final) in enumerate(rest):
            if final <= self.last:
                continue
            if first > self.last + 1:
                self.status, self.waiting = "gap", rest[i:]
                return "gap", done
            self.last = final
            done.append((first, final))
        return "live", done


SYNC_SCHEMA = "symbol string, event_ix long, outcome string, status string, last_id long, applied int"


def step(state: Synchronizer, row: dict) -> dict:
    """One row (symbol, event_ix, kind snapshot or update, first_id, final_id) through the synchronizer."""
    if row["kind"] == "snapshot":
        outcome, done = state.snapshot(row["final_id"])
    else:
        outcome = state.update(row["first_id"], row["final_id"])
        done = [None] if outcome == "applied" else []
    return {"symbol": row["symbol"], "event_ix": row["event_ix"], "outcome": outcome, "status": state.status, "last_id": state.last, "applied": len(done)}


def synchronize(events: DataFrame) -> DataFrame:
    """Outcome of each event (symbol, event_ix, kind, first_id, final_id), symbols side by side."""
    return fold(events.select("symbol", "event_ix", "kind", "first_id", "final_id"), ("symbol",), ("event_ix",), Synchronizer, lambda s, rows: [step(s, r) for r in rows], SYNC_SCHEMA)
