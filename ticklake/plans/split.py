"""Chronological splits of sessions into training, validation and test parts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST_ROWS = 100


@dataclass(frozen=True)
class Split:
    mode: str
    train: tuple[int, ...]
    validation: tuple[int, ...]
    test: tuple[int, ...]


def choose(counts: list[tuple[int, int]], least: int = LEAST_ROWS) -> Split | None:
    """Whole-session parts closest to 60/20/20 by rows (equal ones: the earliest cuts); counts are in time order.

    None if there are fewer than three sessions or every choice leaves a part with fewer than least rows.
    """
    total, ends, run = sum(n for _, n in counts), [], 0
    for _, n in counts:
        run += n
        ends.append(run)
    best = None
    for i in range(1, len(counts) - 1):
        for j in range(i + 1, len(counts)):
            if min(ends[i - 1], ends[j - 1] - ends[i - 1], total - ends[j - 1]) >= least:
                cost = (abs(ends[i - 1] - total * 0.6) + abs(ends[j - 1] - total * 0.8), i, j)
                best = min(best or cost, cost)
    if best is None:
        return None
    ids = tuple(s for s, _ in counts)
    return Split("whole_session", ids[: best[1]], ids[best[1] : best[2]], ids[best[2] :])


def chronological_split(rows: DataFrame, purge: int, least: int = LEAST_ROWS) -> DataFrame:
    """rows with part (train, validation, test); by whole sessions if that works, else 60/80 by row with purged gaps.

    The driver sees one count a session. Purged rows are left out.
    """
    counts = [(r.session_id, r.n) for r in rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).orderBy("session_id").collect()]
    split = choose(counts, least)
    if split:
        part = F.when(F.col("session_id").isin(*split.train), "train").when(F.col("session_id").isin(*split.validation), "validation").otherwise("test")
        return rows.withColumn("part", part)
    total, before, start = sum(n for _, n in counts), [], 0
    for s, n in counts:
        before.append((s, start))
        start += n
    first, second = int(total * 0.6), int(total * 0.8)
    if min(first, second - first - purge, total - second - purge) < least:
        raise ValueError("too few rows after splitting and purging")
    offset = F.create_map(*(F.lit(x) for pair in before for x in pair))[F.col("session_id")]
    place = offset + F.row_number().over(Window.partitionBy("session_id").orderBy("event_ix")) - 1
    part = F.when(place < first, "train").when((place >= first + purge) & (place < second), "validation").when(place >= second + purge, "test")
    return rows.withColumn("part", part).where(F.col("part").isNotNull())
