"""Order books from depth changes: by level lifetimes (an interval join) and by a sequential fold; depth features.

Changes are rows session_id, epoch, event_ix, side (bid, ask), price, qty; qty 0 deletes the level. A snapshot or a
break in the data starts a new epoch with an empty book. Rows with one event_ix are one event.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quotes import EPSILON, imbalance

KEYS = ("session_id", "epoch")
LEVELS = "array<struct<price:bigint,qty:bigint>>"
L2_WARM_UP = 25


def with_epochs(events: DataFrame, starts: Column) -> DataFrame:
    """events with epoch: the number of rows so far in the session for which starts holds."""
    w = Window.partitionBy("session_id").orderBy("event_ix").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("epoch", F.sum(starts.cast("int")).over(w).cast("long"))


def lifetimes(changes: DataFrame) -> DataFrame:
    """Each level quantity with the events [born, died) between which it stands; died is null while it stands at the end.

    If changes have a block, that of born (block) and that of died (died_block) come with them.
    """
    last = F.row_number().over(Window.partitionBy(*KEYS, "side", "price", "event_ix").orderBy(F.desc("part"))) if "part" in changes.columns else None
    rows = changes if last is None else changes.withColumn("_r", last).where("_r = 1").drop("_r")
    w = Window.partitionBy(*KEYS, "side", "price").orderBy("event_ix")
    blocks = [F.col("block"), F.lead("block").over(w).alias("died_block")] if "block" in changes.columns else []
    return rows.select(*KEYS, "side", "price", "qty", F.col("event_ix").alias("born"), F.lead("event_ix").over(w).alias("died"), *blocks)


def _best_standing(order: pa.ChunkedArray, start: np.ndarray, stop: np.ndarray, events: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """place of the event, rank from 0, and row, for the best depth levels of one side that stand after each event.

    Row i stands from place start[i] to before stop[i]; rows with one order are one price, and no two of them stand at
    once. Prices are taken best first, until all events have their levels.
    """
    price = pc.rank(order, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
    rows = np.flatnonzero(start < stop)
    rows = rows[np.argsort(price[rows], kind="stable")]
    ends = np.append(np.flatnonzero(np.diff(price[rows])) + 1, len(rows)) if len(rows) else []
    held, found, at = np.zeros(events, np.int64), np.full((events, depth), -1, np.int64), 0
    for end in ends:
        own, at = rows[at:end], end
        length = stop[own] - start[own]
        place = np.repeat(start[own] - np.cumsum(length) + length, length) + np.arange(length.sum())
        few = held[place] < depth
        found[place[few], held[place[few]]] = np.repeat(own, length)[few]
        held[place] += 1
        if held.min() >= depth:
            break
    place, rank = np.nonzero(found >= 0)
    return place, rank, found[place, rank]


def levels_by_interval(changes: DataFrame, depth: int, block: int | None = None) -> DataFrame:
    """session_id, epoch, event_ix, side, price, qty, rank: the best levels after each event, by joining events to lifetimes.

    The events of an epoch are cut into blocks of that many, and each lifetime goes to all blocks in which it stands, so
    an event meets the levels of its block instead of all of its session.
    """
    block = block or max(1, min(4096, 40_000 // depth))
    place = F.dense_rank().over(Window.partitionBy(*KEYS).orderBy("event_ix"))
    placed = changes.where(F.col("session_id").isNotNull() & F.col("epoch").isNotNull() & F.col("event_ix").isNotNull()).withColumn("block", F.floor((place - 1) / block))
    by = [*KEYS, "block"]
    ends = placed.groupBy(*KEYS).agg(F.max("block").alias("_end"))
    life = lifetimes(placed).where("qty > 0").join(ends, [*KEYS])
    life = life.withColumn("block", F.explode(F.sequence("block", F.coalesce("died_block", "_end"))))
    life = life.select(*(F.col(c).alias(f"_{c}") for c in by), "side", "price", "qty", "born", "died", F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price")).alias("order"))
    events = placed.select(*by, "event_ix").distinct()
    kinds = {c: changes.schema[c].dataType.simpleString() for c in (*KEYS, "event_ix", "side", "price", "qty")} | {"rank": "int"}

    def best(events: pa.Table, life: pa.Table) -> pa.Table:
        at = np.sort(events.column("event_ix").to_numpy())
        start = np.searchsorted(at, life.column("born").to_numpy())
        died = life.column("died")
        stop = np.where(died.is_null().to_numpy(), len(at), np.searchsorted(at, pc.fill_null(died, 0).to_numpy()))
        parts = []
        for side in life.column("side").unique():
            own = np.flatnonzero(pc.equal(life.column("side"), side).to_numpy() if side.is_valid else life.column("side").is_null().to_numpy())
            place, rank, row = _best_standing(life.column("order").take(own), start[own], stop[own], len(at), depth)
            levels = life.select(["side", "price", "qty"]).take(own[row])
            key = events.select([*KEYS]).take(np.zeros(len(row), np.int64))
            parts.append(pa.table([*key.columns, pa.array(at[place]), *levels.columns, pa.array((rank + 1).astype(np.int32))], names=list(kinds)))
        empty = pa.table([*events.select([*KEYS]).slice(0, 0).columns, pa.array(at[:0]), *life.select(["side", "price", "qty"]).slice(0, 0).columns, pa.array([], pa.int32())], names=list(kinds))
        return pa.concat_tables([empty, *parts])

    return events.groupBy(*by).cogroup(life.groupBy(*(f"_{c}" for c in by))).applyInArrow(best, ", ".join(f"{c} {k}" for c, k in kinds.items()))


class Book:
    """One book: quantities by price, and sorted prices, of both sides."""

    def __init__(self) -> None:
        self.qty: dict[str, dict[int, int]] = {"bid": {}, "ask": {}}
        self.prices: dict[str, list[int]] = {"bid": [], "ask": []}

    def set(self, side: str, price: int, qty: int) -> int:
        """Sets or deletes a level and returns what it held before."""
        levels, prices = self.qty[side], self.prices[side]
        before = levels.get(price, 0)
        if qty:
            if not before:
                bisect.insort(prices, price)
            levels[price] = qty
        elif before:
            del levels[price]
            del prices[bisect.bisect_left(prices, price)]
        return before

    def best(self, side: str, n: int | None = None) -> list[tuple[int, int]]:
        prices, levels = self.prices[side], self.qty[side]
        chosen = (prices[::-1] if n is None else prices[: -n - 1 : -1]) if side == "bid" else prices if n is None else prices[:n]
        return [(p, levels[p]) for p in chosen]


def fold(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], start: Callable, step: Callable, schema: str, end: Callable = lambda state: ()) -> DataFrame:
    """A sequential fold: start() makes a key's state, step(state, rows of one place) and end(state) give output rows.

    Rows are dealt by keys and sorted; they stream through, with the state of one key at a time in memory. A place is
    all rows that agree in keys and in the first column of order.
    """
    names = rows.columns
    k, at = [names.index(x) for x in keys], names.index(order[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = place = state = None
        held: list[dict] = []
        for b in batches:
            out: list[dict] = []
            columns = [c.to_pylist() for c in b.columns]
            for row in zip(*columns, strict=True):
                own = tuple(row[i] for i in k)
                if held and (own != key or row[at] != place):
                    out += step(state, held)
                    held = []
                if own != key:
                    if key is not None:
                        out += end(state)
                    key, state = own, start()
                place = row[at]
                held.append(dict(zip(names, row, strict=True)))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if held:
            yield pa.RecordBatch.from_pylist([*step(state, held), *end(state)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def slope(levels: list[tuple[int, int]], n: int = 10) -> float:
    """Least-squares slope of log(1 + cumulative quantity) over the distance from the best price in basis points; 0 without spread."""
    total, xs, ys = 0, [], []
    for price, qty in levels[:n]:
        total += qty
        xs.append(abs(price - levels[0][0]) / levels[0][0] * 1e4)
        ys.append(math.log1p(total))
    if len(xs) < 2:
        return 0.0
    mx, my = sum(xs) / len(xs), sum(ys) / len(ys)
    spread = sum((x - mx) ** 2 for x in xs)
    return sum((x - mx) * (y - my) for x, y in zip(xs, ys, strict=True)) / spread if spread > 0 else 0.0


def states(changes: DataFrame, depth: int | None = 20) -> DataFrame:
    """The book after each event (best levels of both sides; all with depth None), with the event's sums of additions and cancellations and the depth slopes.

    A price that changes twice in one event is compared with its quantity before the event both times.
    """

    def step(book: Book, rows: list[dict]) -> list[dict]:
        old = {(r["side"], r["price"]): book.qty[r["side"]].get(r["price"], 0) for r in rows}
        flow = {"bid": [0, 0], "ask": [0, 0]}
        for r in rows:
            change = r["qty"] - old[r["side"], r["price"]]
            flow[r["side"]][change < 0] += abs(change)
            book.set(r["side"], r["price"], r["qty"])
        best = {side: book.best(side, depth) for side in ("bid", "ask")}
        pack = lambda side: [{"price": p, "qty": q} for p, q in best[side]]
        return [{"bid_depth_slope_10": slope(best["bid"]), "ask_depth_slope_10": slope(best["ask"]), "session_id": rows[0]["session_id"], "epoch": rows[0]["epoch"], "event_ix": rows[0]["event_ix"], "ts_ns": rows[0]["ts_ns"], "bids": pack("bid"), "asks": pack("ask"), "added_bid": flow["bid"][0], "added_ask": flow["ask"][0], "cancelled_bid": flow["bid"][1], "cancelled_ask": flow["ask"][1]}]

    part = ["part"] if "part" in changes.columns else []
    rows = changes.select(*KEYS, "event_ix", "ts_ns", "side", "price", "qty", *part)
    return fold(rows, KEYS, ("event_ix", *part), Book, step, f"session_id int, epoch long, event_ix long, ts_ns long, bids {LEVELS}, asks {LEVELS}, added_bid long, added_ask long, cancelled_bid long, cancelled_ask long, bid_depth_slope_10 double, ask_depth_slope_10 double")


def crossed(state: DataFrame) -> DataFrame:
    """Events after which a side is empty or the best bid is not below the best ask."""
    return state.where((F.size("bids") == 0) | (F.size("asks") == 0) | (F.col("bids")[0]["price"] >= F.col("asks")[0]["price"]))


def quantity_at(changes: DataFrame, lookups: DataFrame) -> DataFrame:
    """lookups (session_id, epoch, event_ix, side, price) with the level's quantity after that event, 0 if absent.

    Backward as-of join: lookups and changes are sorted together and the last change carried forward.
    """
    key = [*KEYS, "side", "price"]
    both = changes.select(*key, "event_ix", "qty", F.lit(0).alias("_look")).unionByName(lookups.select(*key, "event_ix", F.lit(None).cast("long").alias("qty"), F.lit(1).alias("_look")))
    w = Window.partitionBy(*key).orderBy("event_ix", "_look").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("quantity", F.coalesce(F.last("qty", ignorenulls=True).over(w), F.lit(0))).where("_look = 1").drop("qty", "_look")


def _sum(levels: str, n: int) -> Column:
    return F.aggregate(F.slice(levels, 1, n), F.lit(0).cast("long"), lambda a, x: a + x["qty"]).cast("double")


def depth_columns(state: DataFrame) -> DataFrame:
    """What one book state says: prices, imbalances, depths, slopes; only where both sides stand."""
    rows = state.where((F.size("bids") > 0) & (F.size("asks") > 0))
    top = {"best_bid": F.col("bids")[0]["price"].cast("double"), "best_ask": F.col("asks")[0]["price"].cast("double"), "bid_qty": F.col("bids")[0]["qty"].cast("double"), "ask_qty": F.col("asks")[0]["qty"].cast("double")}
    sums = {f"{s}_{n}": _sum(f"{s}s", n) for s in ("bid", "ask") for n in (5, 10, 20)}
    weigh = lambda f: F.aggregate(F.concat(F.slice("bids", 1, 5), F.slice("asks", 1, 5)), F.lit(0.0), lambda a, x: a + f(x))
    rows = rows.withColumns(top | sums | {"_pq": weigh(lambda x: (x["price"] * x["qty"]).cast("double")), "_q": weigh(lambda x: x["qty"].cast("double"))})
    mid, total = (F.col("best_bid") + F.col("best_ask")) / 2, F.col("bid_qty") + F.col("ask_qty")
    micro = F.when(total > 0, (F.col("best_ask") * F.col("bid_qty") + F.col("best_bid") * F.col("ask_qty")) / total).otherwise(mid)
    c = F.col
    return rows.withColumns({"mid": mid, "spread_bps": (c("best_ask") - c("best_bid")) / mid * 1e4, "imbalance_1": imbalance(c("bid_qty"), c("ask_qty")), **{f"imbalance_{n}": imbalance(c(f"bid_{n}"), c(f"ask_{n}")) for n in (5, 10, 20)}, "microprice_edge_1_bps": (micro - mid) / mid * 1e4,
        "depth_weighted_mid_edge_5_bps": (F.when(c("_q") > 0, c("_pq") / c("_q")).otherwise(mid) - mid) / mid * 1e4, "log_bid_depth_5": F.log1p("bid_5"), "log_ask_depth_5": F.log1p("ask_5"),
        "bid_concentration_1_10": c("bid_qty") / F.greatest(c("bid_10"), F.lit(EPSILON)), "ask_concentration_1_10": c("ask_qty") / F.greatest(c("ask_10"), F.lit(EPSILON)), "bid_convexity_5_20": F.ln((c("bid_20") + EPSILON) / (c("bid_5") + EPSILON)), "ask_convexity_5_20": F.ln((c("ask_20") + EPSILON) / (c("ask_5") + EPSILON)),
        "depth_addition_imbalance": imbalance(c("added_bid").cast("double"), c("added_ask").cast("double")), "cancellation_imbalance": imbalance(c("cancelled_ask").cast("double"), c("cancelled_bid").cast("double"))}).drop("_pq", "_q")


def order_flow(w) -> Column:
    """Top-of-book order-flow imbalance against the observation before; 0 at the first."""
    b, a, bq, aq = (F.col(x) for x in ("best_bid", "best_ask", "bid_qty", "ask_qty"))
    pb, pa_, pbq, paq = (F.lag(x, 1).over(w) for x in ("best_bid", "best_ask", "bid_qty", "ask_qty"))
    bid = F.when(b > pb, bq).when(b == pb, bq - pbq).otherwise(-pbq)
    ask = F.when(a < pa_, -aq).when(a == pa_, paq - aq).otherwise(paq)
    return F.when(pb.isNull(), F.lit(0.0)).otherwise(bid + ask)


def trade_flow(trades: DataFrame, last: int = 20) -> DataFrame:
    """trades (keys, event_ix, signed_qty) with the imbalance of the last ones, that one included."""
    w = Window.partitionBy(*KEYS).orderBy("event_ix").rowsBetween(-(last - 1), 0)
    size = F.sum(F.abs("signed_qty")).over(w)
    return trades.withColumn("trade_imbalance_20", F.when(size > 0, F.sum("signed_qty").over(w) / size).otherwise(F.lit(0.0)))


def with_trade_flow(rows: DataFrame, trades: DataFrame) -> DataFrame:
    """rows with the trade imbalance as it stood before each event (0 before the first trade of the epoch)."""
    flow = trade_flow(trades).select(*KEYS, "event_ix", "trade_imbalance_20", F.lit(1).alias("_trade"))
    both = rows.withColumn("_trade", F.lit(0)).unionByName(flow, allowMissingColumns=True)
    w = Window.partitionBy(*KEYS).orderBy("event_ix", "_trade").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.coalesce(F.last(F.when(F.col("_trade") == 1, F.col("trade_imbalance_20")), ignorenulls=True).over(w), F.lit(0.0))
    return both.withColumn("_carried", carried).where("_trade = 0").drop("_trade", "trade_imbalance_20").withColumnRenamed("_carried", "trade_imbalance_20")


L2_FEATURES = ("spread_bps", "imbalance_1", "imbalance_5", "imbalance_10", "imbalance_20", "microprice_edge_1_bps", "depth_weighted_mid_edge_5_bps", "log_bid_depth_5", "log_ask_depth_5", "bid_depth_slope_10", "ask_depth_slope_10", "bid_concentration_1_10", "ask_concentration_1_10", "bid_convexity_5_20", "ask_convexity_5_20", "top_of_book_ofi", "depth_addition_imbalance", "cancellation_imbalance", "trade_imbalance_20", "mid_return_1", "mid_return_5", "realized_volatility_20", "log_interarrival_us", "event_rate_10", "spread_change_1", "imbalance_change_1")


def l2_history(rows: DataFrame) -> DataFrame:
    """Depth columns with what depends on earlier observations of the epoch: zero, not null, while history is short."""
    w = Window.partitionBy(*KEYS).orderBy("event_ix")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    ret = lambda k: zero(F.ln(F.col("mid") / F.lag("mid", k).over(w)) * 1e4)
    gap = F.col("ts_ns") - F.lag("ts_ns", 1).over(w)
    ten = (F.col("ts_ns") - F.lag("ts_ns", 10).over(w)) / 1e9
    out = rows.withColumns({"top_of_book_ofi": order_flow(w), "mid_return_1": ret(1), "mid_return_5": ret(5), "log_interarrival_us": F.log1p(F.greatest(zero(gap.cast("double")), F.lit(0.0)) / 1e3), "event_rate_10": F.when(ten > 0, 10 / ten).otherwise(F.lit(0.0)), "spread_change_1": zero(F.col("spread_bps") - F.lag("spread_bps", 1).over(w)), "imbalance_change_1": zero(F.col("imbalance_1") - F.lag("imbalance_1", 1).over(w)), "place": F.row_number().over(w)})
    last = w.rowsBetween(-19, 0)
    mean = F.avg("mid_return_1").over(last)
    spread = F.sqrt(F.greatest(F.avg(F.col("mid_return_1") * F.col("mid_return_1")).over(last) - mean * mean, F.lit(0.0)))
    return out.withColumn("realized_volatility_20", F.when(F.col("place") >= 20, spread).otherwise(F.lit(0.0)))


def l2_features(changes: DataFrame, trades: DataFrame, horizon: int | None = None) -> DataFrame:
    """The 26 depth features of each event from the 26th observation of its epoch on, with labels if a horizon is given.

    ix counts observations over the whole session, so that waiting times run on across epochs; labels stay in an epoch.
    """
    rows = with_trade_flow(l2_history(depth_columns(states(changes))), trades).where(F.col("place") > L2_WARM_UP)
    if horizon is None:
        return rows
    w = Window.partitionBy(*KEYS).orderBy("event_ix")
    ahead = rows.withColumns({f"future_{c}": F.lead(c, horizon).over(w) for c in ("best_bid", "best_ask", "bid_qty", "ask_qty", "mid")})
    ix = (F.row_number().over(Window.partitionBy("session_id").orderBy("event_ix")) - 1).cast("long")
    return ahead.where(F.col("future_mid").isNotNull()).withColumns({"target": F.ln(F.col("future_mid") / F.col("mid")) * 1e4, "ix": ix})


def state_hash(update_id: int, bids: list[tuple[int, int]], asks: list[tuple[int, int]]) -> int:
    """64-bit FNV-1a over update id, and for each side its number of levels and their prices and quantities (little-endian)."""
    import struct

    h = 0xCBF29CE484222325
    data = struct.pack("<QQ", update_id, len(bids)) + b"".join(struct.pack("<qQ", *x) for x in bids) + struct.pack("<Q", len(asks)) + b"".join(struct.pack("<qQ", *x) for x in asks)
    for byte in data:
        h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def hashed(state: DataFrame, update_id: str = "event_ix") -> DataFrame:
    """States with state_hash as text (unsigned 64 bits do not fit a long); states need all levels (depth None)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = lambda c, b=b: [[(x["price"], x["qty"]) for x in side] for side in b.column(c).to_pylist()]
            hashes = [str(state_hash(u, x, y)) for u, x, y in zip(b.column("_u").to_pylist(), pairs("bids"), pairs("asks"), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(hashes, pa.string())], [*b.schema.names[:-1], "state_hash"])

    rows = state.withColumn("_u", F.col(update_id))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema.fields)
    return rows.mapInArrow(run, f"{fields}, state_hash string")


def verify_checkpoints(hashed_states: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Checkpoints (session_id, event_ix, state_hash) that replay does not reproduce."""
    own = hashed_states.select("session_id", "event_ix", F.col("state_hash").alias("_own"))
    return checkpoints.join(own, ["session_id", "event_ix"], "left").where(F.col("_own").isNull() | (F.col("_own") != F.col("state_hash"))).drop("_own")
