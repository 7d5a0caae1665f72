"""Books, synchronisation, simulated execution and file formats against simple models and worked cases."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticklake.operators import book, simulator, stats, sync
from ticklake.operators.simulator import SCALE, Case, simulate
from ticklake.plans import research, ridge, split
from ticklake.sources import codecs, tables


def event(kind, ts, ix, bids=(), asks=(), first=0, final=0, **more):
    return {"kind": kind, "ts_ns": ts, "event_ix": ix, "bids": [(int(p * SCALE), int(q * SCALE)) for p, q in bids], "asks": [(int(p * SCALE), int(q * SCALE)) for p, q in asks], "first_id": first, "final_id": final} | more


def market(trade=None, update=None):
    out = [event("snapshot", 1_000, 0, [(100, 5), (99, 10)], [(101, 5), (102, 10)], 1, 1)]
    out.append(event("depth", 2_000, 1, *(update or ([(98, 1)], [])), first=2, final=2))
    if trade:
        out.append(event("trade", 3_000, 2, trade_price=trade[0] * SCALE, trade_qty=trade[1] * SCALE, buyer_is_maker=trade[2]))
    return out


def order(i="a", side="buy", qty=1, limit=None, at=1_100, ttl=None):
    return {"kind": "order", "order_id": i, "decision_ns": at, "side": side, "qty": qty * SCALE, "limit_price": None if limit is None else int(limit * SCALE), "ttl_ns": ttl}


FAST = Case(transmission_ns=0, cancel_ns=0)


def test_market_order_walks_the_book():
    m = simulate(market(), [order(qty=6)], FAST)
    assert [(f.price // SCALE, f.qty // SCALE) for f in m.fills] == [(101, 5), (102, 1)]
    assert m.orders["a"].status == "filled"


def test_leftover_does_not_rest():
    m = simulate(market(), [order(qty=7, limit=101)], FAST)
    assert (m.orders["a"].status, m.orders["a"].filled // SCALE, m.orders["a"].reason) == ("partially_filled", 5, "insufficient_visible_depth")


def test_passive_fill_after_the_queue():
    m = simulate(market(trade=(100, 6, True)), [order(limit=100)], FAST)
    assert [(f.qty // SCALE, f.maker) for f in m.fills] == [(1, True)]
    assert not simulate(market(trade=(100, 6, False)), [order(limit=100)], FAST).fills


def test_depth_decrease_fills_by_model():
    less = ([(100, 3)], [])
    fills = lambda model, ahead: len(simulate(market(update=less), [order(limit=100)], Case(transmission_ns=0, model=model, queue_share=ahead)).fills)
    assert [fills(m, 0.2) for m in simulator.MODELS] == [0, 0, 1]
    assert [fills(m, 0.0) for m in simulator.MODELS] == [0, 1, 1]


def test_order_at_the_event_time_sees_the_new_book():
    new_ask = ([], [(101, 0), (100.5, 2)])
    price = lambda at: simulate(market(update=new_ask), [order(at=at)], FAST).fills[0].price / SCALE
    assert (price(1_500), price(2_000)) == (101, 100.5)


def test_consumed_quantity_comes_back_only_with_its_level():
    m = simulate(market(trade=(90, 1, True)), [order("a", qty=5, limit=101), order("b", qty=5, limit=101, at=2_500)], FAST)
    assert m.orders["b"].status == "rejected"
    m = simulate(market(trade=(90, 1, True), update=([], [(101, 5)])), [order("a", qty=5, limit=101), order("b", qty=5, limit=101, at=2_500)], FAST)
    assert m.orders["b"].status == "filled"


def test_controls_and_limits():
    cancel = {"kind": "cancel", "order_id": "a", "decision_ns": 1_200, "side": None, "qty": None, "limit_price": None, "ttl_ns": None}
    assert simulate(market(), [order(limit=99), cancel], FAST).orders["a"].status == "cancelled"
    late = simulate(market(), [order(limit=99, at=1_100), cancel], Case(transmission_ns=500, cancel_ns=0))
    assert (late.orders["a"].status, late.orders["a"].reason) == ("cancelled", "cancel_arrived_before_order")
    assert simulate(market(), [order(limit=99, ttl=100)], FAST).orders["a"].status == "expired"
    assert simulate(market(), [order(at=9_000)], FAST).orders["a"].reason == "recording_ended_before_arrival"
    assert simulate(market(), [order(qty=20)], FAST).orders["a"].reason == "position_limit"
    assert simulate(market(), [order(at=500)], FAST).orders["a"].reason == "book_unavailable"
    assert simulate([*market(), event("boundary", 5_000, 9)], [order(limit=99)], FAST).orders["a"].reason == "market_data_boundary"
    with pytest.raises(ValueError):
        simulate(market(), [order(), order()], FAST)


def test_kill_switch_is_sticky():
    down = event("depth", 3_000, 2, [(100, 0), (50, 1)], [(101, 0), (102, 0), (51, 1)], 3, 3)
    m = simulate([*market(), down], [order(qty=5), order("b", at=3_500)], Case(transmission_ns=0, kill_loss=10.0))
    assert m.killed


def test_fees_and_markouts():
    later = event("depth", 2_000_000, 2, [(100, 0), (100.5, 1)], [(101, 0), (101.5, 1)], 3, 3)
    m = simulate([*market(), later], [order(qty=1)], Case(transmission_ns=0, taker_bps=10, horizons=(1_000_000,)))
    assert m.fills[0].fee == pytest.approx(0.101)
    assert m.fills[0].markouts[1_000_000] == pytest.approx((101 - 101) / 101 * 1e4)


def test_queue_equals_orders_one_by_one():
    """Offsets in a level's volume against a count of what stands before each order; every order sees all volume."""
    r = random.Random(3)
    for _ in range(200):
        queue, before, open_, t = simulator.Queue(), {}, {}, 0
        for _ in range(40):
            t += 1
            what = r.random()
            if what < 0.4:
                o = simulator.Order(f"o{t}", "bid", r.randint(1, 30), 100, t, None)
                shown = r.randint(0, 20) * r.choice((0.0, 0.5, 1.0))
                before[o.turn] = shown + sum(x.left for x in open_.values())
                open_[o.turn] = o
                queue.join(o, shown)
            elif what < 0.5 and open_:
                queue.leave(open_.pop(r.choice(list(open_))))
            else:
                volume = r.randint(1, 25) * r.choice((0.5, 1.0))
                offers = {turn: qty for turn, _, qty in queue.flow(volume) if qty}
                want = {turn: int(max(0.0, volume - before[turn])) for turn in open_}
                assert offers == {turn: qty for turn, qty in want.items() if qty}
                for turn, o in list(open_.items()):
                    before[turn] = max(0.0, before[turn] - volume)
                    done = min(o.left, want[turn])
                    o.filled += done
                    queue.resting -= done
                    if not o.left:
                        queue.leave(open_.pop(turn))
            assert queue.resting == sum(o.left for o in open_.values())


def test_position_limit_within_a_fill_leaves_the_order_open():
    sell = event("trade", 3_000, 2, trade_price=100 * SCALE, trade_qty=20 * SCALE, buyer_is_maker=True)
    m = simulate([*market(), sell], [order("a", qty=8, limit=100), order("b", qty=8, limit=100)], Case(transmission_ns=0, queue_share=0.0))
    assert (m.orders["a"].status, m.orders["a"].filled // SCALE) == ("filled", 8)
    assert (m.orders["b"].status, m.orders["b"].reason, m.position // SCALE) == ("expired", "position_limit_during_partial_fill", 8)


def test_summary_has_status_counts_and_markouts():
    later = event("depth", 2_000_000, 3, [(100, 0), (100.5, 1)], [(101, 0), (101.5, 1)], 3, 3)
    trade = event("trade", 3_000, 2, trade_price=100 * SCALE, trade_qty=6 * SCALE, buyer_is_maker=True)
    asked = [order("a", qty=2), order("b", limit=100), order("c", limit=99, ttl=100), order("d", at=9_000_000), order("e", qty=20)]
    got = simulate([*market(), trade, later], asked, Case(transmission_ns=0, taker_bps=10, horizons=(1_000_000, 10**12))).summary()
    assert dict(got["status_counts"]) == {"pending": 0, "open": 0, "partially_filled": 0, "filled": 2, "cancelled": 0, "rejected": 1, "expired": 2}
    assert (got["maker_qty"], got["taker_qty"], got["maker_share"]) == (1.0, 2.0, pytest.approx(1 / 3))
    assert got["mean_markout_bps"] == [("1000000_ns", pytest.approx((0.0 + 100.0) / 2))]
    with pytest.raises(ValueError):
        Case(horizons=(5, 5))
    with pytest.raises(TypeError):
        Case(decision_ns=1.5)


def test_grid_streams_requests_beside_events(spark):
    """All cases in one pass over sorted rows against each case alone, with requests at, before and after events, and cancels."""
    r = random.Random(8)
    events, asked = [], []
    for s in range(3):
        own = [event("snapshot", 1_000, 0, [(100, 5), (99, 10)], [(101, 5), (102, 10)], 1, 1)]
        for i in range(1, 120):
            ts = 1_000 + i * 10 + r.choice((0, 0, -15))
            if r.random() < 0.4:
                own.append(event("trade", ts, i, trade_price=r.choice((99, 100, 101)) * SCALE, trade_qty=r.randint(1, 4) * SCALE, buyer_is_maker=r.random() < 0.5))
            else:
                own.append(event("depth", ts, i, [(r.choice((99, 100)), r.randint(1, 9))], [(r.choice((101, 102)), r.randint(1, 9))], max(e["final_id"] for e in own) + 1, max(e["final_id"] for e in own) + 1))
        events += [{"session_id": s, "trade_price": None, "trade_qty": None, "buyer_is_maker": None} | e for e in own]
        for i in range(60):
            at = r.randint(900, 2_500)
            asked.append({"session_id": s} | order(f"o{i}", r.choice(("buy", "sell")), 1, r.choice((None, 99, 100, 101, 102)), at, r.choice((None, 100))))
            if r.random() < 0.3:
                asked.append(asked[-1] | {"kind": "cancel", "decision_ns": at + r.randint(-20, 100)})
    cases = {m: Case(model=m, transmission_ns=d, cancel_ns=5, most_position=5 * SCALE, queue_share=0.5, horizons=(50,)) for m, d in zip(simulator.MODELS, (0, 10, 40))}
    level = "array<struct<price:bigint,qty:bigint>>"
    shaped = [e | {k: [{"price": p, "qty": q} for p, q in e[k]] for k in ("bids", "asks")} for e in events]
    got = simulator.sensitivity_grid(
        spark.createDataFrame(shaped, f"session_id int, event_ix long, ts_ns long, kind string, first_id long, final_id long, bids {level}, asks {level}, trade_price long, trade_qty long, buyer_is_maker boolean"),
        spark.createDataFrame(asked, "session_id int, kind string, order_id string, decision_ns long, side string, qty long, limit_price long, ttl_ns long"),
        cases,
    ).collect()
    assert len(got) == 9
    for row in got:
        alone = simulate([e for e in events if e["session_id"] == row.session_id], [a for a in asked if a["session_id"] == row.session_id], cases[row.case_id]).summary()
        alone |= {"status_counts": dict(alone["status_counts"]), "mean_markout_bps": dict(alone["mean_markout_bps"])}
        assert row.asDict() == {"case_id": row.case_id, "session_id": row.session_id} | alone and alone["fills"] > 5


def test_gap_raises():
    with pytest.raises(RuntimeError):
        simulate([*market(), event("depth", 3_000, 2, [(97, 1)], [], 9, 9)], [], FAST)


def test_synchronizer_bridge_gap_and_old_snapshot():
    s = sync.Synchronizer()
    assert [s.update(99, 101), s.update(102, 103)] == ["buffered"] * 2
    assert s.snapshot(100) == ("live", [(99, 101), (102, 103)])
    assert [s.update(90, 103), s.update(104, 104), s.update(106, 107)] == ["ignored_stale", "applied", "gap_detected"]
    assert s.snapshot(100)[0] == "snapshot_too_old"
    assert s.snapshot(105) == ("live", [(106, 107)])
    s = sync.Synchronizer()
    s.update(150, 151)
    assert s.snapshot(100)[0] == "snapshot_too_old"
    s = sync.Synchronizer(waiting=[(90, 95), (150, 151)])
    assert s.snapshot(100)[0] == "snapshot_too_old" and s.waiting == [(150, 151)]
    assert [s.update(152, 152), s.update(140, 149), s.status] == ["buffered", "out_of_order", "gap"] and s.waiting[-1] == (152, 152)
    s = sync.Synchronizer(waiting=[(101, 102), (105, 106), (107, 107)])
    assert s.snapshot(100) == ("gap", [(101, 102)]) and s.waiting == [(105, 106), (107, 107)]


@pytest.mark.parametrize("block", [1, 7, 64, None])
def test_levels_by_interval_in_blocks_of_events(spark, block):
    """Two sessions, two epochs, deep and empty books, levels that never change, events of several changes, a price set twice in one."""
    r = random.Random(23)
    rows = [(s, e, -1, 0, "bid", p, 9) for s in (0, 1) for e in (0, 1) for p in range(900, 900 + 40 * s)]
    for s, e, i in ((s, e, i) for s in (0, 1) for e in (0, 1) for i in range(150)):
        for part in range(r.choice((1, 1, 3))):
            side = r.choice(("bid", "ask"))
            rows.append((s, e, i * 10, part, side, (1000 - r.randint(1, 3)) if side == "bid" else 1000 + r.randint(1, 3), r.choice((0, 0, 1, 5))))
    rows = list({(s, e, i, part, side, p): (s, e, i, part, side, p, q) for s, e, i, part, side, p, q in ((s, e, i, n if i < 0 else part, side, p, q) for n, (s, e, i, part, side, p, q) in enumerate(rows))}.values())
    df = spark.createDataFrame(rows, "session_id int, epoch long, event_ix long, part int, side string, price long, qty long")
    want, levels = set(), {}
    for at in sorted({x[:3] for x in rows}):
        for s, e, _, _, side, p, q in sorted(x for x in rows if x[:3] == at):
            levels[s, e, side, p] = q
        for side, sign in (("bid", -1), ("ask", 1)):
            best = sorted(((p, q) for (s, e, d, p), q in levels.items() if (s, e, d) == (*at[:2], side) and q), key=lambda x: sign * x[0])
            want |= {(*at, side, p, q, k + 1) for k, (p, q) in enumerate(best[:5])}
    found = book.levels_by_interval(df, 5, **({"block": block} if block else {}))
    got = [tuple(x) for x in found.collect()]
    assert found.columns == ["session_id", "epoch", "event_ix", "side", "price", "qty", "rank"] and len(got) == len(set(got)) and set(got) == want
    assert book.levels_by_interval(df.limit(0), 5).isEmpty()


def test_levels_by_interval_meet_events_of_their_block_only(spark, sf):
    """A join by session compares each event with all lifetimes of the session, whose number grows with the events."""
    from ticklake.queries import QUERIES

    plan = QUERIES["book_top5_by_interval"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert ">= born" not in plan and "block" in plan


def test_book_by_fold_equals_model_and_intervals(spark):
    r = random.Random(17)
    rows = [(0, 0, i, i, r.choice(("bid", "ask")), 0, r.randint(0, 5)) for i in range(400)]
    rows = [(s, e, i, t, side, (1000 - r.randint(1, 20) if side == "bid" else 1000 + r.randint(1, 20)), q) for s, e, i, t, side, _, q in rows]
    df = spark.createDataFrame(rows, "session_id int, epoch long, event_ix long, ts_ns long, side string, price long, qty long")
    got = {x.event_ix: x for x in book.states(df, 5).collect()}
    levels = {"bid": {}, "ask": {}}
    for _, _, i, _, side, p, q in rows:
        levels[side].pop(p, None)
        if q:
            levels[side][p] = q
        assert [(x.price, x.qty) for x in got[i].bids] == sorted(levels["bid"].items(), reverse=True)[:5]
        assert [(x.price, x.qty) for x in got[i].asks] == sorted(levels["ask"].items())[:5]
    by_interval = {(x.event_ix, x.side, x.rank, x.price, x.qty) for x in book.levels_by_interval(df, 5).collect()}
    assert by_interval == {(i, s, k + 1, x.price, x.qty) for i, g in got.items() for s, v in (("bid", g.bids), ("ask", g.asks)) for k, x in enumerate(v)}


def test_state_hash_is_fnv():
    assert book.state_hash(0, [], []) != book.state_hash(1, [], []) < 1 << 64


def test_direction_metrics_by_hand(spark):
    rows = spark.createDataFrame(list(zip((1.0, 1.0, -1.0, 0.0, 1.0, -1.0), (1.0, -1.0, -1.0, 1.0, 0.0, -1.0))), "p double, t double")
    m = stats.direction_metrics(rows, "p", "t").first()
    assert (m.nonzero_targets, m.abstentions) == (5, 1)
    for name, want in (("zero_fraction", 1 / 6), ("majority_accuracy", 3 / 5), ("accuracy", 3 / 5), ("lift", 0), ("balanced_accuracy", 7 / 12), ("coverage", 4 / 5), ("actionable_accuracy", 3 / 4)):
        assert m[name] == pytest.approx(want)


def test_split_choice():
    assert split.choose([(i, 450) for i in range(5)]) == split.Split("whole_session", (0, 1, 2), (3,), (4,))
    assert split.choose([(0, 500), (1, 500)]) is None


def test_ridge_equals_augmented_least_squares(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=300)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, target double")
    m = ridge.fit(df, df, ("a", "b", "c"), penalties=(10.0,))
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.lstsq(np.vstack([z, np.sqrt(10.0) * np.eye(3)]), np.concatenate([y - y.mean(), np.zeros(3)]), rcond=None)[0]
    assert np.allclose(m.beta, want, atol=1e-8) and m.intercept == pytest.approx(y.mean())


def test_pipeline_end_to_end(spark, sf):
    from ticklake.operators.features import tob_features
    from ticklake.sources.views import quotes

    rows = tob_features(quotes(spark, sf), 20)
    out = research.train_and_evaluate(rows, 20)
    assert set(out["rows"]) == {"train", "validation", "test"} and out["test"]["regression"]["n"] == out["rows"]["test"]
    prior = spark.createDataFrame([(f,) for f in out["holdout"].values()], "fingerprint string")
    with pytest.raises(ValueError):
        research.train_and_evaluate(rows, 20, prior_fingerprints=prior)
    assert research.evidence_card(out).startswith("# Evidence card")


def test_training_never_sees_the_test_part(spark):
    base = spark.range(600).select(F.col("id").alias("event_ix"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("target"))
    train, validation = base.where("event_ix < 300"), base.where("event_ix >= 300")
    poisoned = base.withColumn("x", F.when(F.col("event_ix") >= 500, F.lit(1e9)).otherwise(F.col("x")))
    assert ridge.fit(train, validation, ("x",)).mean == ridge.fit(poisoned.where("event_ix < 300"), validation, ("x",)).mean


QUOTES = np.array([(1 + i, 100.0, 100.5, 10, 20) for i in range(10)], codecs.QUOTE_RECORD)


def test_quote_files(spark, tmp_path):
    (tmp_path / "a.qbin").write_bytes(codecs.encode_quotes(5, QUOTES))
    rows = codecs.read_quotes(spark, str(tmp_path)).orderBy("event_ix").collect()
    assert [(r.ts_ns, r.best_bid, r.ask_volume) for r in rows] == [(1 + i, 100.0, 20) for i in range(10)]
    assert list(codecs.decode_ids(codecs.encode_ids(5, np.array([1, 5, 9])), 5)) == [1, 5, 9]
    for bad in (codecs.encode_ids(5, np.array([1, 1])), codecs.encode_ids(4, np.array([1])), b"", codecs.encode_ids(5, np.array([1]))[:-3]):
        with pytest.raises(ValueError):
            codecs.decode_ids(bad, 5)


def depth_file():
    e = codecs.encode_event
    return codecs.encode_depth(7, "BTCUSDT", [e("snapshot", 10, first_id=1, final_id=1, bids=[(100, 5)], asks=[(101, 6)]), e("depth", 11, 3, 2, 2, [(100, 0)]), e("trade", 12, 4, 9, trade_price=100, trade_qty=3, flags=1), e("boundary", 13, flags=4)])


def test_depth_files(spark, tmp_path):
    (tmp_path / "a.l2bin").write_bytes(depth_file())
    rows = codecs.read_depth(spark, str(tmp_path)).orderBy("event_ix").collect()
    assert [r.kind for r in rows] == ["snapshot", "depth", "trade", "boundary"] and rows[0].symbol == "BTCUSDT"
    assert [(x.price, x.qty) for x in rows[0].asks] == [(101, 6)] and rows[1].bids[0].qty == 0


def test_damaged_depth_files_raise_and_never_crash():
    data = depth_file()
    r = random.Random(3)
    for _ in range(300):
        spoiled = bytearray(data)
        spoiled[r.randrange(len(data))] ^= 1 << r.randrange(8)
        spoiled = bytes(spoiled[: r.randrange(len(data))]) if r.random() < 0.5 else bytes(spoiled)
        try:
            list(codecs.decode_depth(spoiled))
        except ValueError:
            pass


def test_checkpoints():
    good = codecs.encode_checkpoints(7, [(1, 2, 3), (4, 5, 6)])
    assert codecs.decode_checkpoints(good, 7)["update_id"].tolist() == [2, 5]
    with pytest.raises(ValueError):
        codecs.decode_checkpoints(codecs.encode_checkpoints(7, [(4, 2, 3), (4, 5, 6)]), 7)


def test_fixed_decimals(spark):
    from ticklake.functions.parsing import fixed_decimal

    cases = {"64130.50000000": 6_413_050_000_000, "1.25000000": 125_000_000, "1.000000001": None, "1.000000000": 100_000_000, "-1": None, "1e5": None, "": None, "7": 700_000_000}
    rows = spark.createDataFrame([(k,) for k in cases], "v string").select("v", fixed_decimal(F.col("v")).alias("u")).collect()
    assert {r.v: r.u for r in rows} == cases


def test_messages(spark):
    from ticklake.functions.parsing import depth_messages, top_of_book

    quotes = spark.createDataFrame([('{"s":"ABC","u":5,"b":"1.5","B":"2","a":"1.6","A":"3"}',), ('{"s":"ABC","u":5,"b":"1.7","B":"2","a":"1.6","A":"3"}',), ("junk",), ('{"s":"XYZ","u":5,"b":"1.5","B":"2","a":"1.6","A":"3"}',)], "value string")
    assert [(r.best_bid, r.ask_volume) for r in top_of_book(quotes, "ABC").collect()] == [(1.5, 3_000_000)]
    depth = spark.createDataFrame([('{"stream":"x","data":{"e":"depthUpdate","E":1,"s":"ABC","U":1,"u":2,"b":[["1.5","0"]],"a":[]}}',), ('{"stream":"x","data":{"e":"aggTrade","E":1,"s":"ABC","t":1,"p":"0","q":"1","m":true}}',), ("junk",)], "value string")
    assert sorted((r.kind or "", r.corrupt) for r in depth_messages(depth).collect()) == [("", True), ("depth", False), ("trade", True)]


def test_orders_models_and_publishing(spark, tmp_path):
    (tmp_path / "orders.csv").write_text("order_id,decision_timestamp_ns,side,order_type,quantity,limit_price\na,10,BUY,limit,1.5,100\nb,11,sell,market,2,\n")
    rows = {r.order_id: r for r in tables.read_orders(spark, str(tmp_path / "orders.csv")).collect()}
    assert rows["a"].limit_price == 100 * SCALE and rows["b"].limit_price is None and rows["a"].qty == 15 * SCALE // 10
    model = tables.model_row(spark, {"beta": [1.0]}, [("x", "plain")])
    assert tables.load_model(model, [("x", "plain")]) == {"beta": [1.0]}
    with pytest.raises(ValueError):
        tables.load_model(model, [("x", "other")])
    to = str(tmp_path / "out")
    tables.publish({"model": model}, {"ok": 1}, to)
    assert tables.classify_reports(spark, to + "/report").first().state == "current"
    with pytest.raises(FileExistsError):
        tables.publish({"model": model}, {}, to)
    with pytest.raises(Exception):
        tables.publish({"model": model, "bad": model.select(F.raise_error(F.lit("x")).alias("x"))}, {}, str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists() and not (tmp_path / "bad.staging").exists()


def test_stream_equals_batch(spark, sf, tmp_path):
    from ticklake.operators.features import FEATURES, lagged
    from ticklake.sources.views import quotes
    from ticklake.streaming.online import online_features

    rows = quotes(spark, sf).where("session_id < 2")
    rows.repartition(3).write.parquet(str(tmp_path / "q"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "q"))
    q = online_features(stream).writeStream.format("memory").queryName("online").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.session_id, r.event_ix): [r[f] for f in FEATURES] for r in spark.table("online").collect()}
    want = {(r.session_id, r.event_ix): [r[f] for f in FEATURES] for r in lagged(rows).where("ix >= 25").collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert np.allclose(got[k], v, rtol=1e-9, atol=1e-9)


def test_features_in_blocks_equal_those_of_whole_sessions(spark, sf):
    from ticklake.operators.features import FEATURES, tob_features, tob_features_in_blocks
    from ticklake.sources.views import quotes

    rows = quotes(spark, sf.replace("sf0.001", "sf0.1"))
    key = ["session_id", "event_ix", "ix", "session_rows", "target", *FEATURES]
    whole, parts = tob_features(rows, 20).select(key), tob_features_in_blocks(rows, 20, blocks=8, least=10_000).select(key)
    rounded = lambda df: df.select(*key[:4], *(F.round(c, 6).alias(c) for c in key[4:]))
    assert rounded(whole).exceptAll(rounded(parts)).isEmpty() and rounded(parts).exceptAll(rounded(whole)).isEmpty()


def test_blocks_have_one_set_of_cuts(spark, monkeypatch):
    """Approximate quantiles that come out otherwise each time, as they do from several executors."""
    from ticklake.operators.features import in_blocks

    real = F.percentile_approx
    moved = F.udf(lambda cuts: [c + int.from_bytes(os.urandom(1), "big") for c in cuts], "array<bigint>").asNondeterministic()
    monkeypatch.setattr(F, "percentile_approx", lambda *args: moved(real(*args)))
    rows = spark.range(40_000).select(F.lit(1).alias("session_id"), F.col("id").alias("event_ix"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.exchange.reuse")}
    try:
        for k, v in zip(kept, ("-1", "false"), strict=True):
            spark.conf.set(k, v)
        found = in_blocks(rows, 25, 20, 8, 10_000).select("event_ix", "block", "first", "halo").collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    own = sorted((r.event_ix, r.block, r.first) for r in found if not r.halo)
    assert [x for x, _, _ in own] == list(range(40_000)) and len({b for _, b, _ in own}) == 8
    starts = {b: x for x, b, _ in reversed(own)}
    ends = {b: x for x, b, _ in own}
    assert all(starts[b] == first for _, b, first in own)
    want = {(x, b) for b in starts for x in [*range(starts[b] - 25, starts[b]), *range(ends[b] + 1, ends[b] + 21)] if 0 <= x < 40_000}
    assert {(r.event_ix, r.block) for r in found if r.halo} == want


def test_queries_take_every_event(spark, sf):
    """Against brute force over all events; the SQL of some of these reads only a part of the events."""
    from ticklake.queries import QUERIES
    from ticklake.sources.views import depth_changes, quotes

    run = lambda name: QUERIES[name](spark, sf).collect()
    bids, books, hashes, swept = {}, {}, {}, set()
    for r in depth_changes(spark, sf).orderBy("event_ix").collect():
        own = books.setdefault(r.session_id, {"bid": {}, "ask": {}})
        own[r.side].pop(r.price, None)
        if r.qty:
            own[r.side][r.price] = r.qty
        key, left = (r.session_id, r.event_ix), 120
        bids[key] = own["bid"].get(9990, 0)
        hashes[key] = str(book.state_hash(r.event_ix, sorted(own["bid"].items(), reverse=True), sorted(own["ask"].items())))
        for price, shown in sorted(own["ask"].items()):
            if left:
                swept.add((*key, price, min(left, shown)))
                left -= min(left, shown)
    assert {(r.session_id, r.event_ix): r.quantity for r in run("book_quantity_at")} == bids
    assert {(r.session_id, r.event_ix): r.state_hash for r in run("book_state_hash")} == hashes
    assert {tuple(r) for r in run("taker_sweep")} == swept

    rows = quotes(spark, sf).orderBy("event_ix").collect()
    side = lambda q: 1 if q.event_ix % 2 == 0 else -1
    paid = lambda q: q.best_ask if side(q) > 0 else q.best_bid
    sums, accounts, moves = {}, {}, {}
    for q in rows:
        value = paid(q) * q.bid_qty
        fee = value * (-0.3141592653 if q.event_ix % 3 == 0 else 2.718281828) / 1e4
        position, cash, fees = sums.get(q.session_id, (0.0, 0.0, 0.0))
        sums[q.session_id] = position + side(q) * q.bid_qty, cash - side(q) * value - fee, fees + fee
        accounts[q.event_ix] = (fee, *sums[q.session_id])
        later = next((m for m in rows if m.session_id == q.session_id and m.ts_ns >= q.ts_ns + 3600 * 10**9), None)
        moves[q.event_ix] = later and side(q) * ((later.best_bid + later.best_ask) / 2 - paid(q)) / paid(q) * 1e4
    got = {r.event_ix: (r.fee, r.position, r.cash, r.fees) for r in run("fill_accounting")}
    assert got.keys() == accounts.keys() and all(got[i] == pytest.approx(accounts[i], abs=2e-6) for i in got)
    got = {r.event_ix: r.markout_bps for r in run("markouts_asof")}
    assert got.keys() == moves.keys() and all(got[i] == (moves[i] if moves[i] is None else pytest.approx(moves[i], abs=2e-6)) for i in got)

    asked = run("simulate_orders")
    assert {c: sum(r.orders for r in asked if r.case_id == c) for c in {r.case_id for r in asked}} == dict.fromkeys({r.case_id for r in asked}, len(rows))
    assert {r.orders for r in run("sensitivity_grid")} == {len(rows)}


def test_statistics_take_every_session(spark, sf):
    from ticklake.queries import QUERIES  # first: the catalog registers itself with it
    from ticklake.catalog.quotes import features, scored
    from ticklake.operators.features import FEATURES

    targets = {}
    for r in scored(spark, sf).orderBy("event_ix").collect():
        targets.setdefault(r.session_id, []).append(r.target)
    got = {r.session_id: r for r in QUERIES["newey_west_t"](spark, sf).collect()}
    assert got.keys() == targets.keys() and len(got) == 5
    for session, x in targets.items():
        x = np.array(x)
        n, c = len(x), x - x.mean()
        lags = int(4 * (n / 100) ** (2 / 9))
        variance = (c @ c + sum(2 * (1 - k / (lags + 1)) * (c[k:] @ c[:-k]) for k in range(1, lags + 1))) / n
        assert (got[session].n, got[session].lags) == (n, lags) and got[session].t == pytest.approx(x.mean() / np.sqrt(variance / n), abs=2e-6)

    every = [r.session_id for r in QUERIES["session_strategy_table"](spark, sf).collect() if r.trades]
    assert sorted(every) == sorted(r.session_id for r in QUERIES["greedy_trades"](spark, sf).select("session_id").distinct().collect()) and 3 in every

    whole = research.coefficient_bootstrap(features(spark, sf), FEATURES, 1.0, 50)
    got = QUERIES["coefficient_bootstrap"](spark, sf).collect()
    assert [r.feature for r in got] == [x["feature"] for x in whole] and [r.median for r in got] == pytest.approx([x["median"] for x in whole])


def test_sessions_of_unlike_sizes_and_without_trades(spark):
    from ticklake.operators import strategy

    trades = spark.createDataFrame([(0, 1.0), (0, 3.0)], "session_id int, net_bps double")
    sessions = spark.createDataFrame([(0,), (0,), (3,)], "session_id int")
    assert sorted(tuple(r) for r in strategy.session_table(trades, sessions).collect()) == [(0, 2, 2.0, 4.0), (3, 0, 0.0, 0.0)]
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(s, i, float(x)) for s, n in ((0, 700), (1, 60), (2, 2), (3, 1)) for i, x in enumerate(rng.normal(1, 1, n))], "session_id int, ix int, x double")
    got = {r.session_id: r for r in stats.newey_west_by(rows, "x", "ix", ("session_id",)).collect()}
    for session in range(4):
        one = stats.newey_west(rows.where(F.col("session_id") == session), "x", block=50).first()
        assert (got[session].n, got[session].lags) == (one.n, one.lags) and got[session].t == pytest.approx(one.t) and got[session].mean == pytest.approx(one.mean)


def test_quantiles_and_ranks_equal_sorting(spark):
    """Ties, nulls, one value, keys without values, and many more values than ranges."""
    rng = np.random.default_rng(2)
    rows = [(k, None if r < 0.05 else float(v)) for k, n in ((0, 3000), (1, 1), (2, 40)) for r, v in zip(rng.random(n), np.where(rng.random(n) < 0.4, 7, np.round(rng.normal(5, 3, n), 2)))] + [(3, None)]
    df = spark.createDataFrame(rows, "k int, x double")
    shares = [0.0, 1 / 3, 0.5, 0.95, 1.0]
    of = lambda k: [v for i, v in rows if v is not None and (k is None or i == k)]
    got = {r.k: r["_q"] for r in stats.quantiles(df, "x", shares, ("k",)).collect()}
    assert got.keys() == {k for k in range(3) if of(k)} and all(got[k] == pytest.approx(np.quantile(of(k), shares).tolist()) for k in got)
    assert stats.quantiles(df, "x", shares).first()["_q"] == pytest.approx(np.quantile(of(None), shares).tolist())
    assert stats.quantiles(df.limit(0), "x", shares).isEmpty()
    for keys in ((), ("k",)):
        for r in stats.average_ranks(df, "x", "r", keys).collect():
            values = of(r.k if keys else None)
            assert r.r == (None if r.x is None else sum(v < r.x for v in values) + (sum(v == r.x for v in values) + 1) / 2)


def test_drawdowns_carry_over_sessions(spark):
    from ticklake.operators import strategy

    rng = np.random.default_rng(4)
    rows = [(t, s, i, float(x)) for t in (0, 1) for s in range(6) for i, x in enumerate(rng.normal(0, 1, rng.integers(1, 30)))]
    df = spark.createDataFrame(rows, "threshold int, session_id int, ix int, net_bps double")
    got = {(r.threshold, r.session_id, r.ix): (r.cumulative, r.drawdown) for r in strategy.drawdowns(df, ("threshold",)).collect()}
    for t in (0, 1):
        total = peak = 0.0
        for k, s, i, x in rows:
            if k == t:
                total += x
                peak = max(peak, total)
                assert got[t, s, i] == pytest.approx((total, total - peak))
    plan = strategy.strategy_metrics(df.withColumn("gross_bps", F.col("net_bps")), ("threshold",))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_newey_west_in_blocks(spark):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(s, i, float(x)) for s in range(7) for i, x in enumerate(rng.normal(1, 1, 37))], "session_id int, ix int, net_bps double")
    whole, cut = (stats.newey_west(rows, "net_bps", block=b).first() for b in (10_000, 11))
    x = np.array([r.net_bps for r in rows.orderBy("session_id", "ix").collect()])
    n, c = len(x), x - x.mean()
    lags = int(4 * (n / 100) ** (2 / 9))
    t = x.mean() / np.sqrt((c @ c + sum(2 * (1 - k / (lags + 1)) * (c[k:] @ c[:-k]) for k in range(1, lags + 1))) / n / n)
    assert whole.t == pytest.approx(t) and cut.t == pytest.approx(t) and whole.lags == lags and whole.n == n


@pytest.fixture
def recorded(spark, tmp_path):
    from ticklake.sources import recordings

    rows = [(s, i, 1_000 + i, 100.0 + i, 100.5 + i, 10 + i, 20 + i, 5 + 2 * i) for s, n in ((0, 25), (3, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "session_id int, event_ix long, ts_ns long, best_bid double, best_ask double, bid_volume long, ask_volume long, update_id long")
    found = recordings.write_recordings(df.repartition(3), str(tmp_path))
    assert [(r.created, r.records, r.complete, r.first_id, r.last_id) for r in found] == [(1, 25, True, 5, 53), (4, 1, True, 5, 5)]
    with pytest.raises(Exception, match="FileExistsError"):
        recordings.write_recordings(df, str(tmp_path))
    return rows


def test_recordings_in_ranges_with_ids(spark, tmp_path, recorded):
    from ticklake.sources import recordings

    got = sorted((int(r.recording.split("session-")[1][0]), *tuple(r)[1:]) for r in recordings.read_recordings(spark, str(tmp_path), rows=4, require_complete=True).collect())
    assert got == recorded
    assert recordings.read_recordings(spark, str(tmp_path / "none")).isEmpty()


def test_recordings_without_sidecar_or_ids(spark, tmp_path, recorded):
    """Tri-state completeness, and ids that are missing or do not grow across ranges."""
    import json

    from ticklake.sources import recordings

    one, side, ids = (tmp_path / f"session-0.qbin{end}" for end in ("", ".meta.json", ".qids"))
    text, data = side.read_text(), ids.read_bytes()
    spoiled = [{"symbol": "ETHUSDT"}, {"schema_version": 2}, {"schema_version": True}, {"created_unix_ns": 9}, {"recorded_records": 24}, {"accepted_records": 3}, {"recording_dropped": 1}, {"data_complete": "yes"}, {"first_update_id": 6}, {"last_update_id": 6}, {"recording_file": "x"}, {"record_size": 1}, {"boundaries": [{"record_index": 26, "kind": "gap"}]}, {"boundaries": [{"record_index": 1, "kind": " "}]}]
    for change in spoiled:
        side.write_text(json.dumps(json.loads(text) | change))
        with pytest.raises(ValueError):
            recordings.inspect(str(one))
    side.write_text(json.dumps({k: v for k, v in json.loads(text).items() if k != "update_id_file"}))
    with pytest.raises(ValueError):
        recordings.inspect(str(one))
    marks = [{"record_index": 7, "kind": "gap "}, {"record_index": 0, "kind": "start"}, {"record_index": 7, "kind": "gap"}]
    side.write_text(json.dumps(json.loads(text) | {"boundaries": marks}))
    assert recordings.inspect(str(one)).boundaries == ((0, "start"), (7, "gap"))
    side.unlink()
    assert recordings.inspect(str(one)).complete is False
    with pytest.raises(ValueError):
        recordings.read_recordings(spark, str(tmp_path), require_complete=True)
    swapped = bytearray(data)
    at = len(data) - 8 * 25
    swapped[at + 8 * 8 : at + 8 * 9] = (1).to_bytes(8, "little")  # the first id of the third range of four
    ids.write_bytes(bytes(swapped))
    with pytest.raises(Exception, match="ids do not increase"):
        recordings.read_recordings(spark, str(tmp_path), rows=4).collect()
    ids.write_bytes(data[:-8])
    assert [r.event_ix for r in recordings.read_recordings(spark, str(tmp_path), rows=4).where("update_id IS NULL").collect()] == [24]
    ids.unlink()
    assert recordings.inspect(str(one)).complete is None
    assert recordings.metadata(spark, str(tmp_path)).where("complete IS NULL").count() == 1
    one.write_bytes(one.read_bytes()[:-1])
    with pytest.raises(ValueError):
        recordings.inspect(str(one))


def test_replay_finds_spoiled_checkpoints(spark, tmp_path):
    from ticklake.sources import recordings

    level = "array<struct<price:bigint,qty:bigint>>"
    own = [event("snapshot", 10, 0, [(100, 5)], [(101, 6)], 1, 1)] + [event("depth", 11 + i, 1 + i, [(99 - i % 3, i % 4)], [], 2 + i, 2 + i) for i in range(40)]
    rows = [{"session_id": 2, "trade_price": None, "trade_qty": None, "buyer_is_maker": None} | e | {k: [{"price": p, "qty": q} for p, q in e[k]] for k in ("bids", "asks")} for e in own]
    df = spark.createDataFrame(rows, f"session_id int, event_ix long, ts_ns long, kind string, first_id long, final_id long, bids {level}, asks {level}, trade_price long, trade_qty long, buyer_is_maker boolean")
    recordings.write_depth(df, str(tmp_path), "BTCUSDT", every=10)
    assert [tuple(r)[1:] for r in codecs.verify_replay(spark, str(tmp_path)).collect()] == [(4, 0)]
    checks = tmp_path / "session-2.l2bin.l2chk"
    good = codecs.decode_checkpoints(checks.read_bytes(), 3).tolist()
    checks.write_bytes(codecs.encode_checkpoints(3, [good[0], (good[1][0], good[1][1], good[1][2] ^ 1), (good[2][0], 999, good[2][2]), good[3]]))
    assert [tuple(r)[1:] for r in codecs.verify_replay(spark, str(tmp_path)).collect()] == [(4, 2)]


def test_groups_are_fitted_as_if_alone(spark, sf):
    from ticklake.queries import QUERIES  # first: the catalog registers itself with it
    from ticklake.catalog.quotes import features

    parted = split.chronological_split(features(spark, sf), 25).cache()
    train, validation = (parted.where(F.col("part") == p) for p in ("train", "validation"))
    groups = {"a": ("imbalance", "spread_bps"), "b": ("spread_bps", "mid_return_5", "microprice_edge_bps"), "c": ("imbalance",)}
    together = ridge.fit_groups(train, validation, groups)
    for name, own in groups.items():
        alone = ridge.fit(train, validation, own)
        assert together[name].features == alone.features and together[name].penalty == alone.penalty
        assert together[name].beta == pytest.approx(alone.beta) and together[name].intercept == pytest.approx(alone.intercept) and together[name].mean == pytest.approx(alone.mean)
    parted.unpersist()
    rows = {r.group: r for r in QUERIES["feature_group_study"](spark, sf).collect()}
    assert {g: r.features for g, r in rows.items()} == {"top_of_book": 12, "depth": 14, "all": 26} and all(r.rows > 0 and r.mse > 0 for r in rows.values())


def test_correlation_without_spread(spark):
    rows = [("flat", 1.0, 2.0), ("flat", 2.0, 2.0), ("one", 1.0, 1.0), ("gaps", 1.0, None), ("gaps", 2.0, 5.0), ("gaps", 4.0, 1.0), ("gaps", None, 9.0), ("none", None, None)]
    got = {r.k: r.r for r in spark.createDataFrame(rows, "k string, x double, y double").groupBy("k").agg(stats.pearson("x", "y").alias("r")).collect()}
    assert got == {"flat": 0.0, "one": None, "gaps": pytest.approx(-1.0), "none": None}
