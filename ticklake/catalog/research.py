"""Queries over trades, splits and fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats, strategy
from ..operators.features import FEATURES
from ..plans import research, ridge
from ..plans.split import chronological_split
from ..queries import register
from .quotes import HORIZON, SCORED_SQL, features, scored

LEVELS = [0.0, 0.2, 0.4, 0.6]
FEE, SLIPPAGE = 0.1, 0.2
COST = 2 * (FEE + SLIPPAGE)
SIZE = 0.3


def _trades_sql(size: float | None = None, source: str = SCORED_SQL, last: str = f"SELECT c.*, gross_bps - CAST({COST} AS DOUBLE) AS net_bps FROM c JOIN p USING (threshold, session_id, ix)") -> str:
    """Signals g of source by threshold, those that fit c, the chosen places p; and what is wanted of them."""
    fits = f"WHERE capacity >= {size}" if size else ""
    return f"""(WITH RECURSIVE g AS MATERIALIZED (SELECT CAST(threshold AS DOUBLE) AS threshold, session_id, event_ix, ix, CASE WHEN score > 0 THEN 1 ELSE -1 END AS side,
        CASE WHEN score > 0 THEN ln(future_best_bid / best_ask) ELSE ln(best_bid / future_best_ask) END * CAST(1e4 AS DOUBLE) AS gross_bps, CASE WHEN score > 0 THEN least(ask_qty, future_bid_qty) ELSE least(bid_qty, future_ask_qty) END AS capacity
        FROM ({source}), (SELECT unnest({LEVELS}) AS threshold) WHERE (score > 0 AND score >= threshold) OR (score < 0 AND score <= -threshold)), c AS MATERIALIZED (SELECT * FROM g {fits}),
      p AS (SELECT threshold, session_id, min(ix) AS ix FROM c GROUP BY ALL UNION ALL SELECT p.threshold, p.session_id, min(c.ix) FROM p JOIN c ON c.threshold = p.threshold AND c.session_id = p.session_id AND c.ix >= p.ix + {HORIZON} GROUP BY p.threshold, p.session_id)
      {last})"""


TRADES = _trades_sql()


def trades(spark, sf_dir, size: float = 0.0):
    return strategy.select_trades(scored(spark, sf_dir), "score", LEVELS, HORIZON, COST, size)


@register("greedy_trades", f"SELECT session_id, event_ix, side, gross_bps, net_bps, capacity FROM {TRADES} WHERE threshold = CAST(0.4 AS DOUBLE)", "gross_bps net_bps capacity")
def greedy_trades(spark, sf_dir):
    return trades(spark, sf_dir)[0].where(F.col("threshold") == 0.4).select("session_id", "event_ix", "side", "gross_bps", "net_bps", "capacity")


@register("trades_by_threshold", f"SELECT threshold, count(*) AS trades, sum(ix) AS places, avg(net_bps) AS mean_bps FROM {TRADES} GROUP BY threshold", "mean_bps")
def trades_by_threshold(spark, sf_dir):
    return trades(spark, sf_dir)[0].groupBy("threshold").agg(F.count(F.lit(1)).alias("trades"), F.sum("ix").alias("places"), F.avg("net_bps").alias("mean_bps"))


@register("liquidity_screen", f"SELECT threshold, count(*) AS trades, min(capacity) AS least FROM {_trades_sql(SIZE)} GROUP BY threshold", "least")
def liquidity_screen(spark, sf_dir):
    return trades(spark, sf_dir, SIZE)[0].groupBy("threshold").agg(F.count(F.lit(1)).alias("trades"), F.min("capacity").alias("least"))


_REFUSED = f"""SELECT threshold, count(*) AS refused FROM g WHERE NOT coalesce(capacity >= {SIZE}, false)
      AND NOT EXISTS (SELECT 1 FROM p WHERE p.threshold = g.threshold AND p.session_id = g.session_id AND p.ix < g.ix AND g.ix < p.ix + {HORIZON}) GROUP BY threshold"""


@register("refused_signals", f"SELECT * FROM {_trades_sql(SIZE, last=_REFUSED)}")
def refused_signals(spark, sf_dir):
    """Signals with too little shown quantity while the session was free."""
    return trades(spark, sf_dir, SIZE)[1]


@register("cost_stress", f"SELECT threshold, extra_bps, count(*) AS trades, avg(gross_bps - 2 * ({FEE} + {SLIPPAGE} + extra_bps)) AS mean_bps, sum(gross_bps - 2 * ({FEE} + {SLIPPAGE} + extra_bps)) AS total_bps, avg(CASE WHEN gross_bps - 2 * ({FEE} + {SLIPPAGE} + extra_bps) > 0 THEN 1 ELSE 0 END) AS win_rate FROM {TRADES}, (SELECT CAST(unnest([0, 0.5, 1]) AS DOUBLE) AS extra_bps) GROUP BY ALL", "mean_bps total_bps win_rate")
def cost_stress(spark, sf_dir):
    return strategy.cost_stress(trades(spark, sf_dir)[0], FEE, SLIPPAGE, [0.0, 0.5, 1.0], ("threshold",))


_W = "PARTITION BY threshold ORDER BY session_id, ix ROWS UNBOUNDED PRECEDING"
_MARKED = f"SELECT *, cumulative - greatest(0, max(cumulative) OVER ({_W})) AS drawdown FROM (SELECT *, sum(net_bps) OVER ({_W}) AS cumulative FROM {TRADES})"


@register("drawdown_curve", f"SELECT threshold, session_id, event_ix, cumulative, drawdown FROM ({_MARKED})", "cumulative drawdown")
def drawdown_curve(spark, sf_dir):
    return strategy.drawdowns(trades(spark, sf_dir)[0], ("threshold",)).select("threshold", "session_id", "event_ix", "cumulative", "drawdown")


@register(
    "strategy_metrics",
    f"""SELECT threshold, count(*) AS trades, avg(CASE WHEN net_bps > 0 THEN 1 ELSE 0 END) AS win_rate, avg(net_bps) AS mean_bps, median(net_bps) AS median_bps, sum(net_bps) AS total_bps, avg(gross_bps) AS gross_mean_bps, sum(gross_bps) AS gross_total_bps, -min(drawdown) AS max_drawdown_bps,
      avg(net_bps) / stddev_samp(net_bps) * sqrt(count(*)) AS naive_t, avg(net_bps) / stddev_samp(net_bps) AS sharpe, coalesce(sum(net_bps) FILTER (WHERE net_bps > 0), 0) / abs(sum(net_bps) FILTER (WHERE net_bps < 0)) AS profit_factor,
      coalesce(avg(net_bps) FILTER (WHERE net_bps > 0) / abs(avg(net_bps) FILTER (WHERE net_bps < 0)), 0) AS payoff, avg(net_bps) FILTER (WHERE r <= greatest(1, ceil(n * 0.05))) AS shortfall_bps, greatest(0, avg(net_bps) / 2) AS breakeven_bps, count(DISTINCT session_id) AS sessions
      FROM (SELECT *, row_number() OVER (PARTITION BY threshold ORDER BY net_bps) AS r, count(*) OVER (PARTITION BY threshold) AS n FROM ({_MARKED})) GROUP BY threshold""",
    "win_rate mean_bps median_bps total_bps gross_mean_bps gross_total_bps max_drawdown_bps naive_t sharpe profit_factor payoff shortfall_bps breakeven_bps",
)
def strategy_metrics(spark, sf_dir):
    return strategy.strategy_metrics(trades(spark, sf_dir)[0], ("threshold",))


_SOME = "threshold = CAST(0.4 AS DOUBLE)"


@register("session_strategy_table", f"SELECT s.session_id, count(net_bps) AS trades, coalesce(avg(net_bps), 0) AS mean_bps, coalesce(sum(net_bps), 0) AS total_bps FROM (SELECT DISTINCT session_id FROM ({SCORED_SQL})) s LEFT JOIN (SELECT * FROM {TRADES} WHERE {_SOME}) t ON s.session_id = t.session_id GROUP BY s.session_id", "mean_bps total_bps")
def session_strategy_table(spark, sf_dir):
    """Every session, also one without a trade."""
    return strategy.session_table(trades(spark, sf_dir)[0].where(F.col("threshold") == 0.4), scored(spark, sf_dir))


@register("regime_buckets", f"SELECT CASE WHEN spread_bps <= a THEN 'low' WHEN spread_bps <= b THEN 'middle' ELSE 'high' END AS regime, count(*) AS samples, corr(score, target) AS ic, avg(abs(score - target)) AS mae FROM ({SCORED_SQL}), (SELECT quantile_cont(spread_bps, CAST(1 AS DOUBLE) / 3) AS a, quantile_cont(spread_bps, CAST(2 AS DOUBLE) / 3) AS b FROM ({SCORED_SQL})) GROUP BY regime", "ic mae")
def regime_buckets(spark, sf_dir):
    return strategy.regimes(scored(spark, sf_dir), "spread_bps", "score", "target")


@register("capacity_summary", f"SELECT threshold, min(capacity) AS least, median(capacity) AS median, max(capacity) AS most FROM {TRADES} GROUP BY threshold", "least median most")
def capacity_summary(spark, sf_dir):
    return strategy.capacity_summary(trades(spark, sf_dir)[0], ("threshold",))


_SIGNALS = ("imbalance", "microprice_edge_bps", "mid_return_5")


@register("baseline_ic", f"SELECT signal, corr(x, target) AS ic FROM (UNPIVOT (SELECT target, {', '.join(_SIGNALS)} FROM ({SCORED_SQL})) ON {', '.join(_SIGNALS)} INTO NAME signal VALUE x) GROUP BY signal", "ic")
def baseline_ic(spark, sf_dir):
    return scored(spark, sf_dir).unpivot(["target"], list(_SIGNALS), "signal", "x").groupBy("signal").agg(stats.pearson("x", "target").alias("ic"))


_COUNTS = f"SELECT session_id, count(*) AS n, sum(count(*)) OVER (ORDER BY session_id) AS stop, sum(count(*)) OVER () AS total, row_number() OVER (ORDER BY session_id) AS i FROM ({SCORED_SQL}) GROUP BY session_id"


@register(
    "chronological_split",
    f"""WITH c AS ({_COUNTS}), b AS (SELECT x.i AS a, y.i AS b FROM c x, c y WHERE x.i < y.i AND y.i < (SELECT max(i) FROM c) AND least(x.stop, y.stop - x.stop, x.total - y.stop) >= 100
        ORDER BY abs(x.stop - x.total * 0.6) + abs(y.stop - x.total * 0.8), x.i, y.i LIMIT 1)
      SELECT CASE WHEN c.i <= b.a THEN 'train' WHEN c.i <= b.b THEN 'validation' ELSE 'test' END AS part, c.session_id, c.n FROM c, b""",
)
def split(spark, sf_dir):
    return chronological_split(features(spark, sf_dir), 25).groupBy("part", "session_id").agg(F.count(F.lit(1)).alias("n"))


@register("ridge_fit")
def ridge_fit(spark, sf_dir):
    """Weights of the model fitted on the training part."""
    parted = chronological_split(features(spark, sf_dir), 25).cache()
    try:
        model = ridge.fit(parted.where("part = 'train'"), parted.where("part = 'validation'"), FEATURES)
    finally:
        parted.unpersist()
    return spark.createDataFrame([(f, float(b), model.penalty) for f, b in zip(model.features, model.beta, strict=True)], "feature string, beta double, penalty double")


@register("walk_forward")
def walk_forward(spark, sf_dir):
    rows = features(spark, sf_dir).cache()
    ids = [r.session_id for r in rows.select("session_id").distinct().orderBy("session_id").collect()]
    try:
        folds = research.walk_forward(rows, ids, HORIZON)
    finally:
        rows.unpersist()
    return spark.createDataFrame([(f["session_id"], f["threshold"], f["trades"], f["n"], f["mse"]) for f in folds], "session_id int, threshold double, trades long, rows long, mse double")


@register("coefficient_bootstrap")
def coefficient_bootstrap(spark, sf_dir):
    found = research.coefficient_bootstrap(features(spark, sf_dir), FEATURES, 1.0, 50)
    return spark.createDataFrame([tuple(x.values()) for x in found], "feature string, p05 double, median double, p95 double, sign_consistency double")


_LATE = lambda d: f"SELECT * REPLACE (coalesce(lag(score, {d}) OVER (PARTITION BY session_id ORDER BY event_ix), 0) AS score) FROM ({SCORED_SQL})"
_DELAYS = " UNION ALL ".join(f"SELECT CAST({d} AS INTEGER) AS delay, count(*) AS trades, avg(net_bps) AS mean_bps, sum(net_bps) AS total_bps FROM {_trades_sql(source=_LATE(d))} WHERE threshold = CAST(0.4 AS DOUBLE)" for d in (0, 1, 5))


@register("delay_stress", _DELAYS, "mean_bps total_bps")
def delay_stress(spark, sf_dir):
    return research.delay_stress(scored(spark, sf_dir), "score", 0.4, HORIZON, research.Costs(FEE, SLIPPAGE), (0, 1, 5)).select("delay", "trades", "mean_bps", "total_bps")


@register("feature_group_study")
def feature_group_study(spark, sf_dir):
    """Models of the depth features: the top of the book, what is below it, and all; on whole sessions held out."""
    from ..operators import book
    from ..sources.scratch import written
    from ..sources.views import trades as traded
    from .depth import changes

    own = traded(spark, sf_dir).withColumn("epoch", F.lit(0).cast("long"))
    rows, _ = written(book.l2_features(changes(spark, sf_dir), own, HORIZON))
    groups = {"top_of_book": research.TOP_OF_BOOK, "depth": tuple(f for f in book.L2_FEATURES if f not in research.TOP_OF_BOOK), "all": book.L2_FEATURES}
    found = research.group_study(chronological_split(rows, 25), groups, HORIZON, research.Costs(FEE, SLIPPAGE))
    cells = [(x["group"], x["features"], x["penalty"], x["threshold"], x["regression"]["n"], x["regression"]["mse"], x["regression"]["pearson_ic"], x["strategy"]["trades"]) for x in found]
    return spark.createDataFrame(cells, "group string, features int, penalty double, threshold double, rows long, mse double, pearson_ic double, trades long")
