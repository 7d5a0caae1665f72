"""Leakage-aware evaluation of a linear forecast, from features to a report; and its walk-forward, baseline and stress forms."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quotes import finite
from ..operators import stats, strategy
from ..operators.features import FEATURES, delayed
from ..sources.scratch import once
from . import ridge
from .split import chronological_split

#: Shares of |prediction| that are tried as thresholds.
THRESHOLD_SHARES = (0.0, 0.25, 0.5, 0.65, 0.75, 0.85, 0.9, 0.95)
#: Delays of a signal, in events, that are tried.
DELAYS = (0, 1, 2, 5, 10, 20)
#: What each feature group of the depth study has.
TOP_OF_BOOK = ("spread_bps", "imbalance_1", "microprice_edge_1_bps", "top_of_book_ofi", "trade_imbalance_20", "mid_return_1", "mid_return_5", "realized_volatility_20", "log_interarrival_us", "event_rate_10", "spread_change_1", "imbalance_change_1")


@dataclass(frozen=True)
class Costs:
    """Costs a side in basis points, and the size that must be shown."""

    fee: float = 0.1
    slippage: float = 0.0
    size: float = 0.0
    participation: float = 1.0

    @property
    def round_trip(self) -> float:
        return 2 * (self.fee + self.slippage)


def thresholds(validation: DataFrame, prediction: str) -> list[float]:
    """Distinct quantiles of |prediction|, ascending."""
    row = once(validation.select(F.abs(F.col(prediction)).alias("_p")), lambda rows: stats.quantiles(rows, "_p", list(THRESHOLD_SHARES))).first()
    return sorted(set(row["_q"])) if row else [0.0]


def select_threshold(validation: DataFrame, prediction: str, horizon: int, costs: Costs) -> float:
    """The candidate with the best validation result among those with enough trades; all candidates in one job."""
    found = thresholds(validation, prediction)
    least = max(10, int(validation.count() * 0.005))
    trades, _ = strategy.select_trades(validation, prediction, found, horizon, costs.round_trip, costs.size, costs.participation)
    return strategy.best_threshold(strategy.strategy_metrics(trades, ("threshold",)), found[0], least)


def report_row(row) -> dict:
    """A row as a dict, with null for what is not finite."""
    return {k: None if isinstance(v, float) and not math.isfinite(v) else v for k, v in row.asDict().items()}


def evaluate(rows: DataFrame, prediction: str, threshold: float, horizon: int, costs: Costs) -> dict:
    """Regression, direction and strategy metrics of one part."""
    trades, refused = strategy.select_trades(rows, prediction, [threshold], horizon, costs.round_trip, costs.size, costs.participation)
    trades = trades.cache()
    metrics = strategy.strategy_metrics(trades).first()
    out = {"regression": report_row(stats.regression_metrics(rows, prediction, "target").first()), "direction": report_row(stats.direction_metrics(rows, prediction, "target").first()), "strategy": report_row(metrics) if metrics and metrics.trades else {"trades": 0}}
    missed = refused.first()
    out["strategy"]["refused"] = missed.refused if missed else 0
    if metrics and metrics.trades:
        out["strategy"]["newey_west_t"] = stats.newey_west(trades, "net_bps").first().t
        out["bootstrap"] = report_row(stats.session_bootstrap(trades, "net_bps", 200, 7).first())
        out["capacity"] = report_row(strategy.capacity_summary(trades).first())
        out["cost_stress"] = [report_row(r) for r in strategy.cost_stress(trades, costs.fee, costs.slippage, [0.0, 0.05, 0.1, 0.25, 0.5]).orderBy("extra_bps").collect()]
    trades.unpersist()
    return out


def train_and_evaluate(features: DataFrame, horizon: int = 20, costs: Costs = Costs(), names: tuple[str, ...] = FEATURES, prior_fingerprints: DataFrame | None = None) -> dict:
    """Split, fit on training rows, choose penalty and threshold on validation rows, evaluate once on test rows.

    An earlier report's fingerprints of held-out sessions stop the run before the test part is looked at.
    """
    from ..operators.fingerprints import block_fingerprint, require_fresh

    parted = chronological_split(features, max(horizon, 25)).cache()
    train, validation, test = (parted.where(F.col("part") == p) for p in ("train", "validation", "test"))
    fingerprints = block_fingerprint(test, "session_id", ("event_ix", "ts_ns", "best_bid", "best_ask"))
    if prior_fingerprints is not None:
        require_fresh(fingerprints, prior_fingerprints)
    model = ridge.fit(train, validation, names)
    scored = lambda part: part.withColumn("prediction", model.column())
    threshold = select_threshold(scored(validation), "prediction", horizon, costs)
    out = {"model": asdict(model) | {"threshold": threshold, "horizon": horizon}, "rows": {r.part: r.n for r in parted.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}, "holdout": {str(r.session_id): r.fingerprint for r in fingerprints.collect()}}
    out["test"] = evaluate(scored(test), "prediction", threshold, horizon, costs)
    out["drift"] = [report_row(r) for r in stats.stability_index(parted, names).orderBy("feature", "part").collect()]
    parted.unpersist()
    return out


def baselines(parted: DataFrame, horizon: int, costs: Costs, signals: tuple[str, ...] = ("imbalance", "microprice_edge_bps", "mid_return_5")) -> dict[str, dict]:
    """Each plain signal through threshold selection on validation and one evaluation on test rows."""
    out = {}
    for s in signals:
        t = select_threshold(parted.where("part = 'validation'"), s, horizon, costs)
        out[s] = {"threshold": t} | evaluate(parted.where("part = 'test'"), s, t, horizon, costs)
    return out


def group_study(parted: DataFrame, groups: dict[str, tuple[str, ...]], horizon: int, costs: Costs = Costs()) -> list[dict]:
    """What each group of features is worth by itself: fitted, given a threshold on validation rows, and evaluated on test rows."""
    train, validation, test = (parted.where(F.col("part") == p) for p in ("train", "validation", "test"))
    out = []
    for group, model in ridge.fit_groups(train, validation, groups).items():
        scored = lambda part: part.withColumn("prediction", model.column())  # noqa: E731, B023
        threshold = select_threshold(scored(validation), "prediction", horizon, costs)
        out.append({"group": group, "features": len(model.features), "penalty": model.penalty, "threshold": threshold} | evaluate(scored(test), "prediction", threshold, horizon, costs))
    return out


def walk_forward(features: DataFrame, sessions: list[int], horizon: int, costs: Costs = Costs(), names: tuple[str, ...] = FEATURES) -> list[dict]:
    """Anchored folds: train on all sessions but the last two seen, validate on the next, evaluate on the one after."""
    out = []
    for t in range(2, len(sessions)):
        of = lambda ids: features.where(F.col("session_id").isin(*ids))
        model = ridge.fit(of(sessions[: t - 1]), of([sessions[t - 1]]), names)
        scored = lambda ids: of(ids).withColumn("prediction", model.column())  # noqa: E731, B023
        threshold = select_threshold(scored([sessions[t - 1]]), "prediction", horizon, costs)
        target = scored([sessions[t]])
        trades, _ = strategy.select_trades(target, "prediction", [threshold], horizon, costs.round_trip)
        m = strategy.strategy_metrics(trades).first()
        out.append({"session_id": sessions[t], "threshold": threshold, "trades": m.trades if m else 0, "mean_bps": m.mean_bps if m else None} | report_row(stats.regression_metrics(target, "prediction", "target").first()))
    return out


def delay_stress(scored: DataFrame, prediction: str, threshold: float, horizon: int, costs: Costs, delays: tuple[int, ...] = DELAYS) -> DataFrame:
    """Strategy metrics with the signal acted on some events late; all delays in one plan."""
    out = None
    for d in delays:
        late = scored.withColumn("_late", delayed(prediction, d) if d else F.col(prediction))
        trades, _ = strategy.select_trades(late, "_late", [threshold], horizon, costs.round_trip)
        m = strategy.strategy_metrics(trades.drop("_late")).withColumn("delay", F.lit(d))
        out = m if out is None else out.unionByName(m)
    return out


def coefficient_bootstrap(train: DataFrame, names: tuple[str, ...], penalty: float, draws: int = 200, seed: int = 3) -> list[dict]:
    """Quantiles and sign consistency of weights over resampled sessions, from one Gram matrix a session."""
    mean, scale = ridge.moments(train, names)
    columns = ("_one", *(f"_z{i}" for i in range(len(names))), "target")
    rows = ridge.gram(ridge.standardised(train, names, mean, scale).withColumn("_one", F.lit(1.0)), columns, ("session_id",)).orderBy("session_id").collect()
    grams = [ridge.matrix(r, len(columns)) for r in rows]
    rng = np.random.Generator(np.random.PCG64(seed))
    picks = rng.integers(0, len(grams), (draws, len(grams)))
    betas = np.array([ridge.solve(sum(grams[i] for i in p), penalty)[0] for p in picks])
    sign = np.sign(np.median(betas, 0))
    low, mid, high = np.quantile(betas, [0.05, 0.5, 0.95], axis=0)
    return [{"feature": n, "p05": float(a), "median": float(m), "p95": float(b), "sign_consistency": float((np.sign(betas[:, i]) == sign[i]).mean())} for i, (n, a, m, b) in enumerate(zip(names, low, mid, high, strict=True))]


def require_same_sessions(report: list[int], predictions: DataFrame) -> None:
    """An error unless the predictions cover exactly the sessions that the report held out."""
    seen = {r.session_id for r in predictions.select("session_id").distinct().collect()}
    if seen != set(report):
        raise ValueError(f"predictions cover sessions {sorted(seen)}, the report held out {sorted(report)}")


def usable(rows: DataFrame, names: tuple[str, ...]) -> Column:
    good = F.lit(True)
    for c in names:
        good = good & finite(F.col(c))
    return good


def evidence_card(report: dict) -> str:
    """The report as Markdown; N/A for what is not known."""
    show = lambda v: "N/A" if v is None or isinstance(v, float) and not math.isfinite(v) else f"{v:.6g}" if isinstance(v, float) else str(v)
    lines = ["# Evidence card", ""]
    for part in ("regression", "direction", "strategy", "bootstrap", "capacity"):
        if values := report.get("test", {}).get(part):
            lines += [f"## {part}", "", *(f"- {k}: {show(v)}" for k, v in values.items()), ""]
    return "\n".join(lines)
