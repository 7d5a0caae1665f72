"""Statistics of forecasts: correlations, direction, ranks, quantile tables, drift, HAC t, resampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quotes import finite
from ..sources.scratch import once


def pearson(x: str, y: str) -> Column:
    """Correlation as an aggregate over rows with both: null with fewer than two, 0 if one side has no spread.

    The quotient is spelled out, as corr() divides by zero before a condition around it could help.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    flat = (F.stddev_pop(a) <= 1e-15) | (F.stddev_pop(b) <= 1e-15)
    return F.when(F.count(a) < 2, F.lit(None).cast("double")).when(flat, F.lit(0.0)).otherwise(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def value_places(rows: DataFrame, column: str, keys: tuple[str, ...] = (), parts: int = 64) -> DataFrame:
    """keys, column, _c, _below, _n: each distinct value with its rows, the rows below it, and all rows of its key.

    Rows are counted by value first, with partial sums. Distinct values are then dealt to value ranges, cut for each key
    at approximate quantiles, and added up in their range; what stands in lower ranges is one row a key and range. So no
    task holds all values, nor all rows of a tied one. Null values take no part.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_c"))
    shares = F.array(*(F.lit(i / parts) for i in range(1, parts)))
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(column, shares, F.lit(10 * parts)).alias("_cuts"))  # one row a key
    dealt = _with_keys(counts, cuts, keys).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col(column)))).drop("_cuts")
    sizes = dealt.groupBy(*keys, "_part").agg(F.sum("_c").alias("_s"))  # at most parts rows a key
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    lower = F.sum("_s").over(over.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    below = sizes.select(*keys, "_part", F.coalesce(lower, F.lit(0)).alias("_lower"), F.sum("_s").over(over).alias("_n"))
    own = F.sum("_c").over(Window.partitionBy(*keys, "_part").orderBy(column).rowsBetween(Window.unboundedPreceding, -1))
    return dealt.join(below if keys else F.broadcast(below), [*keys, "_part"]).withColumn("_below", F.col("_lower") + F.coalesce(own, F.lit(0))).drop("_part", "_lower")


def _with_keys(rows: DataFrame, per_key: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """rows beside a table of one row a key (of one row, without keys, which is broadcast)."""
    return rows.join(per_key, list(keys)) if keys else rows.crossJoin(F.broadcast(per_key))


def quantiles(rows: DataFrame, column: str, shares: list[float], keys: tuple[str, ...] = ()) -> DataFrame:
    """keys and _q: the exact, interpolated quantiles of column, in the order of shares; one row a key (none for a key without values)."""
    places = value_places(rows, column, keys)
    at = [(F.col("_n") - 1) * F.lit(float(p)) for p in shares]
    pick = lambda k: F.max(F.when((F.col("_below") <= k) & (k < F.col("_below") + F.col("_c")), F.col(column)))
    ends = places.groupBy(*keys).agg(F.max("_n").alias("_n"), *(pick(F.floor(x)).alias(f"_l{i}") for i, x in enumerate(at)), *(pick(F.ceil(x)).alias(f"_h{i}") for i, x in enumerate(at)))
    between = [F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * (x - F.floor(x)) for i, x in enumerate(at)]
    return ends.where(F.col("_n").isNotNull()).select(*keys, F.array(*between).alias("_q"))


def average_ranks(rows: DataFrame, column: str, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """rows with the 1-based rank of column, ties averaged, within keys; rows with a null value have none.

    Distinct values are ranked (see value_places()) and joined back.
    """
    ranks = value_places(rows, column, keys).select(*keys, F.col(column).alias("_v"), (F.col("_below") + (F.col("_c") + 1) / 2).alias(name))
    ranks = ranks.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = F.col(column) == F.col("_v")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return rows.join(ranks, same, "left").drop("_v", *(f"_key_{k}" for k in keys))


def spearman(rows: DataFrame, x: str, y: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """spearman (and n) of x and y by keys: Pearson on average ranks of the pairs in which both are finite."""
    good = rows.where(finite(F.col(x)) & finite(F.col(y)))

    def build(good: DataFrame) -> DataFrame:
        ranked = average_ranks(average_ranks(good, "_x", "_rx", keys), "_y", "_ry", keys)
        return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), pearson("_rx", "_ry").alias("spearman"))

    return once(good.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")), build)


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def direction_metrics(rows: DataFrame, prediction: str, target: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sign classification by keys: zero targets are left out, a zero prediction abstains."""
    p, t = F.col(prediction), F.col(target)
    counts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(t != 0).alias("nonzero"), F.count_if(t > 0).alias("up"), F.count_if((t != 0) & (p == 0)).alias("abstentions"),
        F.count_if((t > 0) & (p > 0)).alias("true_positive"), F.count_if((t < 0) & (p < 0)).alias("true_negative"), F.count_if((t < 0) & (p > 0)).alias("false_positive"), F.count_if((t > 0) & (p < 0)).alias("false_negative"),
    )
    n, up, tp, tn, fp, fn = (F.col(c).cast("double") for c in ("nonzero", "up", "true_positive", "true_negative", "false_positive", "false_negative"))
    down, acted = n - up, n - F.col("abstentions")
    product = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return counts.select(
        *keys, F.col("nonzero").alias("nonzero_targets"), F.when(n > 0, 1 - n / F.col("total")).otherwise(F.lit(1.0)).alias("zero_fraction"), _share(up, n).alias("positive_fraction"), _share(tp + tn, n).alias("accuracy"),
        _share(F.greatest(up, down), n).alias("majority_accuracy"), (_share(tp + tn, n) - _share(F.greatest(up, down), n)).alias("lift"), ((_share(tp, up) + _share(tn, down)) / 2).alias("balanced_accuracy"),
        _share(acted, n).alias("coverage"), _share(tp + tn, acted).alias("actionable_accuracy"), F.when(product > 0, (tp * tn - fp * fn) / F.sqrt(product)).otherwise(F.lit(0.0)).alias("matthews"), _share(tp + fp, acted).alias("positive_predictions"),
        "true_positive", "true_negative", "false_positive", "false_negative", "abstentions",
    )


def regression_metrics(rows: DataFrame, prediction: str, target: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """n, mse, mae, r2 (0 if the target has no spread) and Pearson IC by keys."""
    e = F.col(prediction) - F.col(target)
    spread = F.var_pop(target)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.when(spread > 1e-15, 1 - F.avg(e * e) / spread).otherwise(F.lit(0.0)).alias("r2"), pearson(prediction, target).alias("pearson_ic"))


def bin_of(x: Column, edges: Column) -> Column:
    """Number of interior edges at or below x (bins are closed on the left)."""
    return F.size(F.filter(edges, lambda e: e <= x))


def distinct_quantiles(rows: DataFrame, column: str, shares: list[float], keys: tuple[str, ...] = ()) -> DataFrame:
    """keys and _e: the distinct exact quantiles, ascending."""
    return quantiles(rows, column, shares, keys).select(*keys, F.array_sort(F.array_distinct("_q")).alias("_e"))


def quantile_table(rows: DataFrame, prediction: str, target: str, bins: int = 10) -> DataFrame:
    """Samples and mean outcome by quantile bin of the prediction; monotonicity() takes it further."""

    def build(rows: DataFrame) -> DataFrame:
        edges = distinct_quantiles(rows, prediction, [i / bins for i in range(bins + 1)])
        inner = F.when(F.size("_e") > 2, F.slice("_e", 2, F.greatest(F.size("_e") - 2, F.lit(1)))).otherwise(F.array().cast("array<double>"))
        binned = rows.crossJoin(F.broadcast(edges.select(inner.alias("_e")))).withColumn("quantile", bin_of(F.col(prediction), F.col("_e")) + 1)
        means = binned.groupBy("quantile").agg(F.count(F.lit(1)).alias("samples"), F.avg(prediction).alias("mean_prediction"), F.avg(target).alias("mean_target"), F.avg((F.col(target) > 0).cast("int")).alias("positive_rate"))
        medians = quantiles(binned, target, [0.5], ("quantile",)).select("quantile", F.col("_q")[0].alias("median_target"))  # one row a bin
        return means.join(F.broadcast(medians), "quantile", "left").select("quantile", "samples", "mean_prediction", "mean_target", "median_target", "positive_rate")

    return once(rows.select(prediction, target), build)


def monotonicity(table: DataFrame) -> DataFrame:
    """Rank correlation of a quantile table's bin numbers with its mean targets."""
    return spearman(table.withColumn("_b", F.col("quantile").cast("double")), "_b", "mean_target", ()).select(F.when(F.col("n") >= 2, F.col("spearman")).alias("monotonicity"))


def stability_index(rows: DataFrame, features: tuple[str, ...], part: str = "part", reference: str = "train") -> DataFrame:
    """feature, part, psi, shift: each part against the reference part.

    psi compares shares in the reference's decile bins (at least 1e-6 each); shift is the difference of means in
    reference deviations.
    """
    def build(rows: DataFrame) -> DataFrame:
        long = rows.select(part, *features).unpivot([part], list(features), "feature", "x").where(finite(F.col("x")))
        train = long.where(F.col(part) == reference)
        edges = distinct_quantiles(train, "x", [i / 10 for i in range(1, 10)], ("feature",))
        known = train.groupBy("feature").agg(F.avg("x").alias("_m"), F.stddev_pop("x").alias("_s"), F.count(F.lit(1)).alias("_n")).join(F.broadcast(edges), "feature")  # one row a feature
        binned = long.join(F.broadcast(known), "feature").withColumn("_b", bin_of(F.col("x"), F.col("_e")))  # one row a feature
        counts = binned.groupBy("feature", part, "_b").agg(F.count(F.lit(1)).alias("_c"), F.sum("x").alias("_sum"))
        totals = counts.groupBy("feature", part).agg(F.sum("_c").alias("_total"), F.sum("_sum").alias("_all"))
        slots = known.select("feature", "_m", "_s", "_n", F.explode(F.sequence(F.lit(0), F.size("_e"))).alias("_b"))
        own = counts.where(F.col(part) == reference).select("feature", "_b", F.col("_c").alias("_r"))
        grid = totals.where(F.col(part) != reference).join(slots, "feature").join(own, ["feature", "_b"], "left").join(counts.select("feature", part, "_b", "_c"), ["feature", part, "_b"], "left")
        share = lambda c, n: F.greatest(F.coalesce(F.col(c), F.lit(0)) / F.col(n), F.lit(1e-6))
        a, b = share("_c", "_total"), share("_r", "_n")
        scale = F.when(F.col("_s") > 1e-12, F.col("_s")).otherwise(F.lit(1.0))
        return grid.groupBy("feature", part).agg(F.sum((a - b) * F.ln(a / b)).alias("psi"), F.first((F.col("_all") / F.col("_total") - F.col("_m")) / scale).alias("shift"))

    return once(rows.select(part, *features), build)


def _newey_west_lags(n: int) -> int:
    return min(max(math.floor(4 * (n / 100) ** (2 / 9)), 0), max(n - 1, 0))


def newey_west_by(rows: DataFrame, value: str, order: str, keys: tuple[str, ...]) -> DataFrame:
    """keys, n, mean, lags, t: newey_west() of each key's rows, in one pass over all of them.

    The driver reads one count a key; each key's own number of lags decides which of the lagged products count for it.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_m"))
    most = _newey_west_lags(sizes.agg(F.max("_n")).first()[0] or 0)
    w = Window.partitionBy(*keys).orderBy(order)
    n = F.col("_n")
    lags = F.greatest(F.least(F.floor(4 * F.pow(n / 100, F.lit(2 / 9))), n - 1), F.lit(0)).cast("int")
    centred = rows.join(F.broadcast(sizes.withColumn("_lags", lags)), list(keys)).withColumn("_c", F.col(value) - F.col("_m"))  # one row a key
    products = centred.withColumns({f"_p{k}": F.col("_c") * F.lag("_c", k).over(w) for k in range(1, most + 1)})
    sums = products.groupBy(*keys).agg(F.first("_n").alias("n"), F.first("_m").alias("mean"), F.first("_lags").alias("lags"), F.sum(F.col("_c") * F.col("_c")).alias("_v"), *(F.sum(f"_p{k}").alias(f"_p{k}") for k in range(1, most + 1)))
    variance = F.col("_v")
    for k in range(1, most + 1):
        weight = F.when(F.col("lags") >= k, 2 * (1 - k / (F.col("lags") + 1))).otherwise(F.lit(0.0))
        variance = variance + weight * F.coalesce(F.col(f"_p{k}"), F.lit(0.0))
    of_mean = F.greatest(variance / F.col("n"), F.lit(0.0)) / F.col("n")
    return sums.select(*keys, "n", "mean", "lags", F.when(of_mean > 1e-30, F.col("mean") / F.sqrt(of_mean)).otherwise(F.lit(0.0)).alias("t"))


def newey_west(rows: DataFrame, value: str, order: tuple[str, str] = ("session_id", "ix"), max_lag: int | None = None, block: int = 100_000) -> DataFrame:
    """n, mean, lags, t: the mean's t-statistic with Bartlett weights over trades in order of session and place.

    The number of lags follows the number of rows (a small count read by the driver). Rows are numbered by session, on
    top of the rows of earlier sessions, and dealt in blocks, each with the last rows of the block before it.
    """
    session, place = order
    n = rows.count()
    lags = _newey_west_lags(n) if max_lag is None else min(max(max_lag, 0), max(n - 1, 0))
    sizes = rows.groupBy(session).agg(F.count(F.lit(1)).alias("_k"))  # one row a session
    before = sizes.select(session, F.coalesce(F.sum("_k").over(Window.partitionBy(F.lit(0)).orderBy(session).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    mean = rows.agg(F.avg(value).alias("_m"))
    numbered = rows.join(before, session).withColumn("_i", F.col("_before") + F.row_number().over(Window.partitionBy(session).orderBy(place)) - 1)
    size = max(block, lags + 1)
    own = (F.col("_i") / size).cast("long")
    centred = numbered.crossJoin(F.broadcast(mean)).select("_i", "_m", (F.col(value) - F.col("_m")).alias("_c"), own.alias("_own"))
    halo = F.when(F.col("_i") % size >= size - lags, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))
    w = Window.partitionBy("_block").orderBy("_i")
    lagged = centred.withColumn("_block", F.explode(halo)).withColumns({f"_l{k}": F.lag("_c", k).over(w) for k in range(1, lags + 1)}).where("_block = _own")
    variance = F.sum(F.col("_c") * F.col("_c")) / n if n else F.lit(0.0)
    for k in range(1, lags + 1):
        variance = variance + F.lit(2 * (1 - k / (lags + 1))) * F.coalesce(F.sum(F.col("_c") * F.col(f"_l{k}")), F.lit(0.0)) / n
    of_mean = F.greatest(variance, F.lit(0.0)) / max(n, 1)
    return lagged.agg(F.count(F.lit(1)).alias("n"), F.first("_m").alias("mean"), F.lit(lags).alias("lags"), F.when(of_mean > 1e-30, F.first("_m") / F.sqrt(of_mean)).otherwise(F.lit(0.0)).alias("t"))


def hash_draw(*parts: Column, n: Column) -> Column:
    """A whole number below n that depends on parts alone, the same in every engine: first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("long") % n


def session_bootstrap(rows: DataFrame, value: str, samples: int, seed: int) -> DataFrame:
    """mean, low, high, p_not_positive: resampled sessions (null with fewer than two), each with all its rows.

    Sessions are summed first; each draw picks as many sessions as there are, by hash.
    """
    sums = rows.groupBy("session_id").agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_n"))
    numbered = sums.withColumn("_i", F.row_number().over(Window.orderBy("session_id")) - 1)  # one row a session
    total = numbered.agg(F.count(F.lit(1)).alias("_k"))
    picks = F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("draw")
    grid = total.select("_k", picks).select("_k", "draw", F.explode(F.sequence(F.lit(0), F.col("_k").cast("int") - 1)).alias("slot"))
    drawn = grid.withColumn("_i", hash_draw(F.lit(str(seed)), F.col("draw").cast("string"), F.col("slot").cast("string"), n=F.col("_k")))
    means = drawn.join(numbered, "_i").groupBy("draw").agg((F.sum("_s") / F.sum("_n")).alias("_mean"))
    observed = sums.agg((F.sum("_s") / F.sum("_n")).alias("mean"), F.count(F.lit(1)).alias("sessions"))
    enough = F.col("sessions") >= 2
    out = means.agg(F.percentile("_mean", F.lit(0.025)).alias("_lo"), F.percentile("_mean", F.lit(0.975)).alias("_hi"), ((F.count_if(F.col("_mean") <= 0) + 1) / (F.count(F.lit(1)) + 1)).alias("_p"))
    return observed.crossJoin(out).select("mean", "sessions", F.when(enough, F.col("_lo")).alias("low"), F.when(enough, F.col("_hi")).alias("high"), F.when(enough, F.col("_p")).alias("p_not_positive"))


def circular_shift_test(rows: DataFrame, prediction: str, target: str, samples: int, seed: int, order: str = "event_ix") -> DataFrame:
    """observed, p: the correlation against those of predictions rotated within sessions by hashed offsets."""
    w = Window.partitionBy("session_id")
    numbered = rows.select("session_id", F.col(prediction).alias("_p"), F.col(target).alias("_t"), (F.row_number().over(w.orderBy(order)) - 1).alias("_i"), F.count(F.lit(1)).over(w).alias("_n"))
    draws = numbered.select("session_id", "_n").distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    offset = F.when(F.col("_n") > 1, 1 + hash_draw(F.lit(str(seed)), F.col("draw").cast("string"), F.col("session_id").cast("string"), n=F.col("_n") - 1)).otherwise(F.lit(0))
    moved = numbered.select("session_id", "_p", "_i").join(draws.withColumn("_o", offset), "session_id").withColumn("_j", (F.col("_i") + F.col("_o")) % F.col("_n"))
    paired = moved.select("session_id", "draw", "_j", "_p").join(numbered.select("session_id", F.col("_i").alias("_j"), "_t"), ["session_id", "_j"])
    shifted = paired.groupBy("draw").agg(pearson("_p", "_t").alias("_r"))
    observed = numbered.agg(pearson("_p", "_t").alias("observed"))
    return observed.crossJoin(shifted).agg(F.first("observed").alias("observed"), ((F.count_if(F.abs("_r") >= F.abs("observed")) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


def latency_percentiles(rows: DataFrame, age: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """n, p50, p99, p99.9 of an age."""

    def build(rows: DataFrame) -> DataFrame:
        sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        q = quantiles(rows, age, [0.5, 0.99, 0.999], keys).select(*keys, *(F.col("_q")[i].alias(x) for i, x in enumerate(("p50", "p99", "p999"))))
        return _with_keys(sizes, q, keys)

    return once(rows.select(*keys, age), build)
