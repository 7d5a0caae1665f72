"""Queries over forecasts and their outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as f
from ..operators import stats as s
from ..queries import register
from ..sources.views import QUOTES_SQL, quotes
from .quotes import SCORED_SQL, scored

P, T = "score", "target"
PARTS_SQL = f"SELECT *, CASE WHEN session_id <= 2 THEN 'train' WHEN session_id = 3 THEN 'validation' ELSE 'test' END AS part FROM ({SCORED_SQL})"


def parted(spark, sf_dir):
    return scored(spark, sf_dir).withColumn("part", F.when(F.col("session_id") <= 2, "train").when(F.col("session_id") == 3, "validation").otherwise("test"))


@register("pearson_ic", f"SELECT count(*) AS n, corr(score, target) AS ic FROM ({SCORED_SQL})", "ic")
def pearson_ic(spark, sf_dir):
    return scored(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), s.pearson(P, T).alias("ic"))


_RANKS = f"SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rs, rank() OVER (ORDER BY target) + (count(*) OVER (PARTITION BY target) - 1) / 2 AS rt FROM ({SCORED_SQL})"


@register("spearman_ic", f"SELECT count(*) AS n, corr(rs, rt) AS spearman FROM ({_RANKS})", "spearman")
def spearman_ic(spark, sf_dir):
    return s.spearman(scored(spark, sf_dir), P, T)


_TIED = f"SELECT session_id, event_ix, bid_qty, rank() OVER (ORDER BY bid_qty) + (count(*) OVER (PARTITION BY bid_qty) - 1) / 2 AS r FROM ({QUOTES_SQL})"


@register("average_ranks", f"SELECT session_id, event_ix, r FROM ({_TIED})", "r")
def average_ranks(spark, sf_dir):
    return s.average_ranks(quotes(spark, sf_dir).select("session_id", "event_ix", "bid_qty"), "bid_qty", "r").select("session_id", "event_ix", "r")


@register("regression_metrics", f"SELECT count(*) AS n, avg((score - target) * (score - target)) AS mse, avg(abs(score - target)) AS mae, 1 - avg((score - target) * (score - target)) / var_pop(target) AS r2, corr(score, target) AS pearson_ic FROM ({SCORED_SQL})", "mse mae r2 pearson_ic")
def regression_metrics(spark, sf_dir):
    return s.regression_metrics(scored(spark, sf_dir), P, T)


def _direction_sql(source: str, keys: str = "") -> str:
    by = f"{keys}, " if keys else ""
    share = lambda a, b: f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0 END"
    return f"""SELECT {by}nonzero AS nonzero_targets, CASE WHEN nonzero > 0 THEN 1 - CAST(nonzero AS DOUBLE) / total ELSE 1 END AS zero_fraction, {share('up', 'nonzero')} AS positive_fraction, {share('tp + tn', 'nonzero').replace('tp + tn', '(tp + tn)')} AS accuracy,
      {share('greatest(up, nonzero - up)', 'nonzero')} AS majority_accuracy, {share('(tp + tn)', 'nonzero')} - {share('greatest(up, nonzero - up)', 'nonzero')} AS lift, ({share('tp', 'up')} + {share('tn', '(nonzero - up)')}) / 2 AS balanced_accuracy,
      {share('(nonzero - abst)', 'nonzero')} AS coverage, {share('(tp + tn)', '(nonzero - abst)')} AS actionable_accuracy,
      CASE WHEN CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END AS matthews, {share('(tp + fp)', '(nonzero - abst)')} AS positive_predictions,
      tp AS true_positive, tn AS true_negative, fp AS false_positive, fn AS false_negative, abst AS abstentions FROM (
      SELECT {by}count(*) AS total, count(*) FILTER (WHERE target <> 0) AS nonzero, count(*) FILTER (WHERE target > 0) AS up, count(*) FILTER (WHERE target <> 0 AND score = 0) AS abst, count(*) FILTER (WHERE target > 0 AND score > 0) AS tp,
        count(*) FILTER (WHERE target < 0 AND score < 0) AS tn, count(*) FILTER (WHERE target < 0 AND score > 0) AS fp, count(*) FILTER (WHERE target > 0 AND score < 0) AS fn FROM ({source}) {f'GROUP BY {keys}' if keys else ''})"""


_DIRECTION = "zero_fraction positive_fraction accuracy majority_accuracy lift balanced_accuracy coverage actionable_accuracy matthews positive_predictions"


@register("direction_metrics", _direction_sql(SCORED_SQL), _DIRECTION)
def direction_metrics(spark, sf_dir):
    return s.direction_metrics(scored(spark, sf_dir), P, T)


@register("session_direction_table", _direction_sql(SCORED_SQL, "session_id"), _DIRECTION)
def session_direction_table(spark, sf_dir):
    return s.direction_metrics(scored(spark, sf_dir), P, T, ("session_id",))


_SESSION_IC = f"""SELECT session_id, count(*) AS samples, corr(score, target) AS pearson_ic, corr(rs, rt) AS spearman_ic, avg(abs(score - target)) AS mae FROM (
  SELECT *, rank() OVER (PARTITION BY session_id ORDER BY score) + (count(*) OVER (PARTITION BY session_id, score) - 1) / 2 AS rs, rank() OVER (PARTITION BY session_id ORDER BY target) + (count(*) OVER (PARTITION BY session_id, target) - 1) / 2 AS rt FROM ({SCORED_SQL})) GROUP BY session_id"""


def _session_ic(spark, sf_dir):
    rows = scored(spark, sf_dir).select("session_id", P, T)
    ranks = s.spearman(rows, P, T, ("session_id",)).select("session_id", F.col("spearman").alias("spearman_ic"))
    plain = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("samples"), s.pearson(P, T).alias("pearson_ic"), F.avg(F.abs(F.col(P) - F.col(T))).alias("mae"))
    return plain.join(ranks, "session_id").select("session_id", "samples", "pearson_ic", "spearman_ic", "mae")


register("session_ic_table", _SESSION_IC, "pearson_ic spearman_ic mae")(_session_ic)


@register("session_ic_summary", f"SELECT count(*) AS sessions, median(pearson_ic) AS median_ic, avg(CASE WHEN pearson_ic > 0 THEN 1 ELSE 0 END) AS positive_share FROM ({_SESSION_IC})", "median_ic positive_share")
def session_ic_summary(spark, sf_dir):
    return _session_ic(spark, sf_dir).agg(F.count(F.lit(1)).alias("sessions"), F.median("pearson_ic").alias("median_ic"), F.avg((F.col("pearson_ic") > 0).cast("int")).alias("positive_share"))


_shares = ", ".join(str(i / 10) for i in range(11))
_QUANTILES = f"""SELECT bin + 1 AS quantile, count(*) AS samples, avg(score) AS mean_prediction, avg(target) AS mean_target, median(target) AS median_target, avg(CASE WHEN target > 0 THEN 1 ELSE 0 END) AS positive_rate FROM (
  SELECT *, CAST(len(list_filter(list_slice(e, 2, len(e) - 1), lambda x: x <= score)) AS INTEGER) AS bin FROM ({SCORED_SQL}), (SELECT list_sort(list_distinct(quantile_cont(score, [{_shares}]))) AS e FROM ({SCORED_SQL}))) GROUP BY bin"""


@register("quantile_table", _QUANTILES, "mean_prediction mean_target median_target positive_rate")
def quantile_table(spark, sf_dir):
    return s.quantile_table(scored(spark, sf_dir), P, T)


@register("quantile_monotonicity", f"SELECT corr(a, b) AS monotonicity FROM (SELECT rank() OVER (ORDER BY quantile) AS a, rank() OVER (ORDER BY mean_target) AS b FROM ({_QUANTILES}))", "monotonicity")
def quantile_monotonicity(spark, sf_dir):
    return s.monotonicity(s.quantile_table(scored(spark, sf_dir), P, T))


_deciles = ", ".join(str(i / 10) for i in range(1, 10))
_DRIFT = f"""WITH l AS (UNPIVOT (SELECT part, {', '.join(f.FEATURES)} FROM ({PARTS_SQL})) ON {', '.join(f.FEATURES)} INTO NAME feature VALUE x),
  k AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, [{_deciles}]))) AS e, avg(x) AS m, stddev_pop(x) AS sd, count(*) AS n FROM l WHERE part = 'train' GROUP BY feature),
  c AS (SELECT feature, part, len(list_filter(e, lambda y: y <= x)) AS b, count(*) AS c, sum(x) AS t FROM l JOIN k USING (feature) GROUP BY ALL),
  t AS (SELECT feature, part, sum(c) AS n, sum(t) AS t FROM c GROUP BY ALL),
  g AS (SELECT t.feature, t.part, greatest(coalesce(o.c, 0) / t.n, CAST(1e-6 AS DOUBLE)) AS a, greatest(coalesce(r.c, 0) / k.n, CAST(1e-6 AS DOUBLE)) AS r, (t.t / t.n - k.m) / CASE WHEN k.sd > 1e-12 THEN k.sd ELSE 1 END AS shift
    FROM t JOIN (SELECT *, unnest(range(len(e) + 1)) AS b FROM k) k ON t.feature = k.feature LEFT JOIN c o ON o.feature = t.feature AND o.part = t.part AND o.b = k.b LEFT JOIN c r ON r.feature = t.feature AND r.part = 'train' AND r.b = k.b WHERE t.part <> 'train')
  SELECT feature, part, sum((a - r) * ln(a / r)) AS psi, first(shift) AS shift FROM g GROUP BY feature, part"""


def drift(spark, sf_dir):
    return s.stability_index(parted(spark, sf_dir), f.FEATURES)


register("psi_by_feature", f"SELECT feature, part, psi FROM ({_DRIFT})", "psi")(lambda spark, sf_dir: drift(spark, sf_dir).select("feature", "part", "psi"))


@register("drift_report", f"SELECT feature, max(psi) FILTER (WHERE part = 'validation') AS validation_psi, max(psi) FILTER (WHERE part = 'test') AS test_psi, max(shift) FILTER (WHERE part = 'validation') AS validation_shift, max(shift) FILTER (WHERE part = 'test') AS test_shift FROM ({_DRIFT}) GROUP BY feature", "validation_psi test_psi validation_shift test_shift")
def drift_report(spark, sf_dir):
    of = lambda p, c: F.max(F.when(F.col("part") == p, F.col(c))).alias(f"{p}_{c}")
    return drift(spark, sf_dir).groupBy("feature").agg(*(of(p, c) for c in ("psi", "shift") for p in ("validation", "test")))


_NW_LAGS = "CAST(floor(4 * pow(count(*) / 100, CAST(2 AS DOUBLE) / 9)) AS BIGINT)"
_NW = f"""WITH v AS (SELECT session_id, target AS x, row_number() OVER (PARTITION BY session_id ORDER BY event_ix) AS i FROM ({SCORED_SQL})), n AS (SELECT session_id, count(*) AS n, avg(x) AS m, {_NW_LAGS} AS lags FROM v GROUP BY session_id),
  c AS (SELECT session_id, i, x - m AS c, lags FROM v JOIN n USING (session_id)), g AS (SELECT session_id, l, sum(a.c * b.c) AS c FROM (SELECT *, unnest(range(1, 40)) AS l FROM c) a JOIN c b USING (session_id) WHERE l <= a.lags AND b.i = a.i - l GROUP BY ALL),
  s AS (SELECT session_id, sum(2 * (1 - l / (lags + CAST(1 AS DOUBLE))) * c) AS s FROM g JOIN n USING (session_id) GROUP BY session_id), z AS (SELECT session_id, sum(c * c) AS c FROM c GROUP BY session_id)
  SELECT session_id, n, m AS mean, CAST(lags AS INTEGER) AS lags, CASE WHEN greatest((z.c + coalesce(s, 0)) / n, 0) / n > 1e-30 THEN m / sqrt(greatest((z.c + coalesce(s, 0)) / n, 0) / n) ELSE 0 END AS t FROM n JOIN z USING (session_id) LEFT JOIN s USING (session_id)"""


@register("newey_west_t", _NW, "mean t")
def newey_west_t(spark, sf_dir):
    """Of every session."""
    return s.newey_west_by(scored(spark, sf_dir), T, "event_ix", ("session_id",))


_DRAW = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"
_BOOT = f"""WITH r AS (SELECT session_id, sum(target) AS s, count(*) AS n, row_number() OVER (ORDER BY session_id) - 1 AS i FROM ({SCORED_SQL}) GROUP BY session_id), k AS (SELECT count(*) AS k, sum(s) / sum(n) AS mean FROM r),
  d AS (SELECT draw, {_DRAW.format("'7|' || draw || '|' || slot")} % k AS i FROM k, (SELECT unnest(range(200)) AS draw) a, (SELECT unnest(range(100)) AS slot) b WHERE slot < k),
  m AS (SELECT draw, sum(s) / sum(n) AS mean FROM d JOIN r USING (i) GROUP BY draw)
  SELECT any_value(k.mean) AS mean, any_value(k.k) AS sessions, quantile_cont(m.mean, 0.025) AS low, quantile_cont(m.mean, 0.975) AS high, (count(*) FILTER (WHERE m.mean <= 0) + 1) / (count(*) + 1) AS p_not_positive FROM m, k"""


@register("session_bootstrap_hash", _BOOT, "mean low high p_not_positive")
def session_bootstrap_hash(spark, sf_dir):
    return s.session_bootstrap(scored(spark, sf_dir), T, 200, 7)


_SHIFT = f"""WITH v AS (SELECT session_id, score, target, row_number() OVER (PARTITION BY session_id ORDER BY event_ix) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n FROM ({SCORED_SQL})),
  d AS (SELECT DISTINCT session_id, n, draw, CASE WHEN n > 1 THEN 1 + {_DRAW.format("'11|' || draw || '|' || session_id")} % (n - 1) ELSE 0 END AS o FROM v, (SELECT unnest(range(20)) AS draw) k),
  m AS (SELECT d.draw, corr(a.score, b.target) AS r FROM d JOIN v a ON a.session_id = d.session_id JOIN v b ON b.session_id = a.session_id AND b.i = (a.i + d.o) % d.n GROUP BY d.draw), o AS (SELECT corr(score, target) AS observed FROM v)
  SELECT any_value(observed) AS observed, (count(*) FILTER (WHERE abs(r) >= abs(observed)) + 1) / (count(*) + 1) AS p FROM m, o"""


@register("circular_shift_hash", _SHIFT, "observed p")
def circular_shift_hash(spark, sf_dir):
    return s.circular_shift_test(scored(spark, sf_dir), P, T, 20, 11)


@register("latency_percentiles", f"SELECT session_id, count(*) AS n, quantile_cont(gap, 0.5) AS p50, quantile_cont(gap, 0.99) AS p99, quantile_cont(gap, 0.999) AS p999 FROM (SELECT session_id, CAST(ts_ns - lag(ts_ns) OVER (PARTITION BY session_id ORDER BY event_ix) AS DOUBLE) / CAST(1e6 AS DOUBLE) AS gap FROM ({QUOTES_SQL})) WHERE gap IS NOT NULL GROUP BY session_id", "p50 p99 p999")
def latency_percentiles(spark, sf_dir):
    gaps = quotes(spark, sf_dir).withColumn("gap", (F.col("ts_ns") - F.lag("ts_ns", 1).over(f.in_order())) / 1e6).where("gap IS NOT NULL")
    return s.latency_percentiles(gaps, "gap", ("session_id",))


@register("gram_matrix", "SELECT a, b, sum(x * y) AS g, count(*) AS n FROM (SELECT unnest([1, 1, 1, 2, 2, 3]) AS a, unnest([1, 2, 3, 2, 3, 3]) AS b, unnest([imbalance, imbalance, imbalance, spread_bps, spread_bps, target]) AS x, unnest([imbalance, spread_bps, target, spread_bps, target, target]) AS y FROM (" + SCORED_SQL + ")) GROUP BY a, b", "g")
def gram_matrix(spark, sf_dir):
    from ..plans.ridge import gram

    g = gram(scored(spark, sf_dir), ("imbalance", "spread_bps", "target"))
    return g.select(F.explode("cells").alias("c"), "n").select((F.col("c.a") + 1).alias("a"), (F.col("c.b") + 1).alias("b"), F.col("c.g").alias("g"), "n")
