"""Queries on forecasts: baselines, their errors, and reports on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.numbers import int_frac
from tidemark.operators import forecast as M, series as S
from tidemark.plans import query
from tidemark.plans.series import HORIZONS, INPUT, SCALED_SQL, SEASON, rounded, train_scaled
from tidemark.sources.tables import table

HS = ", ".join(f"({h})" for h in HORIZONS)
#: A third model beside persistence and the last season: the mean of the input.
LONG_SQL = SCALED_SQL + f""", h(horizon) AS (VALUES {HS}), input AS (SELECT domain, i, n, list(z) OVER (PARTITION BY domain ORDER BY i ROWS BETWEEN {INPUT} PRECEDING AND 1 PRECEDING) AS x, list(z) OVER (PARTITION BY domain ORDER BY i ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING) AS y,
 avg(z) OVER (PARTITION BY domain ORDER BY i ROWS BETWEEN {INPUT} PRECEDING AND 1 PRECEDING) AS mean, lag(z, 13) OVER (PARTITION BY domain ORDER BY i) AS held FROM scaled),
o AS (SELECT domain, horizon, i, x, y, mean, held FROM input CROSS JOIN h WHERE len(x) = {INPUT} AND i >= floor(n * 0.8::DOUBLE) AND i + horizon <= n),
p AS (SELECT domain, horizon, i, CAST(t AS INT) AS step, y[t + 1] AS actual, x[{INPUT}] AS last, x[{INPUT - SEASON + 1} + t % {SEASON}] AS season, mean, held FROM o CROSS JOIN range(0, 24) r(t) WHERE t < horizon),
predictions AS (SELECT domain, horizon, i, step, actual, 'Last' AS model, last AS prediction FROM p UNION ALL SELECT domain, horizon, i, step, actual, 'SeasonalNaive', season FROM p UNION ALL SELECT domain, horizon, i, step, actual, 'WindowMean', mean FROM p),
e AS (SELECT domain, horizon, model, avg((prediction - actual) ** 2) AS mse, avg(abs(prediction - actual)) AS mae, count(*) AS points FROM predictions GROUP BY domain, horizon, model)"""


def test_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long table of the forecasts of every test origin."""
    return predictions_between(spark, sf_dir, int_frac(F.col("n"), 0.8), F.col("n"))


def predictions_between(spark: SparkSession, sf_dir: str, lo: Column, hi: Column) -> DataFrame:
    """Forecasts of every origin whose target lies in [lo, hi). One window of the longest horizon serves the shorter ones."""
    rows = train_scaled(spark, sf_dir)
    longest = max(HORIZONS)
    w = S.W.partitionBy("domain").orderBy("i")
    got = rows.select("domain", "i", "n", F.collect_list("z").over(w.rowsBetween(-INPUT, -1)).alias("x"), F.collect_list("z").over(w.rowsBetween(0, longest - 1)).alias("ahead"))
    got = got.where((F.size("x") == INPUT) & (F.col("i") >= lo)).withColumn("horizon", F.explode(F.array(*map(F.lit, HORIZONS)))).where(F.col("i") + F.col("horizon") <= hi)
    got = got.withColumn("y", F.slice("ahead", F.lit(1), F.col("horizon")))
    mean = F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / INPUT
    models = {"Last": M.persistence(F.col("x"), F.col("horizon")), "SeasonalNaive": M.seasonal_naive(F.col("x"), F.col("horizon"), SEASON), "WindowMean": F.array_repeat(mean, F.col("horizon"))}
    return M.long_predictions(got, ["domain", "horizon", "i"], models)


def error_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.errors(test_predictions(spark, sf_dir), ["domain", "horizon", "model"])


@query(f"""WITH {LONG_SQL} SELECT domain, horizon, model, points, round(mse, 6) AS mse, round(mae, 6) AS mae, round(sqrt(mse), 6) AS rmse, round(1 - mse / max(CASE WHEN model = 'SeasonalNaive' THEN mse END) OVER (PARTITION BY domain, horizon), 6) + 0.0 AS skill FROM e""")
def baseline_metrics(spark, sf_dir):
    table_ = M.skill(error_table(spark, sf_dir), ["domain", "horizon"], "SeasonalNaive")
    return table_.select("domain", "horizon", "model", "points", *(rounded(c).alias(c) for c in ("mse", "mae", "rmse", "skill")))


@query(f"""WITH {LONG_SQL} SELECT domain, horizon, i, model, round(avg((prediction - actual) ** 2), 6) AS mse FROM predictions GROUP BY domain, horizon, i, model""")
def origin_errors(spark, sf_dir):
    return M.errors(test_predictions(spark, sf_dir), ["domain", "horizon", "i", "model"]).select("domain", "horizon", "i", "model", rounded("mse").alias("mse"))


@query(f"""WITH {LONG_SQL}, b AS (SELECT *, rank() OVER (PARTITION BY domain, horizon ORDER BY mse) AS rank, min(CASE WHEN model IN ('Last', 'SeasonalNaive') THEN mse END) OVER (PARTITION BY domain, horizon) AS best FROM e)
SELECT domain, horizon, model, CAST(rank AS INT) AS rank, round(best, 6) AS best_simple, round(100 * (best - mse) / best, 6) + 0.0 AS gain_pct FROM b""")
def baseline_rank(spark, sf_dir):
    out = M.ranked(error_table(spark, sf_dir), ["domain", "horizon"], ["Last", "SeasonalNaive"])
    return out.select("domain", "horizon", "model", "rank", rounded("best_simple").alias("best_simple"), rounded("gain_pct").alias("gain_pct"))


@query(f"""WITH {LONG_SQL} SELECT domain, horizon, model, round(mse, 6) AS mse FROM e QUALIFY row_number() OVER (PARTITION BY domain, horizon ORDER BY mse, CASE model WHEN 'Last' THEN 1 WHEN 'SeasonalNaive' THEN 2 ELSE 3 END) = 1""")
def winners(spark, sf_dir):
    out = M.winners(error_table(spark, sf_dir), ["domain", "horizon"], ["Last", "SeasonalNaive", "WindowMean"])
    return out.select("domain", "horizon", "model", rounded("mse").alias("mse"))


@query(f"""WITH {LONG_SQL} SELECT domain, horizon, round(max(mse) FILTER (model = 'Last'), 6) AS last, round(max(mse) FILTER (model = 'SeasonalNaive'), 6) AS seasonal_naive, round(max(mse) FILTER (model = 'WindowMean'), 6) AS window_mean FROM e GROUP BY domain, horizon""")
def pivot_models(spark, sf_dir):
    wide = error_table(spark, sf_dir).groupBy("domain", "horizon").pivot("model", ["Last", "SeasonalNaive", "WindowMean"]).agg(F.first("mse"))
    return wide.select("domain", "horizon", rounded("Last").alias("last"), rounded("SeasonalNaive").alias("seasonal_naive"), rounded("WindowMean").alias("window_mean"))


@query("""SELECT l_returnflag AS flag, l_linestatus AS status, u.measure, round(avg(u.value), 6) AS mean FROM lineitem, LATERAL (VALUES ('l_quantity', l_quantity), ('l_discount', l_discount), ('l_tax', l_tax)) u(measure, value) GROUP BY 1, 2, 3""")
def unpivot_measures(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_quantity", "l_discount", "l_tax")
    tall = rows.unpivot(["flag", "status"], ["l_quantity", "l_discount", "l_tax"], "measure", "value")
    return tall.groupBy("flag", "status", "measure").agg(F.round(F.avg("value"), 6).alias("mean"))


@query("""SELECT l_returnflag AS model, l_suppkey AS seed, count(*) AS runs, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, max(l_quantity) AS max FROM lineitem GROUP BY 1, 2""")
def seed_summary(spark, sf_dir):
    """Mean and sample deviation per group; a single row has no deviation."""
    q = F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.col("l_suppkey").alias("seed"))
    return rows.agg(F.count("*").alias("runs"), F.round(F.avg(q), 6).alias("mean"), F.round(F.stddev_samp(q), 6).alias("std"), F.max(q).alias("max"))


@query("""SELECT regexp_replace(p_brand || '_s' || (p_partkey % 3), '_s[0-9]+$', '') AS family, count(*) AS runs, round(avg(p_retailprice), 6) AS mean, round(stddev_samp(p_retailprice), 6) AS std FROM part GROUP BY 1""")
def family_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("_s"), (F.col("p_partkey") % 3).cast("string")).alias("model"), "p_retailprice")
    family = F.regexp_replace("model", r"_s\d+$", "").alias("family")
    return rows.groupBy(family).agg(F.count("*").alias("runs"), F.round(F.avg("p_retailprice"), 6).alias("mean"), F.round(F.stddev_samp("p_retailprice"), 6).alias("std"))


@query(f"""WITH {LONG_SQL}, m AS (SELECT domain, horizon, i, step, actual, avg(prediction) AS prediction FROM predictions GROUP BY domain, horizon, i, step, actual) SELECT domain, horizon, round(avg((prediction - actual) ** 2), 6) AS mse FROM m GROUP BY domain, horizon""")
def ensemble_errors(spark, sf_dir):
    """Errors of the mean forecast over the models, taken at every point."""
    mean = M.ensemble(test_predictions(spark, sf_dir), ["domain", "horizon", "i", "step", "model"], "model")
    return M.errors(mean, ["domain", "horizon"]).select("domain", "horizon", rounded("mse").alias("mse"))


@query(f"""WITH {LONG_SQL}, d AS (SELECT domain, model, avg(mse) AS mse FROM e GROUP BY domain, model) SELECT model, round(avg(mse), 6) AS macro_mse, count(*) AS domains FROM d GROUP BY model""")
def macro_mean(spark, sf_dir):
    by_domain = error_table(spark, sf_dir).groupBy("domain", "model").agg(F.avg("mse").alias("mse"))
    return by_domain.groupBy("model").agg(rounded(F.avg("mse")).alias("macro_mse"), F.count("*").alias("domains"))


@query(f"""WITH {LONG_SQL}, g AS (SELECT a.domain, a.horizon, 100 * (b.mse - a.mse) / b.mse AS gain FROM e a JOIN e b ON a.domain = b.domain AND a.horizon = b.horizon AND a.model = 'WindowMean' AND b.model = 'Last'),
r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY gain DESC, horizon) AS k, sum(gain) OVER (PARTITION BY domain) AS total FROM g)
SELECT domain, round(avg(gain), 6) AS mean_gain, round(avg(gain) FILTER (k > 1), 6) AS without_largest, round(max(CASE WHEN k = 1 THEN gain / total END), 6) AS largest_share FROM r GROUP BY domain""")
def leave_largest_out(spark, sf_dir):
    wide = error_table(spark, sf_dir).groupBy("domain", "horizon").pivot("model", ["Last", "WindowMean"]).agg(F.first("mse"))
    gains = wide.select("domain", "horizon", (100 * (F.col("Last") - F.col("WindowMean")) / F.col("Last")).alias("gain"))
    w = S.W.partitionBy("domain")
    gains = gains.withColumn("k", F.row_number().over(w.orderBy(F.desc("gain"), "horizon"))).withColumn("total", F.sum("gain").over(w))
    return gains.groupBy("domain").agg(rounded(F.avg("gain")).alias("mean_gain"), rounded(F.avg(F.when(F.col("k") > 1, F.col("gain")))).alias("without_largest"), rounded(F.max(F.when(F.col("k") == 1, F.col("gain") / F.col("total")))).alias("largest_share"))


@query(f"""WITH {LONG_SQL}, c AS (SELECT domain, horizon, avg((last - actual) ** 2) AS clean, avg((held - actual) ** 2) AS corrupt FROM p GROUP BY domain, horizon)
SELECT domain, horizon, round(clean, 6) AS clean_mse, round(corrupt, 6) AS corrupt_mse, round(100 * (corrupt - clean) / clean, 6) + 0.0 AS degradation_pct FROM c""")
def robust_tail_missing(spark, sf_dir):
    """Persistence when the last twelve inputs are missing and filled forward, against the clean input."""
    rows = train_scaled(spark, sf_dir)
    held = rows.select("domain", "i", F.lag("z", 13).over(S.W.partitionBy("domain").orderBy("i")).alias("held"))
    clean = test_predictions(spark, sf_dir).where("model = 'Last'").join(held, ["domain", "i"])
    square = lambda c: F.avg((F.col(c) - F.col("actual")) * (F.col(c) - F.col("actual")))
    out = clean.groupBy("domain", "horizon").agg(square("prediction").alias("clean"), square("held").alias("corrupt"))
    return out.select("domain", "horizon", rounded("clean").alias("clean_mse"), rounded("corrupt").alias("corrupt_mse"), rounded(100 * (F.col("corrupt") - F.col("clean")) / F.col("clean")).alias("degradation_pct"))


@query("""WITH c(kind) AS (VALUES ('AIR'), ('click'), ('error'), ('purchase'), ('signup'), ('view')) SELECT kind, count(event_id) AS times FROM c LEFT JOIN events ON event_type = kind GROUP BY kind""")
def value_counts_full(spark, sf_dir):
    """Counts of a fixed list of kinds, those that don't occur at 0."""
    kinds = spark.range(1).select(F.explode(F.array(*map(F.lit, ("AIR", "click", "error", "purchase", "signup", "view")))).alias("kind"))
    counts = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("times"))
    return kinds.join(counts, "kind", "left").select("kind", F.coalesce("times", F.lit(0)).alias("times"))


@query("""WITH r AS (SELECT c_nationkey AS domain, c_custkey % 3 AS fold, CASE WHEN c_acctbal > 5000 THEN 'semantic' WHEN c_acctbal > 0 THEN 'frequency' ELSE 'numeric' END AS variant, c_acctbal AS gain FROM customer),
t AS (SELECT domain, fold, variant, count(*) AS n FROM r GROUP BY ALL), m AS (SELECT domain, fold, variant, n FROM t QUALIFY row_number() OVER (PARTITION BY domain, fold ORDER BY n DESC, variant) = 1),
s AS (SELECT domain, fold, count(*) AS folds, count(*) FILTER (gain > 0) AS positive FROM r GROUP BY domain, fold) SELECT domain, fold, variant AS most_chosen, n AS chosen_folds, folds, positive, positive >= 2 AS replicated FROM s JOIN m USING (domain, fold)""")
def cross_fold_replication(spark, sf_dir):
    variant = F.when(F.col("c_acctbal") > 5000, "semantic").when(F.col("c_acctbal") > 0, "frequency").otherwise("numeric")
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("domain"), (F.col("c_custkey") % 3).alias("fold"), variant.alias("variant"), F.col("c_acctbal").alias("gain"))
    return M.replication(rows, ["domain", "fold"], "variant", "gain")
