"""Simple forecasters, their errors, and reports on tables of errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def persistence(x: Column, horizon: Column | int) -> Column:
    """The last value, repeated."""
    return F.array_repeat(F.element_at(x, -1), horizon if isinstance(horizon, Column) else F.lit(horizon))


def seasonal_naive(x: Column, horizon: Column | int, period: int) -> Column:
    """The last season, repeated as often as the horizon needs. The input must hold a season."""
    steps = F.sequence(F.lit(0), (horizon if isinstance(horizon, Column) else F.lit(horizon)) - 1)
    return F.transform(steps, lambda k: F.element_at(x, (k % period - period).cast("int")))


def long_predictions(forecasts: DataFrame, keys: list[str], models: dict[str, Column], truth: str = "y") -> DataFrame:
    """(keys, model, step, actual, prediction) from windows with one array per model."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("model"), F.arrays_zip(F.col(truth).alias("actual"), v.alias("prediction")).alias("steps")) for k, v in models.items())))
    out = forecasts.select(*keys, each.alias("m")).select(*keys, "m.model", F.posexplode("m.steps").alias("step", "s"))
    return out.select(*keys, "model", "step", "s.actual", "s.prediction")


def errors(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Mean squared and absolute error and root over origins and steps."""
    e = F.col("prediction") - F.col("actual")
    out = predictions.groupBy(*keys).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.count("*").alias("points"))
    return out.withColumn("rmse", F.sqrt("mse"))


def skill(table: DataFrame, keys: list[str], baseline: str) -> DataFrame:
    """table with skill: the share of the baseline model's squared error that a model saves; null where that is 0."""
    base = F.max(F.when(F.col("model") == baseline, F.col("mse"))).over(W.partitionBy(*keys))
    return table.withColumn("skill", 1 - F.col("mse") / F.nullif(base, F.lit(0.0)))


def ranked(table: DataFrame, keys: list[str], simple: list[str], score: str = "mse") -> DataFrame:
    """table with rank (equal scores share the least), the best score of the simple models and the gain on it in percent."""
    by = W.partitionBy(*keys)
    best = F.min(F.when(F.col("model").isin(simple), F.col(score))).over(by)
    out = table.withColumn("rank", F.rank().over(by.orderBy(score))).withColumn("best_simple", best)
    return out.withColumn("gain_pct", 100 * (F.col("best_simple") - F.col(score)) / F.nullif(F.col("best_simple"), F.lit(0.0)))


def winners(table: DataFrame, keys: list[str], order: list[str], score: str = "mse") -> DataFrame:
    """The model of least score per key, the first in the given order among equals."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("model"))
    best = W.partitionBy(*keys).orderBy(score, place)
    return table.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def ensemble(predictions: DataFrame, keys: list[str], member: str) -> DataFrame:
    """Mean forecast over the members (seeds) at every point."""
    by = [k for k in keys if k != member]
    return predictions.groupBy(*by).agg(F.first("actual").alias("actual"), F.avg("prediction").alias("prediction"), F.count("*").alias("members"))


def replication(results: DataFrame, group: list[str], choice: str, gain: str, least: int = 2) -> DataFrame:
    """Per group over its folds: the choice met most (first by name among equals), its folds, positive gains, whether enough."""
    counts = results.groupBy(*group, choice).agg(F.count("*").alias("times"))
    most = counts.groupBy(*group).agg(F.min(F.struct(-F.col("times"), choice)).alias("m"))
    totals = results.groupBy(*group).agg(F.count("*").alias("folds"), F.count_if(F.col(gain) > 0).alias("positive"))
    return totals.join(most, group).select(*group, F.col(f"m.{choice}").alias("most_chosen"), (-F.col("m.col1")).alias("chosen_folds"), "folds", "positive", (F.col("positive") >= least).alias("replicated"))
