"""Resampling statistics, adjusted p-values and gates."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def holm_bh(values: DataFrame, p: str = "p", family: list[str] | None = None, buckets: int = 1024) -> DataFrame:
    """values with holm and bh: step-down and step-up adjusted p-values within a family of tests; null p-values stay out.

    Equal p-values get equal results. Tests are counted per distinct value first; values are ranked within buckets of the
    unit interval, and buckets by the tests, the greatest and the least of those beside them, so that no task sorts a family.
    """
    keys = family or ["_all"]
    known = values.where(F.col(p).isNotNull())
    known = known if family else known.withColumn("_all", F.lit(1))
    counts = known.groupBy(*keys, p).agg(F.count("*").alias("_c")).withColumn("_b", F.least(F.floor(F.col(p) * buckets), F.lit(buckets)))
    by = W.partitionBy(*keys)
    per = counts.groupBy(*keys, "_b").agg(F.sum("_c").alias("_n"))
    per = per.withColumn("_m", F.sum("_n").over(by)).withColumn("_before", F.coalesce(F.sum("_n").over(by.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = W.partitionBy(*keys, "_b")
    placed = counts.join(per.drop("_n"), [*keys, "_b"]).withColumn("_r", F.col("_before") + F.sum("_c").over(inside.orderBy(p)))
    raw = placed.withColumn("_h", (F.col("_m") - F.col("_r") + F.col("_c")) * F.col(p)).withColumn("_u", F.col("_m") / F.col("_r") * F.col(p))
    ends = raw.groupBy(*keys, "_b").agg(F.max("_h").alias("_h"), F.min("_u").alias("_u"))
    ends = ends.select(*keys, "_b", F.max("_h").over(by.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)).alias("_above"), F.min("_u").over(by.orderBy("_b").rowsBetween(1, W.unboundedFollowing)).alias("_below"))
    holm = F.greatest(F.max("_h").over(inside.orderBy(p)), F.col("_above"))
    bh = F.least(F.min("_u").over(inside.orderBy(F.desc(p))), F.col("_below"))
    adjusted = raw.join(ends, [*keys, "_b"]).select(*keys, p, F.least(F.lit(1.0), holm).alias("holm"), F.least(F.lit(1.0), bh).alias("bh"))
    return known.join(adjusted, [*keys, p]).drop("_all")


def empirical_p(nulls: DataFrame, keys: list[str], aligned: str = "aligned", null: str = "null_score") -> DataFrame:
    """(1 + number of null scores at or below the aligned one) / (draws + 1) per key."""
    return nulls.groupBy(*keys).agg(F.count("*").alias("draws"), ((1 + F.count_if(F.col(null) <= F.col(aligned))) / (F.count("*") + 1)).alias("p"))


def block_power(losses: DataFrame, keys: list[str], length: int, position: str = "i", difference: str = "d") -> DataFrame:
    """Per key: whole blocks of so many origins, the standard error of their means, and the least effect that 80% power finds.

    Rows after the last whole block are left out; with fewer than three blocks the effect is null. position counts from 0.
    """
    n = F.count("*").over(W.partitionBy(*keys))
    block = F.floor(F.col(position) / length)
    blocks = losses.withColumn("_b", block).withColumn("_n", n).where(F.col("_b") < F.floor(F.col("_n") / length)).groupBy(*keys, "_b").agg(F.avg(difference).alias("m"))
    critical = NormalDist().inv_cdf(0.975) + NormalDist().inv_cdf(0.80)
    return blocks.groupBy(*keys).agg(F.count("*").alias("blocks"), F.when(F.count("*") >= 3, critical * F.stddev_samp("m") / F.sqrt(F.count("*"))).alias("mde"))


def hash_draw(seed: int, *parts: Column, below: Column) -> Column:
    """A whole number from 0 to below - 1, by the first 8 hex digits of an MD5: the same in any engine."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *(p.cast("string") for p in parts)).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % below


def block_bootstrap(losses: DataFrame, keys: list[str], block: int, repeats: int, seed: int, position: str = "i", difference: str = "d") -> DataFrame:
    """Moving-block bootstrap of a mean difference per key: mean, and the 2.5% and 97.5% points over the repeats.

    Blocks have min(max(2, block), n) rows, the last of a repeat fewer, so that each has n. A block's sum is the difference
    of two prefix sums, so a repeat costs its blocks, not its rows.
    """
    w = W.partitionBy(*keys).orderBy(position)
    prefix = losses.withColumn("at", F.row_number().over(w)).withColumn("s", F.sum(difference).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    sums = prefix.select(*keys, "at", "s").unionByName(losses.select(*keys).distinct().withColumn("at", F.lit(0)).withColumn("s", F.lit(0.0)))
    size = losses.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(difference).alias("mean"))
    size = size.withColumn("length", F.least(F.greatest(F.lit(2), F.lit(block)), F.col("n"))).withColumn("blocks", F.ceil(F.col("n") / F.col("length")))
    draws = size.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).withColumn("b", F.explode(F.sequence(F.lit(1).cast("long"), F.col("blocks"))))
    start = hash_draw(seed, F.col("rep"), F.col("b"), below=F.col("n") - F.col("length") + 1)
    rows = F.when(F.col("b") < F.col("blocks"), F.col("length")).otherwise(F.col("n") - (F.col("blocks") - 1) * F.col("length"))
    draws = draws.withColumn("lo", start.cast("int")).withColumn("hi", (F.col("lo") + rows).cast("int")).select(*keys, "n", "rep", F.explode(F.array(F.struct(F.col("hi").alias("at"), F.lit(1.0).alias("sign")), F.struct(F.col("lo").alias("at"), F.lit(-1.0).alias("sign")))).alias("e"))
    means = draws.select(*keys, "n", "rep", "e.*").join(sums, [*keys, "at"]).groupBy(*keys, "rep").agg((F.sum(F.col("sign") * F.col("s")) / F.first("n")).alias("m"))
    ends = means.groupBy(*keys).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return size.select(*keys, "n", "mean").join(ends, keys)


def circular_shifts(rows: DataFrame, keys: list[str], guard: int, draws: int, seed: int, position: str = "i") -> DataFrame:
    """rows for each of so many drawn shifts from guard to n - guard, with moved: the position that each row takes its partner from."""
    n = F.count("*").over(W.partitionBy(*keys))
    out = rows.withColumn("_n", n).where(F.col("_n") >= 2 * guard).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    out = out.withColumn("shift", guard + hash_draw(seed, F.col("draw"), below=F.col("_n") - 2 * guard + 1))
    return out.withColumn("moved", F.pmod(F.col(position) - F.col("shift"), F.col("_n"))).drop("_n")


def gate(candidates: DataFrame, keys: list[str], p_limit: float = 0.025) -> DataFrame:
    """candidates with eligible: better than the fallback on the whole decision span and in both its halves, and p small.

    An empty half has a null error and makes a candidate ineligible.
    """
    better = lambda a, b: F.coalesce(F.col(a) < F.col(b), F.lit(False))
    return candidates.withColumn("eligible", better("mse", "fallback_mse") & better("mse_first", "fallback_first") & better("mse_second", "fallback_second") & F.coalesce(F.col("p") <= p_limit, F.lit(False)))


def route(gated: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key the eligible variant of least error, the first in order among equals, or numeric_fallback."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("variant"))
    best = F.min(F.when(F.col("eligible"), F.struct("mse", place.alias("at"), "variant")))
    return gated.groupBy(*keys).agg(F.count_if("eligible").alias("eligible"), F.coalesce(best["variant"], F.lit("numeric_fallback")).alias("route"))


def disagreement_gate(points: DataFrame, keys: list[str], quantiles: tuple[float, ...] = (0.5, 0.7, 0.8, 0.9, 0.95, 1.0), weights: tuple[float, ...] = (0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """Per key the threshold on |candidate - numeric| and the weight of the candidate below it that err least.

    Thresholds are 0 and quantiles of the disagreement. The first of equal errors wins, thresholds before weights.
    points: keys, actual, numeric, candidate.
    """
    gap = F.abs(F.col("candidate") - F.col("numeric"))
    cuts = points.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0)), F.percentile(gap, F.array(*map(F.lit, quantiles)))))).alias("t"))
    grid = cuts.select(*keys, F.explode("t").alias("threshold")).withColumn("weight", F.explode(F.array(*map(F.lit, weights))))
    tried = apply_disagreement_gate(points, grid, keys)
    best = tried.groupBy(*keys).agg(F.min(F.struct(F.round("mse", 9).alias("m"), "threshold", "weight", "mse", "accepted")).alias("b"))
    return best.select(*keys, "b.threshold", "b.weight", "b.mse", "b.accepted")


def apply_disagreement_gate(points: DataFrame, gates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, threshold, weight, mse, accepted) of gates on points: the error of the blend and the share of points it changes."""
    gap = F.abs(F.col("candidate") - F.col("numeric"))
    blended = F.col("numeric") + F.when(gap <= F.col("threshold"), F.col("weight")).otherwise(0.0) * (F.col("candidate") - F.col("numeric"))
    e = blended - F.col("actual")
    return points.join(gates, keys).groupBy(*keys, "threshold", "weight").agg(F.avg(e * e).alias("mse"), F.avg((gap <= F.col("threshold")).cast("double")).alias("accepted"))


def within_tolerance(a: Column, b: Column, absolute: float = 1e-7, relative: float = 1e-6) -> Column:
    """Whether a recomputed value agrees with a stored one; two unknown values agree."""
    known = F.abs(a - b) <= absolute + relative * F.abs(b)
    return F.coalesce(known, a.isNull() & b.isNull())


def iid_bootstrap(losses: DataFrame, keys: list[str], repeats: int, seed: int, position: str = "i", difference: str = "d") -> DataFrame:
    """Bootstrap of a mean difference per key by single rows: repeats, and the 2.5% and 97.5% points. position counts from 0."""
    n = F.count("*").over(W.partitionBy(*keys))
    draws = losses.select(*keys, position, n.alias("_n")).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    picked = draws.select(*keys, "rep", hash_draw(seed, F.col("rep"), F.col(position), below=F.col("_n")).alias(position))
    means = picked.join(losses.select(*keys, position, difference), [*keys, position]).groupBy(*keys, "rep").agg(F.avg(difference).alias("m"))
    return means.groupBy(*keys).agg(F.count("*").alias("repeats"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def shuffled(rows: DataFrame, keys: list[str], position: str, value: str, seed: int) -> DataFrame:
    """rows (keys, at, value) with the value of another row of the key: from, shuffled. The order is that of a digest of places."""
    first = F.min(position).over(W.partitionBy(*keys))
    placed = rows.select(*keys, (F.col(position) - first).alias("from"), value)
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("from").cast("string")).cast("binary"))
    moved = placed.withColumn("at", F.row_number().over(W.partitionBy(*keys).orderBy(digest, "from")) - 1).withColumnRenamed(value, "shuffled")
    return moved.join(placed.select(*keys, F.col("from").alias("at"), value), [*keys, "at"])


def development_gate(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the candidates better than the fallback, the mean placebo and the fallback in both halves, and the best of them."""
    better = lambda a, b: F.coalesce(F.col(a) < F.col(b), F.lit(False))
    chosen = better("mse", "fallback_mse") & better("mse", "placebo_mse") & better("mse_first", "fallback_first") & better("mse_second", "fallback_second")
    best = F.min(F.when(chosen, F.struct("mse", "variant")))["variant"]
    return candidates.groupBy(*keys).agg(F.count_if(chosen).alias("chosen"), F.coalesce(best, F.lit("numeric")).alias("variant"))
