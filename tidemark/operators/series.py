"""Operators on numeric series: order, audits, filling, scaling, windows and segments.

Every window function is partitioned by domain: positions are a series' own, and a series is what one task sorts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.numbers import ffill_array, int_frac

DAY = 86400


def with_positions(series: DataFrame, order: tuple[str, ...] = ("start_ts",)) -> DataFrame:
    """series with i, the row's position in its domain from 0, and n, the domain's rows. Gaps in time are not filled."""
    w = W.partitionBy("domain")
    return series.withColumn("i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("n", F.count("*").over(w).cast("int"))


def order_audit(series: DataFrame, start: str, end: str, row: str, days: int = 30, rows: int = 4096) -> DataFrame:
    """Per domain: rows, rows whose place changes under the stable order by start, end and row, and whether they came sorted.

    row, a number, tells the order in which the rows came. Places are counted in buckets of days and of rows.
    """
    came = ordinal(series, ["domain"], F.floor(F.col(row) / rows), [row], "came")
    placed = ordinal(came, ["domain"], F.floor(F.datediff(F.to_date(start), F.lit("1970-01-01")) / days), [start, end, row], "goes")
    moved = placed.groupBy("domain").agg(F.count("*").alias("rows"), F.count_if(F.col("came") != F.col("goes")).alias("moved"))
    # Whether starts rise or fall as rows came: within buckets of rows, then from each bucket's last to the next one's first.
    chunk = F.floor(F.col(row) / rows).alias("b")
    inside = W.partitionBy("domain", "b").orderBy(row)
    steps = series.select("domain", chunk, row, start).withColumn("before", F.lag(start).over(inside))
    ends = steps.groupBy("domain", "b").agg(
        F.bool_and(F.coalesce(F.col(start) >= F.col("before"), F.lit(True))).alias("rises"), F.bool_and(F.coalesce(F.col(start) <= F.col("before"), F.lit(True))).alias("falls"),
        F.min_by(start, row).alias("first"), F.max_by(start, row).alias("last"),
    )
    last = F.lag("last").over(W.partitionBy("domain").orderBy("b"))
    ends = ends.withColumn("rises", F.col("rises") & F.coalesce(F.col("first") >= last, F.lit(True))).withColumn("falls", F.col("falls") & F.coalesce(F.col("first") <= last, F.lit(True)))
    way = F.when(F.bool_and("rises"), "ascending").when(F.bool_and("falls"), "descending").otherwise("unsorted")
    return moved.join(ends.groupBy("domain").agg(way.alias("arrival")), "domain")


def audit(series: DataFrame, seconds: int = 3600) -> DataFrame:
    """Per domain: rows, first and last start, missing targets, repeated starts, and the modal step between distinct starts.

    The step is in units of so many seconds; the smallest of equally frequent steps counts.
    """
    starts = series.where("start_ts is not null").select("domain", "start_ts").distinct()
    step = (F.unix_micros("start_ts") - F.unix_micros(F.lag("start_ts").over(W.partitionBy("domain").orderBy("start_ts")))) / (1e6 * seconds)
    steps = starts.withColumn("step", step).where("step is not null").groupBy("domain", "step").agg(F.count("*").alias("times"))
    modal = steps.groupBy("domain").agg(F.min(F.struct(-F.col("times"), "step"))["step"].alias("modal_step"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    rows = series.groupBy("domain").agg(
        F.count("*").alias("rows"),
        text(F.min("start_ts")).alias("first_start"),
        text(F.max("start_ts")).alias("last_start"),
        F.count_if(F.col("ot").isNull()).alias("missing"),
        (F.count("start_ts") - F.countDistinct("start_ts")).alias("repeated"),
    )
    return rows.join(modal, "domain", "left")


def forward_fill(value: str, by: str = "domain", order: str = "i") -> Column:
    """The last known value up to each row."""
    return F.last(value, ignorenulls=True).over(W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))


def filled(series: DataFrame, train_end: Column) -> DataFrame:
    """series with filled: forward-filled, then by the median of the training rows. Needs i."""
    w = W.partitionBy("domain")
    median = F.median(F.when(F.col("i") < train_end, F.col("ot"))).over(w)
    return series.withColumn("filled", F.coalesce(forward_fill("ot"), median))


def trimmed(series: DataFrame) -> DataFrame:
    """Rows from the first to the last known target of each domain. Needs i."""
    known = F.when(F.col("ot").isNotNull(), F.col("i"))
    w = W.partitionBy("domain")
    return series.withColumn("_lo", F.min(known).over(w)).withColumn("_hi", F.max(known).over(w)).where("i between _lo and _hi").drop("_lo", "_hi")


def scaled(series: DataFrame, train_end: Column, value: str = "ot") -> DataFrame:
    """series with z, its value scaled by mean and population deviation of the training rows; null where that is nearly 0."""
    w = W.partitionBy("domain")
    train = F.when(F.col("i") < train_end, F.col(value))
    out = series.withColumn("mean", F.avg(train).over(w)).withColumn("std", F.stddev_pop(train).over(w))
    return out.withColumn("z", F.when(F.col("std") > 1e-8, (F.col(value) - F.col("mean")) / F.col("std")))


def windows(series: DataFrame, length: int, horizon: int, inputs: str = "z", truth: str = "z") -> DataFrame:
    """(domain, i, n, x, y): at each origin i the length values before it and the horizon values from it on.

    Origins without a whole input or target are left out, and so are those with an unknown value in the target.
    Structs hold nulls in their place, which collect_list would drop.
    """
    w = W.partitionBy("domain").orderBy("i")
    gather = lambda c, lo, hi: F.transform(F.collect_list(F.struct(F.col(c).alias("v"))).over(w.rowsBetween(lo, hi)), lambda s: s["v"])
    out = series.select("domain", "i", "n", gather(inputs, -length, -1).alias("x"), gather(truth, 0, horizon - 1).alias("y"))
    return out.where((F.size("x") == length) & (F.size("y") == horizon) & F.forall("y", lambda v: v.isNotNull()))


def bounds(n: Column, fractions: dict[str, float]) -> list[Column]:
    """Cut-points of a series of n rows, truncated from binary fractions; the fraction 1 is n itself."""
    return [(n if f == 1.0 else int_frac(n, f)).alias(name) for name, f in fractions.items()]


def segment(i: Column, horizon: Column | int, cuts: list[tuple[str, Column, Column]]) -> Column:
    """The first named segment [lo, hi) that holds an origin with its whole target; null in none."""
    out = F.lit(None).cast("string")
    for name, lo, hi in reversed(cuts):
        out = F.when((i >= lo) & (i + horizon <= hi), F.lit(name)).otherwise(out)
    return out


def half_masks(origins: DataFrame) -> DataFrame:
    """origins (i, horizon, train_end, validation_end) with the target-disjoint halves of the validation span.

    boundary halves the span; calibration targets end by it, decisions start at it. The decision half is halved again, and
    either part may be empty.
    """
    out = origins.withColumn("boundary", F.floor((F.col("train_end") + F.col("validation_end")) / 2).cast("int"))
    out = out.withColumn("middle", F.floor((F.col("boundary") + F.col("validation_end")) / 2).cast("int"))
    end = F.col("i") + F.col("horizon")
    inside = (F.col("i") >= F.col("train_end")) & (end <= F.col("validation_end"))
    decision = inside & (F.col("i") >= F.col("boundary"))
    return out.select(
        "*", (inside & (end <= F.col("boundary"))).alias("calibration"), decision.alias("decision"), (decision & (end <= F.col("middle"))).alias("first_half"), (decision & (F.col("i") >= F.col("middle"))).alias("second_half")
    )


def ordinal(rows: DataFrame, keys: list[str], bucket: Column, order: list[Column | str], name: str) -> DataFrame:
    """rows with name, the place of each among its keys' rows from 1 in the order given.

    bucket must rise with the first of order. Rows are numbered within buckets, and buckets by the rows before them, so
    that no task sorts all rows of a key.
    """
    dealt = rows.withColumn("_b", bucket)
    sizes = dealt.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*keys, "_b", before.alias("_before"))
    inside = F.row_number().over(W.partitionBy(*keys, "_b").orderBy(*order))
    return dealt.join(sizes, [*keys, "_b"]).withColumn(name, inside + F.col("_before")).drop("_b", "_before")


def scaled_channels(tall: DataFrame, train_end: Column) -> DataFrame:
    """(domain, channel, i, z) of channels that vary in training: filled forward, then by the training median, then scaled.

    tall: domain, channel, i, n, value. A channel that is constant or empty in training (sample deviation nearly 0) goes.
    """
    by = W.partitionBy("domain", "channel")
    train = F.col("i") < train_end
    known = F.when(train, F.col("value"))
    out = tall.withColumn("_s", F.stddev_samp(known).over(by)).withColumn("_m", F.median(known).over(by)).where(F.col("_s") > 1e-8)
    last = F.last("value", ignorenulls=True).over(by.orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow))
    out = out.withColumn("v", F.coalesce(last, F.col("_m")))
    mean, std = F.avg(F.when(train, F.col("v"))).over(by), F.stddev_pop(F.when(train, F.col("v"))).over(by)
    return out.select("domain", "channel", "i", ((F.col("v") - mean) / F.nullif(std, F.lit(0.0))).alias("z"))


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """df without the columns that are null in every row; one aggregate over all columns decides."""
    counts = df.agg(*(F.count(f"`{c}`").alias(str(k)) for k, c in enumerate(df.columns))).first()
    return df.select(*(f"`{c}`" for k, c in enumerate(df.columns) if counts[k]))


def hourly_audit(series: DataFrame, least_rows: int) -> DataFrame:
    """Per domain: rows, hours that repeat, gaps, unknown targets, and whether the series meets a strict load's demands."""
    before = F.lag("start_ts").over(W.partitionBy("domain").orderBy("start_ts"))
    steps = series.withColumn("_b", before)
    repeated, missing = F.count_if(F.col("_b") == F.col("start_ts")), F.count_if(F.col("ot").isNull())
    gaps = F.count_if(F.unix_micros("start_ts") - F.unix_micros("_b") > 3_600_000_000)
    holds = (F.count("*") >= least_rows) & (repeated == 0) & (missing == 0)
    return steps.groupBy("domain").agg(F.count("*").alias("rows"), repeated.alias("repeated"), gaps.alias("gaps"), missing.alias("missing"), holds.alias("holds"))


def demand(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rows as they are; one for which a rule isn't true fails the job, with the rule's name."""
    checks = F.lit(True)
    for name, rule in rules.items():
        checks = checks & F.when(F.coalesce(rule, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(name)).cast("boolean"))
    return rows.where(checks)


def prepared(raw: DataFrame, key: str, row: str) -> DataFrame:
    """(domain, i, key, ot): one row per domain and key, trimmed to known targets and placed anew.

    What isn't finite is null; a key whose rows have different known targets is ambiguous, and null; else its first row counts.
    """
    value = F.when(~F.isnan("ot") & (F.abs("ot") < F.lit(float("inf"))), F.col("ot"))
    known = raw.select("domain", key, row, value.alias("ot"))
    first = F.min(F.struct(row, "ot"))["ot"]
    one = known.groupBy("domain", key).agg(F.when(F.countDistinct("ot") <= 1, first).alias("ot")).withColumn("i", F.col(key))
    return trimmed(one).withColumn("i", F.row_number().over(W.partitionBy("domain").orderBy(key)) - 1)


def fixed_split(i: Column, horizon: Column, first: int, rows: dict[str, int]) -> Column:
    """The segment of an origin where segments have fixed counts of rows, one after another; the first starts at a row of its own."""
    cuts, at = [], 0
    for name, n in rows.items():
        cuts.append((name, F.lit(max(at, first)), F.lit(at + n)))
        at += n
    return segment(i, horizon, cuts)


def shared_targets(origins: DataFrame, horizon: int) -> DataFrame:
    """Per domain, the distinct target positions of origins (domain, fold, i) and how many more than one fold has."""
    targets = origins.select("domain", "fold", F.explode(F.sequence(F.col("i"), F.col("i") + horizon - 1)).alias("target")).distinct()
    folds = targets.groupBy("domain", "target").agg(F.count("*").alias("folds"))
    return folds.groupBy("domain").agg(F.count("*").alias("targets"), F.count_if(F.col("folds") > 1).alias("shared"))


def corrupted(windows: DataFrame, keys: list[str]) -> DataFrame:
    """windows for each kind of corruption of x: clean, gaussian noise of 0.1, a tenth missing, the last twelve missing, and
    spikes of 3 on two in a hundred. Missing values are filled forward. Draws are digests of kind, keys and place."""

    def uniform(kind: str, place: Column) -> Column:
        digest = F.md5(F.concat_ws("|", F.lit(kind), *(F.col(k).cast("string") for k in keys), place.cast("string")).cast("binary"))
        return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + 0.5) / 4294967296.0

    noise = lambda p: 0.1 * F.sqrt(-2 * F.log(uniform("a", p))) * F.cos(2 * math.pi * uniform("b", p))
    spike = lambda u: F.when(u < 0.01, -3.0).when(u < 0.02, 3.0).otherwise(0.0)
    x = F.col("x")
    kinds = {
        "clean": x,
        "gaussian": F.transform(x, lambda v, p: v + noise(p)),
        "missing": F.transform(x, lambda v, p: F.when(uniform("m", p) >= 0.1, v)),
        "tail": F.transform(x, lambda v, p: F.when(p < F.size(x) - 12, v)),
        "spikes": F.transform(x, lambda v, p: v + spike(uniform("s", p))),
    }
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), ffill_array(v).alias("x")) for k, v in kinds.items())))
    return windows.withColumn("_c", each).withColumn("kind", F.col("_c.kind")).withColumn("x", F.col("_c.x")).drop("_c")
