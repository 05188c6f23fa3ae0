"""Point-in-time joins of dated facts to forecast origins, and overlaps of intervals.

Both are range joins. Spark has no operator for these, so each side is dealt to time buckets and joined on an equal bucket:
a fact lies in one bucket, an origin's span in those it touches, and no pair is met twice. Pairs are filtered after that, so
the work follows the facts near an origin, not all facts times all origins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.text import normalise, stable_id, iso, is_valid, tells_future

SOURCES = ("report", "search")


def corpus(facts: DataFrame) -> DataFrame:
    """Valid facts once per (source, text): domain, source, start_ts, end_ts, fact, text_id, characters, future.

    Of equal texts the one with the earliest end stays, then the earliest start, then the least fact_id. Facts without a
    whole interval, or that end before they start, are left out.
    """
    texts = facts.withColumn("fact", normalise(F.col("fact"))).where(is_valid(F.col("fact"))).where("end_ts >= start_ts")
    told = {"text_id": stable_id(F.col("domain"), F.col("source"), iso(F.col("start_ts")), iso(F.col("end_ts")), F.col("fact")), "characters": F.length("fact"), "future": tells_future(F.col("fact"))}
    # What is told of a text is told before the shuffle, which goes by its digest: so a plan without the text ships none.
    texts = texts.withColumns(told | {"_d": F.sha2("fact", 256)})
    first = W.partitionBy("domain", "source", "_d").orderBy("end_ts", "start_ts", "fact_id")
    return texts.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "_d")


def origins(series: DataFrame, input_len: int) -> DataFrame:
    """(domain, i, history_start, cutoff): origins are rows of a series, their history the input_len rows before. Needs i."""
    past = F.lag("start_ts", input_len).over(W.partitionBy("domain").orderBy("i"))
    return series.select("domain", "i", past.alias("history_start"), F.col("start_ts").alias("cutoff")).where("history_start is not null")


def bucket(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts) / (seconds * 1_000_000)).cast("long")


def eligible(origin: DataFrame, facts: DataFrame, seconds: int = 86400) -> DataFrame:
    """Pairs of an origin and a fact of its domain with history_start <= end_ts < cutoff. A fact's start plays no part."""
    spans = origin.withColumn("bucket", F.explode(F.sequence(bucket(F.col("history_start"), seconds), bucket(F.col("cutoff"), seconds))))
    dated = facts.withColumn("bucket", bucket(F.col("end_ts"), seconds))
    return spans.join(dated, ["domain", "bucket"]).where("end_ts >= history_start and end_ts < cutoff").drop("bucket")


def top_facts(pairs: DataFrame, k: int, fact_id: str = "text_id") -> DataFrame:
    """The newest k facts per origin and source, ties by id: adds rank, and age in days (fractions count)."""
    newest = W.partitionBy("domain", "i", "source").orderBy(F.desc("end_ts"), fact_id)
    age = (F.unix_micros("cutoff") - F.unix_micros("end_ts")) / 86400e6
    return pairs.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= k).withColumn("age", age)


def text_index(origin: DataFrame, facts: DataFrame, k: int = 32, seconds: int = 86400, fact_id: str = "text_id") -> DataFrame:
    """One row per origin, those without facts too: counts available and selected, ids in order, latest and mean age.

    Available counts are taken before the limit of k, in an aggregate of their own, so that the window only ever keeps k.
    """
    pairs = eligible(origin, facts, seconds)
    key = ["domain", "i"]
    counts = pairs.groupBy(*key).agg(*(F.count_if(F.col("source") == s).alias(f"{s}_available") for s in SOURCES))
    top = top_facts(pairs, k, fact_id)
    ids = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("source") == s, F.struct("rank", F.col(fact_id).cast("string").alias("id"))))), lambda x: x["id"])
    chosen = top.groupBy(*key).agg(*(ids(s).alias(f"{s}_ids") for s in SOURCES), F.min("age").alias("latest_age"), F.avg("age").alias("mean_age"))
    out = origin.join(counts, key, "left").join(chosen, key, "left")
    empty = F.array().cast("array<string>")
    out = out.withColumns({f"{s}_ids": F.coalesce(f"{s}_ids", empty) for s in SOURCES}).withColumns({f"{s}_available": F.coalesce(f"{s}_available", F.lit(0)) for s in SOURCES})
    return out.withColumns({f"{s}_selected": F.size(f"{s}_ids") for s in SOURCES})


def quality(index: DataFrame, future: DataFrame) -> DataFrame:
    """Ten quality features of each row of a text index; future has (domain, i, report_future, search_future) shares.

    History is in whole days, one at least; a missing age counts as a whole history.
    """
    days = F.greatest(F.floor((F.unix_micros("cutoff") - F.unix_micros("history_start")) / 86400e6).cast("double"), F.lit(1.0))
    out = index.join(future, ["domain", "i"], "left")
    return out.select(
        "domain", "i",
        *(F.log1p(f"{s}_available").alias(f"{s}_log_available") for s in SOURCES), *(F.log1p(f"{s}_selected").alias(f"{s}_log_selected") for s in SOURCES),
        *((F.col(f"{s}_selected") == 0).cast("double").alias(f"{s}_missing") for s in SOURCES),
        F.coalesce(F.col("latest_age") / days, F.lit(1.0)).alias("latest_age_ratio"), F.coalesce(F.col("mean_age") / days, F.lit(1.0)).alias("mean_age_ratio"),
        *(F.coalesce(f"{s}_future", F.lit(0.0)).alias(f"{s}_future_fraction") for s in SOURCES),
    )


def overlap_counts(spans: DataFrame, intervals: DataFrame, key: str, seconds: int = 86400) -> DataFrame:
    """spans with n_overlaps: intervals of the same domain that meet a span, both closed. Spans without one have 0.

    An interval and a span meet in each bucket they share; the pair counts in the later of their first buckets.
    """
    wide = lambda df, lo, hi: df.withColumn("_first", bucket(F.col(lo), seconds)).withColumn("bucket", F.explode(F.sequence("_first", bucket(F.col(hi), seconds))))
    a = wide(spans.select("domain", key, "start_ts", "end_ts"), "start_ts", "end_ts").withColumnRenamed("_first", "_a")
    b = wide(intervals.select("domain", F.col("start_ts").alias("_s"), F.col("end_ts").alias("_e")), "_s", "_e").withColumnRenamed("_first", "_b")
    met = a.join(b, ["domain", "bucket"]).where("start_ts <= _e and _s <= end_ts and bucket = greatest(_a, _b)")
    counts = met.groupBy("domain", key).agg(F.count("*").alias("n_overlaps"))
    return spans.join(counts, ["domain", key], "left").withColumn("n_overlaps", F.coalesce("n_overlaps", F.lit(0)))


def decay(age_days: Column, history_days: Column) -> Column:
    """Weight of a fact by age: halves every quarter of the history, one day at least."""
    return F.exp(-F.log(F.lit(2.0)) * age_days / F.greatest(history_days / 4, F.lit(1.0)))


def weighted_mean(vectors: DataFrame, keys: list[str], vector: str = "embedding", weight: str = "w") -> DataFrame:
    """keys and mean: the weighted mean vector per key, scaled to length 1 unless it is nearly 0.

    Components are summed apart, so that a key's vectors are never gathered in one task.
    """
    parts = vectors.select(*keys, weight, F.posexplode(vector).alias("pos", "v"))
    means = parts.groupBy(*keys, "pos").agg((F.sum(F.col(weight) * F.col("v")) / F.sum(weight)).alias("m"))
    rows = means.groupBy(*keys).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"), F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("c"))
    return rows.select(*keys, F.transform("c", lambda c: F.when(F.col("norm") > 1e-8, c["m"] / F.col("norm")).otherwise(c["m"])).alias("mean"))
