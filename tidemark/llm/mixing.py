"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0 to 1. Its integral is the source's cumulative token demand. A
source's documents, in an order given by a keyed hash, fill that demand one after another, pass after pass; inverting the
demand at a document's offset gives its training position, by which the mix is range-sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.llm.common import WORD, cut_lineage

#: Documents of a hash bucket of a source, about. Documents are summed in buckets, then buckets, so that no task holds a source.
BUCKET_ROWS = 2_000
#: The most sources whose plan is broadcast; beyond, it is joined.
BROADCAST_SOURCES = 100_000


def sizes(docs: DataFrame, seed: int = 42, *more: Column) -> DataFrame:
    """(doc_id, source, size, order): words of each whole text, null: 0; order is a hash of seed, doc_id and text.

    The text's part spreads rows without a doc_id, or that repeat one.
    """
    order = F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text"))
    return docs.select("doc_id", "source", *more, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), order.alias("order"))


def targets(sized: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, repeats: float = 2.0) -> DataFrame:
    """(source, rows, source_size, weight, target) per source: share of all sizes by weight, at most repeats times its size.

    Weights are dealt to sources in code point order, null last, over and over. What a source can't take goes to the
    others by weight until none is above its limit: with sources in order of limit per weight, the first k are at their
    limit, where k is the least for which the rest, dealt by weight, stays within the next one's limit.
    The windows here run over one row per source.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*map(F.lit, weights))
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    by = by.withColumn("weight", F.element_at(cycle, (F.row_number().over(order) - 1) % len(weights) + 1))
    by = by.withColumn("limit", F.col("source_size") * F.lit(repeats))
    tight = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    every = W.partitionBy()
    by = (
        by.withColumn("wanted", F.lit(share) * F.sum("source_size").over(every))
        .withColumn("fixed", F.coalesce(F.sum("limit").over(tight.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("others", F.sum("weight").over(tight.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("wanted") - F.col("fixed")) / F.col("others"))
        .withColumn("free", F.col("level") * F.col("weight") <= F.col("limit"))
    )
    level = F.min(F.when(F.col("free"), F.struct(F.row_number().over(tight).alias("k"), F.col("level")))).over(every)["level"]
    return by.select("source", "rows", "source_size", "weight", F.least("limit", F.coalesce(level * F.col("weight"), F.col("limit"))).alias("target"))


def position(offset: Column, target: Column, slope: Column) -> Column:
    """The training time at which a source's demand reaches offset.

    The schedule is weight * (1 + slope * (2 t - 1)), slope from -1 to 1, so that its integral to t is
    target * ((1 - slope) t + slope t^2); this solves that for t.
    """
    x = F.when(target > 0, F.least(offset / target, F.lit(1.0))).otherwise(F.lit(0.0))
    root = F.sqrt(F.greatest((1 - slope) * (1 - slope) + 4 * slope * x, F.lit(0.0)))
    # 2x / ((1 - slope) + root) is the root of the quadratic that stays finite at slope 0.
    down = (1 - slope) + root
    return F.when(down > 0, F.least(2 * x / down, F.lit(1.0))).otherwise(F.lit(0.0))


def mix(docs: DataFrame, seed: int = 42, slopes: tuple[float, ...] = (-0.5, 0.0, 0.5), carry: bool = False) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, passes, taken; with carry, all its columns as row.

    passes: array of (pass, words, position), a pass being one run over the source. A document's words in a pass are the
    part of its span that lies under the source's target, so each source's words come to the target, rounded, and only the
    document at the border is taken in part. Slopes of the schedules are dealt to sources like the weights: sources
    that fade out, stay and rise. The order is a hash of seed, doc_id and text, so that reruns agree.
    A null or empty text has size 0 and takes nothing; a source without words has target 0; repeated rows each count, and
    rows equal in doc_id and text are taken one after another.
    """
    cycle = F.array(*map(F.lit, slopes))
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("key")  # never null, so that one shuffle serves join and window
    sized = cut_lineage(sizes(docs, seed))  # so that the texts are measured once
    plan = targets(sized)
    plan = plan.withColumn("slope", F.element_at(cycle, (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(slopes) + 1))
    plan = cut_lineage(plan.select(key, "source_size", "target", "slope", F.ceil(F.col("rows") / BUCKET_ROWS).cast("int").alias("buckets")))
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    bucket = F.pmod("order", F.col("buckets")).cast("int").alias("bucket")
    before = W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    by = sized.select(key, "size", "order").join(plan, "key").groupBy("key", bucket).agg(F.sum("size").alias("words"))
    by = by.select("key", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    rows = sizes(docs, seed, F.struct("*").alias("row")) if carry else sized
    placed = rows.withColumn("key", key).join(plan, "key").withColumn("bucket", bucket).join(by, ["key", "bucket"])
    inside = W.partitionBy("key", "bucket").orderBy("order", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    spans = placed.withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))).withColumn("wanted", F.round("target").cast("long"))

    def taken(k: int) -> Column:
        at = F.col("start") + k * F.col("source_size")
        words = F.greatest(F.least(F.col("wanted") - at, F.col("size")), F.lit(0)).cast("long")
        return F.struct(F.lit(k).alias("pass"), words.alias("words"), position(at.cast("double"), F.col("target"), F.col("slope")).alias("position"))

    passes = F.filter(F.array(taken(0), taken(1)), lambda p: p["words"] > 0)
    return spans.select("doc_id", "source", "size", "source_size", "target", passes.alias("passes"), *["row"] * carry).withColumn(
        "taken", F.aggregate("passes", F.lit(0).cast("long"), lambda s, p: s + p["words"])
    )


def in_training_order(rows: DataFrame, *by: Column, partitions: int | None = None) -> DataFrame:
    """rows range-sorted by training position, then by what else is given; rows without a position come last."""
    order = [F.col("position").asc_nulls_last(), *by]
    return (rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)).sortWithinPartitions(*order)


def curriculum(mixed: DataFrame, partitions: int | None = None) -> DataFrame:
    """The mix in training order: one row per document and pass, range-sorted by position (ties by doc_id, pass)."""
    each = mixed.select("doc_id", "source", F.explode("passes").alias("p")).select("doc_id", "source", "p.*")
    return in_training_order(each, F.col("doc_id"), F.col("pass"), partitions=partitions)


def documents_in_order(mixed: DataFrame) -> DataFrame:
    """The mix in training order, one row per document, at its first pass; documents that aren't taken come last.

    The range sort samples its input before it sorts, so the plan is written first.
    """
    return in_training_order(cut_lineage(mixed.withColumn("position", F.get("passes", F.lit(0))["position"])), F.col("doc_id"))


def take(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The documents of the mix in training order, with their own columns: a row for each pass that takes one.

    Texts stay whole: a document that a pass takes at least half of is in it, others aren't.
    """
    each = mix(docs, seed, carry=True).select("row", "size", F.explode("passes").alias("p")).where(2 * F.col("p.words") >= F.col("size"))
    return in_training_order(each.withColumn("position", F.col("p.position")), F.col("row.doc_id"), F.col("p.pass")).select("row.*")
