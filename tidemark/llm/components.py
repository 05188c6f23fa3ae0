"""Connected components: of a link table by alternating star contraction, as DataFrame jobs, and of a task's own links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import cut_lineage


def join_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index joined to each, after the pairs (a, b) join what root joins already."""
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if (root == before).all():
            return root


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v, low) for each pair, low being the least of u and all its neighbours v."""
    low = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
    return pairs.join(low, "u")


def _are_stars(pairs: DataFrame) -> bool:
    """Whether each u has one v and no v is itself a u: then every pair leads to its component's smallest id."""
    ends = pairs.select(F.col("u").alias("x"), F.lit(1).alias("leads"), F.lit(0).alias("led")).unionByName(pairs.select(F.col("v").alias("x"), F.lit(0).alias("leads"), F.lit(1).alias("led")))
    return ends.groupBy("x").agg(F.sum("leads").alias("leads"), F.max("led").alias("led")).where("leads > 1 or leads = 1 and led = 1").isEmpty()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id in a link: component is the smallest id that its links reach.

    Each round points larger neighbours, then smaller ones, at the least neighbour, until all pairs are stars around a
    smallest id. A hub's pairs meet its least neighbour in a plain join, which adaptive execution can split; minima are
    combined before a shuffle. Null ends and self-links are left out: an id that has no other link isn't in the result.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    pairs = cut_lineage(pairs)
    while not _are_stars(pairs):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        small = _with_least(large)
        pairs = cut_lineage(
            small.where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(small.select("u", F.col("low").alias("v"))).where("u != v").distinct()
        )
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
