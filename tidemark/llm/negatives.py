"""Hard negatives for anchors, scored by the method of Four Russians.

An anchor's numbers are taken in groups of eight dimensions. For each group a table holds the sums of all 256 subsets of the
eight. Candidates are kept as bit planes, packed so that one byte holds one bit of the eight numbers of a group: it is the
index into the group's table. A plane's score is the sum of its lookups, and shifting and adding the planes from the top gives
the full inner product, exactly.

Candidates are dealt to cells of bounded size by a hash, anchors to groups. Every group meets every cell once, as two packed
rows, and leaves the best few of each anchor; windows over those give the result. The anchors are the stated queries, a
hundredth of the rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.llm.common import as_parquet, cut_lineage

#: Rows of a cell and anchors of a group, about: the memory of a task.
CELL, GROUP = 8192, 1024
#: Dimensions in a group of a table's index.
EIGHT = 8
#: Numbers are below this in size, so that a product of a thousand of them fits 64 bits.
LIMIT = 1 << 26
#: Candidates that one step scores against one table: their lookups stay in the processor's cache.
STEP = 4096


def whole_numbers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(id, label, v array<long>): the rows that take part, one per vec_id.

    Out are rows with a null vec_id, label or vector, with a null or non-finite component, or with one whose whole number is
    2 ** 26 or more, since their products don't fit 64 bits. Of rows that repeat a vec_id, the least label, then vector, stays.
    """
    known = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) < LIMIT))  # false for NaN, which is above all
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    id = F.col("vec_id").cast("long")
    label = F.when(id % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(known)
    each = rows.select(id.alias("id"), F.struct(label.alias("label"), v.alias("v")).alias("row")).groupBy("id").agg(F.min("row").alias("row"))
    return each.select("id", "row.label", "row.v")


def bit_planes(v: np.ndarray) -> np.ndarray:
    """planes[b, g, k]: the byte of bit b of candidate k's numbers in group g, lowest bit first; the last plane is the sign's."""
    bits = int(max(int(v.max(initial=0)), -int(v.min(initial=0)) - 1, 0)).bit_length() + 1
    padded = np.pad(v, ((0, 0), (0, -v.shape[1] % EIGHT)))
    return np.stack([np.packbits((padded >> b & 1).astype(np.uint8), axis=1, bitorder="little").T for b in range(bits)])


def subset_sums(anchor: np.ndarray) -> np.ndarray:
    """tables[g, s]: the sum of those of the group's eight numbers whose bits are set in s."""
    groups = np.pad(anchor, (0, -len(anchor) % EIGHT)).reshape(-1, EIGHT)
    tables = np.zeros((len(groups), 1), np.int64)
    for k in range(EIGHT):
        tables = np.hstack((tables, tables + groups[:, k : k + 1]))
    return tables


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Inner products of an anchor with the candidates of the planes: lookups per group, planes shifted and added from the top."""
    top, groups = len(planes) - 1, min(len(tables), planes.shape[1])
    total = np.zeros(planes.shape[2], np.int64)
    for b in range(top, -1, -1):
        one = np.zeros(planes.shape[2], np.int64)
        for g in range(groups):
            one += tables[g].take(planes[b, g])
        total = -one if b == top else (total << 1) + one
    return total


def all_scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    return np.concatenate([scores(tables, planes[:, :, at : at + STEP]) for at in range(0, planes.shape[2], STEP)] or [np.zeros(0, np.int64)])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of numbers, shorter ones filled with zeros."""
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def _longs(row: bytes) -> np.ndarray:
    return np.frombuffer(row, np.int64)


def cells(rows: DataFrame, number: int) -> DataFrame:
    """(cell, ids, labels, shape, planes): each cell's candidates in one row, by label and id, as packed bit planes."""

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        ids, labels, v = table["id"].to_numpy(), table["label"].to_numpy(), _matrix(table["v"])
        order = np.lexsort((ids, labels))
        planes = bit_planes(v[order])
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()), "ids": [ids[order].tobytes()], "labels": [labels[order].tobytes()], "shape": pa.array([list(planes.shape)], pa.list_(pa.int32())), "planes": [planes.tobytes()]})

    dealt = rows.withColumn("cell", F.pmod(F.xxhash64("id"), F.lit(number)).cast("int"))
    return dealt.groupBy("cell").applyInArrow(packed, "cell int, ids binary, labels binary, shape array<int>, planes binary")


def meet(index: DataFrame, number: int, anchors: DataFrame, groups: int, best: Callable, schema: str) -> DataFrame:
    """What best gives for every anchor and cell: best(anchor as a dict, ids, labels, planes) returns columns of the schema.

    A group of anchors and a cell are joined as packed rows, so a task holds one of each.
    """
    names = [c for c in anchors.columns if c != "v"]

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "anchors": [sink.getvalue().to_pybytes()]})

    dealt = anchors.withColumn("part", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(groups)).cast("int")).select("part", *anchors.columns)
    asked = dealt.groupBy("part").applyInArrow(packed, "part int, anchors binary").withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(number - 1))))
    held = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        columns: list[list] = [[] for _ in kinds]
        if left.num_rows and right.num_rows:
            with pa.ipc.open_stream(left["anchors"][0].as_py()) as stream:
                rows = stream.read_all()
            ids, labels, shape = _longs(right["ids"][0].as_py()), _longs(right["labels"][0].as_py()), right["shape"][0].as_py()
            planes = np.frombuffer(right["planes"][0].as_py(), np.uint8).reshape(shape)
            v = _matrix(rows["v"])
            for k, row in enumerate(rows.select(names).to_pylist()):
                for column, values in zip(columns, best(row, subset_sums(v[k]), ids, labels, planes), strict=True):
                    column.append(values)
        return pa.table({n: np.concatenate(c) if c else np.zeros(0, np.int64) for n, c in zip(kinds, columns, strict=True)})

    kinds = [c.split(" ")[0] for c in schema.split(", ")]
    return asked.groupBy("part", "cell").cogroup(held.groupBy("part", "cell")).applyInArrow(run, schema)


def first(values: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest values, ties by smaller id."""
    if len(values) > k:
        places = np.flatnonzero(values >= np.partition(values, len(values) - k)[len(values) - k])
    else:
        places = np.arange(len(values))
    return places[np.lexsort((ids[places], -values[places]))[:k]]


def positives(index: DataFrame, number: int, anchors: DataFrame, groups: int, k: int = 5) -> DataFrame:
    """(anchor, positive, score): the k other rows of an anchor's label with the highest scores, ties by smaller id."""

    def best(row: dict, tables: np.ndarray, ids: np.ndarray, labels: np.ndarray, planes: np.ndarray):
        lo, hi = np.searchsorted(labels, row["label"], "left"), np.searchsorted(labels, row["label"], "right")
        own = ids[lo:hi]
        found = all_scores(tables, planes[:, :, lo:hi])
        others = np.flatnonzero(own != row["id"])
        chosen = others[first(found[others], own[others], k)]
        return np.full(len(chosen), row["id"]), own[chosen], found[chosen]

    each = meet(index, number, anchors, groups, best, "anchor long, positive long, score long")
    place = F.row_number().over(W.partitionBy("anchor").orderBy(F.desc("score"), "positive"))
    return each.withColumn("k", place).where(F.col("k") <= k).drop("k")


def mine(vectors: DataFrame, anchor: Column | None = None, positive_count: int = 5, negative_count: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and positive, the first
    rows of another label whose score is from low to high percent of the positive's.

    anchor says, of an id, whether it is one (divisible by 100). Higher scores come first, ties by smaller id. Vectors of
    different lengths are multiplied as far as both go. whole_numbers says which rows take part. An anchor without another row
    of its label has no positive, and a positive without such negatives no row; an empty table gives none.
    """
    rows = as_parquet(whole_numbers(vectors))
    is_anchor = F.col("id") % 100 == 0 if anchor is None else anchor
    sizes = rows.agg(F.count("*").alias("rows"), F.count_if(is_anchor).alias("anchors")).first()
    number, groups = max(1, -(-sizes["rows"] // CELL)), max(1, -(-sizes["anchors"] // GROUP))
    index = as_parquet(cells(rows, number))
    anchors = rows.where(is_anchor)
    near = cut_lineage(positives(index, number, anchors, groups, positive_count))
    asked = near.groupBy("anchor").agg(F.collect_list("positive").alias("positives"), F.collect_list("score").alias("wanted"))
    asked = anchors.join(asked, anchors["id"] == asked["anchor"]).drop("anchor")

    def best(row: dict, tables: np.ndarray, ids: np.ndarray, labels: np.ndarray, planes: np.ndarray):
        found = all_scores(tables, planes)
        limits = [(-(-low * p // 100), high * p // 100, q, p) for q, p in zip(row["positives"], row["wanted"])]
        places = np.flatnonzero((labels != row["label"]) & (found >= min(x[0] for x in limits)) & (found <= max(x[1] for x in limits)))
        places = places[np.lexsort((ids[places], -found[places]))]
        falling = -found[places]
        out = []
        for least, most, q, p in limits:
            at = int(np.searchsorted(falling, -most, "left"))
            end = min(at + negative_count, int(np.searchsorted(falling, -least, "right")))
            chosen = places[at : max(at, end)]
            n = len(chosen)
            out.append((np.full(n, row["id"]), np.full(n, q), ids[chosen], np.full(n, p), found[chosen]))
        return tuple(map(np.concatenate, zip(*out)))

    each = meet(index, number, asked, groups, best, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    rank = F.row_number().over(W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= negative_count).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
