"""Sums of products of columns, as matrices: what least squares needs of any number of rows.

A task adds up the outer products of its rows in matrix form, one matrix per key; matrices of many tasks are added in a tree.
What is shuffled follows the keys and columns, not the rows, and no task holds a key's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

#: Bytes of matrices that a task holds before it sends them, and matrices that one step of the tree adds.
HELD, FAN = 64_000_000, 64


def rows_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column, all rows of one length, as a matrix."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(len(lists), -1) if len(lists) else values.reshape(0, 0)


def matrix(raw: bytes) -> np.ndarray:
    """A square matrix from its bytes."""
    values = np.frombuffer(raw, float)
    return values.reshape(int(round(np.sqrt(len(values)))), -1)


def gram(rows: DataFrame, keys: list[str], vector: str = "v") -> DataFrame:
    """(keys, gram binary): per key the sum of v v' over its rows. v: array<double> of one length per key, without nulls."""
    kinds = [f"{k} {t}" for k, t in rows.select(*keys).dtypes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        part = TaskContext.get().partitionId()

        def out() -> pa.RecordBatch:
            frame = pd.DataFrame(list(held), columns=keys)
            arrays = [pa.array(frame[k], type=f.type) for k, f in zip(keys, batch.schema)]
            grams = pa.array([m.tobytes() for m in held.values()], pa.binary())
            return pa.RecordBatch.from_arrays([*arrays, pa.array([part] * len(held), pa.int32()), grams], names=[*keys, "part", "gram"])

        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(batch.num_columns - 1)
            for key, places in batch.select(keys).to_pandas().groupby(keys, sort=False, dropna=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                some = rows_of(v.take(pa.array(places)))
                held[key] = held[key] + some.T @ some if key in held else some.T @ some
            if sum(m.nbytes for m in held.values()) > HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    return added(rows.select(*keys, vector).mapInArrow(run, ", ".join([*kinds, "part int", "gram binary"])), keys)


def added(partial: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gram) of partial sums (keys, part, gram): in steps of FAN parts, then whole."""
    fields = partial.select(*keys, "gram").dtypes
    schema = ", ".join(f"{k} {t}" for k, t in fields)

    def add(table: pa.Table) -> pa.Table:
        total = sum(matrix(x.as_py()) for x in table["gram"])
        return table.slice(0, 1).select(keys).append_column("gram", pa.array([total.tobytes()], pa.binary()))

    some = partial.withColumn("part", F.floor(F.col("part") / FAN)).groupBy(*keys, "part").applyInArrow(add, schema)
    return some.groupBy(*keys).applyInArrow(add, schema)


def chunked_gram(rows: DataFrame, keys: list[str], segment: str, params: DataFrame, features: Callable[[pa.Table, bytes], np.ndarray], chunk_rows: int = 16384) -> DataFrame:
    """(keys, segment, gram): sums of products of what features makes of rows and their key's parameters.

    rows: keys, segment, i, n (the rows of the key's series), and what features reads; params: keys, n, params binary, one row
    per key. A key's rows are dealt to chunks of about so many, each of which meets the parameters once.
    """
    chunks = F.greatest(F.ceil(F.col("n") / chunk_rows), F.lit(1)).cast("int")
    left = rows.withColumn("part", F.pmod(F.xxhash64("i"), chunks).cast("int"))
    right = params.withColumn("part", F.explode(F.sequence(F.lit(0), chunks - 1))).select(*keys, "part", "params")
    schema = ", ".join([*(f"{k} {t}" for k, t in rows.select(*keys, segment).dtypes), "part int", "gram binary"])

    def run(some: pa.Table, fitted: pa.Table) -> pa.Table:
        out = {c: [] for c in (*keys, segment, "part", "gram")}
        if some.num_rows and fitted.num_rows:
            v = features(some, fitted["params"][0].as_py())
            for name, places in pd.Series(some[segment].to_pandas()).groupby(some[segment].to_pandas()).indices.items():
                values = [*(some[k][0].as_py() for k in keys), name, some["part"][0].as_py(), (v[places].T @ v[places]).tobytes()]
                for column, value in zip(out.values(), values, strict=True):
                    column.append(value)
        kinds = [some.schema.field(c).type for c in (*keys, segment)] + [pa.int32(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(out.values(), kinds, strict=True)], names=list(out))

    partial = left.groupBy(*keys, "part").cogroup(right.groupBy(*keys, "part")).applyInArrow(run, schema)
    return added(partial, [*keys, segment])


class Sums:
    """A matrix of sums of products, its first column being 1: counts, means, deviations, fits and errors come out of it."""

    def __init__(self, total: np.ndarray):
        self.total = total

    def __add__(self, other: "Sums") -> "Sums":
        return Sums(self.total + other.total)

    @property
    def n(self) -> float:
        return self.total[0, 0]

    def mean(self) -> np.ndarray:
        return self.total[0] / self.n

    def std(self) -> np.ndarray:
        """Population deviations; one of nearly 0 counts as 1."""
        variance = np.maximum(np.diag(self.total) / self.n - self.mean() ** 2, 0.0)
        return np.where(variance < 1e-16, 1.0, np.sqrt(variance))

    def covariance(self, columns: np.ndarray) -> np.ndarray:
        mean = self.mean()[columns]
        return self.total[np.ix_(columns, columns)] / self.n - np.outer(mean, mean)

    def scaled(self, mean: np.ndarray, std: np.ndarray) -> "Sums":
        """The sums of (column - mean) / std; of the first column, the mean is 0 and the deviation 1."""
        mean = np.where(np.arange(len(mean)) > 0, mean, 0.0)
        moved = self.total - np.outer(mean, self.total[0]) - np.outer(self.total[0], mean) + self.n * np.outer(mean, mean)
        return Sums(moved / np.outer(std, std))

    def fit(self, x: np.ndarray, y: np.ndarray, alpha: float) -> np.ndarray:
        """Ridge coefficients of columns y on columns x and, without penalty, on 1: row 0 has the intercepts."""
        first = self.total[0]
        centred = lambda a, b: self.total[np.ix_(a, b)] - np.outer(first[a], first[b]) / self.n
        w = np.linalg.solve(centred(x, x) + alpha * np.eye(len(x)), centred(x, y))
        return np.vstack((self.mean()[y] - self.mean()[x] @ w, w))

    def error(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
        """Mean squared error of coefficients w of (1, x) for y."""
        at = np.concatenate(([0], x)).astype(int)
        g = self.total
        return float(max(0.0, np.trace(g[np.ix_(y, y)] - 2 * w.T @ g[np.ix_(at, y)] + w.T @ g[np.ix_(at, at)] @ w)) / (self.n * len(y)))
