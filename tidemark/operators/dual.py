"""Ridge in the space of rows, for more columns than rows: a kernel made of blocks of rows, and one eigendecomposition for all penalties."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.operators.moments import rows_of
from tidemark.operators.ridge import ALPHAS

#: Rows of a key at most (its kernel takes 8 bytes times their square), and rows of a block.
LIMIT, BLOCK = 8192, 512


def kernel_blocks(rows: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """(keys, a, b, kernel binary): products of every row of block a with every row of block b, for a <= b.

    rows: keys, p (places from 0), x. A task holds two blocks; a block is sent once to each block before or at its place.
    """
    kinds = ", ".join(f"{k} {t}" for k, t in rows.select(*keys).dtypes)
    packs = rows.groupBy(*keys, F.floor(F.col("p") / block).cast("int").alias("a")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda r: r["x"]).alias("left"))
    pairs = packs.join(packs.withColumnsRenamed({"a": "b", "left": "right"}), keys).where("a <= b").select(*keys, "a", "b", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(rows_of(batch.column("left")[k].values) @ rows_of(batch.column("right")[k].values).T).tobytes() for k in range(batch.num_rows)]
            names = [*keys, "a", "b"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.binary())], names=[*names, "kernel"])

    return pairs.mapInArrow(run, f"{kinds}, a int, b int, kernel binary")


def dual_grid(rows: DataFrame, keys: list[str], alphas: tuple[float, ...] = ALPHAS, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """(keys, rows, alpha, validation_mse, test_mse) of ridge of y on x fitted on 'train', the penalty chosen on 'cal'.

    rows: keys, segment ('train', 'cal', 'test'), i, x, y. Columns are centred by the training rows, which the kernel alone
    suffices for, and not scaled. The result is that of ridge.grid on columns scaled before. A key of more than limit rows
    fails the job: its kernel would not fit a task, and the primal form is the right one. Keys without two rows in each
    segment give none. Errors equal to nine digits are equal; the first penalty wins.
    """
    whole, order = W.partitionBy(*keys), F.array_position(F.array(*map(F.lit, ("train", "cal", "test"))), F.col("segment"))
    size = F.count("*").over(whole)
    checked = F.when(size > limit, F.raise_error(F.format_string(f"a key has %d rows, the dual form takes {limit}", size)).cast("long")).otherwise(size)
    rows = rows.where(F.col("segment").isin("train", "cal", "test"))
    placed = rows.select(*keys, "segment", "x", "y", checked.alias("n"), (F.row_number().over(whole.orderBy(order, "i")) - 1).cast("int").alias("p")).where("n > 0")
    targets = placed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("p", "segment", "y"))).alias("t"))
    schema = ", ".join([*(f"{k} {t}" for k, t in rows.select(*keys).dtypes), "rows int, alpha double, validation_mse double, test_mse double"])
    names = ["rows", "alpha", "validation_mse", "test_mse"]

    def solve(key: tuple, blocks: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
        t = targets["t"].iat[0]
        segment, y = np.array([r["segment"] for r in t]), np.array([list(r["y"]) for r in t], float)
        at = {s: segment == s for s in ("train", "cal", "test")}
        if min(m.sum() for m in at.values()) < 2:
            return pd.DataFrame(columns=[*keys, *names])
        n = len(t)
        kernel = np.zeros((n, n))
        for a, b, raw in zip(blocks["a"], blocks["b"], blocks["kernel"]):
            high = min(block, n - a * block)
            part = np.frombuffer(raw, float).reshape(high, -1)
            kernel[a * block : a * block + high, b * block : b * block + part.shape[1]] = part
            kernel[b * block : b * block + part.shape[1], a * block : a * block + high] = part.T
        fit = at["train"]
        # Centring by the training rows: of both factors of every product
        mean = kernel[:, fit].mean(axis=1)
        kernel = kernel - mean[:, None] - mean[None, :] + mean[fit].mean()
        values, vectors = np.linalg.eigh(kernel[np.ix_(fit, fit)])
        centre = y[fit].mean(axis=0)
        turned = vectors.T @ (y[fit] - centre)
        seen = {s: kernel[np.ix_(at[s], fit)] @ vectors for s in ("cal", "test")}

        def error(s: str, alpha: float) -> float:
            return float(np.mean((y[at[s]] - centre - seen[s] @ (turned / (np.maximum(values, 0.0) + alpha)[:, None])) ** 2))

        scores = [error("cal", a) for a in alphas]
        best = int(np.argmin(np.round(scores, 9)))
        return pd.DataFrame([dict(zip(keys, key)) | dict(zip(names, (n, alphas[best], scores[best], error("test", alphas[best]))))])

    return kernel_blocks(placed, keys, block).groupBy(*keys).cogroup(targets.groupBy(*keys)).applyInPandas(solve, schema)
