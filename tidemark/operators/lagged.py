"""Circular-shift nulls of ridge from sums of products at many lags.

Shifting a segment's text along its rows leaves the sums of products among numbers and among texts as they are; only those
between a number and a text change, to the pair's circular cross-correlation at the lag. One transform gives a pair's sums at all
lags, so a draw costs a small matrix, not a pass over rows. A task holds one pair of columns of one segment of a series.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.operators.moments import Sums, gram, matrix, rows_of
from tidemark.operators.residual import COMPONENTS, components
from tidemark.operators.statistics import hash_draw


def drawn_shifts(sizes: DataFrame, guard: int, draws: int, seed: int) -> DataFrame:
    """sizes (…, segment, n) with shifts: so many, from guard to n - guard, or from 1 to n - 1 where there are too few rows."""
    low = F.least(F.greatest(F.lit(1), F.lit(guard)), F.col("n") - 1)
    low = F.when(F.col("n") - low < low, F.lit(1)).otherwise(low)
    one = lambda d: (low + hash_draw(seed, d, F.col("segment"), below=F.greatest(F.col("n") - 2 * low + 1, F.lit(1)))).cast("int")
    return sizes.withColumn("shifts", F.transform(F.sequence(F.lit(1), F.lit(draws)), one))


def columns_of(rows: DataFrame, keys: list[str], side: str) -> DataFrame:
    """(keys, segment, c, p array, v array): the columns of an array column, each with its places."""
    kinds = ", ".join(f"{k} {t}" for k, t in rows.select(*keys, "segment").dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names = [*keys, "segment"]
            heads, cs, ps, vs = [], [], [], []
            for key, places in batch.select(names).to_pandas().groupby(names, sort=False).indices.items():
                some = batch.take(pa.array(places))
                values, p = rows_of(some.column("v")), some.column("p").to_numpy()
                for c in range(values.shape[1]):
                    heads.append(key)
                    cs.append(c)
                    ps.append(p)
                    vs.append(values[:, c])
            frame = pd.DataFrame(heads, columns=names)
            arrays = [pa.array(frame[k], type=batch.schema.field(k).type) for k in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(cs, pa.int32()), pa.array(ps, pa.list_(pa.int32())), pa.array(vs, pa.list_(pa.float64()))], names=[*names, "c", "p", "v"])

    parts = rows.select(*keys, "segment", F.col("p").cast("int").alias("p"), F.col(side).alias("v")).mapInArrow(run, f"{kinds}, c int, p array<int>, v array<double>")
    return parts.groupBy(*keys, "segment", "c").agg(F.flatten(F.collect_list(F.struct("p", "v"))["p"]).alias("p"), F.flatten(F.collect_list(F.struct("p", "v"))["v"]).alias("v"))


def lag_sums(left: DataFrame, right: DataFrame, shifts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, segment, a, b, sums array): per pair of columns and shift s, the sum over places p of left[p] times right[p - s]."""
    on = [*keys, "segment"]
    pairs = left.select(*on, F.col("c").alias("a"), F.col("p").alias("lp"), F.col("v").alias("lv")).join(right.select(*on, F.col("c").alias("b"), F.col("p").alias("rp"), F.col("v").alias("rv")), on).join(shifts.select(*on, "shifts"), on)
    kinds = ", ".join(f"{k} {t}" for k, t in pairs.select(*on).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                lp, lv, rp, rv, at = (batch.column(c)[k].values.to_numpy() for c in ("lp", "lv", "rp", "rv", "shifts"))
                one, other = lv[np.argsort(lp)], rv[np.argsort(rp)]
                lags = np.fft.irfft(np.fft.rfft(one) * np.conj(np.fft.rfft(other)), len(one))
                out.append(lags[at % len(one)])
            names = [*on, "a", "b"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.list_(pa.float64()))], names=[*names, "sums"])

    return pairs.mapInArrow(run, f"{kinds}, a int, b int, sums array<double>")


def circular_null(rows: DataFrame, keys: list[str], alphas: DataFrame, draws: int, guard: int, seed: int, most: int = COMPONENTS) -> DataFrame:
    """(keys, draw, null_score): errors on segment 'dec' of ridge with a fixed penalty when text is shifted along the rows of
    'train' and 'dec', each by a shift of its own.

    rows: keys, i, segment, x, y, e, q; features are scaled x, components of e and scaled q, fitted on the training rows, which
    a shift doesn't change; y is what the last of x leaves of it, or y itself without x. alphas: keys, alpha.
    """
    rows = rows.where(F.col("segment").isin("train", "dec"))
    on = [*keys, "segment"]
    residual = F.when(F.size("x") > 0, F.transform("y", lambda v: v - F.coalesce(F.element_at("x", -1), F.lit(0.0)))).otherwise(F.col("y"))
    p = F.row_number().over(W.partitionBy(*on).orderBy("i")) - 1
    sizes = ["nx", "h", "ne"]
    some = rows.select(*on, p.alias("p"), "x", F.concat("x", residual).alias("u"), F.concat("e", "q").alias("t"), *(F.size(c).alias(s) for c, s in zip("xye", sizes)))
    totals = gram(some.select(*on, *sizes, F.concat(F.array(F.lit(1.0)), "u", "t").alias("v")), [*on, *sizes])
    counts = some.groupBy(*on).agg(F.count("*").cast("int").alias("n"))
    lags = lag_sums(columns_of(some, keys, "u"), columns_of(some, keys, "t"), drawn_shifts(counts, guard, draws, seed), keys)
    schema = ", ".join([*(f"{k} {t}" for k, t in rows.select(*keys).dtypes), "draw int, null_score double"])

    def solve(key: tuple, moved: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        of = {s: matrix(g) for s, g in zip(known["segment"], known["gram"])}
        if set(of) != {"train", "dec"} or min(g[0, 0] for g in of.values()) < 2:
            return pd.DataFrame(columns=[*keys, "draw", "null_score"])
        first = known.iloc[0]
        nx, h, ne = (int(first[s]) for s in sizes)
        width, u = len(of["train"]), nx + h
        x, y, e, q = np.arange(1, 1 + nx), np.arange(1 + nx, 1 + u), np.arange(1 + u, 1 + u + ne), np.arange(1 + u + ne, width)
        train = Sums(of["train"])
        mean, std = train.mean(), train.std()
        v = components(train.covariance(e), most, train.n) if ne else np.zeros((0, 0))
        # From 1, x, y, e, q to 1, scaled x, y, components, scaled q
        turn = np.zeros((1 + u + len(v) + len(q), width))
        turn[0, 0] = 1.0
        turn[x, x], turn[x, 0], turn[y, y] = 1 / std[x], -mean[x] / std[x], 1.0
        at = np.arange(1 + u, 1 + u + len(v))
        turn[np.ix_(at, e)], turn[at, 0] = v, -v @ mean[e]
        at = np.arange(1 + u + len(v), len(turn))
        turn[at, q], turn[at, 0] = 1 / std[q], -mean[q] / std[q]
        columns = np.concatenate((x, np.arange(1 + u, len(turn))))
        cross = {}
        for s, some in moved.groupby("segment"):
            table = np.zeros((draws, u, ne + len(q)))
            table[:, some["a"], some["b"]] = np.array(some["sums"].tolist()).T
            cross[s] = table
        scores = []
        for d in range(draws):
            here = {}
            for s, g in of.items():
                g = g.copy()
                g[1 : 1 + u, 1 + u :], g[1 + u :, 1 : 1 + u] = cross[s][d], cross[s][d].T
                here[s] = Sums(turn @ g @ turn.T)
            scores.append(here["dec"].error(columns, y, here["train"].fit(columns, y, float(first["alpha"]))))
        return pd.DataFrame({k: [first[k]] * draws for k in keys} | {"draw": np.arange(1, draws + 1), "null_score": scores})

    return lags.groupBy(*keys).cogroup(totals.join(alphas, keys).groupBy(*keys)).applyInPandas(solve, schema)
