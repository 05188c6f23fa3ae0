"""Ridge forecasters solved from sums of products, and what other modules of least squares share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.operators.moments import Sums, gram, matrix

# Penalties tried, in order; the first of equals wins.
ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0)


def grid(rows: DataFrame, keys: list[str], alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """(keys, alpha, validation_mse, test_mse) of ridge of y on scaled x, the penalty chosen on 'cal': one Gram matrix serves all.

    rows: keys, segment ('train', 'cal', 'test'), x, y. Scales, fits and errors come out of the segments' sums, so a task
    holds a few matrices, however long a series is. Keys without two rows in each segment give none. Errors equal to nine
    digits are equal; the first penalty wins.
    """
    schema = ", ".join(f"{k} {t}" for k, t in rows.select(*keys).dtypes) + ", alpha double, validation_mse double, test_mse double"
    some = rows.select(*keys, "segment", F.size("x").alias("p"), F.concat(F.array(F.lit(1.0)), "x", "y").alias("v"))

    def solved(part: pd.DataFrame) -> pd.DataFrame:
        p, sums = int(part["p"].iat[0]), {s: Sums(matrix(g)) for s, g in zip(part["segment"], part["gram"])}
        if any(s not in sums or sums[s].n < 2 for s in ("train", "cal", "test")):
            return pd.DataFrame(columns=[*keys, "alpha", "validation_mse", "test_mse"])
        x, y = np.arange(1, p + 1), np.arange(p + 1, len(sums["train"].total))
        mean, std = sums["train"].mean(), sums["train"].std()
        mean[0], std[0], mean[y], std[y] = 0.0, 1.0, 0.0, 1.0
        sums = {s: g.scaled(mean, std) for s, g in sums.items()}
        fits = [sums["train"].fit(x, y, alpha) for alpha in alphas]
        scores = [sums["cal"].error(x, y, w) for w in fits]
        best = int(np.argmin(np.round(scores, 9)))
        return pd.DataFrame([{k: part[k].iat[0] for k in keys} | {"alpha": alphas[best], "validation_mse": scores[best], "test_mse": sums["test"].error(x, y, fits[best])}])

    return gram(some, [*keys, "segment", "p"]).groupBy(*keys).applyInPandas(solved, schema)


def ar_ridge(windows: DataFrame) -> DataFrame:
    """(domain, horizon, alpha, validation_mse, test_mse) of ridge on scaled windows. windows: domain, horizon, segment, x, y."""
    return grid(windows.where(F.col("segment").isin("train", "cal", "test")), ["domain", "horizon"])


def random_fourier(x: np.ndarray, width: int, seed: int) -> np.ndarray:
    """So many random cosine features of scaled rows: a control as wide as the interactions, without their text."""
    rng = np.random.default_rng(seed)
    w = rng.normal(size=(x.shape[1], width)) / np.sqrt(x.shape[1])
    return np.sqrt(2.0 / width) * np.cos(x @ w + rng.uniform(0, 2 * np.pi, width))


def rotated(n: int, rng: np.random.Generator, guard: int) -> np.ndarray:
    """Positions turned by a random shift of at least guard rows either way; a quarter of the rows where there are too few."""
    guard = min(guard, max(1, n // 4))
    return np.roll(np.arange(n), int(rng.integers(guard, max(guard + 1, n - guard + 1))) % n)
