"""Direct solutions in numpy, by which tests judge what the jobs make of sums of products."""

from __future__ import annotations

import numpy as np
import pandas as pd

from tidemark.operators.ridge import ALPHAS, random_fourier


class Scale:
    """Mean and population deviation of columns; a deviation of nearly 0 counts as 1."""

    def __init__(self, x: np.ndarray):
        self.mean, std = x.mean(axis=0), x.std(axis=0)
        self.std = np.where(std < 1e-8, 1.0, std)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.std


class Components:
    """Centred principal components of vectors, at most so many, and no more than rows less one or columns."""

    def __init__(self, x: np.ndarray, most: int = 24):
        self.mean = x.mean(axis=0)
        _, _, v = np.linalg.svd(x - self.mean, full_matrices=False)
        v = v[: max(0, min(most, len(x) - 1, x.shape[1]))]
        self.v = v * np.where(np.take_along_axis(v, np.abs(v).argmax(axis=1)[:, None], axis=1) < 0, -1.0, 1.0)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.v.T


def solve(x: np.ndarray, y: np.ndarray, alphas: tuple[float, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(coefficients, intercept) per penalty, the intercept free of it: one Gram matrix serves all."""
    mx, my = x.mean(axis=0), y.mean(axis=0)
    a, b = x - mx, y - my
    gram, cross = a.T @ a, a.T @ b
    out = []
    for alpha in alphas:
        w = np.linalg.solve(gram + alpha * np.eye(len(gram)), cross)
        out.append((w, my - mx @ w))
    return out


def mse(y: np.ndarray, p: np.ndarray) -> float:
    return float(np.mean((y - p) ** 2))


def best_fit(train: tuple[np.ndarray, np.ndarray], check: tuple[np.ndarray, np.ndarray], alphas: tuple[float, ...] = ALPHAS):
    """(alpha, error on check, fit) of the penalty that errs least on check."""
    fits = solve(*train, alphas)
    scores = [mse(check[1], check[0] @ w + c) for w, c in fits]
    k = int(np.argmin(scores))
    return alphas[k], scores[k], fits[k]


def design(part: pd.DataFrame, segment: str) -> dict[str, np.ndarray]:
    rows = part[part["segment"] == segment].sort_values("i")
    return {c: np.array(rows[c].tolist(), float) for c in ("x", "y", "e", "q") if c in rows}


def _interactions(z: np.ndarray, parts: np.ndarray) -> np.ndarray:
    return (parts[:, :, None] * z[:, None, :]).reshape(len(z), -1)


class Builder:
    """Features of a variant, every scale and component fitted on the training rows alone.

    numeric: the window. semantic: window, components of the text vector, text quality. frequency: these, frequency
    statistics of the window, and their first eight times every component.
    """

    def __init__(self, variant: str, train: dict[str, np.ndarray]):
        self.variant = variant
        self.x = Scale(train["x"])
        if variant != "numeric":
            self.e, self.q = Components(train["e"]), Scale(train["q"])
        if variant in ("frequency", "fourier"):
            self.f = Scale(frequencies(train["x"]))
            self.cross = Scale(self._extra(train))

    def _extra(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        parts, f = self.e(rows["e"]), self.f(frequencies(rows["x"]))[:, :8]
        return _interactions(f, parts) if self.variant == "frequency" else random_fourier(self.x(rows["x"]), f.shape[1] * parts.shape[1], 2026)

    def __call__(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        x = self.x(rows["x"])
        if self.variant == "numeric":
            return x
        parts = self.e(rows["e"])
        out = [x, parts, self.q(rows["q"])]
        if self.variant in ("frequency", "fourier"):
            out += [self.f(frequencies(rows["x"])), self.cross(self._extra(rows))]
        return np.hstack(out)


def frequencies(x: np.ndarray) -> np.ndarray:
    """The ten frequency statistics of windows, as tidemark.functions.numbers gives them."""
    power = np.abs(np.fft.rfft(x, axis=1)) ** 2
    share, bins = power / np.maximum(power.sum(axis=1, keepdims=True), 1e-8), power.shape[1]
    cut = [int(k * bins / 4) for k in range(5)]
    stats = [share[:, a:b].sum(axis=1) for a, b in zip(cut, cut[1:])]
    stats.append(share @ (np.arange(bins) / max(1, bins - 1)))
    stats.append(-(share * np.log(np.maximum(share, 1e-12))).sum(axis=1) / np.log(max(2, bins)))
    stats.append((power[:, 1:].argmax(axis=1) + 1) / max(1, bins - 1) if bins > 1 else np.zeros(len(x)))
    stats += [share.max(axis=1), x[:, -1] - x[:, 0], np.diff(x, axis=1).std(axis=1)]
    return np.column_stack(stats)
