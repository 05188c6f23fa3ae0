"""Ridge on what the last value leaves, from numbers and texts: features, candidates, attribution modes and probes.

Scales and principal components come out of sums of products over the training rows. A second pass makes each row's features
and sums their products; then any choice of columns, any penalty and any segment is a matter of one matrix per segment. No
task holds a series.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.operators.moments import Sums, chunked_gram, gram, matrix, rows_of
from tidemark.operators.ridge import ALPHAS, random_fourier

#: Principal components at most; statistics of a window, the first so many, that are multiplied with every component.
COMPONENTS, CROSSED = 24, 8
#: Parts of the candidates' features.
VARIANTS = {"numeric": ("x",), "semantic": ("x", "pca", "q"), "frequency": ("x", "pca", "q", "f", "cross"), "fourier": ("x", "pca", "q", "f", "fourier")}
#: Parts of each attribution mode, of heads without and with statistics of the window; the last is as wide as the full one.
MODES = {
    "semantic": {"numeric_only": ("x",), "quality_only": ("x", "q"), "semantic_only": ("x", "pca"), "full": ("x", "pca", "q"), "dimension_matched_numeric": ("x", "matched")},
    "frequency": {
        "numeric_only": ("x", "f"), "quality_only": ("x", "q", "f"), "semantic_only": ("x", "pca", "f", "cross"), "full": ("x", "pca", "q", "f", "cross"), "dimension_matched_numeric": ("x", "f", "matched_f"),
    },
}
SEED = 2026
SIZES = ["nx", "nq", "nf", "ne", "h"]


def packed(**arrays: np.ndarray) -> bytes:
    sink = io.BytesIO()
    np.savez(sink, **arrays)
    return sink.getvalue()


def components(covariance: np.ndarray, most: int, rows: float) -> np.ndarray:
    """Principal directions as rows, the largest first: at most so many, and no more than rows less one. The entry of greatest size is positive."""
    if not len(covariance):
        return np.zeros((0, 0))
    _, vectors = np.linalg.eigh(covariance)
    v = vectors.T[::-1][: max(0, min(most, int(rows) - 1, len(covariance)))]
    return v * np.where(np.take_along_axis(v, np.abs(v).argmax(axis=1)[:, None], axis=1) < 0, -1.0, 1.0)


def fitted(rows: DataFrame, keys: list[str], most: int = COMPONENTS) -> DataFrame:
    """(keys, n, nx, nq, nf, ne, h, params): per key the columns of x, q, f, e and y, and over the rows of segment 'train' the
    scales of x, q and f and the principal components of e."""
    sizes = [F.size(c).alias(s) for c, s in zip("xqfey", SIZES)]
    train = rows.where("segment = 'train'").select(*keys, "n", *sizes, F.concat(F.array(F.lit(1.0)), "x", "q", "f", "e").alias("v"))
    by = [*keys, "n", *SIZES]
    schema = ", ".join([*(f"{k} {t}" for k, t in train.select(*by).dtypes), "params binary"])

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        row = part.iloc[0]
        sums = Sums(matrix(row["gram"]))
        ends = np.cumsum([1] + [int(row[s]) for s in SIZES[:4]])
        of = {c: np.arange(a, b) for c, a, b in zip("xqfe", ends, ends[1:])}
        mean, std = sums.mean(), sums.std()
        out = {f"{c}_{what}": values[of[c]] for c in "xqf" for what, values in (("mean", mean), ("std", std))}
        params = packed(**out, e_mean=mean[of["e"]], v=components(sums.covariance(of["e"]), most, sums.n))
        return pd.DataFrame([{k: row[k] for k in by} | {"params": params}])

    return gram(train, by).groupBy(*keys).applyInPandas(fit, schema)


def parts_of(rows: pa.Table, params: bytes, wanted: set[str], crossed: int = CROSSED) -> dict[str, np.ndarray]:
    """Features of rows by part: scaled x, q and f, components of e, their products with statistics, random controls, e itself."""
    p = np.load(io.BytesIO(params))
    scaled = {c: (rows_of(rows[c]) - p[f"{c}_mean"]) / p[f"{c}_std"] for c in "xqf"}
    pca = (rows_of(rows["e"]) - p["e_mean"]) @ p["v"].T
    f = scaled["f"][:, :crossed]
    wide = pca.shape[1] + scaled["q"].shape[1]
    make = {
        "x": lambda: scaled["x"], "q": lambda: scaled["q"], "f": lambda: scaled["f"], "pca": lambda: pca,
        "cross": lambda: (pca[:, :, None] * f[:, None, :]).reshape(len(f), -1),
        "fourier": lambda: random_fourier(scaled["x"], f.shape[1] * pca.shape[1], SEED),
        "matched": lambda: random_fourier(scaled["x"], wide, SEED),
        "matched_f": lambda: random_fourier(np.hstack((scaled["x"], scaled["f"])), wide + f.shape[1] * pca.shape[1], SEED),
        "e": lambda: rows_of(rows["e"]),
    }
    return {name: make[name]() for name in make if name in wanted}


def layout(nx: int, nq: int, nf: int, ne: int, n_train: float, wanted: set[str], most: int, crossed: int) -> dict[str, np.ndarray]:
    """Columns of each part, after the first column of ones, in the order of parts_of."""
    k, c = max(0, min(most, int(n_train) - 1, ne)), min(crossed, nf)
    widths = {"x": nx, "q": nq, "f": nf, "pca": k, "cross": c * k, "fourier": c * k, "matched": k + nq, "matched_f": k + nq + c * k, "e": ne}
    at, out = 1, {}
    for name, width in widths.items():
        if name in wanted:
            out[name] = np.arange(at, at + width)
            at += width
    return out


def sums(rows: DataFrame, keys: list[str], wanted: set[str], most: int = COMPONENTS, crossed: int = CROSSED, residual: bool = True) -> DataFrame:
    """(keys, segment, gram, nx, nq, nf, ne, h): sums of products of ones, the wanted parts of features, and what the last value leaves of y (y itself if not residual).

    rows: keys, i, n, segment, half (1, 2 or null), x, y, e, q, f. The decision span's segment is 'dec0', 'dec1' or 'dec2', by half.
    """
    segment = F.when(F.col("segment") == "dec", F.concat(F.lit("dec"), F.coalesce(F.col("half"), F.lit(0)).cast("string"))).otherwise(F.col("segment"))
    some = rows.withColumn("span", segment).select(*keys, "i", "n", "span", "x", "y", "e", "q", "f", *(F.size(c).alias(s) for c, s in zip("xqfey", SIZES)))

    def features(table: pa.Table, params: bytes) -> np.ndarray:
        x, y = rows_of(table["x"]), rows_of(table["y"])
        return np.hstack((np.ones((len(x), 1)), *parts_of(table, params, wanted, crossed).values(), y - x[:, -1:] if residual else y))

    return chunked_gram(some, [*keys, *SIZES], "span", fitted(rows, keys, most), features)


def solved(rows: DataFrame, keys: list[str], modes: dict[str, tuple[str, ...]], alphas: tuple[float, ...] = ALPHAS, most: int = COMPONENTS, crossed: int = CROSSED, refit: bool = False, residual: bool = True) -> DataFrame:
    """Per key and mode: columns, alpha, calibration_mse, errors on the decision span and its halves beside the last value's own.

    Products with statistics and random controls are scaled by their training rows. The penalty errs least on 'cal' (to nine
    digits; the first of equals). With refit, test_mse is that of a fit on training and calibration rows, else null. Keys
    without two rows in 'train', 'cal' and the decision span give no row.
    """
    wanted = {p for parts in modes.values() for p in parts}
    names = ["mode", "columns", "alpha", "calibration_mse", "mse", "mse_first", "mse_second", "fallback_mse", "fallback_first", "fallback_second", "test_mse"]
    schema = ", ".join([*(f"{k} {t}" for k, t in rows.select(*keys).dtypes), "mode string, columns int", *(f"{n} double" for n in names[2:])])

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        first, of = part.iloc[0], {s: Sums(matrix(g)) for s, g in zip(part["span"], part["gram"])}
        dec = [of[s] for s in ("dec0", "dec1", "dec2") if s in of]
        out = []
        if "train" in of and "cal" in of and dec and min(of["train"].n, of["cal"].n, sum(d.n for d in dec)) >= 2:
            train = of["train"]
            at = layout(*(int(first[c]) for c in SIZES[:4]), train.n, wanted, most, crossed)
            h = int(first["h"])
            y = np.arange(len(train.total) - h, len(train.total))
            mean, std = np.zeros(len(train.total)), np.ones(len(train.total))
            for name in {"cross", "fourier", "matched", "matched_f"} & set(at):
                mean[at[name]], std[at[name]] = train.mean()[at[name]], train.std()[at[name]]
            of = {s: g.scaled(mean, std) for s, g in of.items()}
            dec = [of[s] for s in ("dec0", "dec1", "dec2") if s in of]
            whole = sum(dec[1:], dec[0])
            plain = lambda s: float(np.trace(s.total[np.ix_(y, y)]) / (s.n * h)) if s is not None else None
            for mode, parts in modes.items():
                x = np.concatenate([at[p] for p in parts])
                fits = [of["train"].fit(x, y, a) for a in alphas]
                scores = [of["cal"].error(x, y, w) for w in fits]
                best = int(np.argmin(np.round(scores, 9)))
                error = lambda s: s.error(x, y, fits[best]) if s is not None else None  # noqa: B023, E731
                test = (of["test"].error(x, y, (of["train"] + of["cal"]).fit(x, y, alphas[best]))) if refit and "test" in of else None
                values = [mode, len(x), alphas[best], scores[best], error(whole), error(of.get("dec1")), error(of.get("dec2")), plain(whole), plain(of.get("dec1")), plain(of.get("dec2")), test]
                out.append({k: first[k] for k in keys} | dict(zip(names, values, strict=True)))
        return pd.DataFrame(out, columns=[*keys, *names])

    return sums(rows, keys, wanted, most, crossed, residual).groupBy(*keys).applyInPandas(solve, schema)


def probe(rows: DataFrame, keys: list[str], kinds: dict[str, tuple[str, ...]], alphas: tuple[float, ...]) -> DataFrame:
    """(keys, kind, columns, alpha, validation_mse, test_mse) of ridge of y on whole vectors e and scaled q, with or without x.

    rows: keys, segment ('train', 'val', 'test'), x, e, q, y. The penalty errs least on 'val'; the fit that is tested has the
    rows of both and scales of its own.
    """
    sizes = ["nx", "ne", "nq", "h"]
    v = F.concat(F.array(F.lit(1.0)), "x", "e", "q", "y")
    some = rows.select(*keys, "segment", *(F.size(c).alias(s) for c, s in zip("xeqy", sizes)), v.alias("v"))
    schema = ", ".join([*(f"{k} {t}" for k, t in rows.select(*keys).dtypes), "kind string, columns int, alpha double, validation_mse double, test_mse double"])
    names = ["kind", "columns", "alpha", "validation_mse", "test_mse"]

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        first, of, out = part.iloc[0], {s: Sums(matrix(g)) for s, g in zip(part["segment"], part["gram"])}, []
        if all(s in of and of[s].n >= 2 for s in ("train", "val", "test")):
            ends = np.cumsum([1] + [int(first[s]) for s in sizes])
            at = {c: np.arange(a, b) for c, a, b in zip("xeqy", ends, ends[1:])}

            def scaled(by: Sums) -> dict[str, Sums]:
                mean, std = np.zeros(ends[-1]), np.ones(ends[-1])
                mean[at["q"]], std[at["q"]] = by.mean()[at["q"]], by.std()[at["q"]]
                return {s: g.scaled(mean, std) for s, g in of.items()}

            one, both = scaled(of["train"]), scaled(of["train"] + of["val"])
            for kind, parts in kinds.items():
                x = np.concatenate([at[p] for p in parts])
                scores = [one["val"].error(x, at["y"], one["train"].fit(x, at["y"], a)) for a in alphas]
                best = int(np.argmin(np.round(scores, 9)))
                test = both["test"].error(x, at["y"], (both["train"] + both["val"]).fit(x, at["y"], alphas[best]))
                out.append({k: first[k] for k in keys} | dict(zip(names, [kind, len(x), alphas[best], scores[best], test], strict=True)))
        return pd.DataFrame(out, columns=[*keys, *names])

    return gram(some, [*keys, "segment", *sizes]).groupBy(*keys).applyInPandas(solve, schema)
