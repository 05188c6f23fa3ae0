"""Nulls of ridge by permuted text: how well would the text do that belongs to other rows?

Only text moves, so features are fitted once and a draw reorders their rows. A series of at most STRATUM rows is scored where its
rows are, a task per series and chunk of draws. A longer one is cut into strata of about so many rows, text moves within a
stratum (a permutation test over a smaller group, as valid as the whole one), each stratum gives sums of products per draw, and
the sums are added. So no task holds more than a stratum, and no row is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.moments import Sums, added, matrix, rows_of
from tidemark.operators.residual import COMPONENTS, CROSSED, SIZES, fitted, layout, parts_of
from tidemark.operators.ridge import ALPHAS, rotated

#: Rows of a stratum at most, about; draws of a task.
STRATUM, CHUNK = 65536, 100
SEGMENTS = ("train", "cal", "dec")


def by_generator(seed: int, draw: int, stratum: int, counts: dict[str, int]) -> dict[str, np.ndarray]:
    """Orders of a draw's rows per segment: one generator permutes training, then calibration, then decision rows."""
    rng = np.random.default_rng(seed + draw - 1 if stratum == 0 else (seed + draw - 1, stratum))
    return {s: rng.permutation(n) for s, n in counts.items()}


def by_digest(seed: int, draw: int, stratum: int, counts: dict[str, int]) -> dict[str, np.ndarray]:
    """Orders by the MD5 of seed, draw, segment and place from 1, which any engine can compute."""
    del stratum
    return {s: np.array(sorted(range(n), key=lambda p: hashlib.md5(f"{seed}|{draw}|{s}|{p + 1}".encode()).digest()), int) for s, n in counts.items()}  # noqa: B023


def by_shift(guard: int) -> Callable:
    """Turns of training and decision rows by shifts of at least guard rows; calibration rows stay."""

    def orders(seed: int, draw: int, stratum: int, counts: dict[str, int]) -> dict[str, np.ndarray]:
        rng = np.random.default_rng(seed + draw - 1 if stratum == 0 else (seed + draw - 1, stratum))
        return {s: np.arange(n) if s == "cal" else rotated(n, rng, guard) for s, n in counts.items()}

    return orders


def drawn_sums(rows: pa.Table, params: bytes, parts: tuple[str, ...], residual: bool, crossed: int, stratum: int, draws: range, orders: Callable, seed: int):
    """(draw, segment -> Sums) of ones, parts and y, text in the order of the draw; draw 0 leaves it where it is."""
    wanted = set(parts) | ({"f", "pca"} if "cross" in parts else set())
    held = {}
    for s in SEGMENTS:
        some = rows.filter(pc.equal(rows["segment"], s)).sort_by("i")
        if some.num_rows:
            x, y = rows_of(some["x"]), rows_of(some["y"])
            held[s] = parts_of(some, params, wanted - {"cross"}, crossed) | {"y": y - x[:, -1:] if residual else y}
    counts = {s: len(h["y"]) for s, h in held.items()}
    # In the order of residual.layout
    names = [p for p in ("x", "q", "f", "pca", "cross", "e") if p in parts]
    for draw in draws:
        at = orders(seed, draw, stratum, counts) if draw else {s: np.arange(n) for s, n in counts.items()}
        out = {}
        for s, h in held.items():
            here = {p: h[p][at[s]] if p in ("q", "pca", "e") else h[p] for p in h}
            if "cross" in parts:
                here["cross"] = (here["pca"][:, :, None] * h["f"][:, None, :crossed]).reshape(len(h["y"]), -1)
            v = np.hstack((np.ones((counts[s], 1)), *(here[p] for p in names), h["y"]))
            out[s] = v.T @ v
        yield draw, out


class Scorer:
    """Scores of draws of one key; what the aligned text (draw 0) gives is fixed first: scales of products and the penalty.

    Columns are 1, features, targets, so that blocks of a matrix of sums are plain slices.
    """

    def __init__(self, sizes: dict[str, int], parts: tuple[str, ...], most: int, crossed: int, alphas: tuple[float, ...], fixed_alpha: bool, aligned: dict[str, np.ndarray]):
        self.alphas, self.fixed_alpha, self.ok = alphas, fixed_alpha, False
        if not all(s in aligned and aligned[s][0, 0] >= 2 for s in SEGMENTS):
            return
        self.ok = True
        at = layout(*(sizes[c] for c in SIZES[:4]), aligned["train"][0, 0], set(parts), most, crossed)
        self.h, self.cross = sizes["h"], at.get("cross", np.zeros(0, int))
        self.scale = self._scale(aligned["train"])
        self.alpha, self.aligned = self._best(aligned, self.scale, alphas)

    def _scale(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean, std, by = np.zeros(len(train)), np.ones(len(train)), Sums(train)
        mean[self.cross], std[self.cross] = by.mean()[self.cross], by.std()[self.cross]
        return mean, std

    def _best(self, grams: dict[str, np.ndarray], scale: tuple[np.ndarray, np.ndarray], alphas: tuple[float, ...]) -> tuple[float, float]:
        of = {s: Sums(g).scaled(*scale).total for s, g in grams.items() if s != "cal" or len(alphas) > 1}
        train, cut = of["train"], len(of["train"]) - self.h
        n, first = train[0, 0], train[0]
        inner = train[1:cut, 1:] - np.outer(first[1:cut], first[1:] / n)
        x, y = inner[:, : cut - 1], inner[:, cut - 1 :]
        ridge, diagonal = x.copy(), np.diag(x).copy()
        fits = []
        for alpha in alphas:
            np.fill_diagonal(ridge, diagonal + alpha)
            w = np.linalg.solve(ridge, y)
            fits.append(np.vstack(((first[cut:] - first[1:cut] @ w) / n, w)))

        def error(s: str, w: np.ndarray) -> float:
            g = of[s]
            total = np.trace(g[cut:, cut:]) - 2 * np.sum(w * g[:cut, cut:]) + np.sum(w * (g[:cut, :cut] @ w))
            return float(max(0.0, total) / (g[0, 0] * self.h))

        best = int(np.argmin(np.round([error("cal", w) for w in fits], 9))) if len(alphas) > 1 else 0
        return alphas[best], error("dec", fits[best])

    def __call__(self, grams: dict[str, np.ndarray], refit: bool) -> tuple[float, float]:
        scale = self._scale(grams["train"]) if refit else self.scale
        return self._best(grams, scale, (self.alpha,) if self.fixed_alpha else self.alphas)


def null_scores(rows: DataFrame, keys: list[str], parts: tuple[str, ...], draws: int, seed: int, mode: str = "row", refits: tuple[bool, ...] = (False,), guard: int = 24, residual: bool = True, most: int = COMPONENTS, crossed: int = CROSSED, alphas: tuple[float, ...] = ALPHAS, stratum_rows: int = STRATUM, chunk: int = CHUNK) -> DataFrame:
    """(keys, refit, draw, alpha, aligned, null_score): errors on segment 'dec' of ridge on parts, text (pca, q, e) parted from its rows.

    rows: keys, i, n (rows of the key's series), segment, x, y, e, q, f, of which 'train', 'cal' and 'dec' are read. With residual,
    y is what the last of x leaves. mode row: text is permuted within every segment, the penalty chosen anew on 'cal'; digest:
    the same in an order that SQL can give; circular: text of 'train' and 'dec' is turned, the aligned penalty stays. refit: products of text and statistics are
    scaled by the moved training rows, else by the aligned ones. Keys without two rows in each segment give none.
    """
    orders: dict[str, Callable] = {"row": by_generator, "digest": by_digest, "circular": by_shift(guard)}
    if mode not in orders:
        raise ValueError(f"no such mode: {mode}")
    order, fixed_alpha = orders[mode], mode == "circular"
    some = rows.where(F.col("segment").isin(*SEGMENTS)).select(*keys, "i", "n", "segment", "x", "y", "e", "q", "f")
    strata = F.greatest(F.ceil(F.col("n") / stratum_rows), F.lit(1)).cast("int")
    # Neighbours stay together where text is turned
    stratum: Column = F.floor(F.col("i") * strata / F.col("n")) if mode == "circular" else F.pmod(F.xxhash64("i"), strata)
    some = some.withColumn("strata", strata).withColumn("stratum", stratum.cast("int"))
    chunks = (draws + chunk - 1) // chunk
    parted = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    known = fitted(some, keys, most).withColumn("strata", strata)
    known = known.select(*keys, *SIZES, "params", F.explode(F.sequence(F.lit(0), F.col("strata") - 1)).alias("stratum"), "strata").withColumn("part", parted)
    by = [*keys, "stratum", "part"]
    # By number, or few bytes with much work would be put into one task
    context = rows.sparkSession.sparkContext
    tasks = 4 * max(context.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt, known = some.withColumn("part", parted).repartition(tasks, *by), known.repartition(tasks, *by)
    kinds = ", ".join(f"{k} {t}" for k, t in rows.select(*keys).dtypes)
    last = "refit boolean, draw int, alpha double, aligned double, null_score double"
    score_schema, names = f"{kinds}, {last}", [c.split()[0] for c in last.split(", ")]

    def of_task(table: pa.Table, fit: pa.Table):
        part, at = table["part"][0].as_py(), table["stratum"][0].as_py()
        here = [0, *range(1 + part * chunk, 1 + min(draws, (part + 1) * chunk))]
        return drawn_sums(table, fit["params"][0].as_py(), parts, residual, crossed, at, here, order, seed)

    def table_of(head: pa.Table, fields: dict[str, pa.DataType], values: list[tuple]) -> pa.Table:
        first = [pa.array([head[k][0].as_py()] * len(values), head.schema.field(k).type) for k in keys]
        return pa.table([*first, *(pa.array([v[c] for v in values], t) for c, t in enumerate(fields.values()))], names=[*keys, *fields])

    score_fields = dict(zip(names, (pa.bool_(), pa.int32(), pa.float64(), pa.float64(), pa.float64())))

    def whole(table: pa.Table, fit: pa.Table) -> pa.Table:
        out, scorer = [], None
        for draw, grams in of_task(table, fit) if table.num_rows and fit.num_rows else ():
            if draw == 0:
                scorer = Scorer({s: fit[s][0].as_py() for s in SIZES}, parts, most, crossed, alphas, fixed_alpha, grams)
                if not scorer.ok:
                    break
                continue
            out += [(refit, draw, *(s := scorer(grams, refit))[:1], scorer.aligned, s[1]) for refit in refits]
        return table_of(table if table.num_rows else fit, score_fields, out)

    small = dealt.where("strata = 1").groupBy(*by).cogroup(known.where("strata = 1").groupBy(*by)).applyInArrow(whole, score_schema)

    gram_fields = {"draw": pa.int32(), "segment": pa.string(), "part": pa.int32(), "gram": pa.binary()}

    def sums(table: pa.Table, fit: pa.Table) -> pa.Table:
        out = []
        if table.num_rows and fit.num_rows:
            first = table["part"][0].as_py() == 0
            out = [(d, s, table["stratum"][0].as_py(), g.tobytes()) for d, grams in of_task(table, fit) if d or first for s, g in grams.items()]
        return table_of(table if table.num_rows else fit, gram_fields, out)

    partial = dealt.where("strata > 1").groupBy(*by).cogroup(known.where("strata > 1").groupBy(*by)).applyInArrow(sums, f"{kinds}, draw int, segment string, part int, gram binary")
    total = added(partial, [*keys, "draw", "segment"])
    sizes = known.where("strata > 1 and stratum = 0 and part = 0").select(*keys, *SIZES)
    base = total.where("draw = 0").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("segment", "gram"))).alias("base")).join(sizes, keys)
    draw_grams = total.where("draw > 0").groupBy(*keys, "draw").agg(F.map_from_entries(F.collect_list(F.struct("segment", "gram"))).alias("grams"))

    def scored(batches):
        for frame in batches:
            out = []
            for row in frame.to_dict("records"):
                scorer = Scorer({s: int(row[s]) for s in SIZES}, parts, most, crossed, alphas, fixed_alpha, {s: matrix(g) for s, g in dict(row["base"]).items()})
                if scorer.ok:
                    grams = {s: matrix(g) for s, g in dict(row["grams"]).items()}
                    for refit in refits:
                        alpha, score = scorer(grams, refit)
                        out.append({k: row[k] for k in keys} | dict(zip(names, (refit, row["draw"], alpha, scorer.aligned, score))))
            yield pd.DataFrame(out, columns=[*keys, *names])

    large = draw_grams.join(base, keys).select(*keys, "draw", "grams", "base", *SIZES).mapInPandas(scored, score_schema)
    return small.unionByName(large)
