"""TF-IDF terms of texts, words and pairs of words, and ridge models on them, alone and beside numbers.

Vocabularies are those of a key's own fitting rows. Terms are counted within a batch before anything is shuffled; weights are
made inside a text's row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.operators.moments import Sums, chunked_gram, matrix, rows_of
from tidemark.operators.residual import packed

#: Terms kept at most, and the least number of texts of one.
TERMS, MIN_DF = 1024, 2
#: Distinct terms that a task counts before it sends them.
HELD = 500_000
_WORDS = re.compile("[a-z0-9]{2,}").findall


def plain(text: str | Column) -> Column:
    """Lower case, with the common accents taken off; null: empty."""
    return F.coalesce(F.lower(F.translate(text, "áéíóúñäöüàèçêÉÁÍÓÚÑÄÖÜÀÈÇÊ", "aeiounaouaeceEAIOUNAOUAECE")), F.lit(""))


def terms_of(text: str) -> list[str]:
    words = _WORDS(text)
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def counts(texts: DataFrame, keys: list[str], text: str = "text", words_only: bool = False, among: frozenset[str] | None = None) -> DataFrame:
    """(keys, term, df, total): texts that hold each term, and its occurrences, of words and pairs of them.

    text has been through plain(). words_only leaves pairs out; among counts only pairs of these words.
    """
    kinds = [f"{k} {t}" for k, t in texts.select(*keys).dtypes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: dict[tuple, Counter] = {}
        total: dict[tuple, Counter] = {}

        def out() -> pa.RecordBatch:
            rows = [(*key, term, n, total[key][term]) for key, some in df.items() for term, n in some.items()]
            columns = list(zip(*rows)) or [()] * (len(keys) + 3)
            fields = [*(schema.field(k).type for k in keys), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(columns, fields)], names=[*keys, "term", "df", "total"])

        for batch in batches:
            schema = batch.schema
            heads = list(zip(*(batch.column(k).to_pylist() for k in keys))) if keys else [()] * batch.num_rows
            for key, value in zip(heads, batch.column(text).to_pylist()):
                words = _WORDS(value)
                if among is not None:
                    found = Counter(f"{a} {b}" for a, b in zip(words, words[1:]) if a in among and b in among)
                else:
                    found = Counter(words if words_only else words + [f"{a} {b}" for a, b in zip(words, words[1:])])
                df.setdefault(key, Counter()).update(found.keys())
                total.setdefault(key, Counter()).update(found)
            if sum(map(len, df.values())) > HELD:
                yield out()
                df, total = {}, {}
        if df:
            yield out()

    some = texts.select(*keys, text).mapInArrow(run, ", ".join([*kinds, "term string, df long, total long"]))
    return some.groupBy(*keys, "term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def vocabulary(texts: DataFrame, most: int = TERMS, min_df: int = MIN_DF, words_at_most: int = 50_000) -> list[tuple[str, int]]:
    """(term, df) of the most frequent terms of all texts, by occurrences, then term: at most so many, of min_df texts or more.

    A pair of words that is among them occurs as often as the last word that would be, so both its words do: only pairs of
    such words are counted, unless there are so few words, or so many equally frequent, that nothing would be saved.
    """
    order = [F.desc("total"), F.asc("term")]
    words = counts(texts, [], words_only=True).where(F.col("df") >= min_df).cache()
    first = words.orderBy(*order).limit(most).collect()
    pairs = counts(texts, []).where(F.col("df") >= min_df)
    if len(first) == most:
        often = words.where(F.col("total") >= first[-1]["total"])
        if often.count() <= words_at_most:
            among = frozenset(r["term"] for r in often.select("term").collect())
            pairs = words.unionByName(counts(texts, [], among=among).where(F.col("df") >= min_df))
    found = [(r["term"], r["df"]) for r in pairs.orderBy(*order).limit(most).collect()]
    words.unpersist()
    return found


def weights(text: str, place: dict[str, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) of a text's known terms: (1 + ln count) * idf, of length one together."""
    found = Counter(place[t] for t in terms_of(text) if t in place)
    at = np.fromiter(found, np.int64, len(found))
    w = (1 + np.log(np.fromiter(found.values(), float, len(found)))) * idf[at]
    return at, w / np.linalg.norm(w) if len(w) else w


def idf_of(df: np.ndarray, n: float) -> np.ndarray:
    return np.log((1 + n) / (1 + df)) + 1


def fitted_terms(rows: DataFrame, keys: list[str], most: int = TERMS, min_df: int = MIN_DF) -> DataFrame:
    """(keys, n, params): per key the terms and weights of its texts' vocabulary. n is that of the rows."""
    top = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("total"), "term"))
    terms = counts(rows, keys).where(F.col("df") >= min_df).withColumn("k", top).where(F.col("k") <= most)
    size = rows.groupBy(*keys).agg(F.first("n").alias("n"), F.count("*").alias("texts"))
    each = size.join(terms.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "term", "df"))).alias("terms")), keys, "left")
    schema = ", ".join([*(f"{k} {t}" for k, t in size.select(*keys, "n").dtypes), "params binary"])

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for row in frame.to_dict("records"):
                terms = [t for t in row["terms"]] if row["terms"] is not None else []
                df = np.array([t["df"] for t in terms], float)
                out.append(packed(terms=np.array([t["term"] for t in terms], dtype=np.str_), idf=idf_of(df, row["texts"])))
            yield frame[[*keys, "n"]].assign(params=out)

    return each.mapInPandas(fit, schema)


def text_models(rows: DataFrame, keys: list[str], alphas: tuple[float, ...], most: int = TERMS, min_df: int = MIN_DF) -> DataFrame:
    """(keys, kind, terms, alpha, validation_mse, test_mse) of ridge of y on TF-IDF weights, alone ('TextOnly') and beside x ('EarlyFusion').

    rows: keys, i, n, segment ('train', 'val', 'test'), x, y, text (plain). The penalty errs least on 'val' with the vocabulary of the
    training rows (to nine digits; the first of equals); the fit that is tested has the rows and the vocabulary of both. Sums
    of products of all terms are made per chunk of rows: most bounds their size. Keys without two rows in a segment give none.
    """
    some = rows.select(*keys, "i", "n", "segment", "x", "y", "text", F.size("x").alias("nx"), F.size("y").alias("h"))
    by = [*keys, "nx", "h"]

    def features(table: pa.Table, params: bytes) -> np.ndarray:
        import io

        p = np.load(io.BytesIO(params))
        place, idf = {t: k for k, t in enumerate(p["terms"].tolist())}, p["idf"]
        x, y = rows_of(table["x"]), rows_of(table["y"])
        t = np.zeros((len(y), len(idf)))
        for k, text in enumerate(table["text"].to_pylist()):
            at, w = weights(text, place, idf)
            t[k, at] = w
        return np.hstack((np.ones((len(y), 1)), x.reshape(len(y), -1), t, y))

    def sums(segments: tuple[str, ...], which: str) -> DataFrame:
        params = fitted_terms(some.where(F.col("segment").isin(*segments)), by, most, min_df)
        return chunked_gram(some, by, "segment", params, features).withColumn("which", F.lit(which))

    names = ["kind", "terms", "alpha", "validation_mse", "test_mse"]
    schema = ", ".join([*(f"{k} {t}" for k, t in rows.select(*keys).dtypes), "kind string, terms int, alpha double, validation_mse double, test_mse double"])

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        first, out = part.iloc[0], []
        of = {(w, s): Sums(matrix(g)) for w, s, g in zip(part["which"], part["segment"], part["gram"])}
        if all(("one", s) in of and of["one", s].n >= 2 for s in ("train", "val", "test")):
            nx, h = int(first["nx"]), int(first["h"])

            def at(sums: Sums, kind: str) -> tuple[np.ndarray, np.ndarray]:
                width = len(sums.total)
                return np.arange(1 + (nx if kind == "TextOnly" else 0), width - h), np.arange(width - h, width)

            for kind in ("TextOnly", "EarlyFusion"):
                x, y = at(of["one", "train"], kind)
                scores = [of["one", "val"].error(x, y, of["one", "train"].fit(x, y, a)) for a in alphas]
                best = int(np.argmin(np.round(scores, 9)))
                x, y = at(of["both", "train"], kind)
                test = of["both", "test"].error(x, y, (of["both", "train"] + of["both", "val"]).fit(x, y, alphas[best]))
                terms = len(of["both", "train"].total) - 1 - nx - h
                out.append({k: first[k] for k in keys} | dict(zip(names, [kind, terms, alphas[best], scores[best], test], strict=True)))
        return pd.DataFrame(out, columns=[*keys, *names])

    return sums(("train",), "one").unionByName(sums(("train", "val"), "both")).groupBy(*keys).applyInPandas(solve, schema)
