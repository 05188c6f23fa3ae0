"""Toxicity: a learned lexicon, matched through Levenshtein automata over its trie, weighed by context.

Terms (words, and stems that open words) are learned from labelled rows. The trie of all terms and the Levenshtein
automata of all their spellings within a few edits form one automaton, of which a task builds the states that its words
reach. A hit in quotation marks or after words of reporting counts for less than one at a person.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log, log1p

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.llm.common import cut_lineage, map_rows

#: Bounds of the sample that the lexicon and weights are fitted on: labelled rows of each class, by a hash of doc_id.
TOXIC_ROWS, CLEAN_ROWS = 2000, 3000
#: Terms of a lexicon at most, strongest first: the bound of what is sent to tasks.
TERMS = 500
STEM = (4, 5, 6, 7, 8)
STRIP = ".,;:!?…\"'“”‘’«»()[]{}<>*#$%&|~^_-–—/\\"
#: Words within which context is read, and what a quoted or reported hit counts for.
CONTEXT, QUOTED = 6, 0.35
# Words that report speech, and words that address a person.
REPORTING = frozenset("said says say wrote writes called calls quote quoted quotes cited term word phrase slur sagte schrieb zitiert dit écrit cité dijo escribió cita".split())
ADDRESS = frozenset("you your you're u ur yourself du dich dein ihr euch tu toi vous votre tú te usted vosotros".split())
QUOTES = re.compile("[\"“”„«»]")


@dataclass(frozen=True)
class Model:
    """Terms with their weights, stems ending in *, and the weights of the features."""

    terms: tuple[tuple[str, float], ...] = ()
    weights: tuple[float, ...] = (-3.0, 0.0, 0.0)


def edits_allowed(term: str) -> int:
    """Short terms, and stems, must be met exactly: their neighbours are other words."""
    return 0 if term.endswith("*") or len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """Product of a lexicon's trie and its terms' Levenshtein automata, determinised as words are read.

    A state is a set of (trie node, edits so far); a stem's node, once reached, accepts whatever follows.
    """

    LIMIT = 50_000

    def __init__(self, terms: tuple[tuple[str, float], ...]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[int | None] = [None]
        self.stem: list[int | None] = [None]
        self.reach = [0]
        self.terms = terms
        for k, (term, _) in enumerate(terms):
            at, allowed = 0, edits_allowed(term)
            self.reach[0] = max(self.reach[0], allowed)
            for c in term.rstrip("*"):
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.stem.append(None)
                    self.reach.append(0)
                at = self.children[at][c]
                self.reach[at] = max(self.reach[at], allowed)
            (self.stem if term.endswith("*") else self.term)[at] = k
        self._reset()

    def _reset(self) -> None:
        self.states: list[frozenset] = [frozenset()]
        self.known: dict[frozenset, int] = {frozenset(): 0}
        self.moves: list[dict[str, int]] = [{}]
        self.start = self._state({(0, 0)})

    def _state(self, items: set[tuple[int, int]]) -> int:
        todo, least = list(items), {}
        while todo:  # a letter of the term left out
            node, e = todo.pop()
            if e < least.get(node, 99):
                least[node] = e
                todo += [(c, e + 1) for c in self.children[node].values() if e + 1 <= self.reach[c]]
        key = frozenset(least.items())
        if key not in self.known:
            self.known[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        return self.known[key]

    def _step(self, state: int, c: str) -> int:
        items: set[tuple[int, int]] = set()
        for node, e in self.states[state]:
            if self.stem[node] is not None and e == 0:
                items.add((node, e))
            for letter, child in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.reach[child]:
                    items.add((child, cost))
            if e + 1 <= self.reach[node]:
                items.add((node, e + 1))
        return self._state(items)

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest term, the first of equals, or None."""
        if len(self.states) > self.LIMIT:
            self._reset()
        at, moves = self.start, self.moves
        for c in word:
            to = moves[at].get(c)
            if to is None:
                to = moves[at][c] = self._step(at, c)
            if not to:
                return None
            at = to
        best = None
        for node, e in self.states[at]:
            k = self.term[node] if self.term[node] is not None and e <= edits_allowed(self.terms[self.term[node]][0]) else self.stem[node] if e == 0 else None
            if k is not None and (best is None or (e, k) < best):
                best = (e, k)
        return best and (best[1], best[0])


class Scorer:
    #: Distinct words that a task remembers, each of at most so many characters.
    REMEMBERED, REMEMBERED_LENGTH = 300_000, 48

    def __init__(self, model: Model):
        self.model = model
        self.automaton = Automaton(model.terms)
        self.words: dict[str, tuple[int, int] | None] = {}

    def word(self, raw: str) -> tuple[int, int] | None:
        try:
            return self.words[raw]
        except KeyError:
            found = self.automaton.match(raw.strip(STRIP))
            if len(raw) <= self.REMEMBERED_LENGTH:
                if len(self.words) >= self.REMEMBERED:
                    self.words.clear()
                self.words[raw] = found
            return found

    def features(self, text: str | None) -> tuple[float, ...]:
        """Hits, near spellings counting for less, and the share of words hit; all weighed by term and context."""
        words = (text or "").lower().split()
        look = self.word
        hits = [(i, h) for i, h in enumerate(map(look, words)) if h]
        if not hits:
            return (0.0, 0.0)
        opened = self._inside_quotes(words) if QUOTES.search(text) else None
        direct = near = 0.0
        for i, (term, edits) in hits:
            weight = self.model.terms[term][1]
            around = [w.strip(STRIP) for w in words[max(0, i - CONTEXT) : i] + words[i + 1 : i + 1 + CONTEXT]]
            reported = (opened is not None and opened[i]) or any(w in REPORTING for w in around[: min(i, CONTEXT)])
            if reported and not any(w in ADDRESS for w in around):
                weight *= QUOTED
            if edits:
                near += weight / (1 + edits)
            else:
                direct += weight
        return (log1p(direct + near), min(1.0, 20 * (direct + near) / len(words)))

    @staticmethod
    def _inside_quotes(words: list[str]) -> list[bool]:
        """Whether each word stands in quotation marks; a mark that isn't closed within 60 words opens nothing."""
        inside, start = [False] * len(words), None
        for i, w in enumerate(words):
            for _ in QUOTES.findall(w):
                if start is None:
                    start = i
                else:
                    if i - start <= 60:
                        inside[start : i + 1] = [True] * (i + 1 - start)
                    start = None
            if start is not None and i - start > 60:
                start = None
        return inside

    def score(self, text: str | None) -> float:
        x = self.model.weights[0] + sum(w * f for w, f in zip(self.model.weights[1:], self.features(text), strict=True))
        return 1 / (1 + exp(-max(-30.0, min(30.0, x))))


def training_rows(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> DataFrame:
    """(text, toxic) of the bounded sample of labelled rows that may be learned from: crc32(doc_id) mod 5 is not 0.

    Rows of labels that disagree count as toxic if any says so. The ids, at most toxic_rows + clean_rows, meet the
    documents in a semi-join's place, so that labels never move texts.
    """
    usable = labels.where("toxic is not null and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    pick = [usable.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for t, n in ((1, toxic_rows), (0, clean_rows))]
    chosen = cut_lineage(pick[0].unionByName(pick[1]))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")


def without_copies(rows: DataFrame) -> DataFrame:
    """The sample with one row of each group of near copies: else the chance words of a much copied text look telling.

    A row goes if one before it has the same least hash of its longer words, by any of three hashes: copies that share 80%
    of these words are told with a chance of 99%, and unrelated texts share few.
    """

    def sign(batch: Iterator[dict]) -> Iterator[dict]:
        for row in batch:
            raw = (row["text"] or "").lower().encode("utf-8", "surrogatepass")
            words = {w for w in raw.split() if len(w) > 6} or {raw}
            yield row | {f"h{k}": min(xxhash.xxh64_intdigest(w, k) >> 1 for w in words) for k in range(3)}

    signed = map_rows(rows, sign, f"doc_id {dict(rows.dtypes)['doc_id']}, text string, toxic int, h0 long, h1 long, h2 long")
    first = [F.row_number().over(W.partitionBy(f"h{k}").orderBy("doc_id", "text")).alias(f"n{k}") for k in range(3)]
    return signed.select("*", *first).where("n0 = 1 and n1 = 1 and n2 = 1").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Model:
    """Learn terms by the likelihood ratio of their document counts in both classes, then weights by ridge regression.

    Everything here is bounded by the sample; without rows of both classes the model scores every text alike and low.
    """
    rows = cut_lineage(without_copies(training_rows(docs, labels, toxic_rows, clean_rows)))
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Model()

    def count(batch: Iterator[dict]) -> Iterator[dict]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for row in batch:
            words = {w.strip(STRIP) for w in (row["text"] or "").lower().split()}
            terms = {w for w in words if 3 <= len(w) <= 24}
            terms |= {w[:k] + "*" for w in words for k in STEM if len(w) > k}
            counts[row["toxic"]].update(terms)
        for term in counts[1]:
            yield {"term": term, "toxic": counts[1][term], "clean": counts[0][term]}
        for term in counts[0].keys() - counts[1].keys():
            yield {"term": term, "toxic": 0, "clean": counts[0][term]}

    counted = map_rows(rows, count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    n1, n0 = sizes[1], sizes[0]
    share = F.lit(n1 / (n1 + n0))
    part = lambda n, p: F.when(n > 0, n * F.log(n / ((F.col("a") + F.col("b")) * p))).otherwise(0.0)
    scored = counted.where("a >= 3").withColumn("g", 2 * (part(F.col("a"), share) + part(F.col("b"), 1 - share)))
    seen = scored.count()
    strong = scored.where((F.col("a") / n1 > 19 * F.col("b") / n0) & (F.col("g") > 2 * log(max(seen, 2)) + 2))
    best = strong.orderBy(F.desc("g"), "term").limit(4 * TERMS).collect()  # bounded
    terms: dict[str, float] = {}
    stems = sorted((r["term"] for r in best if r["term"].endswith("*")), key=len)
    kept_stems: list[str] = []
    for s in stems:  # a stem within a shorter one says nothing more; one that only stands for a single word neither
        if not any(s.startswith(k[:-1]) for k in kept_stems):
            words = [r for r in best if not r["term"].endswith("*") and r["term"].startswith(s[:-1])]
            whole = next(r["a"] for r in best if r["term"] == s)
            if not words or max(r["a"] for r in words) < 0.7 * whole:
                kept_stems.append(s)
    for r in best:
        t = r["term"]
        if (t in kept_stems if t.endswith("*") else not any(t.startswith(k[:-1]) for k in kept_stems)) and len(terms) < TERMS:
            terms[t] = min(3.0, log((r["a"] + 0.5) / n1) - log((r["b"] + 0.5) / n0)) / 3.0
    model = Model(tuple(terms.items()), ())

    def measure(batch: Iterator[dict]) -> Iterator[dict]:
        use = Scorer(model)
        for row in batch:
            yield {"f": list(use.features(row["text"])), "toxic": row["toxic"]}

    sample = map_rows(rows, measure, "f array<double>, toxic int").collect()  # bounded by the sample: two numbers a row
    x = np.array([[1.0, *r["f"]] for r in sample])
    y = np.array([r["toxic"] for r in sample], float)
    order = np.lexsort((*x.T, y))
    return Model(model.terms, tuple(np.round(logistic(x[order], y[order]), 6).tolist()))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Newton's method for ridge logistic regression; features may only speak for toxicity, the constant is free."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    w[1:] = np.maximum(w[1:], 0.0)
    return w


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text. Null and empty texts get the score of a text without hits.

    Repeated rows are kept and get equal scores. A text of any length is read whole; words that tie between terms go to the
    nearest, the first of equals. A null doc_id gives a null held_out.
    """

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        use = Scorer(model)
        for row in rows:
            yield {"doc_id": row["doc_id"], "score": use.score(row["text"])}

    scored = map_rows(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
