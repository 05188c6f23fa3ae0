"""Phrase collocations, counted by weighted acyclic automata.

Every word of a piece begins a path of at most five words, so a phrase's count is the weight of all paths that begin with
it. A task sorts the paths of its shard and adds them, in order, to a count transducer: a deterministic acyclic automaton whose
paths share their beginnings and carry weights. Transducers are cut at prefixes that bound ranges of about equal size, each
range's parts are united by summing the weights of equal paths, and what begins with a prefix is summed along the union. Frequent
phrases of a range then make a minimal transducer, and composing it with the parts of candidates looks up the parts' counts.

Bounds of ranges come from a sample of documents and only balance tasks: every path is counted, wherever it falls.
"""

from __future__ import annotations

import struct
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.llm.common import cut_lineage

#: Words of a path: the longest phrase.
LONGEST = 5
#: Words that a shard's transducer takes in before it is cut and sent, and paths of a range, about: the memory of tasks.
SHARD_WORDS, RANGE_PATHS = 2_000_000, 500_000
#: Documents of the sample that bounds the ranges, about, and paths of it that the driver sees at most.
SAMPLE_DOCS, SAMPLE_PATHS = 4_000, 60_000
#: Words of a shard are numbered in 21 bits, so that a path fits two machine words.
_BITS = 21

_BREAK = b"\xff"  # no byte of UTF-8
_TABLE = bytearray(range(256))
for _k in range(65, 91):
    _TABLE[_k] = _k + 32
for _k in b".,;:!?\n\x0b\x0c\r":
    _TABLE[_k] = _BREAK[0]
_TABLE = bytes(_TABLE)


def tokens(text: bytes) -> list[bytes]:
    """Lower-case words of a text, with a break where a piece ends."""
    return text.translate(_TABLE).replace(_BREAK, b" \xff ").split()


class _Numbers(dict):
    """Numbers words in the order of coming, a break 0."""

    def __init__(self) -> None:
        super().__init__({_BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def paths(ids: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """A row per word: the word and those after it up to the end of its piece, filled with 0. ids has 0 for a break."""
    columns = [ids]
    for _ in range(1, longest):
        after = np.zeros_like(ids)
        after[:-1] = columns[-1][1:]
        columns.append(after)
    # Column d is d words on: it counts only if no break lies before it.
    for d in range(1, longest):
        columns[d] = np.where(columns[d - 1] == 0, 0, columns[d])
    return np.stack(columns, axis=1)[ids != 0]


def summed(rows: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows in order, their summed weights)."""
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    if rows.max() < 1 << _BITS:
        wide = rows.astype(np.uint64)
        high, low = np.zeros(len(rows), np.uint64), np.zeros(len(rows), np.uint64)
        for d in range(rows.shape[1]):
            if d < 3:
                high = high << np.uint64(_BITS) | wide[:, d]
            else:
                low = low << np.uint64(_BITS) | wide[:, d]
        order = np.lexsort((low, high))
    else:
        order = np.lexsort(rows.T[::-1])
    rows = rows[order]
    starts = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1))))
    weights = np.diff(starts, append=len(rows)) if weights is None else np.add.reduceat(weights[order], starts)
    return rows[starts], weights


class Transducer:
    """A count transducer in the order of its paths: rows of word numbers (from 1, in byte order, 0 after a path's end), weights.

    As bytes it is written depth first: how many arcs a path shares with the one before, how many it has, the labels of its
    own arcs, and its weight.
    """

    def __init__(self, words: list[bytes], rows: np.ndarray, weights: np.ndarray):
        self.words, self.rows, self.weights = words, rows, weights

    def shared(self) -> np.ndarray:
        """For each path, the number of arcs from the start that it shares with the path before."""
        same = np.ones(len(self.rows), bool)
        same[:1] = False
        out = np.zeros(len(self.rows), np.uint8)
        for d in range(self.rows.shape[1]):
            same[1:] &= self.rows[1:, d] == self.rows[:-1, d]
            out += same & (self.rows[:, d] != 0)
        return out

    def part(self, a: int, b: int) -> "Transducer":
        """Paths a to b, with the words they use."""
        used = np.unique(self.rows[a:b])
        used = used[used > 0]
        number = np.zeros(len(self.words) + 1, np.int32)
        number[used] = np.arange(1, len(used) + 1)
        return Transducer([self.words[k - 1] for k in used.tolist()], number[self.rows[a:b]], self.weights[a:b])

    def to_bytes(self) -> bytes:
        small = lambda v: v.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if int(v.max(initial=0)) <= np.iinfo(t).max))
        shared, sizes = self.shared(), (self.rows != 0).sum(axis=1).astype(np.uint8)
        places = np.arange(self.rows.shape[1])
        labels, weights = small(self.rows[(places >= shared[:, None]) & (places < sizes[:, None])]), small(self.weights)
        words = b" ".join(self.words)
        head = struct.pack("<qqqqqb", len(self.rows), self.rows.shape[1], labels.itemsize, len(labels), weights.itemsize, 0)
        return b"".join((head, shared.tobytes(), sizes.tobytes(), labels.tobytes(), weights.tobytes(), words))

    @classmethod
    def from_bytes(cls, raw: bytes) -> "Transducer":
        n, longest, width, m, heavy, _ = struct.unpack_from("<qqqqqb", raw)
        at = struct.calcsize("<qqqqqb")
        kinds = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}
        shared, sizes = np.frombuffer(raw, np.uint8, n, at), np.frombuffer(raw, np.uint8, n, at + n)
        labels = np.frombuffer(raw, kinds[width], m, at + 2 * n)
        weights = np.frombuffer(raw, kinds[heavy], n, at + 2 * n + m * width).astype(np.int64)
        words = raw[at + 2 * n + m * width + n * heavy :].split(b" ") if n else []
        rows, places = np.zeros((n, longest), np.int32), np.arange(longest)
        rows[(places >= shared[:, None]) & (places < sizes[:, None])] = labels
        for d in range(longest):  # an arc that isn't a path's own is that of the last path with an own one there
            own = np.where(d >= shared, np.arange(n), 0)
            held = np.maximum.accumulate(own)
            rows[:, d] = np.where(d < sizes, rows[held, d], 0)
        return cls(words, rows, weights)


def build(ids: np.ndarray, names: list[bytes]) -> Transducer:
    """The transducer of a shard's paths; names[k - 1] is the word numbered k in ids."""
    order = sorted(range(len(names)), key=names.__getitem__)
    rank = np.zeros(len(names) + 1, np.int32)
    rank[np.array(order, np.int64) + 1] = np.arange(1, len(names) + 1)
    return Transducer([names[k] for k in order], *summed(paths(rank[ids])))


def unite(parts: list[Transducer]) -> Transducer:
    """The union of transducers: the weights of equal paths are summed."""
    words = sorted(set().union(*(p.words for p in parts)))
    number = {w: k for k, w in enumerate(words, 1)}
    rows = [np.concatenate(([0], np.fromiter((number[w] for w in p.words), np.int32, len(p.words))))[p.rows] for p in parts]
    return Transducer(words, *summed(np.concatenate(rows), np.concatenate([p.weights for p in parts])))


def prefixes(t: Transducer, least: int) -> Iterator[tuple[bytes, int, int]]:
    """(phrase, words, weight) of every prefix whose paths weigh so much, and of those at either end, whose range may not hold all."""
    same = np.ones(len(t.rows), bool)
    same[:1] = False
    for d in range(t.rows.shape[1]):
        same[1:] &= t.rows[1:, d] == t.rows[:-1, d]
        starts = np.flatnonzero(~same)
        weights = np.add.reduceat(t.weights, starts)
        keep = weights >= least
        keep[[0, -1]] = True
        keep &= t.rows[starts, d] != 0
        for row, weight in zip(t.rows[starts[keep], : d + 1].tolist(), weights[keep].tolist()):
            yield b" ".join(t.words[k - 1] for k in row), d + 1, weight


class Minimal:
    """A minimal transducer built from sorted phrases one by one: a state is final weight and arcs; equal states are one."""

    def __init__(self, phrases: Iterator[tuple[tuple[bytes, ...], int]]):
        self.register: dict[tuple, int] = {}
        self.states: list[tuple[int, dict[bytes, int]]] = []
        spine: list[list] = [[0, {}, None]]  # of the last phrase: weight, frozen arcs, label of the arc still open
        for words, weight in phrases:
            depth = 0
            while depth < len(words) and depth < len(spine) - 1 and spine[depth][2] == words[depth]:
                depth += 1
            self._freeze(spine, depth)
            for word in words[depth:]:
                spine[-1][2] = word
                spine.append([0, {}, None])
            spine[-1][0] = weight
        self._freeze(spine, 0)
        self.start = self._state(*spine[0][:2])

    def _freeze(self, spine: list[list], depth: int) -> None:
        while len(spine) > depth + 1:
            weight, arcs, _ = spine.pop()
            spine[-1][1][spine[-1][2]] = self._state(weight, arcs)
            spine[-1][2] = None

    def _state(self, weight: int, arcs: dict[bytes, int]) -> int:
        key = (weight, tuple(arcs.items()))
        if key not in self.register:
            self.register[key] = len(self.states)
            self.states.append((weight, arcs))
        return self.register[key]

    def weight(self, words: tuple[bytes, ...]) -> int:
        """The weight of a phrase, 0 if it isn't accepted."""
        at = self.start
        for word in words:
            at = self.states[at][1].get(word)
            if at is None:
                return 0
        return self.states[at][0]


def _place(bounds: list[tuple[str, tuple[bytes, ...]]], lang: str, words: tuple[bytes, ...]) -> int:
    return bisect_right(bounds, (lang, words))


def bounds(docs: DataFrame, range_paths: int = RANGE_PATHS, sample_docs: int = SAMPLE_DOCS, sample_paths: int = SAMPLE_PATHS, seed: int = 42) -> list[tuple[str, tuple[bytes, ...]]]:
    """Least (lang, path) of each range but the first, from a sample of documents: quantiles of at most sample_paths paths."""
    size = docs.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("bytes")).first()
    number = -(-size["bytes"] // (6 * range_paths))  # a word and what parts it from the next have six letters, about
    if number <= 1:
        return []
    sample = docs.sample(min(1.0, sample_docs / size["rows"]), seed) if size["rows"] > sample_docs else docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, found = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = tokens(text)
                for k in range(len(held) % 16, len(held), 16):
                    path = held[k : k + LONGEST]
                    path = path[: path.index(_BREAK)] if _BREAK in path else path
                    if path:
                        langs.append(lang)
                        found.append(b" ".join(path))
            yield pa.record_batch([pa.array(langs, pa.string()), pa.array(found, pa.binary())], names=["lang", "path"])

    seen = sample.mapInArrow(run, "lang string, path binary").withColumn("h", F.xxhash64("lang", "path", F.monotonically_increasing_id())).orderBy("h").limit(sample_paths)
    keys = sorted((r["lang"].encode(), r["path"].split(b" ")) for r in seen.collect())
    cuts = sorted({(lang, tuple(path)) for lang, path in (keys[len(keys) * k // number] for k in range(1, number))} if keys else ())
    return [(lang.decode(), path) for lang, path in cuts]


def texts(docs: DataFrame) -> DataFrame:
    """(lang, text binary); a null language is und, a null text empty."""
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def _cut(t: Transducer, lang: str, cuts: list[tuple[str, tuple[bytes, ...]]]) -> Iterator[tuple[int, bytes]]:
    """(range, transducer of the paths that fall into it)."""
    first, last = bisect_left(cuts, (lang, ())), bisect_left(cuts, (lang + "\0", ()))
    places = [0]
    for _, words in cuts[first:last]:
        lo, hi = places[-1], len(t.rows)
        for d, word in enumerate(words):
            k = bisect_left(t.words, word)
            column = t.rows[lo:hi, d]
            exact = k < len(t.words) and t.words[k] == word
            lo, hi = lo + int(np.searchsorted(column, k + 1, "left")), lo + int(np.searchsorted(column, k + 1, "right" if exact else "left"))
            if not exact or lo == hi:
                break
        places.append(lo)
    places.append(len(t.rows))
    for k, (a, b) in enumerate(zip(places, places[1:])):
        if a < b:
            yield first + k, t.part(a, b).to_bytes()


def counted(docs: DataFrame, least: int = 100, range_paths: int = RANGE_PATHS, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, list]:
    """((lang, phrase, words, f), bounds of the ranges): phrases of up to five words with f >= least, and the number of all
    words of a language as that of the empty phrase."""
    source = texts(docs)
    cuts = bounds(source, range_paths)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held, size = _Numbers(), {}, 0

        def out() -> Iterator[pa.RecordBatch]:
            names = list(numbers)[1:]
            for lang, parts in held.items():
                ids = np.concatenate(parts)
                if ids.any():
                    used = np.unique(ids)
                    used = used[used > 0]
                    own = np.zeros(len(numbers), np.int32)
                    own[used] = np.arange(1, len(used) + 1)
                    for place, raw in _cut(build(own[ids], [names[k - 1] for k in used.tolist()]), lang, cuts):
                        yield pa.record_batch([pa.array([place], pa.int32()), pa.array([lang]), pa.array([raw], pa.binary())], names=["range", "lang", "part"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = tokens(text.as_py())
                ids = np.zeros(len(found) + 1, np.int32)
                ids[:-1] = np.fromiter(map(numbers.__getitem__, found), np.int32, len(found))
                held.setdefault(lang, []).append(ids)
                size += len(ids)
                if size >= shard_words:
                    yield from out()
                    numbers, held, size = _Numbers(), {}, 0
        yield from out()

    def union(key: tuple, table: pa.Table) -> pa.Table:
        by: dict[str, list[Transducer]] = {}
        for lang, raw in zip(table["lang"].to_pylist(), table["part"]):
            by.setdefault(lang, []).append(Transducer.from_bytes(raw.as_py()))
        columns: tuple[list, ...] = ([], [], [], [])
        for lang, parts in by.items():
            t = unite(parts)
            for phrase, words, weight in [(b"", 0, int(t.weights.sum())), *prefixes(t, least)]:
                for column, value in zip(columns, (lang, phrase.decode(), words, weight)):
                    column.append(value)
        return pa.table({"lang": pa.array(columns[0], pa.string()), "phrase": pa.array(columns[1], pa.string()), "words": pa.array(columns[2], pa.int32()), "f": pa.array(columns[3], pa.int64())})

    parts = source.mapInArrow(shards, "range int, lang string, part binary")
    some = parts.groupBy("range").applyInArrow(union, "lang string, phrase string, words int, f long")
    return some.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= F.when(F.col("words") == 0, 0).otherwise(least)), cuts


def looked_up(grams: DataFrame, parts: DataFrame, cuts: list) -> DataFrame:
    """(lang, phrase, f) of the distinct phrases in parts: each range's transducer composed with the parts that fall into it."""

    def placed(df: DataFrame) -> DataFrame:
        names = df.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = [_place(cuts, lang, tuple(phrase.encode().split(b" "))) for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns], names=["range", *names])

        return df.mapInArrow(run, "range int, " + ", ".join(f"{n} {t}" for n, t in df.dtypes)).groupBy("range")

    def compose(left: pa.Table, right: pa.Table) -> pa.Table:
        known: dict[str, list] = {}
        for lang, phrase, f in zip(left["lang"].to_pylist(), left["phrase"].to_pylist(), left["f"].to_pylist()):
            known.setdefault(lang, []).append((tuple(phrase.encode().split(b" ")), f))
        use = {lang: Minimal(iter(sorted(rows))) for lang, rows in known.items()}
        asked = list(zip(right["lang"].to_pylist(), right["phrase"].to_pylist()))
        found = [use[lang].weight(tuple(phrase.encode().split(b" "))) if lang in use else 0 for lang, phrase in asked]
        return pa.table({"lang": pa.array([a for a, _ in asked], pa.string()), "phrase": pa.array([b for _, b in asked], pa.string()), "f": pa.array(found, pa.int64())})

    return placed(grams.select("lang", "phrase", "f")).cogroup(placed(parts.select("lang", "phrase").distinct())).applyInArrow(compose, "lang string, phrase string, f long")


def collocations(docs: DataFrame, least: int = 100, covered: int = 100, most: int = 2000, **sizes: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases of 2 to 5 words, by the lowest score of their cuts.

    a, l, r are the counts of the phrase and of the two parts of its lowest-scoring cut, the shortest left part among equals; n
    counts the language's words. Phrases with fewer than least occurrences are no candidates, nor stay those that lie inside
    a longer candidate with covered percent of their count. sizes are those of counted(). A null language is und, a null text empty; repeated rows each
    count; ties of score and count go by the phrase's bytes; an empty table gives no row.
    """
    grams, cuts = counted(docs, least, **sizes)
    grams = cut_lineage(grams)
    totals = grams.where("words = 0").select("lang", F.col("f").alias("n"))
    grams = grams.where("words > 0")
    w = F.split("phrase", " ", -1)
    candidates = grams.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), "words", w.alias("w"))
    joined = lambda column, start, size: F.array_join(F.slice(column, start, size), " ")
    cuts_of = candidates.select("lang", "phrase", "a", "words", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts_of = cuts_of.select("lang", "phrase", "a", "k", joined("w", F.lit(1), F.col("k")).alias("left"), joined("w", F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    cuts_of = cut_lineage(cuts_of)
    parts = cuts_of.select("lang", F.col("left").alias("phrase")).unionByName(cuts_of.select("lang", F.col("right").alias("phrase")))
    counts = cut_lineage(looked_up(grams, parts, cuts))
    for side in ("left", "right"):
        cuts_of = cuts_of.join(counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(side[0])), ["lang", side])
    digits = "decimal(19,0)"
    top = F.col("a").cast("decimal(15,0)") * F.lit(1000).cast("decimal(4,0)")
    scored = cuts_of.join(totals, "lang").withColumn("top", top.cast(digits) * F.col("n").cast(digits)).withColumn("bottom", F.col("l").cast(digits) * F.col("r").cast(digits))
    scored = scored.withColumn("score", F.expr("top div bottom").cast("long"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("s")).select("lang", "phrase", "s.*")
    inner = candidates.where("words > 2").select("lang", "a", "words", "w", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = inner.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("start")).select("lang", joined("w", F.col("start"), F.col("size")).alias("phrase"), "a")
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("inside"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(F.col("inside").isNull() | (100 * F.col("inside") < covered * F.col("a")))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= most).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
