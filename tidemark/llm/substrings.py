"""Substring dedup: passages that recur across documents, confirmed, compiled to automata and located in every document.

A word goes if a window of so many words covers it whose sequence also starts in a document with a smaller doc_id.

1. Anchors: of the short runs of words in each window the one of least hash, so that equal windows have equal anchors. An
   anchor met in two different texts recurs; windows whose anchor doesn't recur can't.
2. Confirmed windows: those, by hash, of two documents or more. A window's first document holds the passage.
3. Automata: passages are cut to phrases, one at each step of so many words that every window holds a phrase. Documents are
   dealt to shards, and each shard gets the phrases of the passages that its documents can hold, as one Aho-Corasick
   automaton through which they are streamed. A hit is extended word by word, so that equal short hashes alone remove nothing.

Two kinds of documents are settled before the automata, with the result that these would give. One without a recurring
anchor holds no window of another text. One whose text has the SHA-256 of an earlier document's is that text, and all its
windows start there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import as_parquet, cut_lineage, map_rows

#: Words of a window, and of an anchor and a phrase.
WINDOW, PHRASE = 50, 10
#: Bytes of text of a shard, about: with their phrases, what a task holds.
SHARD_BYTES = 512 << 10


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _mix(codes: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each run of so many words, of the words' hashes."""
    n = len(codes) - length + 1
    out = np.zeros(max(n, 0), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(length if n > 0 else 0):
            out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
        return out ^ (out >> np.uint64(29))


def word_codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def anchors(codes: np.ndarray, window: int, phrase: int) -> np.ndarray:
    """For each window's start, the place of its anchor: the first run of least hash in it."""
    runs = _mix(codes, phrase)
    width = window - phrase + 1
    if len(runs) < width:
        return np.zeros(0, np.int64)
    out = np.empty(len(runs) - width + 1, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(runs, width)
    for at in range(0, len(out), 4096):
        out[at : at + 4096] = view[at : at + 4096].argmin(axis=1) + np.arange(at, min(at + 4096, len(out)))
    return out


def _long(values: np.ndarray) -> list[int]:
    return values.view(np.int64).tolist()


def phrases(words: list[bytes], starts: list[int], window: int, phrase: int) -> Iterator[tuple[bytes, bytes, bytes]]:
    """(left, phrase, right) of the passages that the windows at starts make up: phrases a step apart, with the words
    around each that lie in a window with it and in the passage."""
    step = window - phrase + 1
    runs: list[list[int]] = []
    for s in starts:
        if runs and s <= runs[-1][1] - window + 1:
            runs[-1][1] = s + window
        else:
            runs.append([s, s + window])
    for lo, hi in runs:
        for at in range(lo, hi - phrase + 1, step):
            left, right = words[max(lo, at - step + 1) : at], words[at + phrase : min(hi, at + window)]
            yield b" ".join(left), b" ".join(words[at : at + phrase]), b" ".join(right)


class Passages:
    """An Aho-Corasick automaton over phrases, each with the contexts that its passages give it."""

    def __init__(self, entries: list[tuple[int, str, str, str]], window: int, phrase: int):
        self.window, self.phrase = window, phrase
        contexts: dict[str, dict[tuple[str, str], int]] = {}
        for first, left, text, right in entries:
            known = contexts.setdefault(text, {})
            known[left, right] = min(first, known.get((left, right), first))
        self.automaton = ahocorasick.Automaton()
        for text, known in contexts.items():
            self.automaton.add_word(f" {text} ", [(first, a.split(" ")[::-1] if a else [], b.split(" ") if b else []) for (a, b), first in known.items()])
        if contexts:
            self.automaton.make_automaton()
        self.any = bool(contexts)

    def covered(self, doc_id: int, words: list[str]) -> np.ndarray:
        """Words of a document that passages with a smaller doc_id cover by whole windows."""
        edge = np.zeros(len(words) + 1, np.int64)
        if self.any:
            lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
            # ends[i]: where the space after word i stands in the stream, which begins with a space
            ends = np.cumsum(lengths)
            for end, contexts in self.automaton.iter(f" {' '.join(words)} "):
                at = int(np.searchsorted(ends, end)) - self.phrase + 1
                for first, left, right in contexts:
                    if first >= doc_id:
                        continue
                    a = 0
                    while a < len(left) and a < at and words[at - a - 1] == left[a]:
                        a += 1
                    b, tail = 0, at + self.phrase
                    while b < len(right) and tail + b < len(words) and words[tail + b] == right[b]:
                        b += 1
                    if a + self.phrase + b >= self.window:
                        edge[at - a] += 1
                        edge[tail + b] -= 1
        return np.cumsum(edge)[:-1] > 0


def _result(words: list, removed: np.ndarray | None) -> dict:
    if removed is None or not removed.any():
        kept, gone = words, 0
    else:
        kept, gone = [w for w, r in zip(words, removed.tolist(), strict=True) if not r], int(removed.sum())
    joined = (b" " if kept and isinstance(kept[0], bytes) else " ").join(kept) if kept else b""
    raw = joined if isinstance(joined, bytes) else joined.encode("utf-8", "surrogatepass")
    return {"n_words": len(words), "n_removed": gone, "kept_sha256": hashlib.sha256(raw).hexdigest()}


OUT = "n_words long, n_removed long, kept_sha256 string"


def dedup(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per document.

    A text that an earlier document has whole loses all its words, if they make a window, without further search. A null or
    empty text has no words and the digest of the empty string. Rows that repeat a doc_id are one document's: none is
    earlier than another. A null doc_id is earlier and later than none; its row keeps all words.
    """
    kind = dict(docs.dtypes)["doc_id"]
    docs = docs.select("doc_id", "text", F.sha2("text", 256).alias("sig"))

    def pick(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            words = split(row["text"])
            if row["doc_id"] is None or len(words) < window:
                continue
            codes = word_codes(words)
            at = np.unique(anchors(codes, window, phrase))
            yield {"doc_id": row["doc_id"], "sig": row["sig"], "hs": _long(np.unique(_mix(codes, phrase)[at]))}

    picked = as_parquet(map_rows(docs, pick, f"doc_id {kind}, sig string, hs array<long>"))
    firsts = picked.groupBy("sig").agg(F.min("doc_id").alias("original"))
    known = picked.select("doc_id", "sig").distinct().join(firsts, "sig").select("doc_id", "sig", (F.col("doc_id") > F.col("original")).alias("copy"))

    # Copies of a text don't make its anchors recur: two different texts must hold one.
    short = F.xxhash64("sig").alias("short")  # what an anchor carries of its text
    each = picked.select("doc_id", short, F.explode("hs").alias("h"))
    recurring = each.groupBy("h").agg(F.min("short").alias("a"), F.max("short").alias("b")).where("a != b").select("h")
    listed = each.join(recurring, "h").groupBy("doc_id", "short").agg(F.collect_set("h").alias("hs"))  # bounded by a document's length
    plan = known.withColumn("short", short).join(listed, ["doc_id", "short"], "left").select(F.col("doc_id").alias("id"), F.col("sig").alias("s"), "copy", F.when(~F.col("copy"), F.col("hs")).alias("hs"))
    joined = docs.join(plan, (docs["doc_id"] == plan["id"]) & (docs["sig"] == plan["s"]), "left").select("doc_id", "text", "copy", "hs")

    def windows(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            words = split(row["text"])
            if row["copy"]:
                yield {"doc_id": row["doc_id"], **_result(words, np.ones(len(words), bool)), "text": None, "starts": None, "ws": None}
                continue
            starts = np.zeros(0, np.int64)
            if row["hs"]:
                codes = word_codes(words)
                held = np.array(row["hs"], np.int64).view(np.uint64)
                starts = np.nonzero(np.isin(_mix(codes, phrase)[anchors(codes, window, phrase)], held))[0]
            if len(starts):
                ws, at = np.unique(_mix(codes, window)[starts], return_index=True)  # a window that repeats in a text counts once
                yield {"doc_id": row["doc_id"], "text": row["text"], "starts": starts[at].tolist(), "ws": _long(ws)}
            else:
                yield {"doc_id": row["doc_id"], **_result(words, None), "text": None, "starts": None, "ws": None}

    table = as_parquet(map_rows(joined, windows, f"doc_id {kind}, {OUT}, text string, starts array<int>, ws array<long>"))
    settled = table.where("text is null").select("doc_id", "n_words", "n_removed", "kept_sha256")
    open_docs = table.where("text is not null")

    # Confirmed windows and their first documents; both ends are combined before the shuffle.
    seen = open_docs.select("doc_id", F.explode(F.arrays_zip("starts", "ws")).alias("w")).select("doc_id", F.col("w.starts").alias("start"), F.col("w.ws").alias("w"))
    confirmed = seen.groupBy("w").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("w", "first")
    met = cut_lineage(
        seen.join(confirmed, "w")
        .groupBy("doc_id", "first")
        .agg(F.collect_set(F.when(F.col("doc_id") == F.col("first"), F.col("start"))).alias("starts"))  # bounded by a document's length
    )
    own = met.where("doc_id = first").select(F.col("doc_id").alias("id"), F.col("starts").alias("at"))
    holders = open_docs.select("doc_id", "text").join(own, open_docs["doc_id"] == own["id"]).select("doc_id", "text", "at")

    def cut(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            words = split(row["text"])
            for left, text, right in phrases(words, sorted(s for s in row["at"] if s + window <= len(words)), window, phrase):
                yield {"first": row["doc_id"], "left": left.decode("utf-8", "surrogatepass"), "phrase": text.decode("utf-8", "surrogatepass"), "right": right.decode("utf-8", "surrogatepass")}

    cuts = map_rows(holders, cut, f"first {kind}, left string, phrase string, right string")
    shards = 1 + open_docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // shard_bytes
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard")
    wanted = met.where("first < doc_id").select(shard, "first").distinct()
    sent = wanted.join(cuts, "first").select("shard", "first", "left", "phrase", "right")

    def locate(part: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        use = Passages(list(zip(found["first"].tolist(), found["left"], found["phrase"], found["right"])), window, phrase)
        rows = []
        for doc_id, text in zip(part["doc_id"].tolist(), part["text"]):
            words = [w.decode("utf-8", "surrogatepass") for w in split(text)]
            rows.append({"doc_id": doc_id, **_result(words, use.covered(doc_id, words))})
        return pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256"])

    located = open_docs.select(shard, "doc_id", "text").groupBy("shard").cogroup(sent.groupBy("shard")).applyInPandas(locate, f"doc_id {kind}, {OUT}")
    return settled.unionByName(located)
