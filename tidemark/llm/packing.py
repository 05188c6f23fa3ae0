"""Packing documents' tokens into sequences of one length: concatenate and cut.

Documents' ids, each with an end token, are laid end to end in the order of the input's partitions. The first pass encodes
each partition, counting tokens from its start, and writes the ids; prefix sums of the partitions' totals turn these counts into
global offsets. The second pass cuts every document where a window of the length ends: one record per piece. No sequence but
the last has room left, and no text is encoded twice.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.llm.bpe import WHITE
from tidemark.llm.common import as_parquet, cut_lineage

#: Tokens in a sequence, and the token that ends a document.
LENGTH, END = 4096, 2
#: Distinct runs without white space whose ids a task remembers, and ids it holds for them.
REMEMBERED, REMEMBERED_IDS = 1_000_000, 8_000_000
#: Bytes of text that are encoded in one step, about.
STEP = 4_000_000
#: The most partitions whose offsets are broadcast, 16 bytes each; beyond, they are joined.
BROADCAST_PARTS = 1_000_000
#: Characters at which Python's split() parts runs and the vocabulary's normaliser doesn't.
_ODD = "\x1c\x1d\x1e\x1f"
#: Runs that are one word of Latin letters, or one and then a word of stops, however they are normalised.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+([.,;:!?]*)")


class _Places(dict):
    """Number of each distinct key, in the order of coming; new holds the keys that came since it was last emptied."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self.new.append(key)
        place = self[key] = len(self)
        return place


class RunEncoder:
    """Ids of whole texts by the tokenizers library, which is asked once for each distinct run without white space.

    The vocabulary's words never go beyond white space, so a text's ids are those of its runs, one after another. Plain runs
    are sent many at a time: the last id of a word tells where it ends.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            suffix = json.load(file)["model"]["end_of_word_suffix"]
        vocab = self.library.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for piece, i in vocab.items() if piece.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.places, self.ids, self.first, self.size = _Places(), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @staticmethod
    def runs(text: str) -> list[str]:
        if any(c in text for c in _ODD):
            return [run for run in WHITE.split(text) if run]
        return text.split()

    def ask(self, runs: list[str]) -> None:
        """Append the ids of runs that are new, by the library."""
        parts, at, firsts, sizes = [self.ids], len(self.ids), [self.first], [self.size]
        for k in range(0, len(runs), 2048):
            found = list(map(_PLAIN.fullmatch, runs[k : k + 2048]))
            plain = np.fromiter((m is not None for m in found), bool, len(found))
            words = np.fromiter((1 + bool(m[1]) for m in found if m), np.int64, int(plain.sum()))
            batch = [" ".join(m[0] for m in found if m), *(run for run, m in zip(runs[k : k + 2048], found) if not m)]
            joined, *others = (np.array(x.ids, np.uint32) for x in self.library.encode_batch_fast(batch, add_special_tokens=False))
            ends = np.flatnonzero(self.ends_word[joined])[np.cumsum(words) - 1] + 1
            size, first = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
            size[plain], size[~plain] = np.diff(ends, prepend=0), [len(x) for x in others]
            first[plain], first[~plain] = at + ends - size[plain], at + len(joined) + np.cumsum(size[~plain]) - size[~plain]
            parts += [joined, *others]
            at += int(size.sum())
            firsts.append(first)
            sizes.append(size)
        self.ids, self.first, self.size = map(np.concatenate, (parts, firsts, sizes))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all the texts, number of ids of each)."""
        runs = [self.runs(text or "") for text in texts]
        n = sum(map(len, runs))
        at = np.fromiter(map(self.places.__getitem__, chain.from_iterable(runs)), np.int64, n)
        new, self.places.new = self.places.new, []
        if new:
            self.ask(new)
        first, size = self.first[at], self.size[at]
        before = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.repeat(first - before[:-1], size) + np.arange(before[-1])]
        of_text = np.diff(before[np.concatenate(([0], np.cumsum([len(r) for r in runs], dtype=np.int64)))])
        if len(self.places) > REMEMBERED or len(self.ids) > REMEMBERED_IDS:
            self.forget()
        return ids, of_text


@functools.lru_cache(maxsize=2)
def run_encoder(path: str) -> RunEncoder:
    """One encoder per Python worker and file; the file is read where the task runs."""
    return RunEncoder(path)


def _steps(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of a batch that hold about STEP bytes of text, a text of more by itself."""
    texts = batch.column(1).to_pylist()
    at, weight = 0, 0
    for k, text in enumerate(texts):
        weight += len(text or "")
        if weight >= STEP or k - at >= 2047 or k == len(texts) - 1:
            yield batch.slice(at, k + 1 - at), texts[at : k + 1]
            at, weight = k + 1, 0


def encoded(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """(doc_id, part int, before long, doc_tokens long, ids binary) per document, the first pass.

    ids are little-endian unsigned numbers of 32 bits, with the end token last; before counts the ids that come earlier in the
    partition numbered part. A null or empty text has the end token alone; null ids and repeated rows are kept.
    """
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, part int, before long, doc_tokens long, ids binary"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, part, before = run_encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows, texts in _steps(batch):
                ids, sizes = use.encode(texts)
                ends = np.cumsum(sizes)
                closed = np.insert(ids, ends, np.uint32(end)).astype("<u4").tobytes()
                sizes, ends = sizes + 1, ends + np.arange(1, len(sizes) + 1)
                offsets = pa.array(np.concatenate(([0], 4 * ends)).astype(np.int32), pa.int32())
                held = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, offsets.buffers()[1], pa.py_buffer(closed)])
                places = before + ends - sizes
                before += int(sizes.sum())
                columns = [rows.column(0), pa.array(np.full(len(sizes), part, np.int32)), pa.array(places), pa.array(sizes), held]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def offsets(tokens: DataFrame) -> DataFrame:
    """tokens with at, the number of ids before a document in the whole input: prefix sums over the totals of partitions.

    The window without a key runs over one row per partition of the input.
    """
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    base = F.coalesce(F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    starts = cut_lineage(totals.select("part", base.alias("base")))
    if starts.count() <= BROADCAST_PARTS:
        starts = F.broadcast(starts)
    return tokens.join(starts, "part").withColumn("at", F.col("base") + F.col("before")).drop("base")


def cut(placed: DataFrame, piece: Callable[[Column], Column], length: int = LENGTH) -> DataFrame:
    """One row per piece, the second pass: doc_id, start, length, what piece makes of its ids, doc_tokens, sequence_id, offset.

    Windows of the length are laid over all ids; a document has a piece in each window that it reaches into. Pieces are cut
    inside the document's row, so that its ids aren't copied for each.
    """
    at, n = F.col("at"), F.col("doc_tokens")
    first, last = (F.floor(x / length).cast("long") for x in (at, at + n - 1))

    def record(k: Column) -> Column:
        start = F.greatest(k * length - at, F.lit(0).cast("long"))
        size = F.least((k + 1) * length - at, n) - start
        ids = F.substring("ids", (start * 4 + 1).cast("int"), (size * 4).cast("int"))
        return F.struct(start.alias("start"), size.alias("length"), piece(ids), n.alias("doc_tokens"), k.alias("sequence_id"), (at + start - k * length).alias("offset"))

    return placed.select("doc_id", F.inline(F.transform(F.sequence(first, last), record)))


def crc(ids: Column) -> Column:
    return F.crc32(ids).alias("ids_crc32")


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Sequences hold exactly length ids, the last one what is left. Ids are written once, in the shared folder, so that reruns of
    lost tasks cut at the same places. Every row is a document of its own: ties, repeated rows and rows without an id too. An
    empty table gives no piece.
    """
    return cut(offsets(as_parquet(encoded(docs, path, end), compression="zstd")), crc, length)


def sequences(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, pad: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids binary): the sequences themselves, padded to length unless their tokens are a power of two."""
    pieces = cut(offsets(as_parquet(encoded(docs, path, end), compression="zstd")), lambda ids: ids.alias("ids"), length)
    joined = F.aggregate(F.sort_array(F.collect_list(F.struct("offset", "ids"))), F.lit(b""), lambda held, p: F.concat(held, p["ids"]))
    made = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
    n = F.col("n_tokens")
    missing = F.when(n.bitwiseAND(n - 1) == 0, 0).otherwise(F.lit(length) - n).cast("int")
    filling = F.aggregate(F.array_repeat(F.lit(pad.to_bytes(4, "little")), missing), F.lit(b""), lambda held, p: F.concat(held, p))
    return made.withColumn("ids", F.concat("ids", filling))
