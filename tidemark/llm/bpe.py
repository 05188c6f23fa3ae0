"""Byte-pair encoding and decoding with a public vocabulary file, as the tokenizers library does it.

Supported files: BPE models with a word-end suffix, the normalizer NFC / white space to one space / lower case, a
splitting pattern followed by the byte alphabet, and special tokens that are cut out before normalising.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import regex
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import map_rows

#: Words of more parts than this use a heap in place of scans, with equal results.
SHORT_WORD = 128
#: Distinct words, and runs without white space, that a task remembers, each of at most so many characters.
REMEMBERED, REMEMBERED_LENGTH = 400_000, 48


# Letters and numbers, by their code points, that the library's tables don't have yet, so that it takes them as symbols.
LATER_NUMBERS = "11de0-11de9 1246f 12475-1247f 12550-12686 16ff4-16ff6"
LATER_LETTERS = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11df1 16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 "
    "187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 "
    "1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
)
# Capitals that the library lowers and Python doesn't know, by the code points of the first, the last and the first one's small letter.
CAPITALS = "1c89-1c89-1c8a a7cb-a7cb-264 a7cc-a7cc-a7cd a7ce-a7ce-a7cf a7d2-a7d2-a7d3 a7d4-a7d4-a7d5 a7da-a7da-a7db a7dc-a7dc-19b 10d50-10d65-10d70 16ea0-16eb8-16ebb"


def _lowered() -> dict[int, int]:
    rows = [[int(x, 16) for x in row.split("-")] for row in CAPITALS.split(" ")]
    return {k: small + k - first for first, last, small in rows for k in range(first, last + 1)}


LOWERED = _lowered()
CAPITAL = re.compile("[" + "".join(map(chr, LOWERED)) + "]")
SEPARATORS = re.compile("[\x1c-\x1f]")
WHITE = re.compile(r"[^\S\x1c-\x1f]+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where Latin-1 prints it, else 256, 257, ... in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class Encoder:
    """Encodes texts to ids and decodes ids to text, with the vocabulary in a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        steps = {n["type"] for n in spec["normalizer"]["normalizers"]}
        if model["type"] != "BPE" or steps != {"NFC", "Replace", "Lowercase"} or not model["end_of_word_suffix"]:
            raise ValueError(f"{path}: not a lower-case BPE vocabulary with word ends")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.pair: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(x if isinstance(x, list) else x.split(" ") for x in model["merges"]):
            joined = self.vocab[a + b]
            self.pair.setdefault((self.vocab[a], self.vocab[b]), (rank, joined))
        letters = byte_alphabet()
        self.inner = [self.vocab[c] for c in letters]
        self.last = [self.vocab[c + self.suffix] for c in letters]
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.piece = {i: t for t, i in (self.vocab | specials).items()}
        self.name = {i: str(i) for i in self.piece}
        self.specials = specials
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        for kind, later in ((r"\p{L}", LATER_LETTERS), (r"\p{N}", LATER_NUMBERS)):
            ranges = "".join("-".join(f"\\U{int(x, 16):08x}" for x in row.split("-")) for row in later.split(" "))
            pattern = pattern.replace(kind, f"[{kind}--[{ranges}]]")
        self.words = regex.compile(pattern, regex.VERSION1).findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.known_words: dict[str, tuple[int, ...]] = {}

    def merge(self, ids: list[int]) -> list[int]:
        """Apply merges, lowest rank first and leftmost among equals, to the parts of one word.

        parts and ranks are one contiguous array each: ranks[i] is the rank of merging parts[i] with parts[i + 1]. Each
        step scans for the smallest rank, deletes the boundary there and refreshes the two ranks beside it.
        """
        if len(ids) > SHORT_WORD:
            return self.merge_long(ids)
        parts, none = list(ids), (1 << 60, 0)
        look = self.pair.get
        ranks = [look(p, none)[0] for p in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == none[0]:
                break
            at = ranks.index(low)
            parts[at : at + 2] = [look((parts[at], parts[at + 1]))[1]]
            del ranks[at]
            if at:
                ranks[at - 1] = look((parts[at - 1], parts[at]), none)[0]
            if at < len(ranks):
                ranks[at] = look((parts[at], parts[at + 1]), none)[0]
        return parts

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same merges for a long word in n log n steps: a heap of (rank, place) over linked parts."""
        parts: list[int | None] = list(ids)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.pair[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.pair]
        heapq.heapify(heap)
        while heap:
            _, at, left, right = heapq.heappop(heap)
            nxt = after[at]
            if parts[at] != left or nxt >= n or parts[nxt] != right:
                continue
            parts[at], parts[nxt] = self.pair[left, right][1], None
            after[at] = after[nxt]
            if after[nxt] < n:
                before[after[nxt]] = at
            for a in (before[at], at):
                if a >= 0 and after[a] < n and (found := self.pair.get((parts[a], parts[after[a]]))):
                    heapq.heappush(heap, (found[0], a, parts[a], parts[after[a]]))
        return [p for p in parts if p is not None]

    def word(self, word: str) -> tuple[int, ...]:
        if (known := self.known_words.get(word)) is not None:
            return known
        raw = word.encode("utf-8", "surrogatepass")
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        return self.remember(self.known_words, word, tuple(self.merge(ids)))

    def run(self, run: str) -> tuple[int, ...]:
        """Ids of a run without white space: no word of the splitting pattern goes beyond one."""
        words = self.words(run)
        ids = self.word(words[0]) if len(words) == 1 else tuple(i for word in words for i in self.word(word))
        return self.remember(self.known, run, ids)

    @staticmethod
    def remember(known: dict, key: str, ids: tuple[int, ...]) -> tuple[int, ...]:
        if len(key) <= REMEMBERED_LENGTH:
            if len(known) >= REMEMBERED:
                known.clear()
            known[key] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        known = self.known.get
        for k, part in enumerate(self.split_special.split(text or "")):
            if k % 2:
                out.append(self.specials[part])
                continue
            # Each capital is lowered by itself: the library has no final sigma, Python's lower() has.
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            if CAPITAL.search(part):
                part = part.translate(LOWERED)
            # Python's split() also splits at U+001C to U+001F, which the pattern takes as symbols.
            for run in WHITE.split(part) if SEPARATORS.search(part) else part.split():
                ids = known(run)
                out += self.run(run) if ids is None else ids
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The library's decoding for a file without a decoder: pieces joined by spaces, special tokens kept."""
        return " ".join(map(self.piece.__getitem__, ids))

    def digest_ids(self, ids: Iterable[int]) -> str:
        return hashlib.sha256(" ".join(map(self.name.__getitem__, ids)).encode()).hexdigest()


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file; the file is read where the task runs."""
    return Encoder(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text. A null text gives an empty array; ties and repeats keep their rows."""

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        use = encoder(path)
        for row in rows:
            yield {"id": row["id"], "ids": use.encode(row["text"])}

    kind = dict(docs.dtypes)[id_col]
    return map_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row of ids. Null ids give the empty text."""

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        use = encoder(path)
        for row in rows:
            yield {"id": row["id"], "text": use.decode(row["ids"] or [])}

    kind = dict(tokens.dtypes)[id_col]
    return map_rows(tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every whole text: doc_id, n_tokens, ids_sha256, decoded_sha256, in one narrow pass.

    Null and empty texts have no tokens and the digests of the empty string. Null ids and repeated rows are kept.
    """

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        use = encoder(path)
        for row in rows:
            ids = use.encode(row["text"])
            text = use.decode(ids)
            yield {"doc_id": row["doc_id"], "n_tokens": len(ids), "ids_sha256": use.digest_ids(ids), "decoded_sha256": hashlib.sha256(text.encode()).hexdigest()}

    kind = dict(docs.dtypes)["doc_id"]
    return map_rows(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
