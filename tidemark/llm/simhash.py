"""SimHash near-duplicates: fingerprints of word shingles, compared bit-sliced within blocks that share key bits.

Two fingerprints of 64 bits that differ in at most r bits agree on at least m - r of m blocks of bits. So every pair within
the radius meets in one of the C(m, m - r) tables that are keyed by m - r blocks. Within a key, fingerprints are compared
in bit planes: plane b holds bit b of 64 fingerprints in one machine word.

Key tables serve small radii. For similar texts, which differ in more bits than any exact key could allow for, fingerprints
are longer, and tables are keyed by bands of the shingles' least hashes instead; the comparison is the same. Such
fingerprints only propose: texts that they join are held against one another shingle by shingle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import as_parquet, cut_lineage, map_rows
from tidemark.llm.components import connected_components, join_roots

BITS = 64
SEED = 42
#: A key's fingerprints are compared in chunks of about so many, so that no task holds a whole key.
CHUNK = 4096
#: Words of planes that one step compares with queries, all queries taken together: the memory of a step.
PAIRED_WORDS = 1 << 15
#: Distinct shingles of the texts that one side of a verification holds, about: the memory of a task.
CHUNK_SHINGLES = 1 << 21
#: Long fingerprints have so many words of 64 bits.
LANES = 4
#: Standard deviations that a long fingerprint's distance may lie above the one that its similarity is worth.
SPREAD = 4
#: Bands of least hashes, and hashes in a band: texts of Jaccard similarity 0.8 share a band with a chance of 0.9998.
BANDS, IN_BAND = 12, 3
#: First and last band of each round of verification.
ROUNDS = ((0, 1), (2, BANDS - 1))
_SHIFTS = np.arange(BITS, dtype=np.uint64)
#: Odd factors, which turn a shingle's hash into one per least hash and per lane.
_FACTORS = np.array([xxhash.xxh64_intdigest(str(k), SEED) | 1 for k in range(BANDS * IN_BAND + LANES)], np.uint64)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each shingle of a whole text, repeats included, lower case for A-Z; of all words if they are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    digest, seed = xxhash.xxh64_intdigest, SEED
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """64 bits, each 1 if set in over half the hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((ones * 2 > len(hashes)).astype(np.uint64) << _SHIFTS).sum())


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit fingerprint of a whole text; zero if it has no word."""
    return majority(shingle_hashes(text, shingle))


def distinct_shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """The set of a whole text's shingles, as their hashes in order; empty without a word."""
    return np.unique(shingle_hashes(text, shingle))


def sketch(hashes: np.ndarray) -> tuple[list[int], list[int]]:
    """(long fingerprint in words of 64 bits, keys of the bands) of a set of shingles, as signed numbers; zeros if it is empty."""
    if not len(hashes):
        return [0] * LANES, [0] * BANDS
    lanes = [majority(hashes)]
    for factor in _FACTORS[BANDS * IN_BAND + 1 :]:
        turned = (hashes ^ (hashes >> np.uint64(32))) * factor
        lanes.append(majority((turned ^ (turned >> np.uint64(29))) * factor))
    least = np.array([(hashes * factor).min() for factor in _FACTORS[: BANDS * IN_BAND]], np.uint64).reshape(BANDS, IN_BAND)
    signed = lambda v: v - (1 << BITS) if v >> 63 else v
    return [signed(v) for v in lanes], [signed(xxhash.xxh64_intdigest(row.tobytes(), SEED)) for row in least]


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp long): fp holds the fingerprint's 64 bits, as a signed number. A null or empty text has 0."""

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            fp = fingerprint(row["text"], shingle)
            yield {"doc_id": row["doc_id"], "fp": fp - (1 << BITS) if fp >> 63 else fp}

    return map_rows(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def sketches(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(doc_id, same binary, n long, fp array<long>, keys array<long>) per document: a digest of the set of its shingles, their
    number, a long fingerprint and the keys of its bands."""

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            hashes = distinct_shingles(row["text"], shingle)
            fp, keys = sketch(hashes)
            yield {"doc_id": row["doc_id"], "same": hashlib.sha256(hashes.tobytes()).digest(), "n": len(hashes), "fp": fp, "keys": keys}

    return map_rows(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, same binary, n long, fp array<long>, keys array<long>")


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints: row b holds bit b of each, 64 to a word; the last word is filled with the first one.

    A fingerprint is a number of 64 bits, or a row of such numbers.
    """
    n = len(fps)
    padded = np.ascontiguousarray(np.concatenate((fps, np.repeat(fps[:1], -n % BITS, axis=0))))
    bits = np.unpackbits(padded.view(np.uint8).reshape(len(padded), -1), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)


def within(queries: np.ndarray, stored: np.ndarray, n: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, place) of queries and the n fingerprints stored as planes that differ in at most radius bits."""
    words = stored.shape[1]
    query, word, lane = _hits(queries, np.repeat(np.arange(len(queries)), words), np.tile(np.arange(words), len(queries)), stored, radius)
    place = word * BITS + lane
    return query[place < n], place[place < n]


def _hits(queries: np.ndarray, query: np.ndarray, word: np.ndarray, stored: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, word, lane) of the lanes within the radius, for queries[query] against the words of planes beside them.

    A pair of a query and a word of planes has carry-save counters: counts[j] holds bit j of its 64 distances, and over the
    lanes that went beyond the counters. Planes are added in turn; words all of whose lanes are beyond the radius are
    abandoned.
    """
    width = (radius + 1).bit_length()  # 2 ** width > radius + 1, so that an overflow means beyond the radius
    masks = planes_of_lanes(queries)
    counts = [np.zeros(len(query), np.uint64) for _ in range(width)]
    over = np.zeros(len(query), np.uint64)
    everything = np.uint64(0xFFFFFFFFFFFFFFFF)
    for bit in range(len(stored)):
        carry = stored[bit, word] ^ masks[bit, query]
        for j in range(width):
            counts[j], carry = counts[j] ^ carry, counts[j] & carry
        over |= carry
        if bit % 8 == 7 and bit < len(stored) - 1:
            going = _beyond(counts, over, radius) != everything
            if not going.all():
                query, word, over = query[going], word[going], over[going]
                counts = [c[going] for c in counts]
                if not len(query):
                    break
    inside = ~_beyond(counts, over, radius)
    lanes = np.unpackbits(inside.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, lane = np.nonzero(lanes)
    return query[row], word[row], lane


def planes_of_lanes(queries: np.ndarray) -> np.ndarray:
    """Row b has, per query, all ones or all zeros, as its bit b is."""
    bits = queries.reshape(len(queries), -1, 1) >> _SHIFTS & np.uint64(1)
    return bits.reshape(len(queries), -1).T * np.uint64(0xFFFFFFFFFFFFFFFF)


def _beyond(counts: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count is more than radius: compares bit by bit from the top."""
    more, same = over.copy(), ~over
    for j in reversed(range(len(counts))):
        if radius >> j & 1:
            same = same & counts[j]
        else:
            more |= same & counts[j]
            same = same & ~counts[j]
    return more


def block_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links, as places in left and then right, that join what is within the radius: among left, or between left and right.

    Fingerprints are unsigned, one or more words of 64 bits each. Instead of all pairs, each fingerprint is linked with the least that the pairs of this block join it to.
    """
    everything = left if right is None else np.concatenate((left, right))
    stored, n, shift = planes(everything if right is None else right), len(left if right is None else right), 0 if right is None else len(left)
    root = np.arange(len(everything))
    step = max(1, PAIRED_WORDS // stored.shape[1])
    for at in range(0, len(left), step):
        query, place = within(left[at : at + step], stored, n, radius)
        query, place = query + at, place + shift
        root = join_roots(root, query[query != place], place[query != place])
    far = np.nonzero(root != np.arange(len(root)))[0]
    return far, root[far]


def small_links(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links, as places, within each of many groups of 64 fingerprints at most: a group has one word of planes.

    Groups are compared side by side, so that the steps of the counters are shared by many.
    """
    root = np.arange(len(fps))
    for at in range(0, len(starts), 1024):
        start, size = starts[at : at + 1024, None], sizes[at : at + 1024, None]
        lanes = np.arange(BITS)[None, :]
        places = start + np.where(lanes < size, lanes, 0)
        group, own = np.nonzero(lanes < size)
        mine = places[group, own]
        query, word, lane = _hits(fps[mine], np.arange(len(mine)), group, planes(fps[places.ravel()]), radius)
        a, b = mine[query], places[word, lane]
        root = join_roots(root, a[a != b], b[a != b])
    far = np.nonzero(root != np.arange(len(root)))[0]
    return far, root[far]


def tables_for(n: int, radius: int) -> list[int]:
    """Masks of the key bits of each table, for n distinct fingerprints.

    More blocks give keys of more bits and more tables; all choices find every pair. Keys have about log2(n) - 9 bits or
    more, so that a table's key holds some hundreds of unrelated fingerprints at most, at any n.
    """
    for blocks in range(radius + 1, radius + 5):
        if BITS * (blocks - radius) // blocks >= max(n, 2).bit_length() - 9:
            break
    edges = [round(BITS * k / blocks) for k in range(blocks + 1)]
    masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(masks, blocks - radius)]


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << BITS) if mask >> 63 else mask)


def links(fps: DataFrame, radius: int = 4, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links between distinct fingerprints of column fp, enough to join all that are within the radius."""
    distinct = cut_lineage(fps.select("fp").where("fp is not null").distinct())
    keys = F.array(*(F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(_signed(mask)).alias("key")) for k, mask in enumerate(tables_for(distinct.count(), radius))))
    keyed = distinct.select("fp", F.explode(keys).alias("k")).select("k.*", F.col("fp").alias("id"), "fp")
    return compared(keyed, radius, chunk)


def compared(keyed: DataFrame, radius: int, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links between ids, enough to join all that share a key of a table and whose fingerprints are within the radius.

    keyed: t, key, id, fp (long or array<long>). Keys of one row are left out after a count. A key of more than a chunk is
    dealt to several by a hash, and each pair of its chunks is compared by itself: rows are multiplied by the number of
    chunks, never by those in a key.
    """
    id_type = dict(keyed.dtypes)["id"]
    return _compared(keyed, radius, chunk, lambda t, far, root: pd.DataFrame({"a": far, "b": root}), f"a {id_type}, b {id_type}").distinct()


def clusters(keyed: DataFrame, radius: int, chunk: int = CHUNK) -> DataFrame:
    """(c, id, t): sets of ids that a key's links join, each with the first table that has it; ids that share a key and whose
    fingerprints are within the radius are in one set. A set lies within two chunks of one key, and equal sets of many keys are one."""

    def sets(t: np.ndarray, far: np.ndarray, root: np.ndarray) -> pd.DataFrame:
        members = pd.DataFrame({"t": np.append(t, t), "root": np.append(root, root), "id": np.append(far, root)}).drop_duplicates().sort_values(["t", "root", "id"])
        name = members.groupby(["t", "root"], sort=False)["id"].transform(lambda ids: np.int64(np.uint64(xxhash.xxh64_intdigest(",".join(map(str, ids)), SEED)).view(np.int64)))
        return pd.DataFrame({"c": name.to_numpy(np.int64), "id": members["id"], "t": members["t"].to_numpy(np.int32)})

    found = _compared(keyed, radius, chunk, sets, f"c long, id {dict(keyed.dtypes)['id']}, t int")
    return found.groupBy("c", "id").agg(F.min("t").alias("t"))


def _compared(keyed: DataFrame, radius: int, chunk: int, give: Callable[[np.ndarray, np.ndarray, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """What give makes of the links in each pair of a key's chunks: tables, ids and the ids that they are linked with.

    Links of one pair of chunks lead to the least place that they join, so equal second ids of one call are one set.
    """
    counts = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / F.lit(chunk)).cast("int")
    dealt = keyed.join(counts, ["t", "key"]).withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    # For chunk c: the pairs (c, c), (c, other) and (other, c), the smaller first. A chunk by itself is compared once.
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    paired = paired.select("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "fp")
    group = ["t", "key", "i", "j"]
    ready = paired.repartition(*group).sortWithinPartitions(*group, "own")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def out(frame: pd.DataFrame) -> pd.DataFrame:
            ids = frame[group].to_numpy()
            fps, own, named = np.array(frame["fp"].tolist(), np.int64).view(np.uint64), frame["own"].to_numpy(), frame["id"].to_numpy()
            starts = np.concatenate(([0], np.nonzero((ids[1:] != ids[:-1]).any(axis=1))[0] + 1, [len(frame)]))
            sizes, small = np.diff(starts), np.diff(starts) <= BITS
            small &= ids[starts[:-1], 2] == ids[starts[:-1], 3]
            sides = tuple([places] for places in small_links(fps, starts[:-1][small], sizes[small], radius))
            for a, b in zip(starts[:-1][~small].tolist(), starts[1:][~small].tolist()):
                found = ()
                i, j = ids[a, 2], ids[a, 3]
                if i == j:
                    found = block_links(fps[a:b], None, radius)
                else:
                    cut = a + int((own[a:b] == i).sum())  # sorted by own, and i < j
                    if a < cut < b:
                        found = block_links(fps[a:cut], fps[cut:b], radius)
                for side, places in zip(sides, found):
                    side.append(a + places)
            far, root = map(np.concatenate, sides)
            return give(ids[far, 0].astype(np.int64), named[far], named[root])

        for batch in batches:
            held.append(batch)
            frame = pd.concat(held) if len(held) > 1 else batch
            last = (frame[group] != frame[group].iloc[-1]).any(axis=1).to_numpy()
            cut = int(np.nonzero(last)[0][-1]) + 1 if last.any() else 0
            held = [frame.iloc[cut:]]
            if cut:
                yield out(frame.iloc[:cut])
        if held and len(held[0]):
            yield out(held[0])

    return ready.mapInPandas(run, schema)


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) per document; component_id is the smallest doc_id that links reach.

    Equal fingerprints are one class, represented by its smallest doc_id, and only classes are compared; so a component's
    smallest id comes out of the contraction itself. A null or empty text has fingerprint zero, which links like any other.
    A row without a doc_id has its class's component, null if no other row is in the class, and joins no classes.
    """
    fps = cut_lineage(fingerprints(docs, shingle))
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    pairs = links(fps, radius)
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("fp").alias(side), F.col("least").alias(f"least_{side}")), side)
    found = connected_components(pairs, "least_a", "least_b")
    of = classes.join(found, classes["least"] == found["id"], "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    return fps.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """One document of each group, the one with the smallest doc_id, with all its columns.

    Rows that repeat that doc_id all stay, and so do rows without a doc_id, which no group can name.
    """
    return _without_extra(docs, near_duplicates(docs, radius, shingle))


def _without_extra(docs: DataFrame, found: DataFrame) -> DataFrame:
    extra = found.where("doc_id != component_id").select(F.col("doc_id").alias("_extra")).distinct()
    return docs.join(extra, docs["doc_id"] == extra["_extra"], "left_anti")


def radius_for(similarity: float) -> int:
    """Bits of a long fingerprint by which sets of that Jaccard similarity may differ.

    Sets of equal size have the cosine 2 s / (1 + s), others of the same similarity a higher one; the share of bits that
    differ is the angle as a part of a half turn, and spreads like heads of a coin.
    """
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(BITS * LANES * share + SPREAD * np.sqrt(BITS * LANES * share * (1 - share)))


def alike(codes: np.ndarray, ends: np.ndarray, similarity: float, middle: int = 0) -> np.ndarray:
    """For each set, the first one that pairs of a Jaccard similarity of so much or more join it to.

    Set k is codes[ends[k]:ends[k + 1]], of numbers below the length of codes. All pairs are compared, or, with a middle,
    those of a set before it and one from it on; pairs that are joined already need no comparison.
    """
    sizes, n = np.diff(ends), len(ends) - 1
    root, marked = np.arange(n), np.zeros(len(codes) + 1, bool)
    for k in range(middle or n):
        others = np.arange(middle or k + 1, n)
        small, large = np.minimum(sizes[others], sizes[k]), np.maximum(sizes[others], sizes[k])
        others = others[(root[others] != root[k]) & (small >= similarity * large)]
        others = others[sizes[others] > 0]
        if not len(others):
            continue
        mine = codes[ends[k] : ends[k + 1]]
        marked[mine] = True
        lengths = sizes[others]
        first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        held = codes[np.repeat(ends[others] - first, lengths) + np.arange(lengths.sum())]
        shared = np.add.reduceat(marked[held], first, dtype=np.int64)
        marked[mine] = False
        joined = others[shared >= similarity * (sizes[k] + lengths - shared)]
        if len(joined):
            met = np.unique(root[np.append(joined, k)])
            root[np.isin(root, met)] = met[0]
    return root


def shingle_sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(id, shingles array<long>) of the documents whose doc_id is among ids, in order and without repeats."""

    def sets(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            yield {"id": row["id"], "shingles": distinct_shingles(row["text"], shingle).view(np.int64).tolist()}

    texts = docs.select(F.col("doc_id").alias("id"), "text").join(ids.select("id").distinct(), "id", "left_semi")
    return map_rows(texts, sets, f"id {dict(ids.dtypes)['id']}, shingles array<long>")


def verified(sets: DataFrame, near: DataFrame, similarity: float, chunk: int = 2 * CHUNK, chunk_shingles: int = CHUNK_SHINGLES) -> DataFrame:
    """(a, b): links between ids, enough to join all that near puts in one set and whose shingles are alike.

    sets: id, shingles; near: id, c, the sets of candidates. Similarity is that of Jaccard. A set of more than a chunk, of ids
    or of shingles, is dealt to several by a hash and each pair of its chunks is compared by itself, as compared() does.
    """
    id_type = dict(near.dtypes)["id"]
    sizes = sets.groupBy("id").agg(F.sum(F.size("shingles")).alias("n"))
    weighed = near.join(sizes, "id").groupBy("c").agg(F.greatest(F.ceil(F.count("*") / F.lit(chunk)), F.ceil(F.sum("n") / F.lit(chunk_shingles)), F.lit(1)).cast("int").alias("chunks"))
    dealt = near.join(weighed, "c").withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    paired = dealt.select("c", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id").join(sets, "id")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["own", "id"], kind="stable")
        own, ids = frame["own"].to_numpy(), frame["id"].to_numpy()
        ends = np.concatenate(([0], np.cumsum(frame["shingles"].map(len).to_numpy(np.int64))))
        codes = np.unique(np.concatenate(frame["shingles"].to_list()).astype(np.int64), return_inverse=True)[1]
        middle = int((own == own[0]).sum()) if frame["i"].iloc[0] != frame["j"].iloc[0] else 0
        if middle == len(frame):  # the other chunk of this pair is empty
            return pd.DataFrame({"a": ids[:0], "b": ids[:0]})
        root = alike(codes, ends, similarity, middle)
        far = np.nonzero(root != np.arange(len(root)))[0]
        return pd.DataFrame({"a": ids[far], "b": ids[root[far]]})

    return paired.groupBy("c", "i", "j").applyInPandas(run, f"a {id_type}, b {id_type}")


def similar(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """(doc_id, component_id) per document, which links join to the smallest doc_id they reach.

    Two texts link if the Jaccard similarity of their sets of shingles is so much or more. Candidates share a band of least
    hashes, and their long fingerprints are within radius_for(similarity). What candidates join within one band's key is then
    compared shingle by shingle, so that no other texts link and loose links never chain. Bands are taken in rounds: sets
    that earlier rounds have put in one component are done. Texts without a word are alike. A row without a doc_id has the component of the
    same set, null if there is none, and joins none. Rows that repeat a doc_id have one component.
    """
    found = cut_lineage(sketches(docs, shingle))
    classes = cut_lineage(found.groupBy("same", "n", "fp", "keys").agg(F.min("doc_id").alias("least")).where("least is not null"))
    keyed = classes.select(F.posexplode("keys").alias("t", "key"), F.col("least").alias("id"), "fp")
    near = cut_lineage(clusters(keyed, radius_for(similarity)))
    sets = as_parquet(shingle_sets(docs, near, shingle))
    links = joined = None
    for first, last in ROUNDS:
        some = near.where(F.col("t").between(first, last)).select("c", "id")
        if joined is not None:
            placed = some.join(joined, "id", "left").select("c", F.coalesce("component", "id").alias("r"))
            some = some.join(placed.groupBy("c").agg(F.min("r").alias("a"), F.max("r").alias("b")).where("a != b"), "c", "left_semi")
        new = verified(sets, some, similarity)
        links = cut_lineage(new if links is None else new.unionByName(links))
        joined = connected_components(links)
    of = classes.join(joined, classes["least"] == joined["id"], "left").select("same", F.coalesce("component", "least").alias("component_id"))
    return found.join(of, "same", "left").select("doc_id", "component_id")


def dedup_similar(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """One document of each group of similar texts, chosen as dedup does."""
    return _without_extra(docs, similar(docs, similarity, shingle))
