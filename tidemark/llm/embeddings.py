"""Near-duplicate embeddings: a navigable small-world graph per shard of a label, every shard searched, links verified.

Vectors of a label are dealt to shards by a hash of their id, and each shard is indexed once. A shard's own vectors are
searched where its graph is built; those of later shards are sent to it in blocks, a batch of them walking the graph side by
side. Queries travel, graphs are sent once per block of shards. A walk whose beam fills with links is compared with the
whole shard, so that dense groups are found whole. Audits compare the searches of ids divisible by 100, and of some that
found links, with all vectors of the shard, and widen the beam until enough links are found.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import as_parquet
from tidemark.llm.components import connected_components, join_roots


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.98
    #: Vectors of a shard, about: the unit of memory and of work.
    shard: int = 16384
    #: Links of a node above the ground layer; twice as many on it.
    degree: int = 8
    build_beam: int = 24
    beam: int = 16
    #: Of the vectors that found links, how many are audited besides the ids divisible by 100; the share to be found.
    audits: int = 64
    recall: float = 0.99
    #: Shards whose vectors one task searches in a graph: a graph is sent once for so many.
    block: int = 16


#: An empty slot of a row of links.
EMPTY = np.int32(-1)

class Graph:
    """Hierarchical navigable small world over unit vectors, similarity being the dot product.

    Nodes are ordered by their highest layer, so that each layer is a prefix of them, and inserted in batches: a batch walks
    the graph so far side by side, and its members are compared with each other. order leads from nodes to vectors.
    """

    def __init__(self, vectors: np.ndarray, degree: int, beam: int, seed: int = 7, batch: int = 256):
        n = len(vectors)
        level = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / math.log(degree)).astype(int), 12)
        self.order = np.argsort(-level, kind="stable")
        self.v, level = np.ascontiguousarray(vectors[self.order], np.float32), level[self.order]
        self.degree, self.beam = degree, beam
        counts = [int((level >= k).sum()) for k in range(int(level.max(initial=0)) + 1)]
        self.links = [np.full((m, self._room(k)), EMPTY) for k, m in enumerate(counts)]
        self.filled = [np.zeros(m, np.int32) for m in counts]
        at = 0
        while at < n:
            to = min(at + max(1, min(batch, at)), counts[level[at]])
            self._insert(np.arange(at, to), int(level[at]))
            at = to
        for k in range(len(counts)):
            over = np.nonzero(self.filled[k] > self._limit(k))[0]
            for at in range(0, len(over), 1024):
                self._prune(k, over[at : at + 1024])
            self.links[k] = np.ascontiguousarray(self.links[k][:, : self._limit(k)])

    def _limit(self, layer: int) -> int:
        return self.degree * (1 if layer else 2)

    def _room(self, layer: int) -> int:
        """Links that a node may have while the graph grows: beyond it they are chosen anew."""
        return self._limit(layer) * 3 // 2

    def _insert(self, new: np.ndarray, level: int) -> None:
        first, q = int(new[0]), self.v[new]
        among = q @ q.T
        np.fill_diagonal(among, -2)
        k = min(self.beam // 2, len(new) - 1)
        own = np.argpartition(-among, k - 1, axis=1)[:, :k] if k else np.zeros((len(new), 0), np.int64)
        near = np.zeros((len(new), min(first, 1)), np.int32)
        for layer in range(len(self.links) - 1, -1, -1):
            if layer > level:
                near, _ = self.walk(q, near, layer, 1)
                continue
            sims = np.zeros((len(new), 0), np.float32)
            if first:
                near, sims = self.walk(q, near, layer, self.beam)
            ids = np.concatenate((near, new[own].astype(np.int32)), axis=1)
            if ids.shape[1]:
                chosen = self._diverse(ids, np.concatenate((sims, np.take_along_axis(among, own, 1)), axis=1), self.degree)
                self.links[layer][new, : chosen.shape[1]] = chosen
                self.filled[layer][new] = (chosen >= 0).sum(axis=1)
                self._link_back(layer, chosen, new)

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, limit: int) -> np.ndarray:
        """Per row, nearest first, candidates nearer to the row's own vector than to one chosen before; then the nearest of the rest."""
        order = np.argsort(-sims, axis=1)
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        known, block = ids >= 0, self._block(ids)
        among = block @ block.transpose(0, 2, 1)
        nearest, count, taken = np.full(ids.shape, -2, np.float32), np.zeros(len(ids), np.int32), np.zeros(ids.shape, bool)
        for k in range(ids.shape[1]):
            taken[:, k] = known[:, k] & (nearest[:, k] <= sims[:, k]) & (count < limit)
            count += taken[:, k]
            rows = np.nonzero(taken[:, k])[0]
            nearest[rows] = np.maximum(nearest[rows], among[rows, k])
        last = ids.shape[1]
        rank = np.arange(last) + np.where(taken, 0, last) + np.where(known, 0, 2 * last)
        return np.take_along_axis(np.where(known, ids, EMPTY), np.argsort(rank, axis=1)[:, :limit], 1)

    def _block(self, ids: np.ndarray) -> np.ndarray:
        return self.v.take(ids.ravel(), axis=0, mode="clip").reshape(*ids.shape, -1)

    def _link_back(self, layer: int, chosen: np.ndarray, new: np.ndarray) -> None:
        row, col = np.nonzero(chosen >= 0)
        target, source = chosen[row, col], new[row].astype(np.int32)
        lacking = ~(self.links[layer][target] == source[:, None]).any(axis=1)  # members of a batch may have chosen each other
        by = np.argsort(target[lacking], kind="stable")
        target, source = target[lacking][by], source[lacking][by]
        if not len(target):
            return
        nodes, start, times = np.unique(target, return_index=True, return_counts=True)
        slot = self.filled[layer][target] + np.arange(len(target)) - np.repeat(start, times)
        room = self._room(layer)
        fits = slot < room
        self.links[layer][target[fits], slot[fits]] = source[fits]
        self.filled[layer][nodes] = np.minimum(self.filled[layer][nodes] + times, room)
        if not fits.all():
            over, at = np.unique(target[~fits], return_inverse=True)
            extra = np.full((len(over), int(slot.max()) - room + 1), EMPTY)
            extra[at, slot[~fits] - room] = source[~fits]
            self._prune(layer, over, extra)

    def _prune(self, layer: int, nodes: np.ndarray, extra: np.ndarray | None = None) -> None:
        ids = self.links[layer][nodes]
        ids = ids if extra is None else np.concatenate((ids, extra), axis=1)
        sims = np.where(ids >= 0, np.matmul(self._block(ids), self.v[nodes][:, :, None])[..., 0], -2)
        kept = self._diverse(ids, sims, self._limit(layer))
        self.links[layer][nodes] = EMPTY
        self.links[layer][nodes, : kept.shape[1]] = kept
        self.filled[layer][nodes] = (kept >= 0).sum(axis=1)

    def walk(self, q: np.ndarray, entry: np.ndarray, layer: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the beam best nodes found in a layer for each row of q, best first; -1 where there are fewer.

        All rows walk side by side: each step opens some of the best unopened nodes of every row that has any left in its
        beam, and compares the neighbours that the row hasn't met.
        """
        links, v, width = self.links[layer], self.v, max(1, beam // 6)
        met = np.full((len(q), len(links)), -1, np.int32)
        ids, sims = np.full((len(q), beam), EMPTY), np.full((len(q), beam), -2, np.float32)
        ids[:, : entry.shape[1]] = entry[:, :beam]
        row, col = np.nonzero(ids >= 0)
        sims[row, col] = np.einsum("ij,ij->i", v[ids[row, col]], q[row])
        met[row, ids[row, col]] = 0
        unopened, tick, going = ids >= 0, 1, np.arange(len(q))
        while True:
            best = np.where(unopened[going], sims[going], -3)
            pick = best.argmax(axis=1)[:, None] if width == 1 else np.argpartition(-best, width - 1, axis=1)[:, :width]
            good = np.take_along_axis(best, pick, 1) > -3
            left = good.any(axis=1)
            going, pick, good = going[left], pick[left], good[left]
            if not len(going):
                break
            unopened[going[:, None], pick] = False
            around = links[np.where(good, ids[going[:, None], pick], 0)]
            around[~good] = EMPTY
            around = around.reshape(len(going), -1)
            at, col = np.nonzero(around >= 0)
            node = around[at, col]
            fresh = met[going[at], node] < 0
            at, node = at[fresh], node[fresh]
            # A node that two opened ones share is compared once: the last number written stays.
            number = np.arange(tick, tick + len(node), dtype=np.int32)
            met[going[at], node] = number
            once = met[going[at], node] == number
            at, node, tick = at[once], node[once], tick + len(number)
            sim = np.einsum("ij,ij->i", v.take(node, axis=0), q.take(going[at], axis=0))
            better = sim > sims[going].min(axis=1)[at]
            at, node, sim = at[better], node[better], sim[better]
            if not len(node):
                continue
            times = np.bincount(at, minlength=len(going))
            some = np.nonzero(times)[0]
            place = np.cumsum(times > 0) - 1
            slot = np.arange(len(at)) - (np.cumsum(times) - times)[at]
            more, more_sims = np.full((len(some), int(times.max())), EMPTY), np.full((len(some), int(times.max())), -2, np.float32)
            more[place[at], slot], more_sims[place[at], slot] = node, sim
            rows = going[some]
            joined = np.concatenate((sims[rows], more_sims), axis=1)
            top = np.argpartition(-joined, beam - 1, axis=1)[:, :beam]
            sims[rows] = np.take_along_axis(joined, top, 1)
            ids[rows] = np.take_along_axis(np.concatenate((ids[rows], more), axis=1), top, 1)
            unopened[rows] = np.take_along_axis(np.concatenate((unopened[rows], more >= 0), axis=1), top, 1)
        order = np.argsort(-sims, axis=1)
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def around(self, q: np.ndarray, beam: int, entry: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the beam best nodes that walks find, from the top layer down or from entry nodes on the ground."""
        if entry is None:
            entry = np.zeros((len(q), 1), np.int32)
            for layer in range(len(self.links) - 1, 0, -1):
                entry, _ = self.walk(q, entry, layer, 1)
        return self.walk(q, entry, 0, beam)


def _unit(block: np.ndarray) -> np.ndarray:
    return block / np.linalg.norm(block, axis=1, keepdims=True)


#: Queries that are compared with a whole shard at once.
ROWS = 256


@dataclass
class Search:
    """What a batch of queries found: links (query, node), queries to compare with the whole shard, the beam, the recall."""

    query: np.ndarray
    node: np.ndarray
    dense: np.ndarray
    beam: int
    recall: float | None


def find(queries: np.ndarray, graph: Graph, stored: np.ndarray, use: Settings, audited: np.ndarray, own: bool = False) -> Search:
    """Links of queries to stored, both unit vectors in double precision, stored in the graph's order.

    The radius of a walk is a little below the threshold; each find is verified in double precision. With own, the queries
    are the stored vectors themselves, walks start at them, and they are no links of themselves.
    """
    radius, beam, n = use.threshold - 1e-4, use.beam, len(stored)
    near = queries.astype(np.float32)
    true_of = lambda picks: (queries[picks] @ stored.T >= use.threshold).sum(axis=1) - own
    while True:
        dense, pairs = [], []
        for at in range(0, len(queries), ROWS):
            rows = np.arange(at, min(at + ROWS, len(queries)))
            if beam >= n:
                dense.append(rows)
                continue
            ids, sims = graph.around(near[rows], beam, rows.astype(np.int32)[:, None] if own else None)
            hit = sims >= radius
            full = hit.all(axis=1)
            dense.append(rows[full])
            r, c = np.nonzero(hit & ~full[:, None])
            a, b = rows[r], ids[r, c]
            ok = np.einsum("ij,ij->i", queries[a], stored[b]) >= use.threshold
            if own:
                ok &= a != b
            pairs.append((a[ok], b[ok].astype(np.int64)))
        a, b = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
        dense = np.concatenate(dense) if dense else np.zeros(0, np.int64)
        walked = np.ones(len(queries), bool)
        walked[dense] = False
        finders = np.unique(a)
        picks = np.union1d(np.nonzero(audited & walked)[0], finders[:: max(1, len(finders) // use.audits)])
        true = sum(int(true_of(picks[k : k + ROWS]).sum()) for k in range(0, len(picks), ROWS))
        recall = float(np.isin(a, picks).sum() / true) if true else None
        if recall is None or recall >= use.recall or beam >= n:
            return Search(a, b, dense, beam, recall)
        beam *= 4


class Tally:
    """Links per member, with copies counted and without, and components, of a task's links."""

    def __init__(self, weight: np.ndarray):
        self.weight, self.links, self.degree, self.root = weight, np.zeros(len(weight), np.int64), np.zeros(len(weight), np.int64), np.arange(len(weight))

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links that each stand once, counted at both ends."""
        n = len(self.weight)
        for x, y in ((a, b), (b, a)):
            self.links += np.bincount(x, self.weight[y], n).astype(np.int64)
            self.degree += np.bincount(x, minlength=n)
        apart = self.root[a] != self.root[b]
        if apart.any():
            self.root = join_roots(self.root, a[apart], b[apart])


def own_links(unit: np.ndarray, graph: Graph, weight: np.ndarray, use: Settings, audited: np.ndarray) -> tuple[Tally, Search]:
    """Links among the vectors of a shard. A link that either end's walk finds counts, once."""
    n, out = len(unit), Tally(weight)
    got = find(unit, graph, unit, use, audited, own=True)
    whole = np.zeros(n, bool)
    whole[got.dense] = True
    some = ~whole[got.node]  # the others come out of the comparison of their other end
    both = np.unique(np.minimum(got.query, got.node)[some] * n + np.maximum(got.query, got.node)[some])
    out.add(both // n, both % n)
    for at in range(0, len(got.dense), ROWS):
        rows = got.dense[at : at + ROWS]
        r, b = np.nonzero(unit[rows] @ unit.T >= use.threshold)
        a = rows[r]
        once = ~whole[b] | (a < b)
        out.add(a[once], b[once])
    return out, got


def cross_links(queries: np.ndarray, weights: np.ndarray, graph: Graph, stored: np.ndarray, weight: np.ndarray, use: Settings, audited: np.ndarray) -> tuple[Tally, Search]:
    """Links of queries to the vectors of another shard. Members are the shard's, then the queries."""
    n, out = len(stored), Tally(np.concatenate((weight, weights)))
    got = find(queries, graph, stored, use, audited)
    out.add(got.query + n, got.node)
    for at in range(0, len(got.dense), ROWS):
        rows = got.dense[at : at + ROWS]
        r, b = np.nonzero(queries[rows] @ stored.T >= use.threshold)
        out.add(rows[r] + n, b)
    return out, got


def true_links(queries: np.ndarray, stored: np.ndarray, threshold: float) -> np.ndarray:
    return np.concatenate([(queries[at : at + ROWS] @ stored.T >= threshold).sum(axis=1) for at in range(0, len(queries), ROWS)] or [np.zeros(0, np.int64)])


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """Rows that can link: label not null, a vector of finite components, not all zero. Equal rows count once."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists("embedding", lambda x: x != 0)
    return vectors.select("vec_id", "label", "embedding").where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & some).distinct()


#: Kinds of rows of the index: a vector's own links, a shard's graph, a distinct vector to be searched in other shards.
MEMBER, GRAPH, QUERY = 0, 1, 2


def near_duplicates(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audited_recall) per row of vectors: links at or above the threshold within a label.

    Null labels, and vectors that are null, empty, zero or hold a null or non-finite component, link with nothing; nor do
    vectors of different lengths. Equal vectors of a shard are indexed once and counted as often as they occur. Rows that
    repeat vec_id, label and vector count as one vector and get the same result; a null vec_id links with nothing.
    audited_recall: of the links that vectors with ids divisible by 100 have, by comparing each with all vectors of its
    label, the share that was found, per label; null for a label where they have none.
    """
    use = settings
    valid = valid_vectors(vectors).withColumn("dim", F.size("embedding"))
    group = ["label", "dim"]
    counts = valid.groupBy(*group).agg(F.count("*").alias("n")).where("n > 1").select(*group, F.ceil(F.col("n") / use.shard).cast("int").alias("shards"))
    dealt = valid.join(counts, group).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))
    kinds = dict(vectors.dtypes)
    label, vec, embedding = kinds["label"], kinds["vec_id"], kinds["embedding"]
    shards = int(counts.agg(F.coalesce(F.sum("shards"), F.lit(0))).first()[0])
    schema = f"kind int, label {label}, dim int, shards int, shard int, vec_id {vec}, rep {vec}, links long, root {vec}, audit_found long, audit_true long, embedding {embedding}, blob binary"
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def index(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id")
        first = part.iloc[0]
        shared = {"label": first["label"], "dim": first["dim"], "shards": first["shards"], "shard": first["shard"]}
        ids = part["vec_id"].to_numpy()
        rows, at, of, weight = np.unique(np.array(part["embedding"].tolist(), np.float64), axis=0, return_index=True, return_inverse=True, return_counts=True)
        graph = Graph(_unit(rows), use.degree, use.build_beam)
        place = np.empty(len(rows), np.int64)
        place[graph.order] = np.arange(len(rows))
        of, unit, weight, reps = place[of.ravel()], _unit(rows[graph.order]), weight[graph.order], ids[at[graph.order]]  # the least id of equal vectors, as rows are sorted
        audited_ids = ids % 100 == 0
        audited = np.zeros(len(rows), bool)
        audited[of[audited_ids]] = True
        found, _ = own_links(unit, graph, weight, use, audited)
        lowest = pd.Series(reps).groupby(found.root).transform("min").to_numpy()
        true = np.zeros(len(rows), np.int64)
        true[audited] = true_links(unit[audited], unit, use.threshold) - 1
        whole = {c: 0 for c in ("vec_id", "rep", "links", "root", "audit_found", "audit_true")} | {"embedding": None, "blob": None}
        some = lambda kind, n, **columns: pd.DataFrame({**shared, **whole, "kind": kind, **columns}, index=range(n))[names]
        audit = {"audit_found": np.where(audited_ids, found.degree[of], 0), "audit_true": np.where(audited_ids, true[of], 0)}
        members = some(MEMBER, len(ids), vec_id=ids, rep=reps[of], links=(found.links + weight - 1)[of], root=lowest[of], **audit)
        if first["shards"] == 1:
            return members
        queries = some(QUERY, len(reps), vec_id=reps, links=weight, embedding=part["embedding"].iloc[at[graph.order]].tolist())
        return pd.concat((members, some(GRAPH, 1, blob=[pickle.dumps((reps, weight, unit, graph), protocol=5)]), queries))

    indexed = as_parquet(dealt.repartition(max(1, min(2 * shards, 100_000)), *group, "shards", "shard").groupBy(*group, "shards", "shard").applyInPandas(index, schema))
    members = indexed.where(F.col("kind") == MEMBER)
    # A graph meets the vectors of all later shards, in blocks of shards.
    queries = indexed.where((F.col("kind") == QUERY) & (F.col("shard") > 0)).withColumn("block", F.floor(F.col("shard") / use.block).cast("int")).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("shard") - 1)))
    blocks = F.sequence(F.floor((F.col("shard") + 1) / use.block).cast("int"), F.floor((F.col("shards") - 1) / use.block).cast("int"))
    graphs = indexed.where((F.col("kind") == GRAPH) & (F.col("shard") < F.col("shards") - 1)).withColumn("block", F.explode(blocks)).withColumn("to", F.col("shard"))
    columns = [*group, "to", "block", "kind", "vec_id", "links", "embedding", "blob"]
    tasks = graphs.count()
    links = members.where("vec_id != root").select("vec_id", "root")
    per_vector = members.select("vec_id", "rep", "links", "audit_found", "audit_true")
    if tasks:
        met = graphs.select(columns).unionByName(queries.select(columns))
        ready = met.repartition(min(2 * tasks, 100_000), *group, "to", "block").sortWithinPartitions(*group, "to", "block", "kind")

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, held = None, None
            for batch in batches:
                key = batch[[*group, "to", "block"]].to_numpy(object)
                starts = np.concatenate(([0], np.nonzero((key[1:] != key[:-1]).any(axis=1))[0] + 1, [len(key)]))
                for lo, hi in zip(starts.tolist(), starts[1:].tolist()):
                    part = batch.iloc[lo:hi]
                    if tuple(key[lo]) != at:
                        at, held = tuple(key[lo]), pickle.loads(part["blob"].iat[0])
                        part = part.iloc[1:]
                    for k in range(0, len(part), 4096):
                        rows = part.iloc[k : k + 4096]
                        reps, weight, stored, graph = held
                        ids = rows["vec_id"].to_numpy().astype(reps.dtype)
                        asked = _unit(np.array(rows["embedding"].tolist(), np.float64))
                        audited = ids % 100 == 0
                        found, _ = cross_links(asked, rows["links"].to_numpy(np.int64), graph, stored, weight, use, audited)
                        audited_stored = reps % 100 == 0
                        true = np.zeros(len(reps) + len(ids), np.int64)
                        true[len(reps) :][audited] = true_links(asked[audited], stored, use.threshold)
                        true[: len(reps)][audited_stored] = true_links(stored[audited_stored], asked, use.threshold)
                        all_ids = np.concatenate((reps, ids))
                        lowest = pd.Series(all_ids).groupby(found.root).transform("min").to_numpy()
                        out = pd.DataFrame({"rep": all_ids, "links": found.links, "root": lowest, "audit_found": np.where(true > 0, found.degree, 0), "audit_true": true})
                        yield out[(out["links"] > 0) | (out["audit_true"] > 0)]

        across = as_parquet(ready.mapInPandas(search, f"rep {vec}, links long, root {vec}, audit_found long, audit_true long"))
        links = links.unionByName(across.where("rep != root").select(F.col("rep").alias("vec_id"), "root"))
        more = across.groupBy("rep").agg(F.sum("links").alias("more"), F.sum("audit_found").alias("more_found"), F.sum("audit_true").alias("more_true"))
        sum_of = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
        per_vector = per_vector.join(more, "rep", "left").select("vec_id", "rep", sum_of("links", "more"), sum_of("audit_found", "more_found"), sum_of("audit_true", "more_true"))
    linked = per_vector.groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    audits = members.select("vec_id", "label").join(per_vector.where("audit_true > 0").select("vec_id", "audit_found", "audit_true"), "vec_id")
    recall = audits.groupBy("label").agg((F.sum("audit_found") / F.sum("audit_true")).alias("audited_recall"))
    components = connected_components(links, "vec_id", "root")
    out = vectors.select("vec_id", "label").join(linked, "vec_id", "left").join(components, vectors["vec_id"] == components["id"], "left").join(recall, "label", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"), "audited_recall")
