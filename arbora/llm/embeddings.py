"""Embedding near-dedup with a robust-pruned flat graph.

Equal vectors are one class, named by a hash of its components. Classes are dealt to the cells of two levels of cluster
centres, each to its nearest, its home, and to one more that overlaps it; in each cell a graph is built whose adjacency lists are
pruned robustly (a neighbour goes if a kept one is nearer to it by the factor ALPHA), and the lists of a class are united
over its cells. Each class then searches its own cell from its own place in the graph, and those cells that a vector within
the threshold may lie in from the cell's medoid and other entry points: greedily until the nearest are found, then within a
range, over the neighbours of all that is nearly within reach until nothing new is. Links are verified in double precision.

Only the centres are fitted on a sample; every vector is indexed and is a query. A vector of a cell may lie beyond the
plane that parts it from the query's own by the projection of their difference, whose length the threshold bounds; cells
within SIGMAS times the standard deviation that this has for a difference of any direction are searched. An audit compares
AUDIT queries with all rows; where fewer than RECALL of their links are found, the searches reach twice as far, till the
bound that holds for every difference.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field as own

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.llm.common import Scratch, field, mapped
from arbora.llm.graph import connected_components

THRESHOLD = 0.95
#: Classes for each cluster centre; centres of the first level at most.
PER_CENTRE, CENTRES = 2_000, 2_000
#: Vectors that the first level's centres are fitted on, taken by a hash, and those of each cluster of the first level; bytes of each of the samples at most.
SAMPLE, SUB_SAMPLE, SAMPLE_BYTES = 20_000, 8_000, 64 << 20
#: Bytes of all centres of the second level; beyond, cells are larger and cut in blocks.
SUB_BYTES = 64 << 20
#: Cells whose graphs hold a class, classes in a block of a cell, and queries in a task.
OVERLAP, BLOCK, QUERIES = 2, 4_096, 65_536
#: Out-degree, candidates of the pruning, its factor, and random candidates that keep regions connected.
DEGREE, NEAREST, ALPHA, RANDOM = 20, 48, 1.2, 8
#: Width of the greedy search, nodes expanded in a step, entry points of a block and those taken, and how far below the threshold the expansion goes on.
BEAM, STEP, ENTRIES, TAKEN, SLACK = 32, 4, 128, 6, 0.04
#: Reach of the searches in standard deviations; queries and least recall of the audit.
SIGMAS, AUDIT, RECALL = 3.0, 1_000, 0.95
CHUNK = 256

BASE = [field("_same", T.BinaryType()), field("a", T.LongType()), field("vec", T.BinaryType())]


def normalised(vectors: DataFrame, name: str = "vec_id") -> DataFrame:
    """The id, _same (a hash of the components), a (the class's name) and vec (components); null for vectors that link with nothing."""
    kind = vectors.schema["embedding"].dataType.elementType
    wide = np.float32 if isinstance(kind, T.FloatType) else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, same, nodes, vec = batch.column(1), [], [], []
            flat, at = lists.values.to_numpy(zero_copy_only=False).astype(wide) + wide(0), lists.offsets.to_numpy()  # a null is NaN, -0 is 0
            for i, valid in enumerate(lists.is_valid().to_pylist()):
                v = flat[at[i] : at[i + 1]] if valid else flat[:0]
                ok = len(v) > 0 and bool(np.isfinite(v).all()) and bool(v.any())
                key = hashlib.blake2b(v.tobytes(), digest_size=16).digest() if ok else None
                same.append(key)
                nodes.append(int.from_bytes(key[:8], "big", signed=True) if ok else None)
                vec.append(v.tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), pa.array(nodes, pa.int64()), pa.array(vec, pa.binary())], names=[name, *(x.name for x in BASE)])

    rows = vectors.select(name, "embedding")
    return mapped(rows, run, T.StructType([rows.schema[name], *BASE]))


def unit(rows: list[bytes], wide: type) -> np.ndarray:
    """Vectors of one length, as rows of length one in double precision."""
    x = np.frombuffer(b"".join(rows), dtype=wide).reshape(len(rows), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the length
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def centres(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spread rows."""
    found = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = (sample @ found.T).argmax(axis=1)
        order = np.argsort(near, kind="stable")
        groups, first = np.unique(near[order], return_index=True)
        sums = np.add.reduceat(sample[order], first, axis=0)
        found[groups] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return found


@dataclass
class Router:
    """Centres of the first level by vector length, and those of the second by cluster of the first."""

    wide: type
    first: dict[int, np.ndarray]
    base: dict[int, int]
    second: dict[int, np.ndarray] = own(default_factory=dict)

    def shards(self, length: int, x: np.ndarray) -> tuple[np.ndarray, int]:
        """Similarities to the first level's centres, and the number of the first of them; vectors of a length not sampled have one cluster."""
        if length not in self.first:
            return np.zeros((len(x), 1)), -1 - length
        return x @ self.first[length].T, self.base[length]

    @staticmethod
    def margins(sims: np.ndarray, points: np.ndarray, best: np.ndarray) -> np.ndarray:
        """How far each vector lies from the planes that part each centre from the vector's own."""
        gap = np.sqrt(np.maximum(0, (points * points).sum(1)[best][:, None] + (points * points).sum(1)[None, :] - 2 * points[best] @ points.T))
        return (sims[np.arange(len(sims)), best][:, None] - sims) / np.maximum(gap, 1e-9)

    def cells(self, length: int, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row and cell of each cell to be searched, and each row's own cell and one that overlaps it (its own, if there is no other)."""
        sims, base = self.shards(length, x)
        best = sims.argmax(axis=1)
        near = self.margins(sims, self.first[length], best) <= reach if length in self.first else np.ones((len(x), 1), dtype=bool)
        near[np.arange(len(x)), best] = True
        if sims.shape[1] > 1:
            other = sims.copy()
            other[np.arange(len(x)), best] = -2
            runner = other.argmax(axis=1)
            near[np.arange(len(x)), runner] = True
        else:
            runner = best
        home, overlap = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        rows, cells = [], []
        for s in np.flatnonzero(near.any(axis=0)).tolist():
            own = np.flatnonzero(near[:, s])
            points = self.second.get(base + s)
            at = (base + s) << 20
            if points is None:
                rows.append(own)
                cells.append(np.full(len(own), at))
                place = other_place = np.zeros(len(own), np.int64)
            else:
                inner = x[own] @ points.T
                place = inner.argmax(axis=1)
                within = self.margins(inner, points, place) <= reach
                within[np.arange(len(own)), place] = True
                r, c = np.nonzero(within)
                rows.append(own[r])
                cells.append(at + c)
                other_place = np.argsort(-inner, axis=1, kind="stable")[:, min(1, len(points) - 1)]
            mine = best[own] == s
            home[own[mine]] = at + place[mine]
            second = (runner[own] == s) & ~mine
            overlap[own[second]] = at + place[second]
            alone = mine & (runner[own] == s)
            overlap[own[alone]] = at + other_place[alone]
        return np.concatenate(rows), np.concatenate(cells), home, overlap


def pruned(x: np.ndarray, rows: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Robust pruning for many nodes at once: of each row's candidates, nearest first, what is ALPHA times nearer to a kept one than to the node goes.

    Distances are chords. A row of the result is filled up with -1.
    """
    sims = np.einsum("ij,icj->ic", x[rows], x[candidates])
    sims[candidates == rows[:, None]] = -np.inf
    order = np.argsort(-sims, axis=1, kind="stable")
    candidates, sims = np.take_along_axis(candidates, order, 1), np.take_along_axis(sims, order, 1)
    repeated = np.zeros(candidates.shape, dtype=bool)
    repeated[:, 1:] = candidates[:, 1:] == candidates[:, :-1]
    far = np.sqrt(np.maximum(0, 2 - 2 * sims))
    points = x[candidates]
    between = np.sqrt(np.maximum(0, 2 - 2 * np.matmul(points, points.transpose(0, 2, 1))))
    alive = np.isfinite(sims) & ~repeated
    out, n = np.full((len(rows), DEGREE), -1, dtype=np.int64), np.zeros(len(rows), np.int64)
    for i in range(candidates.shape[1]):
        take = np.flatnonzero(alive[:, i] & (n < DEGREE))
        out[take, n[take]] = candidates[take, i]
        n[take] += 1
        alive[take] &= ALPHA * between[take, i] > far[take]
    return out


def graph(x: np.ndarray) -> np.ndarray:
    """Adjacency lists of a block: pruned ones, then the nearest of the reverse edges; filled up with -1."""
    n, random = len(x), np.random.default_rng(7)
    medoid = int((x @ x.sum(axis=0)).argmax())
    out = np.full((n, 2 * DEGREE), -1, dtype=np.int64)
    for a in range(0, n, CHUNK):
        rows = np.arange(a, min(a + CHUNK, n))
        sims = x[rows] @ x.T  # only the order of neighbours depends on it
        near = np.argpartition(-sims, NEAREST, axis=1)[:, : NEAREST + 1] if n > NEAREST + 1 else np.tile(np.arange(n), (len(rows), 1))
        wide = np.concatenate([near, random.integers(0, n, (len(rows), RANDOM)), np.full((len(rows), 1), medoid)], axis=1)
        out[rows, :DEGREE] = pruned(x, rows, np.sort(wide, axis=1))
    v, slot = np.nonzero(out[:, :DEGREE] >= 0)
    u = out[v, slot]
    far = -np.einsum("ij,ij->i", x[u], x[v])
    order = np.lexsort((far, u))
    v, u = v[order], u[order]
    rank = np.arange(len(u)) - np.searchsorted(u, u, "left")
    keep = rank < DEGREE
    out[u[keep], DEGREE + rank[keep]] = v[keep]
    return out


EDGES = T.StructType([field("a", T.LongType()), field("near", T.ArrayType(T.LongType()))])


def evaluated(queries: np.ndarray, x: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Similarities of pairs, a slice at a time."""
    return np.concatenate([np.einsum("ij,ij->i", queries[q[i : i + 32_768]], x[n[i : i + 32_768]]) for i in range(0, len(q), 32_768)] or [np.empty(0, x.dtype)])


@dataclass
class Block:
    """The graph of one block of a cell, searched for many queries at once. home and over: the cells of its classes."""

    cell: int
    ids: np.ndarray
    weight: np.ndarray
    home: np.ndarray
    over: np.ndarray
    exact: np.ndarray
    near: np.ndarray

    def __post_init__(self):
        self.x = self.exact.astype(np.float32)
        self.root = np.arange(len(self.ids))
        self.links = np.zeros(len(self.ids), np.int64)
        # entry points: the medoid, then each the farthest from those before
        entries = [int((self.exact @ self.exact.sum(axis=0)).argmax())]
        nearest = self.x @ self.x[entries[0]]
        while len(entries) < min(ENTRIES, len(self.ids)):
            entries.append(int(nearest.argmin()))
            nearest = np.maximum(nearest, self.x @ self.x[entries[-1]])
        self.entries = np.array(entries)

    def fresh(self, seen: np.ndarray, mark: np.ndarray, q: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The different pairs that weren't seen, now seen."""
        flat = q * seen.shape[1] + n
        flat = flat[(n >= 0) & ~seen.ravel()[np.where(n >= 0, flat, 0)]]
        mark.ravel()[flat] = np.arange(len(flat))
        flat = flat[mark.ravel()[flat] == np.arange(len(flat))]
        seen.ravel()[flat] = True
        return np.divmod(flat, seen.shape[1])

    def search(self, queries: np.ndarray, places: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) that link; places: the queries' own nodes, if they are of this block."""
        x, n, size = queries.astype(np.float32), len(queries), len(self.ids)
        seen, mark = np.zeros((n, size), dtype=bool), np.empty((n, size), dtype=np.int32)
        if places is None:
            first = x @ self.x[self.entries].T
            take = np.argpartition(-first, TAKEN - 1, axis=1)[:, :TAKEN] if first.shape[1] > TAKEN else np.tile(np.arange(first.shape[1]), (n, 1))
            q, node = np.repeat(np.arange(n), take.shape[1]), self.entries[take].ravel()
        else:
            q, node = np.arange(n), places
        q, node = self.fresh(seen, mark, q, node)
        pool_node, pool_sim, done = np.full((n, BEAM), -1), np.full((n, BEAM), -3.0, np.float32), np.zeros((n, BEAM), dtype=bool)
        met_q, met_n = [], []
        active = np.arange(n)
        while True:
            sims = evaluated(x, self.x, q, node)
            close = sims >= THRESHOLD - SLACK
            met_q.append(q[close])
            met_n.append(node[close])
            # each query's best nodes so far
            if len(q):
                order = np.lexsort((-sims, q))
                q, node, sims = q[order], node[order], sims[order]
                rank = np.arange(len(q)) - np.searchsorted(q, q, "left")
                q, node, sims, rank = (v[rank < BEAM] for v in (q, node, sims, rank))
                new_node, new_sim = np.full((n, BEAM), -1), np.full((n, BEAM), -3.0, np.float32)
                new_node[q, rank], new_sim[q, rank] = node, sims
                all_sim = np.concatenate([pool_sim[active], new_sim[active]], axis=1)
                best = np.argsort(-all_sim, axis=1, kind="stable")[:, :BEAM]
                pool_node[active] = np.take_along_axis(np.concatenate([pool_node[active], new_node[active]], axis=1), best, 1)
                done[active] = np.take_along_axis(np.concatenate([done[active], np.zeros((len(active), BEAM), dtype=bool)], axis=1), best, 1)
                pool_sim[active] = np.take_along_axis(all_sim, best, 1)
            open_ = ~done[active] & (pool_node[active] >= 0)
            # a query that met a node within reach goes on in the range expansion
            open_ &= (pool_sim[active, 0] < THRESHOLD - SLACK)[:, None]
            left = open_.any(axis=1)
            active, open_ = active[left], open_[left]
            if not len(active):
                break
            rank = np.cumsum(open_, axis=1)
            r, c = np.nonzero(open_ & (rank <= STEP))
            done[active[r], c] = True
            nodes = self.near[pool_node[active[r], c]]
            q, node = self.fresh(seen, mark, np.repeat(active[r], nodes.shape[1]), nodes.ravel())
        q, node = np.concatenate(met_q), np.concatenate(met_n)
        found_q, found_n = [q], [node]
        while len(q):  # the neighbours of all that is nearly within reach
            next_q, next_n = [], []
            for i in range(0, len(q), 16_384):
                nodes = self.near[node[i : i + 16_384]]
                a, b = self.fresh(seen, mark, np.repeat(q[i : i + 16_384], nodes.shape[1]), nodes.ravel())
                close = evaluated(x, self.x, a, b) >= THRESHOLD - SLACK
                next_q.append(a[close])
                next_n.append(b[close])
            q, node = np.concatenate(next_q), np.concatenate(next_n)
            found_q.append(q)
            found_n.append(node)
        q, node = np.concatenate(found_q), np.concatenate(found_n)
        linked = evaluated(queries, self.exact, q, node) >= THRESHOLD
        return q[linked], node[linked]

    def join(self, q: np.ndarray, node: np.ndarray) -> None:
        """Brings the nodes that one query links under one root."""
        order = np.argsort(q, kind="stable")
        q, node = q[order], node[order]
        first = node[np.searchsorted(q, q, "left")]
        while True:
            a, b = self.root[first], self.root[node]
            apart = a != b
            if not apart.any():
                return
            pairs = np.unique(np.stack([np.maximum(a, b)[apart], np.minimum(a, b)[apart]], axis=1), axis=0)
            np.minimum.at(self.root, pairs[:, 0], pairs[:, 1])
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]

    def asked(self, ids: np.ndarray, weight: np.ndarray, home: np.ndarray, over: np.ndarray, queries: np.ndarray, places: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows (a, root, links) of queries; links that count for the block's classes are held. places: of its own classes.

        A pair of one home counts for each of the two where it is the query. A pair of two homes counts for both, and once:
        where the home of one overlaps the other, of two such cells in the lesser one; else in the cell that was asked.
        """
        out = []
        for i in range(0, len(ids), CHUNK):
            part = slice(i, i + CHUNK)
            own, own_home, own_over = ids[part], home[part], over[part]
            q, node = self.search(queries[part], None if places is None else places[part])
            if places is not None:
                other = node != places[part][q]
                q, node = q[other], node[other]
            if not len(q):
                continue
            inside, settled = own_home[q] == self.cell, self.home[node] == self.cell
            guest = ~((own_over[q] == self.home[node]) & (self.home[node] < self.cell))
            mine = np.where(inside, settled | guest, settled & (self.over[node] != own_home[q]))
            theirs = np.where(inside, ~settled & guest, mine)
            sums = np.bincount(q[mine], self.weight[node[mine]], len(own)).astype(np.int64)
            np.add.at(self.links, node[theirs], weight[part][q[theirs]])
            if places is None:
                self.join(q, node)
                first, at = np.unique(q, return_index=True)
                out.append((own[first], self.ids[node[at]], sums[first]))
            else:
                self.join(np.concatenate([q, np.arange(len(own))]), np.concatenate([node, places[part]]))
                some = np.flatnonzero(sums)
                out.append((own[some], own[some], sums[some]))
        return out

    def own_rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        some = np.flatnonzero((self.links > 0) | (self.root != np.arange(len(self.ids))))
        return self.ids[some], self.ids[self.root[some]], self.links[some]


FOUND = T.StructType([field("a", T.LongType()), field("root", T.LongType()), field("links", T.LongType())])


def searched(units: DataFrame, wide: type) -> DataFrame:
    """(a, root, links) for units of an index block and its queries.

    Rows: cell, block, part, foreign (false: of the block), a, m (vectors of the class), home, over, vec, near (its list), asked
    (a row of the block that is a query of this part). The block's rows come first, so a task holds one block and a batch of
    queries.
    """
    keys = ["cell", "block", "part"]
    dealt = units.repartition(*keys).sortWithinPartitions(*keys, "foreign")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key, block = None, None

        def rows(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                if len(part[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in part], names=FOUND.names)

        def opened() -> tuple[Block, list]:
            table = pa.Table.from_batches(held).combine_chunks()
            ids = table.column("a").to_numpy()
            exact = unit(table.column("vec").to_pylist(), wide)
            order = np.argsort(ids, kind="stable")
            lists = table.column("near").combine_chunks()
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            place = np.minimum(np.searchsorted(ids, flat, sorter=order), len(ids) - 1)
            place = np.where(ids[order[place]] == flat, order[place], -1)
            n = np.diff(at)
            near = np.full((len(ids), int(n.max(initial=1))), -1, dtype=np.int64)
            row = np.repeat(np.arange(len(ids)), n)
            near[row, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)] = place[at[0] : at[-1]]
            near = -np.sort(-near, axis=1)  # nodes of other blocks go
            near = near[:, : max(1, int((near >= 0).sum(axis=1).max(initial=1)))]
            m, home, over = (table.column(x).to_numpy().astype(np.int64) for x in ("m", "home", "over"))
            made = Block(key[0], ids, m, home, over, exact, near)
            q = np.flatnonzero(table.column("asked").to_numpy(zero_copy_only=False))
            return made, made.asked(ids[q], m[q], home[q], over[q], exact[q], q)

        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.stack([batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (*keys, "foreign")], axis=1)
            edges = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]).any(axis=1), [True]]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if key != (now := tuple(codes[a, :3].tolist())):
                    if held:
                        block, parts = opened()
                        yield from rows(parts)
                    if block is not None:
                        yield from rows([block.own_rows()])
                    key, block, held = now, None, []
                part = batch.slice(a, b - a)
                if not codes[a, 3]:
                    held.append(part)
                    continue
                if held:
                    block, parts = opened()
                    held = []
                    yield from rows(parts)
                if block is not None:
                    numbers = [part.column(x).to_numpy().astype(np.int64) for x in ("a", "m", "home", "over")]
                    yield from rows(block.asked(*numbers, unit(part.column("vec").to_pylist(), wide), None))
        if held:
            block, parts = opened()
            yield from rows(parts)
        if block is not None:
            yield from rows([block.own_rows()])

    return mapped(dealt, run, FOUND)


def lengths(column: pa.Array) -> np.ndarray:
    return pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def fitted(classes: DataFrame, wide: type, scratch: Scratch) -> Router:
    """Centres of both levels. The first level's sample is of all classes, the second's of each large cluster of the first."""
    spark = classes.sparkSession
    sizes = classes.groupBy(F.octet_length("vec").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    all_ = sizes.agg(F.sum("n"), F.sum(F.col("n") * F.col("length"))).first()
    n, mean = all_[0] or 0, (all_[1] or 0) / max(1, all_[0] or 0)
    taken = classes.select("vec", F.xxhash64("a").alias("_order"), "a").orderBy("_order", "a").limit(max(1, min(SAMPLE, int(SAMPLE_BYTES / max(1, mean)))))
    by: dict[int, list[bytes]] = {}
    for row in taken.select("vec").collect():
        by.setdefault(len(row[0]), []).append(bytes(row[0]))
    whole, router = sum(map(len, by.values())), Router(wide, {}, {})
    for length, rows in sorted(by.items()):
        share = n * len(rows) / whole
        k = int(max(1, min(CENTRES, share // PER_CENTRE, len(rows))))
        router.base[length] = sum(map(len, router.first.values()))
        router.first[length] = centres(unit(rows, wide), k)
    shared = spark.sparkContext.broadcast(router)
    found = T.StructType([field("shard", T.LongType()), field("length", T.LongType()), field("_hash", T.LongType()), field("vec", T.BinaryType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = lengths(batch.column("vec"))
            for length in np.unique(size).tolist():
                own = np.flatnonzero(size == length)
                part = batch.take(pa.array(own))
                sims, base = shared.value.shards(length, unit(part.column("vec").to_pylist(), wide))
                yield pa.RecordBatch.from_arrays([pa.array(base + sims.argmax(axis=1), pa.int64()), pa.array(np.full(len(own), length)), part.column("_hash"), part.column("vec")], names=found.names)

    def finer(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.column("vec").to_pylist()
        k = min(table.column("k")[0].as_py(), len(rows))
        points = centres(unit(rows, wide), k)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "points": pa.array([points.tobytes()], pa.binary())})

    # clusters of the first level that are too large for one cell
    dealt = mapped(classes.select("vec", F.xxhash64(F.col("a"), F.lit("second")).alias("_hash")), place, found)
    count = scratch.table(dealt.groupBy("shard", "length").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK), "large")
    total = count.agg(F.sum(F.col("n") * F.col("length") * (8 // np.dtype(wide).itemsize))).first()[0] or 0
    if total:
        per = max(PER_CENTRE, -(-total // SUB_BYTES))
        most = F.least(F.lit(SUB_SAMPLE), F.floor(F.lit(SAMPLE_BYTES) / F.col("length")))
        plan = count.select("shard", F.greatest(F.lit(2), F.floor(F.col("n") / per)).cast("int").alias("k"), (most / F.col("n") * F.lit(float(1 << 62))).alias("_till"))
        sample = dealt.join(plan, "shard").where(F.col("_hash").bitwiseAND((1 << 62) - 1) < F.col("_till")).select("shard", "k", "vec")
        made = sample.groupBy("shard").applyInArrow(finer, T.StructType([field("shard", T.LongType()), field("points", T.BinaryType())]))
        lengths_of = {r["shard"]: r["length"] for r in count.select("shard", "length").collect()}  # a row a cluster
        for r in made.collect():  # SUB_BYTES at most
            router.second[r["shard"]] = np.frombuffer(bytes(r["points"]), dtype=np.float64).reshape(-1, lengths_of[r["shard"]] // np.dtype(wide).itemsize)
    shared.unpersist()
    return router


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row.

    Vectors that are null, empty or zero or hold null or non-finite components link with nothing; vectors of different
    lengths do not link. Repeated rows and equal vectors are vectors of their own that link with each other; so are rows
    that share a vec_id. Null vec_ids name no component: one without another vec_id has a null component_id and is kept.
    vec_id may be of any type that has an order. An empty table gives no rows. Other columns are ignored.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "embeddings")
    wide = np.float32 if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else np.float64
    rows = scratch.table(normalised(vectors), "rows")
    classes = rows.where("_same IS NOT NULL").groupBy("_same").agg(F.min("vec_id").alias("_least"), F.count(F.lit(1)).alias("m"), F.first("a").alias("a"), F.first("vec").alias("vec"))
    classes = scratch.table(classes, "classes")
    found = _links(spark, classes.select("a", "m", "vec"), wide, scratch)
    links = found.groupBy("a").agg(F.sum("links").alias("_links"))
    label = connected_components(found.select("a", F.col("root").alias("b")), scratch)
    group = classes.select("_same", "a", "_least", F.col("m").alias("_m")).join(label.withColumnRenamed("node", "a"), "a", "left").withColumn("label", F.coalesce("label", "a"))
    group = scratch.table(group.join(links, "a", "left"), "groups")
    least = group.groupBy("label").agg(F.min("_least").alias("_component"))
    out = rows.select("vec_id", "_same").join(group.join(least, "label").select("_same", "_m", "_links", "_component"), "_same", "left")
    n = F.coalesce(F.coalesce(F.col("_links"), F.lit(0)) + F.col("_m") - 1, F.lit(0)).cast("long")
    component = F.coalesce("_component", "vec_id")
    return out.select("vec_id", n.alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def _links(spark: SparkSession, classes: DataFrame, wide: type, scratch: Scratch) -> DataFrame:
    """(a, root, links) for classes (a, m, vec): sums of links, and pairs of classes that links connect."""
    router = fitted(classes, wide, scratch)
    truth = scratch.table(_truth(classes, wide), "truth")
    shared = spark.sparkContext.broadcast(router)  # CENTRES rows and SUB_BYTES
    widest = (classes.agg(F.max(F.octet_length("vec"))).first()[0] or 0) / np.dtype(wide).itemsize
    sigmas, nodes = SIGMAS, None
    while True:
        routed = T.StructType([*classes.schema.fields, field("home", T.LongType()), field("over", T.LongType()), field("cells", T.ArrayType(T.LongType()))])

        def route(batches: Iterator[pa.RecordBatch], sigmas: float = sigmas) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                size = lengths(batch.column("vec"))
                for length in np.unique(size).tolist():
                    part = batch.take(pa.array(np.flatnonzero(size == length)))
                    for at in range(0, part.num_rows, 2_000):
                        few = part.slice(at, 2_000)
                        bound = np.sqrt(2 - 2 * THRESHOLD)
                        row, cell, home, overlap = shared.value.cells(length, unit(few.column("vec").to_pylist(), wide), bound * min(1.0, sigmas / np.sqrt(length / np.dtype(wide).itemsize)))
                        # of two cells one asks the other; the one that overlaps a row has it as a guest
                        ask = (cell != home[row]) & (cell != overlap[row]) & ((cell < home[row]) ^ (((cell ^ home[row]) & 1) == 1))
                        row, cell = row[ask], cell[ask]
                        order = np.argsort(row, kind="stable")
                        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[order], np.arange(few.num_rows + 1)).astype(np.int32)), pa.array(cell[order], pa.int64()))
                        yield pa.RecordBatch.from_arrays([*few.columns, pa.array(home), pa.array(overlap), lists], names=routed.names)

        placed = scratch.table(mapped(classes, route, routed), "routed")
        if nodes is None:
            nodes = _graph(placed, wide, scratch)
        found = _searches(placed, nodes, wide, scratch)
        got = found.groupBy("a").agg(F.sum("links").alias("got"))
        exact = truth.join(got, "a", "left").agg(F.sum("n"), F.sum(F.least(F.col("n"), F.coalesce("got", F.lit(0))))).first()
        if not exact[0] or (exact[1] or 0) >= RECALL * exact[0]:
            return found
        if sigmas * sigmas >= widest:
            raise RuntimeError(f"the audit found {exact[1]} of {exact[0]} links at the widest search; no incomplete result is given")
        sigmas *= 2


def _truth(classes: DataFrame, wide: type) -> DataFrame:
    """(a, n): for AUDIT classes, taken by a hash, the links with all classes."""
    spark = classes.sparkSession
    taken = classes.select("a", "vec", F.xxhash64(F.col("a"), F.lit("audit")).alias("_order")).orderBy("_order", "a").limit(AUDIT).select("a", "vec").collect()
    by: dict[int, list] = {}
    for r in taken:
        by.setdefault(len(r[1]), []).append((r[0], bytes(r[1])))
    shared = spark.sparkContext.broadcast({k: (np.array([x for x, _ in v]), unit([x for _, x in v], wide)) for k, v in by.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = lengths(batch.column("vec"))
            for length, (ids, queries) in shared.value.items():
                own = np.flatnonzero(size == length)
                for at in range(0, len(own), 2_000):
                    part = batch.take(pa.array(own[at : at + 2_000]))
                    near = (queries @ unit(part.column("vec").to_pylist(), wide).T >= THRESHOLD) & (ids[:, None] != part.column("a").to_numpy()[None, :])
                    sums = near @ part.column("m").to_numpy()
                    some = np.flatnonzero(sums)
                    if len(some):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(sums[some], pa.int64())], names=["a", "n"])

    return mapped(classes.select("a", "m", "vec"), run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))


def _members(placed: DataFrame) -> DataFrame:
    """cell, with the rows of the classes at home there and of its guests, and their block; blocks: how many of BLOCK classes the cell has."""
    both = placed.withColumn("cell", F.col("home")).unionByName(placed.where("over <> home").withColumn("cell", F.col("over")))
    blocks = both.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    return both.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64(F.col("a"), F.lit("block")), F.col("blocks")).cast("int"))


def _graph(placed: DataFrame, wide: type, scratch: Scratch) -> DataFrame:
    """a, near: the lists that the classes have in the graphs of their cells, united."""
    cut = _members(placed.select("a", "vec", "home", "over")).select("cell", "block", "a", "vec")

    def build(table: pa.Table) -> pa.Table:
        ids = table.column("a").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        lists = graph(unit(table.column("vec").take(pa.array(order)).to_pylist(), wide).astype(np.float32))
        row, slot = np.nonzero(lists >= 0)
        near = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(ids) + 1)).astype(np.int32)), pa.array(ids[lists[row, slot]], pa.int64()))
        return pa.table({"a": pa.array(ids), "near": near})

    built = cut.groupBy("cell", "block").applyInArrow(build, EDGES)
    return scratch.table(built.groupBy("a").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "lists")


def _searches(placed: DataFrame, lists: DataFrame, wide: type, scratch: Scratch) -> DataFrame:
    """(a, root, links) from all units of a block and its queries."""
    own = ["a", "m", "home", "over", "vec"]
    members = _members(placed.select(*own))
    away = placed.select(*own, F.explode("cells").alias("cell"))
    asked = away.groupBy("cell").agg(F.count(F.lit(1)).alias("_asked"))
    size = members.groupBy("cell").agg(F.first("blocks").alias("blocks"), F.count_if(F.col("home") == F.col("cell")).alias("_own")).join(asked, "cell", "left")
    # a block's queries: those from other cells, and all that are at home in its cell
    parts = F.greatest(F.lit(1), F.ceil((F.coalesce("_asked", F.lit(0)) + F.col("_own")) / QUERIES)).cast("int")
    size = scratch.table(size.select("cell", "blocks", parts.alias("parts")), "cells")
    part = F.pmod(F.xxhash64(F.col("a"), F.lit("part")), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    none = F.lit(None).cast("array<bigint>")
    index = members.join(size.select("cell", "parts"), "cell").join(lists, "a").select("cell", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *own, "near", part.alias("_own"))
    index = index.select("cell", "block", "part", F.lit(False).alias("foreign"), *own, "near", ((F.col("_own") == F.col("part")) & (F.col("home") == F.col("cell"))).alias("asked"))
    foreign = away.join(size, "cell").select("cell", F.explode(every).alias("block"), part.alias("part"), F.lit(True).alias("foreign"), *own, none.alias("near"), F.lit(True).alias("asked"))
    # the other blocks of a query's own cell
    beside = members.where("blocks > 1 AND home = cell").drop("blocks").join(size, "cell").select("cell", F.col("block").alias("_from"), F.explode(every).alias("block"), part.alias("part"), *own)
    beside = beside.where("block <> _from").select("cell", "block", "part", F.lit(True).alias("foreign"), *own, none.alias("near"), F.lit(True).alias("asked"))
    return scratch.table(searched(index.unionByName(foreign).unionByName(beside), wide), "found")


def audit_recall(vectors: DataFrame, result: DataFrame, every: int = 100, block: int = 2_000) -> float:
    """Links found for the vectors whose vec_id is divisible by `every`, as a share of those that a comparison with all rows finds."""
    spark, rows = vectors.sparkSession, normalised(vectors).where("vec IS NOT NULL")
    wide = np.float32 if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else np.float64
    asked, exact, got = rows.where(F.col("vec_id") % every == 0).select("vec_id", "vec"), 0, {}
    for r in result.where(F.col("vec_id") % every == 0).select("vec_id", "n_links").toLocalIterator():
        got[r[0]] = r[1]
    held: list = []

    def counted(part: list) -> tuple[int, int]:
        by: dict[int, list] = {}
        for i, x in part:
            by.setdefault(len(x), []).append((i, bytes(x)))
        shared = spark.sparkContext.broadcast({k: unit([x for _, x in v], wide) for k, v in by.items()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                size = lengths(batch.column(0))
                for length, queries in shared.value.items():
                    if (size == length).any():
                        x = unit(batch.column(0).filter(pa.array(size == length)).to_pylist(), wide)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(queries), length)), pa.array(np.arange(len(queries))), pa.array((x @ queries.T >= THRESHOLD).sum(axis=0))], names=["length", "q", "n"])

        sums = mapped(rows.select("vec"), run, "length long, q long, n long").groupBy("length", "q").agg(F.sum("n").alias("n")).collect()
        shared.unpersist()
        return sum(r["n"] - 1 for r in sums), sum(min(r["n"] - 1, got[by[r["length"]][r["q"]][0]]) for r in sums)

    hits = 0
    for row in asked.toLocalIterator():
        held.append(row)
        if len(held) == block:
            n, same = counted(held)
            exact, hits, held = exact + n, hits + same, []
    if held:
        n, same = counted(held)
        exact, hits = exact + n, hits + same
    return hits / exact if exact else 1.0


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of all embeddings."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP8_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.r, b.r AS o FROM ok a JOIN ok b ON len(a.e) = len(b.e) AND a.r <> b.r AND list_cosine_similarity(a.e, b.e) >= 0.95),
c AS (SELECT r, r AS m FROM v UNION SELECT p.o, c.m FROM c JOIN p ON p.r = c.r),
g AS (SELECT c.r, min(v.vec_id) AS component_id FROM c JOIN v ON v.r = c.m GROUP BY c.r),
n AS (SELECT r, count(*) AS n_links FROM p GROUP BY r)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, component_id = vec_id AS kept FROM v JOIN g USING (r) LEFT JOIN n USING (r)
"""
