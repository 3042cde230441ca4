"""MinHash near-dedup by an LSH forest.

A document's set of word shingles has one signature, read in several orders. In each order the signatures are sorted;
documents that share at least LEAST_DEPTH leading values are candidates. Regions with more than REGION of them are parted
at greater depths, until regions are small enough for all their pairs, and neighbours in the sorted order, which have the
longest common prefixes, stay candidates at any depth. In a large region every document also meets the region's hub, the
one that shares most regions with others: the original, where copies are all nearer to it than to each other. Candidates
are confirmed on the full sets.

Documents with equal sets are one class from the start, named by a hash of the set. Links are confirmed in rounds: first
with the hubs, then, among the classes that are still apart, each with the candidate that has the most candidates, then
all that are left; so a large group of copies needs about one comparison for each copy.

Pairs of a large region that were no candidates are not lost: where classes of one region are still in different
components, the ones outside the region's main component are joined with all others of it by prefixes of their sets, the
rarest shingles first, and what meets is compared on the full sets. That join is exact, so no pair that shares a region goes
untested unless links already connect it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.llm.common import Scratch, field, held, mapped, renamed, text_bytes
from arbora.llm.graph import ROWS, connected_components

#: Percent of the union that the intersection must reach; words in a shingle, by the contract of op10 and elsewhere.
PERCENT, SHINGLE, LONG_SHINGLE = 80, 2, 5
#: Orders of the signature, values that candidates share in one, and further values by which large regions are parted.
ORDERS, LEAST_DEPTH, DEEPER = 32, 6, 10
VALUES = ORDERS * LEAST_DEPTH
#: Regions up to this size have all their pairs as candidates at once; larger ones go on to crowds().
REGION = 4
#: Entries of a region that a task holds; it goes on with the last REGION of them, and the crowd knows all.
PART = 200_000
#: Rounds before the last: with the hubs, then of each class with one candidate.
ROUNDS = 3
#: Slots in which the shingles of crowds are counted, to tell common ones.
SLOTS = 1 << 16
#: Ids that are broadcast to pick the candidates' texts, 16 bytes each; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Words that a Python worker remembers, of at most LONGEST bytes each.
MEMO, LONGEST = 200_000, 64

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RANDOM = np.random.default_rng(20240101)
XOR = _RANDOM.integers(0, 1 << 32, VALUES, dtype=np.uint32)
ODD = _RANDOM.integers(0, 1 << 31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, remembered over the tasks of a worker."""
    import xxhash

    known = held("words", dict)
    try:
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(known) > MEMO:
            known.clear()
    own = xxhash.xxh3_64_intdigest
    for x in set(words):
        if x not in known and len(x) <= LONGEST:
            known[x] = own(x)
    get = known.get
    return np.fromiter((h if (h := get(x)) is not None else own(x) for x in words), np.uint64, len(words))


def shingles(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """The sorted set of a text's shingles as 64-bit hashes: runs of k words, or the whole sequence where there are fewer."""
    words = word_hashes(text.translate(LOWER).split())
    if not len(words):
        return words
    short = len(words) < k
    n = 1 if short else len(words) - k + 1
    out = mix(words[:n] + np.uint64(len(words) if short else 0))
    for j in range(1, min(k, len(words))):
        out = mix(out + words[j : j + n] * np.uint64(0x9E3779B97F4A7C15))
    return np.unique(out)


def digest(found: np.ndarray) -> bytes:
    """A 128-bit hash of a whole set."""
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def node(whole: bytes) -> int:
    """A class's name: the first half of its set's hash."""
    return int.from_bytes(whole[:8], "big", signed=True)


def signature(found: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set."""
    out, short = np.full(VALUES, 0xFFFFFFFF, dtype=np.uint32), (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 512):
        part = (short[at : at + 512, None] ^ XOR[None, :]) * ODD[None, :]
        part ^= part >> np.uint32(15)
        np.minimum(out, part.min(axis=0), out=out)
    return out


SIGNED = [field("n_shingles", T.LongType()), field("_set", T.BinaryType()), field("a", T.LongType()), field("_signature", T.BinaryType())]


def signed(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, _set (a 128-bit hash of the whole set; null for an empty one), a (its class's name) and _signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at, _ = text_bytes(batch.column(1))
            n, sets, nodes, signs = [], [], [], []
            for i in range(batch.num_rows):
                found = shingles(bytes(data[at[i] : at[i + 1]]), k)
                whole = digest(found) if len(found) else None
                n.append(len(found))
                sets.append(whole)
                nodes.append(node(whole) if whole else None)
                signs.append(signature(found).tobytes() if whole else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(nodes, pa.int64()), pa.array(signs, pa.binary())], names=["doc_id", *(x.name for x in SIGNED)])

    rows = docs.select("doc_id", "text")
    return mapped(rows, run, T.StructType([rows.schema["doc_id"], *SIGNED]))


ENTRY = T.StructType([field("key", T.BinaryType()), field("a", T.LongType())])
PREFIX = 9  # bytes of a key: the order, and a hash of the first LEAST_DEPTH values; then two bytes for each further value


def entries(classes: DataFrame) -> DataFrame:
    """For each class (a, _signature) and order, a key that sorts by the order and the signature read in it."""
    places = (np.arange(ORDERS)[:, None] * LEAST_DEPTH + np.arange(LEAST_DEPTH + DEEPER)[None, :]) % VALUES
    powers = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) | 1 for i in range(LEAST_DEPTH)], dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                signs = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint32).reshape(-1, VALUES)
                read = signs[:, places]  # class, order, value
                first = mix((mix(read[:, :, :LEAST_DEPTH].astype(np.uint64)) * powers).sum(axis=2)).astype(">u8")
                keys = np.empty((len(signs), ORDERS, PREFIX + 2 * DEEPER), dtype=np.uint8)
                keys[:, :, 0] = np.arange(ORDERS)[None, :]
                keys[:, :, 1:PREFIX] = first[:, :, None].view(np.uint8).reshape(len(signs), ORDERS, 8)
                keys[:, :, PREFIX:] = np.ascontiguousarray((read[:, :, LEAST_DEPTH:] >> np.uint32(16)).astype(">u2")).view(np.uint8).reshape(len(signs), ORDERS, 2 * DEEPER)
                flat = pa.Array.from_buffers(pa.binary(keys.shape[2]), len(signs) * ORDERS, [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([flat, part.column(0).take(pa.array(np.repeat(np.arange(len(signs)), ORDERS)))], names=["key", "a"])

    return mapped(classes, run, ENTRY)


def region_pairs(keys: list[bytes], nodes: list[int], a: int, b: int, depth: int, out: set[tuple[int, int]]) -> None:
    """Candidates among the sorted entries a to b, which share the values up to depth."""
    if b - a <= REGION or depth == DEEPER:
        span = REGION if b - a > REGION else b - a
        for i in range(a, b):
            for j in range(i + 1, min(i + span, b)):
                out.add((nodes[i], nodes[j]) if nodes[i] < nodes[j] else (nodes[j], nodes[i]))
        return
    till = PREFIX + 2 * (depth + 1)
    start = a
    for i in range(a + 1, b + 1):
        if i == b or keys[i][:till] != keys[start][:till]:
            if i - start > 1:
                region_pairs(keys, nodes, start, i, depth + 1, out)
            if start > a:  # the region's parts hang together by the neighbours at their edges
                out.add((nodes[start - 1], nodes[start]) if nodes[start - 1] < nodes[start] else (nodes[start], nodes[start - 1]))
            start = i


FOUND = T.StructType([field("a", T.LongType()), field("b", T.LongType()), field("region", T.LongType())])


def candidates(classes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pairs a < b of classes, and whether one is the other's hub in some region; and crowds (crowd, a): who meets which hub.

    Entries are dealt by range of the whole key, so a region of very many is cut over tasks; it is cut at another place in
    each order, and its hub is one for all its parts. A task's first and last region count as large ones, as they may go on
    in other tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[bytes] = []
        nodes: list[int] = []
        out: set[tuple[int, int]] = set()
        large: list[tuple[list[int], int]] = []

        first = True

        def close(last: bool = False) -> None:
            if len(keys) > 1:
                region_pairs(keys, nodes, 0, len(keys), 0, out)
            if keys and (len(keys) > REGION or first or last):
                large.append((nodes, int.from_bytes(keys[0][1:PREFIX], "big", signed=True) ^ keys[0][0]))

        def found() -> pa.RecordBatch:
            members = [(x, None, r) for part, r in large for x in part]
            rows = [(x, y, None) for x, y in sorted(out)] + members
            out.clear()
            large.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=FOUND.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.frombuffer(b"".join(batch.column("key").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, PREFIX + 2 * DEEPER)
            ids = batch.column("a").to_numpy()
            same = (raw[1:, :PREFIX] == raw[:-1, :PREFIX]).all(axis=1)
            bounds = np.flatnonzero(np.concatenate([[True], ~same, [True]]))
            # entries alone in their region are passed over, but for those at the batch's edges
            long = np.flatnonzero((np.diff(bounds) > 1) | (bounds[:-1] == 0) | (bounds[1:] == batch.num_rows))
            for s, e in zip(bounds[long].tolist(), bounds[long + 1].tolist(), strict=True):
                if keys and keys[0][:PREFIX] != raw[s, :PREFIX].tobytes():
                    close()
                    keys, nodes, first = [], [], False
                keys += [raw[i].tobytes() for i in range(s, e)]
                nodes += ids[s:e].tolist()
                if len(keys) > PART:  # the rest of a region of very many goes on with the last entries of this part
                    close()
                    keys, nodes = keys[-REGION:], nodes[-REGION:]
            if len(out) > 100_000 or large:
                yield found()
        close(True)
        if out or large:
            yield found()

    dealt = entries(classes).repartitionByRange("key").sortWithinPartitions("key")
    raw = scratch.table(mapped(dealt, run, FOUND), "regions")
    members = raw.where("region IS NOT NULL").select("region", "a").distinct()
    sizes = members.groupBy("region").agg(F.count(F.lit(1)).alias("_size"))
    mass = members.join(sizes, "region").groupBy("a").agg(F.sum("_size").alias("_mass"))
    hub = members.join(mass, "a").groupBy("region").agg(F.max(F.struct("_mass", (-F.col("a")).alias("n"))).alias("_hub"))
    met = scratch.table(members.join(hub.select("region", (-F.col("_hub.n")).alias("b")), "region").where("a <> b").select("a", "b").distinct().coalesce(1 + raw.count() // ROWS), "met")
    pairs = raw.where("region IS NULL AND a <> b").select("a", "b", F.lit(False).alias("hub")).unionByName(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(True).alias("hub")))
    crowds = met.select(F.col("b").alias("crowd"), "a").unionByName(met.select(F.col("b").alias("crowd"), F.col("b").alias("a")).distinct())
    return pairs.groupBy("a", "b").agg(F.max("hub").alias("hub")), crowds


def full_sets(docs: DataFrame, nodes: DataFrame, k: int = SHINGLE) -> DataFrame:
    """a and _full, the sorted set's bytes, of the classes in nodes (a, doc_id: a document that holds the set)."""
    few = nodes.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    hint = F.broadcast if few else lambda x: x
    ids = hint(nodes.select(F.col("doc_id").alias("_doc")).distinct())
    rows = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at, _ = text_bytes(batch.column(0))
            for i in range(0, batch.num_rows, 500):
                found = [shingles(bytes(data[at[x] : at[x + 1]]), k) for x in range(i, min(i + 500, batch.num_rows))]
                found = [x for x in found if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([node(digest(x)) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["a", "_full"])

    # a doc_id may stand for other sets too, and a set may come from several rows
    sets = mapped(rows, run, T.StructType([field("a", T.LongType()), field("_full", T.BinaryType())]))
    return sets.join(hint(nodes.select("a")), "a", "left_semi").dropDuplicates(["a"])


def asked(pairs: DataFrame, end: str, sets: DataFrame) -> DataFrame:
    """The sets that pairs name at one end: what is shuffled for a round is in proportion to its pairs. Those of more ids than are broadcast are all kept."""
    ids = pairs.select(F.col(end).alias("a")).distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return sets.join(F.broadcast(ids), "a", "left_semi") if few else sets


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of pairs (a, b, ...; a written table) whose sets reach the similarity."""
    names = pairs.columns
    left, right = asked(pairs, "a", sets), asked(pairs, "b", sets).select(F.col("a").alias("b"), F.col("_full").alias("_other"))
    schema = pairs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("_full"), batch.column("_other"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                    keep.append(False)
                    continue
                if len(p) > len(q):
                    p, q = q, p
                both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            out = batch.select(names).filter(pa.array(keep))
            if out.num_rows:
                yield out

    return mapped(pairs.join(left, "a").join(right, "b").select(*names, "_full", "_other"), run, schema)


def token_counts(sets: DataFrame) -> np.ndarray:
    """How many sets hold a shingle of each slot, SLOTS in all: common shingles stand out, rare ones share a slot with others as rare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            data, at, _ = text_bytes(batch.column("_full"))
            if batch.num_rows:
                counts += np.bincount((np.frombuffer(data, np.uint64)[at[0] // 8 : at[-1] // 8] % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["slot", "n"])

    out = np.zeros(SLOTS, dtype=np.int64)
    for r in mapped(sets.select("_full"), run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["slot"]] = r["n"]
    return out


#: Words of the sketch that goes with a prefix: bits that tell whether an odd number of a set's shingles fall on them.
SKETCH = ["_s0", "_s1", "_s2", "_s3"]
PREFIX_ROW = T.StructType([*(field(x, T.LongType()) for x in ("a", "n", "shingle", "place")), field("short", T.BooleanType()), *(field(x, T.LongType()) for x in SKETCH)])


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Two sets' sketches differ in as many bits as the sets in shingles, or fewer."""
    return np.packbits(np.bincount((shingles >> np.uint64(40)).astype(np.int64) & 255, minlength=256).astype(np.uint8) & 1).view(np.int64)


def prefixes(sets: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """Of each set of n its n - ceil(n * percent / 100) + 1 rarest shingles; short: among the first n - ceil(2 n percent / (100 + percent)) + 1.

    Two sets that link share a shingle of the larger one's prefix and the smaller one's short prefix, if both are in one order,
    whatever it is: their intersection is percent of the larger one at least, and 2 percent / (100 + percent) of the smaller.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                parts = []
                for a, x in zip(batch.column("a").to_pylist()[at : at + 256], batch.column("_full").slice(at, 256), strict=True):
                    own = np.frombuffer(x.as_buffer(), np.uint64)
                    n = len(own)
                    long, few = n + (-percent * n // 100) + 1, n + (-2 * percent * n // (100 + percent)) + 1
                    rare, place = own[np.lexsort((own, counts[own % np.uint64(SLOTS)]))[:long]], np.arange(long)
                    parts.append([np.full(long, a, dtype=np.int64), np.full(long, n), rare.view(np.int64), place, place < few, *(np.full(long, y) for y in sketch(own))])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=PREFIX_ROW.names)

    return mapped(sets.select("a", "_full"), run, PREFIX_ROW)


def crowded(crowds: DataFrame, label: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame | None:
    """x, y: labels that links within crowds connect, where a crowd's classes have several; None: all have one.

    Each class outside a crowd's main component (a stranger) is joined with the crowd's other classes by prefixes of their
    sets. Of pairs that share a shingle there, those whose sizes, places of the shingle and sketches admit a link are compared
    on the full sets, so texts around one boilerplate are told apart by a few numbers. Keys that many have are split by the join.
    """
    rows = crowds.join(label.withColumnRenamed("node", "a"), "a", "left").select("crowd", "a", F.coalesce("label", "a").alias("label"))
    few = 1 + crowds.count() // ROWS
    rows = scratch.table(rows.coalesce(few), "crowds")
    by = rows.groupBy("crowd", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("crowd").agg(F.max(F.struct("n", "label")).alias("_main"), F.count(F.lit(1)).alias("labels"))
    main = scratch.table(by.where("labels > 1").select("crowd", F.col("_main.label").alias("_main")).coalesce(few), "main")
    if main.isEmpty():
        return None
    open_ = scratch.table(rows.join(main, "crowd").select("crowd", "a", "label", (F.col("label") != F.col("_main")).alias("stranger")).coalesce(few), "open")
    own = sets.join(open_.select("a").distinct(), "a", "left_semi")
    marked = scratch.table(prefixes(own, token_counts(own), percent).join(open_, "a"), "prefixes")
    short = marked.where("short").select("crowd", "shingle", *[F.col(x).alias(f"_{x}") for x in ("a", "n", "label", "stranger", "place", *SKETCH)])
    fits = f"label <> _label AND (n > _n OR n = _n AND a > _a) AND 100 * _n >= {percent} * n"
    # what two sets can share at most: what is left of both from the first shingle they share, and by the bits in which they differ
    fits += f" AND {100 + percent} * least(n - place, _n - _place) >= {percent} * (n + _n) AND {100 + percent} * ({' + '.join(f'bit_count({x} ^ _{x})' for x in SKETCH)}) <= {100 - percent} * (n + _n)"
    pick = lambda longer, shorter: longer.join(shorter, ["crowd", "shingle"]).where(fits).select("a", F.col("_a").alias("b"), F.col("label").alias("x"), F.col("_label").alias("y"))
    # strangers with all, and the others with strangers: never all with all
    pairs = pick(marked.where("stranger"), short).unionByName(pick(marked.where("NOT stranger"), short.where("_stranger")))
    linked = confirmed(scratch.table(pairs.distinct(), "strangers"), sets, percent)
    return scratch.table(linked.select("x", "y").distinct(), "crowd-links")


def labels(docs: DataFrame, classes: DataFrame, scratch: Scratch, percent: int = PERCENT, k: int = SHINGLE, rounds: int = ROUNDS) -> DataFrame:
    """node, label: the components of classes (a, doc_id: of a document that holds the set, _signature); alone ones are left out."""
    pairs, crowds = candidates(classes.select("a", "_signature"), scratch)
    open_ = scratch.table(pairs.select("a", "b", F.col("a").alias("x"), F.col("b").alias("y"), "hub"), "candidates")
    nodes = open_.select("a").union(open_.select(F.col("b").alias("a"))).distinct()
    sets = scratch.table(full_sets(docs, scratch.table(classes.select("a", "doc_id").join(nodes, "a", "left_semi"), "nodes"), k), "sets")
    found: DataFrame | None = None
    for n in range(rounds + 1):
        if not (size := open_.count()):
            break
        few = 1 + size // ROWS  # tasks that write tables of pairs and labels
        if n == 0:
            test = open_.where("hub").select("a", "b", "x", "y")
        elif n < rounds:
            ends = open_.select("a", "b", F.col("x").alias("u"), F.col("y").alias("v")).unionByName(open_.select("a", "b", F.col("y").alias("u"), F.col("x").alias("v")))
            degree = scratch.table(ends.groupBy("v").agg(F.count(F.lit(1)).alias("_degree")).coalesce(few), "degree")  # written, so that a hub's rows can be split in the join
            pick = ends.join(degree, "v").groupBy("u").agg(F.max(F.struct("_degree", -F.col("v"), "a", "b", "v")).alias("_pick"))
            test = pick.select("_pick.a", "_pick.b", F.least("u", "_pick.v").alias("x"), F.greatest("u", "_pick.v").alias("y")).distinct()
            test = scratch.table(test.coalesce(few), "test")
        else:
            test = open_.select("a", "b", "x", "y")
        passed = scratch.table(confirmed(test, sets, percent), "passed")
        found = passed.select("a", "b") if found is None else found.unionByName(passed.select("a", "b"))
        if n == rounds:
            break
        label = scratch.table(connected_components(passed.select(F.col("x").alias("a"), F.col("y").alias("b")), scratch).coalesce(few), "labels")
        left = open_.join(test.select("a", "b"), ["a", "b"], "left_anti")
        for end in ("x", "y"):
            left = left.join(label.select(F.col("node").alias(end), F.col("label").alias("_label")), end, "left").withColumn(end, F.coalesce("_label", end)).drop("_label")
        open_ = scratch.table(left.where("x <> y").select("a", "b", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).coalesce(few), "candidates")
    few = 1 + classes.count() // ROWS
    label = scratch.table(connected_components(found if found is not None else open_.select("a", "b"), scratch).coalesce(few), "labels")
    if (met := crowded(crowds, label, sets, scratch, percent)) is None or met.isEmpty():
        return label
    # the components that crowds connect, and the classes that were alone before
    later = scratch.table(connected_components(met.select(F.col("x").alias("a"), F.col("y").alias("b")), scratch).select(F.col("node").alias("_node"), F.col("label").alias("_label")).coalesce(few), "later")
    moved = label.join(later, label["label"] == later["_node"], "left").select("node", F.coalesce("_label", "label").alias("label"))
    alone = later.join(label, later["_node"] == label["node"], "left_anti").select(F.col("_node").alias("node"), F.col("_label").alias("label"))
    return moved.unionByName(alone)


def near_duplicates(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id of the component), kept for each row.

    Shingles are k words. Null and empty texts have an empty set and link with nothing. Repeated rows and rows with equal
    sets are in one component. doc_id may be of any type that has an order; rows that share one but not a text are
    documents of their own, each in its text's component. Null doc_ids stand for no component: one without another doc_id has a
    null component_id and is kept. Whole texts are read; a task holds a batch of at most 4 MB, or one longer text, and
    its shingles. An empty table gives no rows. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    rows = scratch.table(signed(docs, k), "signed")
    some = rows.where("_set IS NOT NULL")
    classes = scratch.table(some.groupBy("_set").agg(F.min("doc_id").alias("doc_id"), F.first("a").alias("a"), F.first("_signature").alias("_signature")), "classes")
    label = labels(docs, classes.select("a", "doc_id", "_signature"), scratch, percent, k)
    group = classes.select("_set", "a", "doc_id").join(label.withColumnRenamed("node", "a"), "a", "left").select("_set", "doc_id", F.coalesce("label", "a").alias("label"))
    group = scratch.table(group.coalesce(1 + classes.count() // ROWS), "groups")
    least = group.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    by_set = group.join(least, "label").select("_set", "component_id")
    out = rows.select("doc_id", "n_shingles", "_set").join(by_set, "_set", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def dedup(docs: DataFrame, percent: int = PERCENT, k: int = LONG_SHINGLE) -> DataFrame:
    """One row of docs for each component, its smallest doc_id, with the columns of docs.

    Of rows that share that doc_id one stays, with the least text. Rows without words all stay but for such repeats.
    Texts, ids and clashing names are treated as in near_duplicates().
    """
    rows, back = renamed(docs, "doc_id", "text")
    found = near_duplicates(rows, percent, k).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")
    repeated = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select(F.col("doc_id").alias("_again"))
    once = rows.join(repeated, F.col("doc_id").eqNullSafe(F.col("_again")), "left_anti")
    again = rows.join(repeated, F.col("doc_id").eqNullSafe(F.col("_again")), "left_semi")
    least = again.groupBy("doc_id").agg(F.min(F.struct("text", *[x for x in rows.columns if x not in ("doc_id", "text")])).alias("_row"))
    return back(once.unionByName(least.select("doc_id", "_row.*").select(*rows.columns)))


def audit_recall(docs: DataFrame, result: DataFrame, percent: int = PERCENT, k: int = SHINGLE, every: int = 100, block: int = 1 << 22) -> float:
    """Of the links of documents whose doc_id is divisible by `every` with all others, by comparison of full sets, the share within one component."""
    scratch = Scratch(docs.sparkSession, "audit")
    place = result.select("doc_id", "component_id").dropDuplicates(["doc_id"])
    rows = docs.select("doc_id", "text").join(place, "doc_id").where("text IS NOT NULL")
    asked = scratch.table(rows.where(F.col("doc_id") % every == 0).withColumn("_size", F.octet_length("text")), "asked")
    hits = total = 0
    held_: list = []

    def counted(part: list) -> tuple[int, int]:
        shared = docs.sparkSession.sparkContext.broadcast([(i, c, shingles(t.encode(), k)) for i, t, c in part])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sets = [x for x in shared.value if len(x[2])]
            tokens, owners = (np.concatenate([x[2] for x in sets]), np.repeat(np.arange(len(sets)), [len(x[2]) for x in sets])) if sets else (np.empty(0, np.uint64), np.empty(0, np.int64))
            order, sizes = np.argsort(tokens, kind="stable"), np.array([len(x[2]) for x in sets], dtype=np.int64)
            tokens, owners = tokens[order], owners[order]
            for batch in batches:
                all_, same = 0, 0
                for i, t, c in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "text", "component_id")), strict=True):
                    p = shingles(t.encode(), k)
                    first, n = np.searchsorted(tokens, p, "left"), np.searchsorted(tokens, p, "right") - np.searchsorted(tokens, p, "left")
                    both = np.bincount(owners[np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))], minlength=len(sets))
                    for m in np.flatnonzero((both > 0) & (100 * both >= percent * (len(p) + sizes - both))).tolist():
                        if sets[m][0] != i:
                            all_, same = all_ + 1, same + (sets[m][1] == c)
                yield pa.RecordBatch.from_arrays([pa.array([all_]), pa.array([same])], names=["n", "same"])

        row = mapped(rows, run, "n long, same long").agg(F.sum("n"), F.sum("same")).first()
        shared.unpersist()
        return row[0] or 0, row[1] or 0

    size = 0
    for r in asked.select("doc_id", "text", "component_id", "_size").toLocalIterator():
        held_.append((r[0], r[1], r[2]))
        size += r[3]
        if size > block:  # a block of queries at a time
            n, same = counted(held_)
            total, hits, held_, size = total + n, hits + same, [], 0
    if held_:
        n, same = counted(held_)
        total, hits = total + n, hits + same
    return hits / total if total else 1.0


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of all documents with shingles of two words."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM d),
n AS (SELECT doc_id, coalesce(len(g), 0)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= 80 * (x.n + y.n - inter)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS m FROM d UNION SELECT u.b, r.m FROM r JOIN u ON u.a = r.v)
SELECT n.doc_id, n.n AS n_shingles, min(r.m) AS component_id, min(r.m) = n.doc_id AS kept FROM n JOIN r ON r.v = n.doc_id GROUP BY n.doc_id, n.n
"""
