"""Benchmark decontamination by winnowed fingerprints.

Of each w consecutive k-gram hashes the least is kept, in items and documents alike, with k + w - 1 = 13 words: any span
of 13 words that both hold has a kept fingerprint in common. Documents' fingerprints are joined with the items' and hits
are extended to whole windows, whose words are compared exactly. Items shorter than 13 words form one window each; for
every such length the same is done with k + w - 1 equal to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.llm.common import field as column
from arbora.llm.common import Scratch, mapped, renamed, small_batches, text_bytes

WINDOW = 13
#: Item words in one broadcast index, about 100 MB; a larger benchmark is taken in several blocks, one pass over the documents for each.
BLOCK_WORDS = 1_000_000
#: Document bytes worked on at once.
CHUNK = 4 << 20

#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z: digits, letters and all bytes of non-ASCII characters.
FOLD = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
POWERS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) | 1 for i in range(64)], dtype=np.uint64)
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k consecutive ids; NONE where one of them is negative, that is an unknown word or a text's end."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    known = np.concatenate([[0], np.cumsum(ids < 0)])
    out, values = np.zeros(n, dtype=np.uint64), mix(ids.astype(np.uint64))
    for j in range(k):
        out += values[j : j + n] * POWERS[j]
    out = mix(out) >> np.uint64(1)
    out[known[k:] > known[:n]] = NONE
    return out


def winnow(ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions and hashes of the fingerprints that cover each window of so many words, and k."""
    k = (length + 1) // 2
    w = length - k + 1
    hashes = grams(ids, k)
    n = len(hashes) - w + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64), k
    least = hashes[:n].copy()
    for j in range(1, w):
        np.minimum(least, hashes[j : j + n], out=least)
    kept = np.zeros(len(hashes), dtype=bool)
    for j in range(w):
        kept[j : j + n] |= hashes[j : j + n] == least
    at = np.flatnonzero(kept & (hashes != NONE))
    return at, hashes[at], k


@dataclass
class Lane:
    """The windows of one length: fingerprints, and each different window's hash, ids and items."""

    length: int
    prints: np.ndarray
    hashes: np.ndarray
    windows: np.ndarray
    owners: list[list[int]]


@dataclass
class Index:
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    lanes: list[Lane] = field(default_factory=list)
    names: list[str] = field(default_factory=list)


def build(items: list[tuple[str, list[bytes]]]) -> Index:
    """An index of items' names and words."""
    index, by_length = Index(), {}
    for name, item in items:
        ids = np.array([index.vocabulary.setdefault(x, len(index.vocabulary)) for x in item], dtype=np.int32)
        by_length.setdefault(min(WINDOW, len(ids)), []).append((len(index.names), ids))
        index.names.append(name)
    for length, group in sorted(by_length.items()):
        prints = np.unique(np.concatenate([winnow(ids, length)[1] for _, ids in group]))
        spans = np.concatenate([np.lib.stride_tricks.sliding_window_view(ids, length) for _, ids in group])
        owner = np.concatenate([np.full(len(ids) - length + 1, i) for i, ids in group])
        windows, inverse = np.unique(spans, axis=0, return_inverse=True)
        owners: list[set[int]] = [set() for _ in windows]
        for i, o in zip(inverse.ravel().tolist(), owner.tolist(), strict=True):
            owners[i].add(o)
        hashes = np.array([grams(x, length)[0] for x in windows], dtype=np.uint64)
        order = np.argsort(hashes, kind="stable")
        index.lanes.append(Lane(length, prints, hashes[order], np.ascontiguousarray(windows[order]), [sorted(owners[i]) for i in order]))
    return index


def occurrences(lane: Lane, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of the lane start in ids, and which: fingerprints in common, extended to whole windows, compared word by word."""
    at, prints, k = winnow(ids, lane.length)
    place = np.minimum(np.searchsorted(lane.prints, prints), len(lane.prints) - 1)
    at = at[lane.prints[place] == prints]
    if not len(at):
        return at, at
    starts = np.unique((at[:, None] - np.arange(lane.length - k + 1)[None, :]).ravel())
    starts = starts[(starts >= 0) & (starts + lane.length <= len(ids))]
    spans = np.lib.stride_tricks.sliding_window_view(ids, lane.length)[starts]
    keep = (spans >= 0).all(axis=1)
    starts, spans = starts[keep], np.ascontiguousarray(spans[keep])
    if not len(starts):
        return starts, starts
    hashes = np.zeros(len(starts), dtype=np.uint64)
    for j in range(lane.length):
        hashes += mix(spans[:, j].astype(np.uint64)) * POWERS[j]
    hashes = mix(hashes) >> np.uint64(1)
    out = np.full(len(starts), -1, dtype=np.int64)
    first, last = np.searchsorted(lane.hashes, hashes, "left"), np.searchsorted(lane.hashes, hashes, "right")
    for step in range(int((last - first).max(initial=0))):  # windows that share a hash
        row = np.minimum(first + step, len(lane.hashes) - 1)
        out = np.where((first + step < last) & (lane.windows[row] == spans).all(axis=1), row, out)
    return starts[out >= 0], out[out >= 0]


def hits(index: Index, texts: list[bytes], hit: list[bytearray | None], found: list[set[str]], counts: list[int]) -> None:
    """Marks hit words and adds the names of items with occurring windows, text by text."""
    get, each = index.vocabulary.get, []
    for i, text in enumerate(texts):
        known = words(text)
        counts[i] = len(known)
        each.append(np.fromiter(map(get, known, repeat(-1)), dtype=np.int32, count=len(known)))
    starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in each])])  # each text ends with -1
    ids = np.full(int(starts[-1]), -1, dtype=np.int32)
    for a, x in zip(starts, each, strict=False):
        ids[a : a + len(x)] = x
    for lane in index.lanes:
        where, which = occurrences(lane, ids)
        owner = np.searchsorted(starts, where, "right") - 1
        for doc, w, s in zip(owner.tolist(), which.tolist(), (where - starts[owner]).tolist(), strict=True):
            if hit[doc] is None:
                hit[doc] = bytearray(counts[doc])
            hit[doc][s : s + lane.length] = b"\1" * lane.length
            found[doc].update(index.names[o] for o in lane.owners[w])


def blocks(benchmark: DataFrame, limit: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items, so many words at a time. Items without words are left out; a null item_id reads as an empty string."""
    rows, n = [], 0
    for name, text in benchmark.selectExpr("cast(item_id as string) item_id", "cast(text as binary) text").toLocalIterator():
        if item := words(bytes(text or b"")):
            if rows and n + len(item) > limit:
                yield rows
                rows, n = [], 0
            rows.append((name or "", item))
            n += len(item)
    if rows:
        yield rows


STATE = [column("_hit", T.BinaryType()), column("_items", T.ArrayType(T.StringType())), column("_words", T.LongType())]


def scan(docs: DataFrame, benchmark: DataFrame, limit: int = BLOCK_WORDS) -> DataFrame:
    """docs with _hit (a byte a word, 1: hit; null: no hit), _items (names of items with occurring windows) and _words.

    One narrow pass for each block of the benchmark: no shuffle, and a text's hits stay with its row. Where there are more
    blocks than one, rows are written after each but the last, and its index is given up, so executors hold one at a time.
    """
    spark, text = docs.sparkSession, docs.schema["text"]
    small_batches(spark)
    scratch = Scratch(spark, "decontamination")
    schema = T.StructType([*docs.schema.fields, *STATE])
    parts = blocks(benchmark, limit)
    out, shared = _pass(spark, docs, next(parts, []), schema, False, text.name)
    before = None
    for items in parts:
        now = scratch.table(out, "hits")
        shared.unpersist()
        scratch.drop(before)
        out, shared = _pass(spark, now, items, schema, True, text.name)
        before = now
    return out


def _pass(spark: SparkSession, rows: DataFrame, items: list[tuple[str, list[bytes]]], schema: T.StructType, again: bool, text: str):
    shared = spark.sparkContext.broadcast(build(items))  # bounded by BLOCK_WORDS
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            data, at, _ = text_bytes(batch.column(text))
            counts = [0] * batch.num_rows
            hit = [bytearray(x) if x is not None else None for x in batch.column("_hit").to_pylist()] if again else [None] * batch.num_rows
            found = [set(x) for x in batch.column("_items").to_pylist()] if again else [set() for _ in range(batch.num_rows)]
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(at, at[a] + CHUNK, "right")) - 1)
                h, f, c = hit[a:b], found[a:b], counts[a:b]
                hits(index, [bytes(data[at[i] : at[i + 1]]) for i in range(a, b)], h, f, c)
                hit[a:b], found[a:b], counts[a:b] = h, f, c
                a = b
            own = [batch.column(x) for x in names[:-3]]
            yield pa.RecordBatch.from_arrays([*own, pa.array([bytes(x) if x is not None else None for x in hit], pa.binary()), pa.array([sorted(x) for x in found], pa.list_(pa.string())), pa.array(counts, pa.int64())], names=names)

    return mapped(rows, run, schema), shared


def decontaminate(docs: DataFrame, benchmark: DataFrame, limit: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs.

    A document is contaminated if n_hit > 0 and 20 * n_hit >= n_words. A null or empty text has no words and no hits; an
    empty benchmark hits nothing; items with one item_id count once; rows that repeat, and rows with a null doc_id, are judged
    each for itself. Texts are read whole, CHUNK bytes or one longer text at a time, with some 4 bytes a word for ids and one for
    hits. An empty table gives no rows. Other columns are ignored.
    """
    schema = T.StructType([docs.schema["doc_id"], column("n_words", T.LongType()), column("n_hit", T.LongType()), column("n_items", T.LongType()), column("items_sha256", T.StringType()), column("contaminated", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("_words").to_numpy(zero_copy_only=False).astype(np.int64)
            hit = np.array([0 if x is None else x.count(1) for x in batch.column("_hit").to_pylist()], dtype=np.int64)
            items = batch.column("_items").to_pylist()
            sums = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(hit), pa.array([len(x) for x in items], pa.int64()), pa.array(sums), pa.array((hit > 0) & (20 * hit >= n))], names=schema.names)

    seen = scan(docs.select("doc_id", "text"), benchmark, limit).select("doc_id", *(x.name for x in STATE))
    return mapped(seen, run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, limit: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs that aren't contaminated, with the columns of docs."""
    own, back = renamed(docs, "text")
    seen = scan(own, benchmark, limit)
    n_hit = F.coalesce(F.length(F.expr("replace(cast(_hit as string), cast(X'00' as string), '')")), F.lit(0))
    return back(seen.where(~((n_hit > 0) & (20 * n_hit >= F.col("_words")))))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """decontaminate() of all documents by all items of the benchmark."""
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce({_WORDS}, []) AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT id, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT r, s, n, id FROM dw JOIN iw USING (n, g)),
c AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS q FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, id FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
