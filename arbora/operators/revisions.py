"""Who wrote each line of a file, from the file's revisions: lines are aligned from one revision to the next and followed back."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Lines of two revisions together up to which plain lists are faster than arrays; lines of a batch of results.
FEW, LINES = 256, 50_000


def rising(places: list[int]) -> list[int]:
    """Indexes of a longest rising run of numbers, by patience sorting."""
    tops, heads, back = [], [], []
    for i, p in enumerate(places):
        at = bisect_left(tops, p)
        tops[at : at + 1], heads[at : at + 1] = [p], [i]
        back.append(heads[at - 1] if at else -1)
    out, i = [], heads[-1] if heads else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def aligned(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For each new line the old line that it is, or -1: a patience diff of line hashes.

    Equal lines at both ends match; between them, lines that occur once on both sides are anchors, of which a longest run
    in order is kept, and the parts between anchors are aligned likewise. A part without an anchor matches at its ends only.
    """
    if len(old) + len(new) <= FEW:
        return np.array(aligned_lists(old.tolist(), new.tolist()), dtype=np.int64)
    out, parts = np.full(len(new), -1, dtype=np.int64), [(0, len(old), 0, len(new))]
    while parts:
        a, b, c, d = parts.pop()
        n = min(b - a, d - c)
        if not n:
            continue
        differ = np.flatnonzero(old[a : a + n] != new[c : c + n])
        head = int(differ[0]) if len(differ) else n
        out[c : c + head] = np.arange(a, a + head)
        a, c, n = a + head, c + head, n - head
        if not n:
            continue
        differ = np.flatnonzero(old[b - n : b][::-1] != new[d - n : d][::-1])
        tail = int(differ[0]) if len(differ) else n
        out[d - tail : d] = np.arange(b - tail, b)
        b, d = b - tail, d - tail
        once = []
        for x, start, end in ((old, a, b), (new, c, d)):
            values, first, counts = np.unique(x[start:end], return_index=True, return_counts=True)
            once.append((values[counts == 1], first[counts == 1] + start))
        _, i, j = np.intersect1d(once[0][0], once[1][0], assume_unique=True, return_indices=True)
        if not len(i):
            continue
        was, now = once[0][1][i], once[1][1][j]
        order = np.argsort(now)
        was, now = was[order], now[order]
        kept = rising(was.tolist())
        was, now = was[kept], now[kept]
        out[now] = was
        for p, q, r, s in zip([a, *(was + 1)], [*was, b], [c, *(now + 1)], [*now, d], strict=True):
            parts.append((int(p), int(q), int(r), int(s)))
    return out


def aligned_lists(old: list[int], new: list[int]) -> list[int]:
    """aligned() for short revisions, where calls on arrays take longer than the lines do."""
    out, parts = [-1] * len(new), [(0, len(old), 0, len(new))]
    while parts:
        a, b, c, d = parts.pop()
        while a < b and c < d and old[a] == new[c]:
            out[c] = a
            a, c = a + 1, c + 1
        while a < b and c < d and old[b - 1] == new[d - 1]:
            b, d = b - 1, d - 1
            out[d] = b
        if a == b or c == d:
            continue
        was, now = {}, {}
        for i in range(a, b):
            was[old[i]] = -1 if old[i] in was else i
        for j in range(c, d):
            now[new[j]] = -1 if new[j] in now else j
        anchors = [(was[x], j) for x, j in now.items() if j >= 0 and was.get(x, -1) >= 0]  # in the order of j: a line that is there once is there where it was put in
        if not anchors:
            continue
        for i in rising([i for i, _ in anchors]):
            p, q = anchors[i]
            out[q] = p
            parts.append((a, p, c, q))
            a, c = p + 1, q + 1
        parts.append((a, b, c, d))
    return out


def blamed(revisions: DataFrame) -> DataFrame:
    """path, line (from 1), rev, author, email, when, text: the lines of each path's last revision, and the revision that each comes from.

    revisions: path, rev, author, email, when, text, where rev orders the revisions of a path. A line comes from the first revision
    since which it was carried over by aligned(); lines are told apart by a 64-bit hash. Revisions are aligned in any tasks, each with
    the one before; then a path's alignments, a number for each line, are followed in order by one task, which holds one
    revision's lines at a time. A null text is a file without lines (deleted), a last line end starts no line; of repeated
    (path, rev) the row with the greatest text counts; rows with a null path or rev are left out.
    """
    kept = revisions.where("path IS NOT NULL AND rev IS NOT NULL").groupBy("path", "rev").agg(F.max(F.struct(F.coalesce("text", F.lit("")).alias("text"), "author", "email", "when")).alias("_r")).select("path", "rev", "_r.*")
    places = revisions.select("path", "rev").where("path IS NOT NULL AND rev IS NOT NULL").distinct().select("path", "rev", F.row_number().over(Window.partitionBy("path").orderBy("rev")).alias("n"), F.lead("rev").over(Window.partitionBy("path").orderBy("rev")).isNull().alias("last"))
    lines = F.when(F.col("text") == "", F.expr("cast(array() AS array<string>)")).otherwise(F.split(F.regexp_replace("text", "\n\\z", ""), "\n"))
    hashed = kept.join(places, ["path", "rev"]).select("path", "n", "rev", "last", F.transform(lines, lambda x: F.xxhash64(x)).alias("own"))
    before = hashed.select("path", (F.col("n") + 1).alias("n"), F.col("own").alias("old"))
    both = hashed.join(before, ["path", "n"], "left")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbers = lambda x: np.array(x.as_py() or [], dtype=np.int64)
            found = [aligned(numbers(o), numbers(w)).tolist() for o, w in zip(b.column("old"), b.column("own"), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("path", "n", "rev", "last")), pa.array(found, pa.list_(pa.int64()))], names=["path", "n", "rev", "last", "match"])

    kind = revisions.schema["rev"].dataType.simpleString()
    matched = both.select("path", "n", "rev", "last", "own", "old").mapInArrow(align, f"path string, n int, rev {kind}, last boolean, match array<bigint>")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, since, done, rows = None, np.empty(0, np.int64), [], 0

        def found() -> pa.RecordBatch:
            sizes = [len(x) for _, x in done]
            lines_ = np.concatenate([np.arange(1, n + 1) for n in sizes])
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in done]).take(pa.array(np.repeat(np.arange(len(done)), sizes))), pa.array(lines_), pa.array(np.concatenate([x for _, x in done]))], names=["path", "line", "n"])

        for b in batches:
            for path, n, last, match in zip(b.column("path").to_pylist(), b.column("n").to_pylist(), b.column("last").to_pylist(), b.column("match"), strict=True):
                if path != now:
                    now, since = path, np.empty(0, np.int64)
                m = match.values.to_numpy()
                since = np.where(m >= 0, since[np.maximum(m, 0)] if len(since) else n, n)
                if last and len(since):
                    done.append((path, since))
                    rows += len(since)
                    if rows >= LINES:
                        yield found()
                        done, rows = [], 0
        if done:
            yield found()

    followed = matched.select("path", "n", "last", "match").repartition("path").sortWithinPartitions("path", "n").mapInArrow(follow, "path string, line long, n long")
    texts = kept.join(places.where("last").select("path", "rev"), ["path", "rev"]).select("path", F.posexplode(lines).alias("line", "text")).select("path", (F.col("line") + 1).cast("long").alias("line"), "text")
    who = kept.join(places, ["path", "rev"]).select("path", F.col("n").cast("long").alias("n"), "rev", "author", "email", "when")
    return followed.join(who, ["path", "n"]).join(texts, ["path", "line"]).select("path", "line", "rev", "author", "email", "when", "text")
