"""Chunks, cosine search and incremental sync of an index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Defaults of splitting and retrieval.
CHUNK, LAPPING, TOP, EMBED_BATCH = 1000, 200, 4, 25
#: Queries that a task holds at once.
QUERIES = 1_000
SEPARATORS = ("\n\n", "\n", " ", "")


def fixed_chunks(docs: DataFrame, size: int = CHUNK, lap: int = LAPPING) -> DataFrame:
    """doc_id, chunk (from 0), text: windows of characters that overlap."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text") - lap), F.lit(size - lap))
    return docs.where("text IS NOT NULL").select("doc_id", "text", F.posexplode(starts).alias("chunk", "_at")).select("doc_id", "chunk", F.substring(F.col("text"), F.col("_at"), F.lit(size)).alias("text"))


def split_text(text: str, size: int = CHUNK, lap: int = LAPPING, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Recursive splitting: at the first separator that occurs, parts too long at the next; parts are merged up to size, with overlap."""
    sep = next((s for s in separators if s == "" or s in text), "")
    rest = separators[separators.index(sep) + 1 :] if sep in separators else ()
    parts = list(text) if sep == "" else text.split(sep)
    out: list[str] = []
    held: list[str] = []
    total = 0

    def flush() -> None:
        joined = sep.join(held).strip()
        if joined:
            out.append(joined)

    for part in parts:
        if len(part) > size and rest:
            if held:
                flush()
                held, total = [], 0
            out += split_text(part, size, lap, rest)
            continue
        extra = len(part) + (len(sep) if held else 0)
        if held and total + extra > size:
            flush()
            while held and (total > lap or total + extra > size):
                total -= len(held[0]) + (len(sep) if len(held) > 1 else 0)
                held.pop(0)
            extra = len(part) + (len(sep) if held else 0)
        held.append(part)
        total += extra
    if held:
        flush()
    return out


def recursive_chunks(docs: DataFrame, size: int = CHUNK, lap: int = LAPPING) -> DataFrame:
    """doc_id, chunk, text."""

    @F.pandas_udf("array<string>")
    def parts(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, size, lap) if t else [])

    return docs.select("doc_id", F.posexplode(parts("text")).alias("chunk", "text"))


def checked(vectors: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """The rows; a vector of another dimension fails the query."""
    return vectors.where(F.assert_true(F.size(column) == dim, F.lit(f"a vector has not {dim} dimensions")).isNull())


def cosine(a: Column, b: Column) -> Column:
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(total(a, b), F.sqrt(total(a, a)) * F.sqrt(total(b, b)))


def top_k(vectors: DataFrame, query: list[float], k: int = TOP, threshold: float = 0.0) -> DataFrame:
    """vec_id, score of the k rows nearest to one query; ties by vec_id. Arrow batches and a top k for each partition."""
    q = np.asarray(query, dtype=np.float64)
    q = q / (np.linalg.norm(q) or 1.0)

    @F.pandas_udf("double")
    def score(rows: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(r, dtype=np.float64) for r in rows]) if len(rows) else np.empty((0, len(q)))
        n = np.linalg.norm(x, axis=1)
        return pd.Series(np.where(n > 0, x @ q / np.where(n > 0, n, 1), 0.0))

    return vectors.select("vec_id", score("embedding").alias("score")).where(F.col("score") >= threshold).orderBy(F.desc("score"), "vec_id").limit(k)


def top_k_each(vectors: DataFrame, queries: DataFrame, k: int = TOP, block: int = QUERIES) -> DataFrame:
    """query_id, vec_id, score, rank for a table of queries (query_id, embedding), each against all vectors but itself.

    Queries are taken so many at a time, one pass over the vectors for each block of them; a task keeps the k best of each
    query while it reads, so a partition gives k rows a query, and ranks are found among those.
    """
    spark, out, held = vectors.sparkSession, None, []

    def scored(part: list) -> DataFrame:
        ids = np.array([r[0] for r in part], dtype=np.int64)
        rows = np.stack([np.asarray(r[1], dtype=np.float64) for r in part])
        length = np.linalg.norm(rows, axis=1, keepdims=True)
        rows = rows / np.where(length > 0, length, 1)  # goes with the tasks, so nothing is left to be freed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, who = np.full((len(ids), k), -np.inf), np.full((len(ids), k), -1, dtype=np.int64)
            for b in batches:
                if not b.num_rows:
                    continue
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                size = np.linalg.norm(x, axis=1)
                names = b.column(0).to_numpy()
                scores = rows @ (x / np.where(size > 0, size, 1)[:, None]).T
                scores[(names[None, :] == ids[:, None])] = -np.inf
                scores, all_ = np.concatenate([best, scores], axis=1), np.concatenate([who, np.broadcast_to(names, scores.shape)], axis=1)
                order = np.lexsort((all_, -scores), axis=1)[:, :k]
                best, who = np.take_along_axis(scores, order, 1), np.take_along_axis(all_, order, 1)
            q, place = np.nonzero(best > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(who[q, place]), pa.array(best[q, place])], names=["query_id", "vec_id", "score"])

        return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "query_id long, vec_id long, score double")

    for row in queries.select(F.col("query_id").cast("long"), "embedding").toLocalIterator():
        held.append(row)
        if len(held) == block:
            out, held = scored(held) if out is None else out.unionByName(scored(held)), []
    if held:
        out = scored(held) if out is None else out.unionByName(scored(held))
    if out is None:
        return spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank - 1).where(F.col("rank") < k)


def embedded(docs: DataFrame, model: Callable[[list[str]], list[list[float]]], batch: int = EMBED_BATCH) -> DataFrame:
    """doc_id, embedding: what a model makes of the texts, so many at a call."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                yield pd.DataFrame({"doc_id": part["doc_id"], "embedding": [list(map(float, v)) for v in model(part["text"].fillna("").tolist())]})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, embedding array<float>")


def dimension(model: Callable[[list[str]], list[list[float]]]) -> int:
    """The length of a model's vectors, told by one call."""
    return len(model(["ping"])[0])


def upserted(index: DataFrame, new: DataFrame, key: str = "vec_id") -> DataFrame:
    """The index with new vectors in place of those of the same key."""
    return index.join(new.select(key), key, "left_anti").unionByName(new.select(*index.columns))


def append_vectors(new: DataFrame, path: str) -> None:
    """Adds vectors to a stored index; a reader takes the last of a key by latest()."""
    new.withColumn("stored_at", F.current_timestamp()).write.mode("append").parquet(path)


def changes(stored: DataFrame, current: DataFrame) -> DataFrame:
    """path, action: add, update (newer and another hash) or delete; unchanged paths are left out."""
    s = stored.select("path", F.col("mod_time").alias("_old_time"), F.col("hash").alias("_old_hash"))
    joined = current.select("path", "mod_time", "hash").join(s, "path", "full_outer")
    action = F.when(F.col("_old_hash").isNull(), "add").when(F.col("hash").isNull(), "delete").when((F.col("mod_time") > F.col("_old_time")) & (F.col("hash") != F.col("_old_hash")), "update")
    return joined.select("path", action.alias("action")).where("action IS NOT NULL")


def synced(index: DataFrame, fresh: DataFrame, diff: DataFrame) -> DataFrame:
    """The index rows (path, ...) after a sync: those of deleted and updated paths go, those of added and updated ones come from fresh."""
    gone = diff.where("action IN ('delete', 'update')").select("path")
    come = diff.where("action IN ('add', 'update')").select("path")
    return index.join(gone, "path", "left_anti").unionByName(fresh.join(come, "path", "left_semi"))


def state_after(stored: DataFrame, current: DataFrame, diff: DataFrame) -> DataFrame:
    """The snapshot to store after a sync; a second sync with it finds nothing."""
    return synced(stored, current, diff)


def should_index(status: DataFrame, force: bool = False) -> bool:
    return force or status.where("indexed").isEmpty()


def context(found: DataFrame, texts: DataFrame) -> DataFrame:
    """One row: the texts of a top k, best first, as a prompt's context."""
    rows = found.join(texts, "vec_id").agg(F.sort_array(F.collect_list(F.struct("score", "text")), False).alias("_all"))
    return rows.select(F.array_join(F.transform("_all", lambda x: x["text"]), "\n\n").alias("context"))
