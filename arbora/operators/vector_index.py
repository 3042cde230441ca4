"""An inverted file of vectors: cells around centres, stored cell by cell, and an exact top k that reads few of them.

Angles between directions obey the triangle inequality. Of a vector at angle r from its cell's centre, and a query at angle a
from that centre, the angle between both is |a - r| at least. So a cell whose angles lie between least and most holds nothing
nearer to the query than max(a - most, least - a), and once k vectors are known, cells beyond the k-th of them are not read;
of a cell that is, only the ring of angles that may hold something nearer.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.operators.retrieval import QUERIES, TOP
from arbora.sources import shared

#: Vectors that centres are fitted on, most centres, and rounds of the fit.
SAMPLE, CENTRES, ROUNDS = 20_000, 4_096, 8
#: Cells whose rings become conditions on row groups; of more, whole cells are read.
RINGS = 64
#: What rounding may add to an angle, and decimals of a score: copies score alike whatever they are multiplied beside.
SLACK, DECIMALS = 1e-5, 12

Conditions = list[tuple[int, float, float]]


def directions(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(length > 0, length, 1)


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between each two directions, from the half chord, which keeps small angles exact."""
    near = np.clip(a @ b.T, -1, 1)
    return 2 * np.arcsin(np.sqrt(np.clip((1 - near) / 2, 0, 1)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(rows) != dim * len(column):
        raise ValueError(f"a vector has not {dim} dimensions")
    return rows.reshape(len(column), dim)


def fitted(sample: np.ndarray, centres: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Directions around which the sample gathers."""
    r = np.random.default_rng(seed)
    out = sample[r.choice(len(sample), min(centres, len(sample)), replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(sample[i : i + 2_000] @ out.T).argmax(1) for i in range(0, len(sample), 2_000)])
        sums = np.zeros_like(out)
        np.add.at(sums, own, sample)
        some = np.linalg.norm(sums, axis=1) > 1e-9
        out = np.where(some[:, None], directions(sums), out)
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of vectors that have a direction: not null, of finite numbers, not all zero."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & sound)


def build(vectors: DataFrame, path: str, centres: int | None = None, seed: int = 0) -> VectorIndex:
    """Stores vectors (vec_id, embedding) under path and opens them as an index.

    Centres are fitted on SAMPLE vectors at most, drawn by a hash of vec_id, some square root of the rows in number (CENTRES at
    most); each vector goes to the nearest, and only which cells are read depends on them. Rows are dealt by range of cell and
    angle, so a cell that holds a third of the rows is written by many tasks, each file a ring of it. The table of centres is
    written last: without it there is no index. Vectors without a direction (null, zero, not finite) and null vec_ids are left out,
    other columns are ignored; vectors of different lengths fail.
    """
    spark, rows = vectors.sparkSession, usable(vectors)
    n, dim = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    dim = dim or 0
    share = min(1.0, 2 * SAMPLE / n) if n else 1.0
    drawn = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    sample = [r[0] for r in drawn.select("embedding").limit(SAMPLE).collect()]
    if any(len(x) != dim for x in sample):
        raise ValueError(f"a vector has not {dim} dimensions")
    count = centres or max(1, round(n**0.5))
    middle = fitted(directions(np.array(sample, dtype=np.float64).reshape(len(sample), dim)), min(count, CENTRES), seed=seed) if sample else np.empty((0, dim))
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = directions(_matrix(b.column("embedding"), dim))
                cell = np.concatenate([(x[i : i + 4_000] @ middle.T).argmax(1) for i in range(0, len(x), 4_000)])
                chord = np.linalg.norm(x - middle[cell], axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(2 * np.arcsin(np.clip(chord / 2, 0, 1)))], names=schema.names)

    dealt = rows.mapInArrow(run, schema).repartitionByRange("cell", "angle").sortWithinPartitions("cell", "angle")
    dealt.write.partitionBy("cell").option("parquet.block.size", 8 << 20).parquet(f"{path}/cells")
    own = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(middle)], "cell int, centre array<double>")
    sums = spark.read.schema(schema).parquet(f"{path}/cells").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("least"), F.max("angle").alias("most"))
    own.join(sums, "cell").coalesce(1).write.parquet(f"{path}/centres")
    return VectorIndex(spark, path)


class VectorIndex:
    """A stored index; the driver holds its centres, CENTRES at most."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
        self.cells, self.n = np.array([r.cell for r in rows], dtype=np.int64), np.array([r.n for r in rows], dtype=np.int64)
        self.centres = np.array([r.centre for r in rows], dtype=np.float64).reshape(len(rows), len(rows[0].centre) if rows else 0)
        self.least, self.most = np.array([r.least for r in rows]), np.array([r.most for r in rows])
        #: Of each pass of the last search: queries, cells read.
        self.passes: list[tuple[int, int]] = []

    def rows(self, rings: Conditions) -> DataFrame:
        """The vectors of some cells, between two angles of each; folders of other cells are never opened."""
        schema = "vec_id long, embedding array<double>, angle double, cell int"
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/cells").where(F.col("cell").isin([c for c, _, _ in rings]))
        if len(rings) > RINGS:
            return rows
        inside = [(F.col("cell") == c) & F.col("angle").between(low, high) for c, low, high in rings]
        return rows.where(reduce(lambda a, b: a | b, inside, F.lit(False)))

    def _scored(self, ids: np.ndarray, asked: np.ndarray, wanted: np.ndarray, rings: Conditions, k: int, itself: bool) -> DataFrame:
        """query_id, vec_id, score: of each partition the k best of each query among the cells wanted for it."""
        place, dim = {int(c): i for i, c in enumerate(self.cells)}, self.centres.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, who = np.full((len(ids), k), -np.inf), np.full((len(ids), k), -1, dtype=np.int64)
            for b in batches:
                if not b.num_rows:
                    continue
                cells, names, x = b.column("cell").to_numpy(), b.column("vec_id").to_numpy(), directions(_matrix(b.column("embedding"), dim))
                for cell in np.unique(cells):
                    q, own = np.flatnonzero(wanted[:, place[int(cell)]]), cells == cell
                    if not len(q):
                        continue
                    scores, found = np.round(asked[q] @ x[own].T, DECIMALS), names[own]
                    if not itself:
                        scores[found[None, :] == ids[q][:, None]] = -np.inf
                    scores, found = np.concatenate([best[q], scores], axis=1), np.concatenate([who[q], np.broadcast_to(found, scores.shape)], axis=1)
                    order = np.lexsort((found, -scores), axis=1)[:, :k]
                    best[q], who[q] = np.take_along_axis(scores, order, 1), np.take_along_axis(found, order, 1)
            q, at = np.nonzero(best > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(who[q, at]), pa.array(best[q, at])], names=["query_id", "vec_id", "score"])

        self.passes.append((len(ids), len(rings)))
        return self.rows(rings).select("vec_id", "embedding", "cell").mapInArrow(run, "query_id long, vec_id long, score double")

    def _block(self, ids: np.ndarray, asked: np.ndarray, k: int, itself: bool, found: str) -> None:
        """Two passes for some queries: cells of the nearest centres that hold k vectors, then those that may hold nearer ones than the k-th found."""
        away = angles(asked, self.centres)
        order = np.argsort(away, axis=1)
        held = np.cumsum(self.n[order], axis=1) - self.n[order]
        first = np.zeros(away.shape, dtype=bool)
        np.put_along_axis(first, order, held < k + (not itself), axis=1)
        every = [(int(c), 0.0, 4.0) for c in self.cells[first.any(axis=0)]]
        self._scored(ids, asked, first, every, k, itself).write.mode("append").parquet(found)
        known = self.spark.read.parquet(found).where(F.col("query_id").isin(ids.tolist()))
        ranked = known.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("_r") == k)
        kth = {r.query_id: r.score for r in ranked.select("query_id", "score").collect()}
        reach = np.array([np.arccos(np.clip(kth[i], -1, 1)) + SLACK if i in kth else np.pi for i in ids.tolist()])[:, None]
        wanted = ~first & (np.maximum(away - self.most, self.least - away) <= reach)
        rings = [(int(self.cells[j]), float((away[q, j] - reach[q, 0]).min()), float((away[q, j] + reach[q, 0]).max())) for j in np.flatnonzero(wanted.any(axis=0)) for q in [np.flatnonzero(wanted[:, j])]]
        if rings:
            self._scored(ids, asked, wanted, rings, k, itself).write.mode("append").parquet(found)

    def search(self, queries: DataFrame, k: int = TOP, itself: bool = False, block: int = QUERIES) -> DataFrame:
        """query_id, vec_id, score, rank (from 0) of the k vectors nearest to each query (query_id, embedding), as a full scan gives them.

        itself: whether a vector whose vec_id is the query_id counts. Equal scores are ordered by vec_id. Queries are taken a
        block at a time; the driver holds a block and, of each, the angles to the centres. Queries without a direction and
        null query_ids give no rows; of repeated query_ids one counts. What is found lies in the shared folder.
        """
        self.passes = []
        found, held = f"{shared.fresh(self.spark, 'top')}/found", []
        rows = usable(queries.select(F.col("query_id").alias("vec_id"), "embedding")).dropDuplicates(["vec_id"])

        def take(part: list) -> None:
            asked = np.array([r[1] for r in part], dtype=np.float64)
            if asked.shape[1] != self.centres.shape[1]:
                raise ValueError(f"a query has not {self.centres.shape[1]} dimensions")
            self._block(np.array([r[0] for r in part], dtype=np.int64), directions(asked), k, itself, found)

        for row in rows.toLocalIterator() if len(self.cells) and k > 0 else []:
            held.append(row)
            if len(held) == block:
                take(held)
                held = []
        if held:
            take(held)
        if not self.passes:
            return self.spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return self.spark.read.parquet(found).withColumn("rank", rank - 1).where(F.col("rank") < k)
