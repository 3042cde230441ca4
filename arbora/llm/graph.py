"""Connected components by contraction, as joins and sums that split a hub's edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import Scratch


#: Rows of a small table that one task writes: many files of few rows cost more than their rows.
ROWS = 200_000


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label: one label for the nodes of each component of edges (a, b); nodes without edges are left out.

    In each round a node points to the neighbour with the least hash, if that is less than its own, so pointers run
    downhill and meet no cycle; pointers are followed a few steps, edges are moved to where they lead, and loops and
    repeats go. Hashes change from round to round, so long chains shrink by a constant factor whatever their ids are.
    A hub's edges meet only in sums with map-side combining and in joins that can be split.
    """
    now = scratch.table(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    while rows := now.count():
        n, few = len(maps), 1 + rows // ROWS
        priority = lambda x: F.struct(F.xxhash64(F.col(x), F.lit(n)).alias("h"), F.col(x).alias("v"))
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min(priority("v")).alias("_least"))
        step = scratch.table(least.select("u", F.least(F.col("_least"), priority("u")).getField("v").alias("label")).coalesce(few), "step")
        jumped = step
        for _ in range(2):
            other = jumped.select(F.col("u").alias("_u"), F.col("label").alias("_label"))
            jumped = scratch.table(jumped.join(other, F.col("label") == F.col("_u")).select("u", F.col("_label").alias("label")).coalesce(few), "jumped")
        left = jumped.select(F.col("u").alias("a"), F.col("label").alias("_a"))
        right = jumped.select(F.col("u").alias("b"), F.col("label").alias("_b"))
        moved = now.join(left, "a").select("_a", "b").join(right, "b").where("_a <> _b")
        after = scratch.table(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct().coalesce(few), "edges")
        scratch.drop(step)
        maps.append(jumped)
        now = after
    if not maps:
        return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    out = maps[0]
    for later in maps[1:]:
        later = later.select(F.col("u").alias("_u"), F.col("label").alias("_label"))
        out = out.join(later, F.col("label") == F.col("_u"), "left").select("u", F.coalesce("_label", "label").alias("label"))
    return out.select(F.col("u").alias("node"), "label")
