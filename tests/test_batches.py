"""Token batches of large directories, found by many tasks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.operators import packing


def greedy(tokens, limit):
    out, number, used = [], 0, None
    for n in tokens:
        if used is None or used + n > limit:
            number, used = number + 1, n
        else:
            used += n
        out.append(number)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_chains_follow_the_greedy_rule(seed):
    r = random.Random(seed)
    tokens = np.array([r.choice([0, 1, 2, 3, 9, 25]) for _ in range(r.randint(1, 60))])
    sums = np.concatenate([[0], np.cumsum(tokens)])
    begun, left = packing.chains(packing.next_starts(tokens, 10), sums)
    for i in range(len(tokens)):
        batches = greedy(tokens[i:].tolist(), 10)
        assert begun[i] == batches[-1] and left[i] == sum(t for t, b in zip(tokens[i:], batches, strict=True) if b == batches[-1])


@pytest.mark.parametrize(("limit", "most"), [(50, 40), (7, 3), (10_000, 64), (1, 1)])
def test_large_directories_equal_the_greedy_rule(spark, limit, most):
    r = random.Random(limit)
    rows = [(f"/d{d}", f"/d{d}/f{i:05d}", r.choice([1, 2, 3, 30, 70])) for d, n in ((0, 700), (1, 1), (2, 90)) for i in range(n)]
    frame = spark.createDataFrame(rows, "dir string, path string, tokens int").repartition(3)
    got = {x.path: x.batch for x in packing.ranged_batches(frame, limit, most).collect()}
    wanted = {}
    for d in ("/d0", "/d1", "/d2"):
        own = [x for x in rows if x[0] == d]
        wanted |= dict(zip([x[1] for x in own], greedy([x[2] for x in own], limit), strict=True))
    assert got == wanted


def test_a_directory_is_dealt_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(packing, "LARGE", 1_000)
    monkeypatch.setattr(packing.ranged_batches, "__defaults__", (2_000,))
    n = 20_000
    files = spark.range(n).select(F.concat(F.lit("/big/"), F.lpad("id", 8, "0"), F.lit(".go")).alias("path"), F.expr("repeat('x', int(id * 7919 % 400))").alias("text"))
    files = files.unionByName(spark.createDataFrame([("/small/a.go", "y"), ("/small/b.go", "z")], "path string, text string"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else these few rows go to one task
    try:
        rows = packing.token_batches(files, 3_000).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    big = sorted((x.path, x.tokens, x.batch) for x in rows if x.path.startswith("/big"))
    assert len(big) == n and [x[2] for x in big] == greedy([x[1] for x in big], 3_000)
    assert len({x.task for x in rows if x.path.startswith("/big")}) > 1 and [x.batch for x in rows if x.path.startswith("/small")] == [1, 1]


def test_no_files(spark):
    assert packing.ranged_batches(spark.createDataFrame([], "dir string, path string, tokens int"), 10).collect() == []
