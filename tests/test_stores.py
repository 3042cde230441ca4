"""Vector index and versioned store: results of a full scan, pruned folders, commits that fail."""

import glob
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.operators import hierarchy, vector_index
from arbora.operators.vector_store import Conflict, VectorStore
from arbora.sources import shared
from arbora.streaming import changes


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], "x") for i, v in rows], "vec_id long, embedding array<double>, cell string")


def gathered(seed, n=2_000, groups=25, dim=12, spread=0.05):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(groups, dim))
    return list(enumerate(middle[r.integers(0, groups, n)] + spread * r.normal(size=(n, dim))))


def ranked(df):
    return sorted((x.query_id, x["rank"], x.vec_id, round(x.score, 9)) for x in df.collect())


@pytest.mark.parametrize(("spread", "centres"), [(0.05, None), (1.0, 7), (0.0, 4)])
def test_index_gives_what_a_full_scan_gives(spark, tmp_path, spread, centres):
    rows = vectors(spark, gathered(1, 1_500, spread=spread))
    index = vector_index.build(rows, str(tmp_path / "index"), centres)
    asked = rows.where("vec_id % 60 = 7").select(F.col("vec_id").alias("query_id"), "embedding")
    x = np.array([r.embedding for r in rows.orderBy("vec_id").collect()])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    wanted = []
    for q in range(7, 1_500, 60):
        scores = np.round(x @ x[q], 9)
        scores[q] = -2
        wanted += [(q, place, int(i), float(scores[i])) for place, i in enumerate(np.lexsort((np.arange(1_500), -scores))[:5])]
    assert ranked(index.search(asked, 5, block=10)) == wanted


def test_cells_and_rings_are_skipped_on_disk(spark, tmp_path):
    rows = vectors(spark, gathered(2, 4_000))
    index = vector_index.build(rows, str(tmp_path / "index"), 40)
    one = rows.where("vec_id = 3").select(F.col("vec_id").alias("query_id"), "embedding")
    index.search(one, 4).collect()
    assert sum(cells for _, cells in index.passes) <= 6 and len(index.cells) > 15
    read = index.rows([(int(index.cells[0]), 0.0, 0.01)])
    plan = read._jdf.queryExecution().executedPlan()
    rows_read = plan.execute().count()
    metrics = plan.collectLeaves().head().metrics()
    assert metrics.apply("numFiles").value() == len(glob.glob(f"{tmp_path}/index/cells/cell={index.cells[0]}/*.parquet")) < len(glob.glob(f"{tmp_path}/index/cells/*/*.parquet")) / 10
    assert rows_read < index.n[0] and "GreaterThanOrEqual(angle,0.0), LessThanOrEqual(angle,0.01)" in plan.toString()


def test_index_of_odd_vectors(spark, tmp_path):
    rows = vectors(spark, [(1, [1, 0]), (2, [0, 0]), (3, None), (None, [1, 1]), (4, [2, 0]), (5, [float("nan"), 1]), (6, [-1, 0]), (7, [0, 3])])
    index = vector_index.build(rows, str(tmp_path / "index"))
    asked = rows.select(F.col("vec_id").alias("query_id"), "embedding")
    got = ranked(index.search(asked, 10))
    assert [(q, v) for q, _, v, _ in got] == [(1, 4), (1, 7), (1, 6), (4, 1), (4, 7), (4, 6), (6, 7), (6, 1), (6, 4), (7, 1), (7, 4), (7, 6)]
    assert ranked(index.search(asked.where("query_id = 1"), 2, itself=True)) == [(1, 0, 1, 1.0), (1, 1, 4, 1.0)]
    assert index.search(asked.limit(0)).collect() == []
    with pytest.raises(ValueError):
        index.search(vectors(spark, [(9, [1, 2, 3])]).withColumnRenamed("vec_id", "query_id"))
    empty = vector_index.build(rows.limit(0), str(tmp_path / "empty"))
    assert empty.search(asked).collect() == []


def state(store, version=None):
    return {r.vec_id: tuple(r.embedding) for r in store.read(version).collect()}


def rows_of(spark, d):
    return spark.createDataFrame([(k, list(map(float, v))) for k, v in d.items()], "vec_id long, embedding array<float>")


def test_store_equals_a_dictionary_after_any_commits(spark, tmp_path):
    store, wanted, history, r = VectorStore(spark, str(tmp_path / "s")), {}, {}, random.Random(5)
    for step in range(9):
        up = {r.randrange(30): (step, r.random() > 0.5) for _ in range(8)}
        gone = {r.randrange(30) for _ in range(6)}
        if step % 4 == 3:
            version = store.compact()
        elif step % 3 == 2:
            version = store.delete(spark.createDataFrame([(x,) for x in gone], "vec_id int"))
            wanted = {k: v for k, v in wanted.items() if k not in gone}
        else:
            version = store.commit(rows_of(spark, up), spark.createDataFrame([(x,) for x in gone], "vec_id long"))
            wanted = {k: v for k, v in wanted.items() if k not in gone} | {k: tuple(map(float, v)) for k, v in up.items()}
        assert state(store) == wanted
        history[version] = wanted
    for version, there in history.items():
        assert state(store, version) == there
    removed = store.vacuum(keep=max(history))
    assert removed and state(store) == wanted
    with pytest.raises(ValueError):
        store.read(1)


def test_failed_and_late_writes_are_never_seen(spark, tmp_path, monkeypatch):
    store = VectorStore(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError):
        store.delete(spark.createDataFrame([(1,)], "vec_id long"))
    store.upsert(rows_of(spark, {1: (1, 1), 2: (2, 2)}))
    broken = rows_of(spark, {1: (9, 9)}).withColumn("embedding", F.raise_error(F.lit("lost")).cast("array<float>"))
    with pytest.raises(Exception, match="lost"):
        store.upsert(broken)
    with pytest.raises(Exception, match="null"):
        store.upsert(spark.createDataFrame([(None, [1.0])], "vec_id long, embedding array<float>"))
    assert state(store) == {1: (1, 1), 2: (2, 2)} and store.versions() == [1]
    late = VectorStore(spark, store.path)
    before = late._markers(None)
    store.delete(spark.createDataFrame([(2,)], "vec_id long"))
    monkeypatch.setattr(late, "_markers", lambda v: before)
    with pytest.raises(Conflict):
        late.upsert(rows_of(spark, {3: (3, 3)}))
    assert state(store) == {1: (1, 1)} and store.vacuum(keep=2, hours=-1) != []
    assert state(store) == {1: (1, 1)}


def test_repeated_keys_and_an_emptied_store(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "s"))
    store.upsert(rows_of(spark, {1: (1, 1)}).unionByName(rows_of(spark, {1: (1, 2)})))
    assert state(store) == {1: (1, 2)}
    store.delete(store.read().select("vec_id"))
    assert state(store) == {}
    store.compact()
    assert state(store) == {}
    store.upsert(rows_of(spark, {}))
    assert state(store) == {}


def test_shared_files(spark, tmp_path):
    path = str(tmp_path / "a" / "b")
    assert shared.created(spark, path, "é1") and not shared.created(spark, path, "2") and shared.text_of(spark, path) == "é1"
    assert [x for x, _ in shared.children(spark, str(tmp_path / "a")) if not x.startswith(".")] == ["b"] and shared.children(spark, str(tmp_path / "none")) == []


def test_places_in_a_global_order(spark):
    rows = spark.createDataFrame([(i * 7919 % 1009, "p") for i in range(1009)], "x long, _at string").repartition(5)
    assert {r.x: r.place for r in hierarchy.numbered(rows, F.col("x")).collect()} == {i: i + 1 for i in range(1009)}
    assert hierarchy.numbered(rows.limit(0), F.col("x")).collect() == []
    plan = hierarchy.numbered(rows, F.col("x"))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]


def test_the_last_burst_of_a_stream_comes_out_by_itself(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "path string, ts timestamp, op string"
    at = lambda ms: F.timestamp_millis(F.lit(1_700_000_000_000 + ms))
    put = lambda rows: spark.createDataFrame(rows, "path string, ms long, op string").select("path", at(0).alias("ts") + F.make_dt_interval(secs=F.col("ms") / 1000), "op").toDF("path", "ts", "op").coalesce(1).write.mode("append").parquet(source)
    put([("/a", 0, "create"), ("/a", 100, "write"), ("/a", 5_000, "write"), ("/b", 40, "create"), (None, 1, "write")])
    stream = spark.readStream.schema(schema).parquet(source)
    query = changes.trailing(stream, 300).writeStream.outputMode("append").format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(240):
            query.awaitTermination(0.5)
            if spark.table("bursts").count() >= 3:
                break
        got = sorted((r.path, r.op, r.events, r.end.timestamp() - r.start.timestamp()) for r in spark.table("bursts").collect())
    finally:
        query.stop()
    assert [(p, o, n, round(s, 3)) for p, o, n, s in got] == [("/a", "write", 1, 0.3), ("/a", "write", 2, 0.4), ("/b", "create", 1, 0.3)]
