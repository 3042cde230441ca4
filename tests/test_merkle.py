"""Merkle hashes kept up to date against a rebuild."""

from pyspark.sql import functions as F

from arbora.operators import hierarchy
from arbora.sources import tables


def nodes_of(spark, files):
    return tables.nodes(spark.createDataFrame([(p, t, len(t or "")) for p, t in files.items()], "path string, text string, size long"))


def rows(df):
    return {r.path: r.hash for r in df.collect()}


def test_an_update_equals_a_rebuild_and_reads_touched_directories(spark, tmp_path, monkeypatch):
    files = {f"/a{i % 7}/b{i % 3}/f{i}.txt": f"text {i}" for i in range(90)} | {"/top.md": "t", "/a0/only/x": "y", "/q/w/e/r": "deep"}
    stored = hierarchy.store_merkle(nodes_of(spark, files), str(tmp_path / "one"))
    assert rows(stored) == rows(hierarchy.merkle(nodes_of(spark, files)))
    up = {"/a1/b1/f1.txt": "new", "/a1/b1/added": "z", "/n/e/w/dir/file": "f", "/top.md": None}
    gone = ["/a2/b2/f2.txt", "/a3/b0/nothing", "/q/w/e/r"]
    after = {k: v for k, v in files.items() if k not in gone} | up
    frames = spark.createDataFrame(list(up.items()), "path string, text string"), spark.createDataFrame([(x,) for x in gone], "path string")
    changes = hierarchy.merkle_changes(stored, *frames)
    empty = spark.createDataFrame([("/q/w/e", True)], "path string, is_dir boolean")
    emptied = nodes_of(spark, after).unionByName(empty.select("path", F.lit("/q/w").alias("parent_path"), F.lit("e").alias("name"), "is_dir", F.lit(3).alias("depth"), F.lit("").alias("ext"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("string").alias("text")))
    more = [("/q/w", "/q", "w", 2), ("/q", "/", "q", 1)]
    emptied = emptied.unionByName(spark.createDataFrame([(p, up_, n, True, d, "", 0, None) for p, up_, n, d in more], emptied.schema))
    wanted = rows(hierarchy.merkle(emptied))
    assert rows(hierarchy.merkle_after(stored, changes)) == wanted
    touched = {"/", "/a1", "/a1/b1", "/a2", "/a2/b2", "/a3", "/a3/b0", "/n", "/n/e", "/n/e/w", "/n/e/w/dir", "/q", "/q/w", "/q/w/e"}
    assert {r.path for r in changes.collect()} == touched | set(up) | set(gone)
    monkeypatch.setattr(hierarchy, "TOUCHED", 2)
    assert rows(hierarchy.merkle_after(stored, hierarchy.merkle_changes(stored, *frames))) == wanted
    none = [x.limit(0) for x in frames]
    assert rows(hierarchy.merkle_after(stored, hierarchy.merkle_changes(stored, *none))) == rows(stored)
