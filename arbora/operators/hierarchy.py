"""Trees as flat tables: listings, roll-ups, hashes and rendering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions import paths
from arbora.sources import shared


def children(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where(F.col("parent_path") == path)


def find(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where(F.col("path") == path)


def visit(nodes: DataFrame) -> DataFrame:
    """Depth-first order is the order of the segments."""
    return nodes.orderBy(paths.segments(F.col("path")))


def numbered(rows: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """Rows with their place (from 1) in a global order, without a window over all of them.

    Rows are dealt by range and sorted within partitions, so the order of partitions is the order of rows; a place is a
    row's number in its partition and the rows of the partitions before, of which there is one sum each. The sorted rows
    are written once, as a second range could cut elsewhere. Equal rows get some order.
    """
    made = rows.withColumns({f"_o{i}": x for i, x in enumerate(order)})
    keys = [f"_o{i}" for i in range(len(order))]
    ranged = made.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys).withColumn("_at", F.monotonically_increasing_id())
    stored = shared.written(ranged, f"{shared.fresh(rows.sparkSession, 'numbered')}/rows")
    part = F.shiftright("_at", 33)
    sums = stored.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))  # a row a partition
    before = sums.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"))
    joined = stored.withColumn("_part", part).join(F.broadcast(before), "_part")
    return joined.select(*rows.columns, (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).alias(name))


def depth_first(nodes: DataFrame) -> DataFrame:
    """Nodes with their place in a depth-first walk that takes children by name."""
    return numbered(nodes, paths.segments(F.col("path")))


def statistics(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count(F.lit(1)).alias("total_nodes"), F.count_if("is_dir").alias("directories"), F.count_if(~F.col("is_dir")).alias("files"), F.sum("size").alias("total_size"), F.max("depth").alias("max_depth"))


def subtree_statistics(nodes: DataFrame) -> DataFrame:
    """For each directory the nodes in it, itself included, and their bytes. Sums are combined before the shuffle."""
    up = F.when(F.col("path") == "/", F.array(F.lit("/"))).when(F.col("is_dir"), F.concat(paths.ancestors(F.col("path")), F.array("path"))).otherwise(paths.ancestors(F.col("path")))
    rows = nodes.select(F.explode(up).alias("dir"), "is_dir", "size")
    return rows.groupBy("dir").agg(F.count(F.lit(1)).alias("nodes"), F.count_if("is_dir").alias("directories"), F.count_if(~F.col("is_dir")).alias("files"), F.sum("size").alias("bytes"))


def file_hashes(nodes: DataFrame) -> DataFrame:
    return nodes.where(~F.col("is_dir")).select("path", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


def merkle(nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """path, hash: of a file its SHA-256, of a directory that of its children's hashes in the order of their names.

    Files are hashed once, in one pass, and the hashes are written to the shared folder; one pass a level over them, from the
    deepest up, folds them.
    """
    own = F.when(~F.col("is_dir"), F.sha2(F.coalesce("text", F.lit("")), 256))
    known = nodes.select("path", "parent_path", "name", "depth", "is_dir", own.alias("hash"))
    known = shared.written(known, f"{shared.fresh(nodes.sparkSession, 'merkle')}/hashes")
    deepest = max_depth if max_depth is not None else known.agg(F.max("depth")).first()[0] or 0
    files, dirs = known.where(~F.col("is_dir")).drop("is_dir"), known.where("is_dir").drop("is_dir", "hash")
    done, level = files, files.where(F.col("depth") == deepest)
    for d in range(deepest - 1, -1, -1):
        folded = dirs.where(F.col("depth") == d).join(_of_children(level), "path", "left").select("path", "parent_path", "name", "depth", F.coalesce("_hash", F.sha2(F.concat(F.lit("empty_dir:"), "name"), 256)).alias("hash"))
        done = done.unionByName(folded)
        level = folded.unionByName(files.where(F.col("depth") == d))
    return done.select("path", "hash")


def _of_children(rows: DataFrame) -> DataFrame:
    """path, _hash of directories from their children's (parent_path, name, hash)."""
    in_order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "hash"))), lambda x: x["hash"]), "")
    return rows.groupBy(F.col("parent_path").alias("path")).agg(F.sha2(in_order, 256).alias("_hash"))


#: Touched directories whose paths become a condition on the stored rows; more are joined.
TOUCHED = 1_000


def store_merkle(nodes: DataFrame, path: str) -> DataFrame:
    """The hashes of all nodes, written in the order of their directories, so that reads of few directories skip the rest."""
    rows = nodes.select("path", "is_dir").join(merkle(nodes), "path")
    own = F.col("path")
    full = rows.select("path", paths.parent(own).alias("parent_path"), paths.name(own).alias("name"), paths.depth(own).alias("depth"), "is_dir", "hash")
    full.repartitionByRange("parent_path", "name").sortWithinPartitions("parent_path", "name").write.option("parquet.block.size", 8 << 20).parquet(path)
    return nodes.sparkSession.read.schema(full.schema).parquet(path)


def merkle_changes(stored: DataFrame, upserts: DataFrame, deletes: DataFrame) -> DataFrame:
    """What changes in stored hashes: rows as in store_merkle() with their new hash, which is null for files that are gone.

    upserts: files (path, text), new or changed; deletes: files (path); a path in both stays. Only the directories above these are
    read, and only their own entries: each level is folded from the entries of touched directories, with stored hashes for all that
    didn't change. New directories come into being with their files; a directory stays when its last file goes. Deleting what
    isn't there does nothing to hashes. Of repeated paths the greatest text counts.
    """
    spark, own = stored.sparkSession, F.col("path")
    folder = shared.fresh(spark, "merkle")
    new = upserts.groupBy("path").agg(F.max("text").alias("text")).select("path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    gone = deletes.select("path").distinct().join(new.select("path"), "path", "left_anti").withColumn("hash", F.lit(None).cast("string"))
    files = new.unionByName(gone).select("path", paths.parent(own).alias("parent_path"), paths.name(own).alias("name"), paths.depth(own).alias("depth"), F.lit(False).alias("is_dir"), "hash")
    files = shared.written(files, f"{folder}/files")
    dirs = files.select(F.explode(paths.ancestors(own)).alias("path")).distinct()
    dirs = shared.written(dirs.select("path", paths.parent(own).alias("parent_path"), paths.name(own).alias("name"), paths.depth(own).alias("depth"), F.lit(True).alias("is_dir")), f"{folder}/dirs")
    few = [r[0] for r in dirs.select("path").limit(TOUCHED + 1).collect()]
    near = stored.where(F.col("parent_path").isin(few)) if len(few) <= TOUCHED else stored.join(dirs.select(F.col("path").alias("parent_path")), "parent_path", "left_semi")
    same = shared.written(near.select(files.columns).join(files.select("path"), "path", "left_anti").join(dirs.select("path"), "path", "left_anti"), f"{folder}/same")
    entries, done, below = same.unionByName(files.where("hash IS NOT NULL")), files, None
    for d in range(dirs.agg(F.max("depth")).first()[0] or 0, -1, -1):
        inside = entries.where(F.col("depth") == d + 1)
        inside = inside if below is None else inside.unionByName(below)
        here = dirs.where(F.col("depth") == d).join(_of_children(inside), "path", "left")
        below = shared.written(here.select("path", "parent_path", "name", "depth", "is_dir", F.coalesce("_hash", F.sha2(F.concat(F.lit("empty_dir:"), "name"), 256)).alias("hash")), f"{folder}/level-{d}")
        done = done.unionByName(below)
    return done


def merkle_after(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """The stored rows with the changes of merkle_changes()."""
    return stored.join(changes.select("path"), "path", "left_anti").select(changes.columns).unionByName(changes.where("hash IS NOT NULL"))


def shown(nodes: DataFrame, files: bool = True, hidden: bool = False, max_depth: int = -1) -> DataFrame:
    """What a tree shows: a hidden directory goes with all below it; nodes at max_depth and deeper go, if that is positive."""
    out = nodes if files else nodes.where("is_dir")
    out = out if hidden else out.where(~paths.hidden_path(F.col("path")))
    return out.where(F.col("depth") < max_depth) if max_depth > 0 else out


def tree_lines(nodes: DataFrame) -> DataFrame:
    """path, line: a node's line in a drawn tree; lines in the order of the paths' segments draw it.

    The last of its siblings is found by the largest name, so that no directory's children meet in one task. A node looks
    up itself and the directories above it in one join.
    """
    below = nodes.where("path <> '/'").select("path", "parent_path", "name", "is_dir", "size")
    last = below.groupBy(F.col("parent_path").alias("_in")).agg(F.max("name").alias("_last"))
    label = F.when(F.col("is_dir"), F.concat("name", F.lit("/"))).otherwise(F.concat("name", F.when(F.col("size") > 0, F.concat(F.lit(" ("), "size", F.lit(" bytes)"))).otherwise("")))
    s = paths.segments(F.col("path"))
    way = below.select("path", label.alias("_label"), F.size(s).alias("_depth"), s.alias("_s"), F.posexplode(paths.ancestors(F.col("path"))).alias("_at", "_in"))
    ends = way.join(last, "_in").select("path", "_label", "_depth", "_at", (F.element_at("_s", F.col("_at") + 1) == F.col("_last")).alias("_end"))
    mark = F.when(F.col("_at") == F.col("_depth") - 1, F.when(F.col("_end"), "└── ").otherwise("├── ")).otherwise(F.when(F.col("_end"), "    ").otherwise("│   "))
    drawn = ends.select("path", "_label", "_at", mark.alias("_mark")).groupBy("path").agg(F.first("_label").alias("_label"), F.array_sort(F.collect_list(F.struct("_at", "_mark"))).alias("_marks"))
    return nodes.where("path = '/'").select("path", F.lit(".").alias("line")).unionByName(drawn.select("path", F.concat(F.array_join(F.col("_marks._mark"), ""), "_label").alias("line")))


def directories_first(nodes: DataFrame) -> DataFrame:
    """Siblings' order in a listing: directories, then files, by name."""
    return nodes.orderBy(F.desc("is_dir"), "name")


def tree_from_paths(paths_: DataFrame) -> DataFrame:
    """Nodes of a list of file paths (path, size) and of the directories above them."""
    files = paths_.select(paths.normal(F.col("path")).alias("path"), "size").withColumn("is_dir", F.lit(False))
    dirs = files.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct().select("path", F.lit(0).cast("long").alias("size"), F.lit(True).alias("is_dir"))
    every = files.unionByName(dirs)
    return every.select("path", paths.parent(F.col("path")).alias("parent_path"), paths.name(F.col("path")).alias("name"), "is_dir", paths.depth(F.col("path")).alias("depth"), F.when(~F.col("is_dir"), paths.ext(F.col("path"))).otherwise("").alias("ext"), "size")


def process(nodes: DataFrame, f: Callable[[Column], Column], *columns: str) -> DataFrame:
    """path, value, error of an expression over each node; an error is a value of its row."""
    return nodes.select("path", *columns, f(F.col("path")).alias("value"))


def process_python(nodes: DataFrame, f: Callable[[dict], str]) -> DataFrame:
    """path, value, error of a Python function over each node; one failing row leaves the others alone."""

    def run(frames):
        for frame in frames:
            values, errors = [], []
            for row in frame.to_dict("records"):
                try:
                    values.append(str(f(row)))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  errors of the caller's function are data
                    values.append(None)
                    errors.append(str(e))
            frame = frame[["path"]].copy()
            frame["value"], frame["error"] = values, errors
            yield frame

    return nodes.mapInPandas(run, "path string, value string, error string")


def by_level(nodes: DataFrame, f: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """A function of each level's nodes, from the root down. The nodes are written once, a folder a level, so each pass reads its own level."""
    path = f"{shared.fresh(nodes.sparkSession, 'levels')}/nodes"
    nodes.write.partitionBy("depth").parquet(path)
    held = nodes.sparkSession.read.schema(nodes.schema).parquet(path).select(nodes.columns)
    deepest = held.agg(F.max("depth")).first()[0]
    return [] if deepest is None else [f(held.where(F.col("depth") == d)) for d in range(deepest + 1)]
