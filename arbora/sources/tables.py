"""Views over the driver tables in the engine's data model: files, nodes, blame lines and the like."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions import paths


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text, size: documents as files below their source and language."""
    d = table(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*map(F.lit, ("md", "txt", "go", "py", "json"))), (F.col("doc_id") % 5 + 1).cast("int"))
    dot = F.when(F.col("doc_id") % 17 == 0, ".").otherwise("")
    return d.select(F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), dot, F.lit("doc"), "doc_id", F.lit("."), kind).alias("path"), "text", F.octet_length("text").cast("long").alias("size"))


def nodes(found: DataFrame) -> DataFrame:
    """path, parent_path, name, is_dir, depth, ext, size, text: the files and every directory above them."""
    dirs = found.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
    rows = found.select("path", F.lit(False).alias("is_dir"), "size", "text").unionByName(dirs.select("path", F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("string").alias("text")))
    p = F.col("path")
    return rows.select("path", paths.parent(p).alias("parent_path"), paths.name(p).alias("name"), "is_dir", paths.depth(p).alias("depth"), F.when(F.col("is_dir"), "").otherwise(paths.ext(p)).alias("ext"), "size", "text")


def blame_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """author, email, when: a row a line of code."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("author"), F.concat(F.lit("User"), "user_id", F.lit("@Example.com")).alias("email"), F.col("ts").alias("when"))


def file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, ts, op: writes and creations of Markdown files."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "view", "write").when(F.col("event_type") == "signup", "create")
    return e.select(F.concat(F.lit("/user"), "user_id", F.lit(".md")).alias("path"), "ts", op.alias("op")).where("op IS NOT NULL")


def states(found: DataFrame, doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """A stored snapshot and a current one of all documents: some have moved, some are newer, some have another hash."""
    i, h = F.col(doc_id), F.md5("text")
    t, path = F.timestamp_seconds(F.lit(1_700_000_000) + i), F.concat(F.lit("/doc"), i)
    old = found.select(path.alias("path"), t.alias("mod_time"), F.when(i % 7 == 0, F.md5(F.concat(F.lit("x"), "text"))).otherwise(h).alias("hash"))
    new = found.select(F.when(i % 11 == 0, F.concat(F.lit("/moved"), i)).otherwise(path).alias("path"), F.when(i % 3 == 0, t + F.expr("INTERVAL 1 HOUR")).otherwise(t).alias("mod_time"), h.alias("hash"))
    return old, new
