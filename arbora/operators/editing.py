"""Nodes made, read, written and deleted: a tree is a table, a change gives the table after it.

Each check is a lookup of one path, pushed to the source; the change itself is a union or an anti-join, so many can be
planned before anything runs. For bulk changes use documents.upserted() and search on the tables themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.functions import paths


class NodeError(ValueError):
    """A change or a read that a tree doesn't allow."""


def _clean(nodes: DataFrame, path: str) -> str:
    return nodes.sparkSession.range(1).select(paths.normal(F.lit(path))).first()[0]


def _row(nodes: DataFrame, path: str):
    return nodes.where(F.col("path") == path).select("path", "is_dir").first()


def _made(nodes: DataFrame, path: str, is_dir: bool, text: str | None) -> DataFrame:
    p, size = F.lit(path), len((text or "").encode())
    row = nodes.sparkSession.range(1).select(p.alias("path"), paths.parent(p).alias("parent_path"), paths.name(p).alias("name"), F.lit(is_dir).alias("is_dir"), paths.depth(p).alias("depth"), F.lit("").alias("ext") if is_dir else paths.ext(p).alias("ext"), F.lit(size).cast("long").alias("size"), F.lit(text).cast("string").alias("text"))
    return nodes.unionByName(row.select(*nodes.columns))


def create(nodes: DataFrame, path: str, text: str | None = None, is_dir: bool = False) -> DataFrame:
    """The nodes with a new one. Its parent must be a directory, and nothing may have its path."""
    path = _clean(nodes, path)
    if _row(nodes, path):
        raise NodeError(f"node already exists: {path}")
    top = path.rsplit("/", 1)[0] or "/"
    parent = _row(nodes, top)
    if parent is None:
        raise NodeError(f"node not found: {top}")
    if not parent["is_dir"]:
        raise NodeError("cannot add child to a file node")
    return _made(nodes, path, is_dir, None if is_dir else text or "")


def read(nodes: DataFrame, path: str) -> str:
    path = _clean(nodes, path)
    row = nodes.where(F.col("path") == path).select("is_dir", "text").first()
    if row is None:
        raise NodeError(f"node not found: {path}")
    if row["is_dir"]:
        raise NodeError("cannot read directory")
    return row["text"] or ""


def write(nodes: DataFrame, path: str, text: str) -> DataFrame:
    """The nodes with another text for a file; a file that isn't there is made."""
    path = _clean(nodes, path)
    row = _row(nodes, path)
    if row is None:
        return create(nodes, path, text)
    if row["is_dir"]:
        raise NodeError("cannot write to directory")
    hit = F.col("path") == path
    return nodes.withColumns({"text": F.when(hit, F.lit(text)).otherwise(F.col("text")), "size": F.when(hit, F.lit(len(text.encode())).cast("long")).otherwise(F.col("size"))})


def delete(nodes: DataFrame, path: str) -> DataFrame:
    """The nodes without one and all below it."""
    path = _clean(nodes, path)
    if path == "/":
        raise NodeError("cannot delete root node")
    if _row(nodes, path) is None:
        raise NodeError(f"node not found: {path}")
    return nodes.where(~paths.under(F.col("path"), path))


def save(nodes: DataFrame, target: str) -> None:
    """Every file below target, a folder that all executors see."""
    from arbora.operators import packing

    packing.write_files(nodes.where(~F.col("is_dir")).select("path", "text"), target)
